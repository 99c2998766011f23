"""Registered text, document, sink, sampling and job queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geo
from ..operators import sampling
from ..operators import validation as val
from ..sources import models, sinks
from . import jobs
from .matching import mesh
from .registry import query
from .sources import scratch
from .telemetry import frame_positions, r
from .views import source, view, with_views


@query("sparse_model_images", "S9 P7", with_views("poses", """
    SELECT frame_id AS image_id, round(qw, 9) AS qw, round(qz, 9) AS qz, round(tx, 6) AS tx, round(ty, 6) AS ty, seq_id + 1 AS camera_id,
        'clip ' || CAST(seq_id AS STRING) || '/frame ' || CAST(frame_id AS STRING) || '.jpg' AS image_name FROM poses"""))
def sparse_model_images(spark, sf_dir):
    path = scratch(spark, "images")
    s, k = F.col("seq_id").cast("string"), F.col("frame_id").cast("string")
    numbers = [F.col(c).cast("string") for c in ("qw", "qx", "qy", "qz", "tx", "ty", "tz")]
    pose = F.concat_ws(" ", k, *numbers, (F.col("seq_id") + 1).cast("string"), F.concat(F.lit("clip "), s, F.lit("/frame "), k, F.lit(".jpg")))
    marks = F.concat_ws(" ", *[F.lit(v) for v in ("12.5", "8.25", "-1", "3.0", "4.0", "17", "9.0", "1.5", "2", "7.5", "6.0", "-1")])
    lines = view(spark, sf_dir, "poses").select(F.explode(F.array(F.lit("# IMAGE_ID, QW, QX, QY, QZ, TX, TY, TZ, CAMERA_ID, NAME"), pose, marks)).alias("value"))
    lines.write.text(path)
    out = models.parse_images(spark.read.text(path)).select("image_id", "qw", "qz", "tx", "ty", "camera_id", "image_name")
    return r(r(out, "qw qz", 9), "tx ty")


@query("sparse_model_points", "S9", """
    SELECT o_orderkey AS point_id, round(o_custkey / 10.0e0, 6) AS x, o_orderkey % 256 AS r, round(o_orderkey % 9 / 4.0e0, 6) AS error,
        o_orderkey % 4 AS track_length, CASE WHEN o_orderkey % 4 > 0 THEN o_custkey END AS first_image FROM orders""")
def sparse_model_points(spark, sf_dir):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    track = F.when(k % 4 > 0, F.concat_ws(" ", F.transform(F.sequence(F.lit(0), (k % 4 - 1).cast("int")), lambda i: F.concat_ws(" ", (c + i).cast("string"), i.cast("string")))))
    line = F.concat_ws(" ", k.cast("string"), (c / 10.0).cast("string"), F.lit("1.5"), F.lit("-2.0"), (k % 256).cast("string"), F.lit("7"), F.lit("9"), (k % 9 / 4.0).cast("string"), track)
    out = models.parse_points(source(spark, sf_dir, "orders").select(line.alias("value"))).select(
        "point_id", "x", F.col("r").cast("bigint").alias("r"), "error", F.size("track").cast("bigint").alias("track_length"),
        F.get("track", F.lit(0))["image_id"].cast("bigint").alias("first_image"),
    )
    return r(out, "x error")


@query("sparse_model_cameras", "S9 P13", """
    SELECT c_custkey AS camera_id, 'PINHOLE' AS model, 1920 AS width, round(600 + c_custkey % 90 + 0.5e0, 6) AS focal FROM customer""")
def sparse_model_cameras(spark, sf_dir):
    k = F.col("c_custkey")
    line = F.concat_ws(" ", k.cast("string"), F.lit("PINHOLE 1920 1080"), (600 + k % 90 + 0.5).cast("string"), F.lit("700.0 960 540"))
    out = models.parse_cameras(source(spark, sf_dir, "customer").select(line.alias("value")))
    return r(out.select("camera_id", "model", "width", F.col("params")[0].alias("focal")), "focal")


def _report_texts(spark, sf_dir):
    """Report documents with current or legacy names, trailing commas, and one in 41 cut short."""
    k = F.col("run_id")
    text = F.when(k % 2 == 0, F.to_json(F.struct(
        k.alias("run_id"), F.struct(F.struct(F.col("gps_rmse_m")).alias("deep")).alias("validation"), F.col("runtime_s").alias("total_runtime_seconds"),
        F.struct(F.col("registration_percent")).alias("sparse_metrics"), F.lit("completed").alias("status"),
    ))).otherwise(F.to_json(F.struct(
        k.alias("run_id"), F.col("runtime_s").alias("total_wall_clock_seconds"), F.when(k % 3 == 0, F.struct(F.col("registration_percent"))).alias("sparse_metrics"),
    )))
    loose = F.when(k % 5 == 0, F.regexp_replace(text, r"\}$", ", }")).otherwise(text)
    return view(spark, sf_dir, "reports").select(F.when(k % 41 == 0, F.substring(loose, 1, 8)).otherwise(loose).alias("value"))


@query("run_summary", "S11 P24 G32", with_views("reports", """
    SELECT run_id, round(runtime_s, 6) AS runtime_seconds, CASE WHEN run_id % 2 = 0 THEN 'completed' ELSE 'not measured' END AS status,
        CASE WHEN run_id % 2 = 0 OR run_id % 3 = 0 THEN printf('%.1f', registration_percent) ELSE 'not measured' END AS registration FROM reports WHERE run_id % 41 <> 0"""))
def run_summary(spark, sf_dir):
    docs = models.parse_reports(_report_texts(spark, sf_dir))
    regs = models.first_path("double", "$.sparse_metrics.registration_percent")
    out = docs.select(
        models.first_path("bigint", "$.run_id").alias("run_id"),
        models.first_path("double", "$.total_runtime_seconds", "$.total_wall_clock_seconds").alias("runtime_seconds"),
        F.coalesce(models.first_path("string", "$.status"), F.lit("not measured")).alias("status"),
        F.when(regs.isNull(), "not measured").otherwise(F.format_string("%.1f", regs)).alias("registration"),
    )
    return r(out, "runtime_seconds")


@query("report_deep_key", "P24", with_views("reports", """
    SELECT run_id, round(gps_rmse_m, 6) AS gps_rmse_m FROM reports WHERE run_id % 2 = 0 AND gps_rmse_m IS NOT NULL AND run_id % 41 <> 0"""))
def report_deep_key(spark, sf_dir):
    docs = models.parse_reports(_report_texts(spark, sf_dir)).select(models.first_path("bigint", "$.run_id").alias("run_id"), "doc")
    found = models.find_key(docs, "gps_rmse_m", 3, "run_id")
    return r(found.select("run_id", F.col("found").cast("double").alias("gps_rmse_m")), "gps_rmse_m")


_FILES = """
    fl AS (SELECT o_custkey % 10 AS gallery, o_custkey AS scene, CASE o_orderkey % 5 WHEN 0 THEN 'scene.glb' WHEN 1 THEN 'scene.jpg' WHEN 2 THEN 'result.npz'
        WHEN 3 THEN 'depth_' || CAST(o_orderkey AS STRING) || '.PNG' ELSE 'notes.txt' END AS file FROM orders)"""


@query("artifact_inventory", "S12", f"""WITH {_FILES}
    SELECT gallery, scene, count(*) FILTER (lower(file) LIKE '%.png' OR lower(file) LIKE '%.jpg') AS depth_images,
        concat_ws(',', CASE WHEN NOT bool_or(file = 'scene.glb') THEN 'scene.glb' END, CASE WHEN NOT bool_or(file = 'scene.jpg') THEN 'scene.jpg' END,
            CASE WHEN NOT bool_or(file = 'result.npz') THEN 'result.npz' END) AS missing,
        bool_or(file = 'scene.glb') AND bool_or(file = 'scene.jpg') AND bool_or(file = 'result.npz') AS complete FROM fl GROUP BY gallery, scene""")
def artifact_inventory(spark, sf_dir):
    k = F.col("o_orderkey")
    name = (
        F.when(k % 5 == 0, "scene.glb").when(k % 5 == 1, "scene.jpg").when(k % 5 == 2, "result.npz")
        .when(k % 5 == 3, F.concat(F.lit("depth_"), k.cast("string"), F.lit(".PNG"))).otherwise("notes.txt")
    )
    listing = source(spark, sf_dir, "orders").select((F.col("o_custkey") % 10).alias("gallery"), F.col("o_custkey").alias("scene"), name.alias("file"))
    return models.artifact_inventory(listing, "gallery", ["scene.glb", "scene.jpg", "result.npz"])


@query("frame_reference_lines", "S14", with_views("telemetry", """
    SELECT flight_id, sample_id, printf('frame_%d.jpg %.10f %.10f %.3f', sample_id, latitude, longitude, altitude_m) AS line FROM telemetry"""))
def frame_reference_lines(spark, sf_dir):
    path = scratch(spark, "references")
    name = F.concat(F.lit("frame_"), F.col("sample_id").cast("string"), F.lit(".jpg"))
    lines = view(spark, sf_dir, "telemetry").select(
        "flight_id", "sample_id", sinks.reference_line(name, F.col("latitude"), F.col("longitude"), F.col("altitude_m")).alias("line")
    )
    sinks.write_ordered(lines, path, ["flight_id", "sample_id"])
    return spark.read.schema("flight_id bigint, sample_id bigint, line string").csv(path, header=True)


@query("pose_lines", "S14", with_views("poses", """
    SELECT seq_id, frame_id, printf('%.6f %.6f %.6f %.6f', tx, ty, tz, s) AS line FROM poses"""))
def pose_lines(spark, sf_dir):
    return view(spark, sf_dir, "poses").select("seq_id", "frame_id", sinks.pose_line([F.col(c) for c in ("tx", "ty", "tz", "s")]).alias("line"))


def _drawn(spark, sf_dir):
    """Drawn outlines with plain longitudes and latitudes (a local plane keeps the checking text short)."""
    places = view(spark, sf_dir, "corners").select(
        "outline_id", "i", (77.0 + F.col("x") / 108000.0).alias("lon"), (12.0 + F.col("y") / 110000.0).alias("lat"), F.col("z").alias("height")
    )
    k = F.col("outline_id")
    rings = places.groupBy("outline_id").agg(F.array_sort(F.collect_list(F.struct("i", "lon", "lat", "height"))).alias("ring"))
    return rings.select("outline_id", F.when(k % 3 == 0, "point").when(k % 3 == 1, "area").otherwise("distance").alias("kind"),
                        F.concat(F.lit('A & "B" '), k.cast("string")).alias("name"), "ring")


_DRAWN = r"""
    pt AS (SELECT outline_id, i, regexp_replace(printf('%.8f', 77 + x / 108000.0e0), '\.?0+$', '') AS lon, regexp_replace(printf('%.8f', 12 + y / 110000.0e0), '\.?0+$', '') AS lat,
        regexp_replace(printf('%.2f', z), '\.?0+$', '') AS h FROM corners),
    ag AS (SELECT outline_id, string_agg('[' || lon || ',' || lat || ',' || h || ']', ',' ORDER BY i) AS js, string_agg(lon || ',' || lat || ',' || h, ' ' ORDER BY i) AS km,
        arg_min('[' || lon || ',' || lat || ',' || h || ']', i) AS j0, arg_min(lon || ',' || lat || ',' || h, i) AS k0 FROM pt GROUP BY outline_id)"""


@query("measurement_features", "S15", with_views("corners", f"""WITH {_DRAWN}
    SELECT outline_id, '{{"type":"Feature","properties":{{"name":"A & \\"B\\" ' || CAST(outline_id AS STRING) || '","tool":"' ||
        CASE outline_id % 3 WHEN 0 THEN 'point' WHEN 1 THEN 'area' ELSE 'distance' END || '","result":"ok"}},"geometry":' || CASE outline_id % 3
        WHEN 0 THEN '{{"type":"Point","coordinates":' || j0 || '}}' WHEN 1 THEN '{{"type":"Polygon","coordinates":[[' || js || ',' || j0 || ']]}}'
        ELSE '{{"type":"LineString","coordinates":[' || js || ']}}' END || '}}' AS geojson,
        '<Placemark><name>A &amp; &quot;B&quot; ' || CAST(outline_id AS STRING) || '</name>' || CASE outline_id % 3 WHEN 0 THEN '<Point><coordinates>' || k0 || '</coordinates></Point>'
        WHEN 1 THEN '<Polygon><outerBoundaryIs><LinearRing><coordinates>' || km || ' ' || k0 || '</coordinates></LinearRing></outerBoundaryIs></Polygon>'
        ELSE '<LineString><tessellate>1</tessellate><coordinates>' || km || '</coordinates></LineString>' END || '</Placemark>' AS kml,
        '"' || CAST(outline_id AS STRING) || '","A & ""B"" ' || CAST(outline_id AS STRING) || '"' AS csv_row FROM ag"""))
def measurement_features(spark, sf_dir):
    return _drawn(spark, sf_dir).select(
        "outline_id", sinks.geojson_feature(F.col("kind"), F.col("name"), F.lit("ok"), F.col("ring")).alias("geojson"),
        sinks.kml_placemark(F.col("kind"), F.col("name"), F.col("ring")).alias("kml"), sinks.quoted_row([F.col("outline_id"), F.col("name")]).alias("csv_row"),
    )


@query("benchmark_markdown", "S16", with_views("runs", """
    SELECT run_id, '| run-' || CAST(run_id AS STRING) || ' | ' || mode || ' | ' || printf('%.4f', runtime_s) || ' | ' || coalesce(printf('%.3f', checkpoint_rmse_m), 'None') || ' |' AS line FROM runs"""))
def benchmark_markdown(spark, sf_dir):
    rmse = F.when(F.col("checkpoint_rmse_m").isNotNull(), F.format_string("%.3f", "checkpoint_rmse_m"))
    cells = [F.concat(F.lit("run-"), F.col("run_id").cast("string")), F.col("mode"), F.format_string("%.4f", "runtime_s"), rmse]
    return view(spark, sf_dir, "runs").select("run_id", sinks.markdown_row(cells).alias("line"))


@query("merged_clouds", "S17", with_views("points", """
    SELECT scan_id AS chunk, count(*) AS points, round(min(x), 6) AS x_min, round(max(z), 6) AS z_max FROM points GROUP BY scan_id"""))
def merged_clouds(spark, sf_dir):
    path = scratch(spark, "clouds")
    view(spark, sf_dir, "points").withColumnRenamed("scan_id", "chunk").write.partitionBy("chunk").parquet(path)
    out = spark.read.parquet(path).groupBy(F.col("chunk").cast("bigint").alias("chunk")).agg(
        F.count(F.lit(1)).alias("points"), F.min("x").alias("x_min"), F.max("z").alias("z_max")
    )
    return r(out, "x_min z_max")


@query("manifest_fingerprints", "G34 P23", with_views("frames", r"""
    SELECT flight_id, count(*) AS entries, sha256('[' || string_agg('{"image_name":"frame_' || CAST(frame_id AS STRING) || '.jpg","source_frame":"' || CAST(frame_id AS STRING)
        || '","time_s":"' || regexp_replace(printf('%.6f', time_s), '\.?0+$', '') || '"}', ',' ORDER BY time_s, frame_id) || ']') AS sha256, 'stream' AS method FROM frames GROUP BY flight_id"""))
def manifest_fingerprints(spark, sf_dir):
    frames = view(spark, sf_dir, "frames")
    name = F.concat(F.lit("frame_"), F.col("frame_id").cast("string"), F.lit(".jpg"))
    entry = sinks.manifest_entry(name, F.col("frame_id"), F.col("time_s"))
    return sinks.fingerprint(frames, "flight_id", ["time_s", "frame_id"], entry, ",", "[", "]")


@query("telemetry_fingerprints", "G34", with_views("telemetry", r"""
    SELECT flight_id, count(*) AS entries, sha256(string_agg(printf('%.9f,%.12f,%.12f,%.6f', time_s, latitude, longitude, altitude_m) || chr(10), '' ORDER BY time_s, sample_id)) AS sha256,
        'stream' AS method FROM telemetry GROUP BY flight_id"""))
def telemetry_fingerprints(spark, sf_dir):
    return sinks.fingerprint(view(spark, sf_dir, "telemetry"), "flight_id", ["time_s", "sample_id"], sinks.telemetry_entry())


@query("exact_point_sample", "G26", with_views("points", """
    WITH u AS (SELECT DISTINCT scan_id, x, y, z FROM points), d AS (SELECT scan_id, CAST(floor(x * 20 + 0.5e0) AS BIGINT) AS a, CAST(floor(y * 20 + 0.5e0) AS BIGINT) AS b, CAST(floor(z * 10 + 0.5e0) AS BIGINT) AS c FROM u)
    SELECT scan_id, a, b, c FROM d QUALIFY row_number() OVER (PARTITION BY scan_id ORDER BY md5('26158-' || CAST(scan_id AS STRING) || '-' || CAST(a AS STRING) || '-' || CAST(b AS STRING) || '-' || CAST(c AS STRING)), a, b, c) <= 500"""))
def exact_point_sample(spark, sf_dir):
    u = view(spark, sf_dir, "points").select(
        "scan_id", F.floor(F.col("x") * 20 + 0.5).alias("a"), F.floor(F.col("y") * 20 + 0.5).alias("b"), F.floor(F.col("z") * 10 + 0.5).alias("c")
    ).distinct()
    return sampling.exact_sample(u, ["scan_id"], ["a", "b", "c"], 500, "26158")


@query("surface_sample", "G26")
def surface_sample(spark, sf_dir):
    faces, vertices = mesh(spark, sf_dir)
    for corner in ("a", "b", "c"):
        v = vertices.select("mesh_id", F.col("vertex_id").alias(corner), F.struct("x", "y", "z").alias(f"_{corner}"))
        faces = faces.join(v, ["mesh_id", corner])
    return r(sampling.surface_sample(faces, "mesh_id", 200, 26158), "x y z")


jobs.dataset(
    "checkpoint_runs",
    lambda spark, sf_dir: view(spark, sf_dir, "checkpoints"),
    accuracy=lambda points: val.checkpoint_report(points, "run_id").select("run_id", "checks", "rmse_3d_m"),
)


@query("dataset_job", "X1", with_views("checkpoints", """
    SELECT run_id, count(*) AS checks, round(sqrt(avg(pow(reconstructed_x_m - known_x_m, 2) + pow(reconstructed_y_m - known_y_m, 2) + pow(reconstructed_z_m - known_z_m, 2))), 6) AS rmse_3d_m
    FROM checkpoints WHERE reconstructed_x_m IS NOT NULL GROUP BY run_id"""))
def dataset_job(spark, sf_dir):
    return r(jobs.evaluate(spark, sf_dir, "checkpoint_runs", "accuracy"), "rmse_3d_m")


@query("scene_parallel_metrics", "X4", with_views("pixels", """
    WITH g AS (SELECT seq_id, frame_id AS scene, avg(depth) AS d, count(*) AS n FROM pixels GROUP BY seq_id, frame_id)
    SELECT seq_id, scene, metric, round(v, 6) AS value, CAST(NULL AS STRING) AS error FROM g, LATERAL (VALUES ('depth_mean', d), ('pixels', CAST(n AS DOUBLE))) m(metric, v) WHERE scene % 9 <> 0
    UNION ALL SELECT seq_id, scene, NULL, NULL, 'ValueError: scene has no poses' FROM g WHERE scene % 9 = 0"""))
def scene_parallel_metrics(spark, sf_dir):
    rows = view(spark, sf_dir, "pixels").select("seq_id", F.col("frame_id").alias("scene"), "depth")
    metrics = {"depth_mean": F.avg("depth"), "pixels": F.count(F.lit(1))}
    errors = {"ValueError: scene has no poses": F.max("scene") % 9 == 0}
    return r(jobs.per_scene(rows, ["seq_id", "scene"], metrics, errors), "value")


@query("enu_grid_references", "P6 P5")
def enu_grid_references(spark, sf_dir):
    e, n = geo.utm(F.col("latitude"), F.col("longitude"))
    at = frame_positions(spark, sf_dir).select("flight_id", "frame_id", "latitude", "longitude", e.alias("e"), n.alias("n"))
    return at.select("flight_id", "frame_id", geo.mgrs(F.col("latitude"), F.col("longitude"), F.col("e"), F.col("n")).alias("mgrs"))
