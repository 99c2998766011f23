"""Sparse-model text, run-report documents and artifact listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def _fields(lines: DataFrame, column: str) -> DataFrame:
    kept = lines.filter((F.trim(column) != "") & ~F.trim(column).startswith("#"))
    return kept.withColumn("_f", F.split(F.trim(column), r"\s+"))


def parse_images(lines: DataFrame, column: str = "value", *keep: str) -> DataFrame:
    """Pose rows of an images table; the 2-D line under each pose fails the field types."""
    f = F.col("_f")
    pose = (F.size(f) >= 10) & F.get(f, F.lit(0)).try_cast("int").isNotNull() & F.get(f, F.lit(8)).try_cast("int").isNotNull()
    names = ("qw", "qx", "qy", "qz", "tx", "ty", "tz")
    return _fields(lines, column).filter(pose).select(
        *keep, f[0].cast("bigint").alias("image_id"), *[f[i + 1].cast("double").alias(n) for i, n in enumerate(names)],
        f[8].cast("bigint").alias("camera_id"), F.array_join(F.slice(f, 10, F.size(f)), " ").alias("image_name"),
    )


def parse_cameras(lines: DataFrame, column: str = "value", *keep: str) -> DataFrame:
    f = F.col("_f")
    return _fields(lines, column).filter(F.size(f) >= 5).select(
        *keep, f[0].cast("bigint").alias("camera_id"), f[1].alias("model"), f[2].cast("int").alias("width"), f[3].cast("int").alias("height"),
        F.transform(F.slice(f, 5, F.size(f)), lambda p: p.cast("double")).alias("params"),
    )


def parse_points(lines: DataFrame, column: str = "value", *keep: str) -> DataFrame:
    """Points with colour, error and their track as (image, 2-D index) pairs."""
    f = F.col("_f")
    length = ((F.size(f) - 8) / 2).cast("int")
    track = F.transform(F.sequence(F.lit(0), length - 1), lambda i: F.struct(
        F.get(f, 8 + 2 * i).cast("int").alias("image_id"), F.get(f, 9 + 2 * i).cast("int").alias("point2d_idx")
    ))
    empty = F.array().cast("array<struct<image_id:int,point2d_idx:int>>")
    return _fields(lines, column).filter(F.size(f) >= 8).select(
        *keep, f[0].cast("bigint").alias("point_id"), *[f[i + 1].cast("double").alias(n) for i, n in enumerate("xyz")],
        *[f[i + 4].cast("int").alias(n) for i, n in enumerate("rgb")], f[7].cast("double").alias("error"),
        F.when(length > 0, track).otherwise(empty).alias("track"),
    )


def parse_reports(texts: DataFrame, column: str = "value") -> DataFrame:
    """Documents as VARIANT ``doc``; trailing commas are tolerated, unreadable ones dropped."""
    clean = F.regexp_replace(column, r",\s*([\]}])", "$1")
    return texts.withColumn("doc", F.try_parse_json(clean)).filter("doc is not null")


def read_reports(spark: SparkSession, path: str, name: str = "run_report.json") -> DataFrame:
    """All report files below a folder, each with its path."""
    files = spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", name).text(path)
    return parse_reports(files.select("value", F.col("_metadata.file_path").alias("report_path")))


def first_path(kind: str, *paths: str) -> Column:
    """First non-null value among alternative paths of ``doc``; values of another type are missing."""
    return F.coalesce(*[F.try_variant_get("doc", p, kind) for p in paths])


def find_key(docs: DataFrame, key: str, depth: int, *keep: str) -> DataFrame:
    """First value of ``key`` anywhere down to ``depth`` levels, shallow levels first."""
    docs.createOrReplaceTempView("_reports")
    levels = []
    names = ", ".join(f"t.{k}" for k in keep)
    for level in range(1, depth + 1):
        joins = "".join(
            f", LATERAL variant_explode({'t.doc' if i == 1 else f'v{i - 1}.value'}) AS v{i}" for i in range(1, level + 1)
        )
        # a variant is neither comparable nor sortable, so its JSON text is carried
        levels.append(f"SELECT {names}, {level} AS _level, v{level}.pos AS _pos, to_json(v{level}.value) AS found FROM _reports t{joins} WHERE v{level}.key = '{key}'")
    found = docs.sparkSession.sql(" UNION ALL ".join(levels))
    return found.groupBy(*keep).agg(F.min_by("found", F.struct("_level", "_pos")).alias("found"))


def list_artifacts(spark: SparkSession, path: str) -> DataFrame:
    """Scene folder, file name and size of every file; contents are never read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length")
    parts = F.split("path", "/")
    return files.select(F.element_at(parts, -2).alias("scene"), F.element_at(parts, -1).alias("file"), F.col("length").alias("size"))


def artifact_inventory(listing: DataFrame, group: str, required: list[str]) -> DataFrame:
    """Per scene: which required files exist, and whether all do."""
    found = listing.groupBy(group, "scene").agg(
        *[F.max(F.when(F.col("file") == name, F.lit(1)).otherwise(0)).alias(f"_r{i}") for i, name in enumerate(required)],
        F.count_if(F.col("file").rlike(r"(?i)\.(png|jpg|jpeg)$")).alias("depth_images"),
    )
    present = sum((F.col(f"_r{i}") for i in range(len(required))), F.lit(0))
    missing = F.array_join(F.array_compact(F.array(*[F.when(F.col(f"_r{i}") == 0, F.lit(n)) for i, n in enumerate(required)])), ",")
    return found.select(group, "scene", "depth_images", missing.alias("missing"), (present == len(required)).alias("complete"))
