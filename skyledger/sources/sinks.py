"""Text forms of result tables and identity fingerprints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..scale import ordered, rank

BLOCK_ENTRIES = 100_000


def fixed_decimals(v: Column, digits: int) -> Column:
    """``printf`` of a double: its binary value is rounded, an exact half to the even digit; null stays null.

    ``format_string`` alone rounds the shortest decimal text of a double half up, so that 0.845, which is
    a little less than that, would become 0.85. ``digits`` is at most 10: then the product with the power of
    ten and the product's rounding error are both exact. A negative zero keeps its sign, as any number does
    that rounds to zero from below.
    """
    if digits > 10:
        raise ValueError("at most 10 decimals")
    scale = F.lit(float(10**digits))
    size = F.abs(v)
    product = size * scale
    wide = size * 134217729.0  # 2^27 + 1 splits a double into two halves
    high = wide - (wide - size)
    error = (high * scale - product) + (size - high) * scale
    whole = F.floor(product).cast("double")
    beyond = (product - whole - 0.5) + error
    up = (beyond > 0) | ((beyond == 0) & (whole % 2 == 1))
    rounded = F.when(up, whole + 1).otherwise(whole) / scale
    near = F.signum(v) * rounded  # no comparison tells a negative zero, its signum is one
    # From 2^52 on a product has no half, and a text of more than 15 digits is no double's own.
    text = F.format_string(f"%.{digits}f", F.when(product < 1e15, near).otherwise(v))
    text = F.when(F.isnan(v), "nan").when(size == float("inf"), F.when(v < 0, "-inf").otherwise("inf")).otherwise(text)
    return F.when(v.isNotNull(), text)


def plain_number(v: Column, digits: int) -> Column:
    """Fixed decimals without trailing zeros."""
    return F.regexp_replace(fixed_decimals(v, digits), r"\.?0+$", "")


def reference_line(name: Column, lat: Column, lon: Column, alt: Column) -> Column:
    return F.format_string("%s %s %s %s", name, fixed_decimals(lat, 10), fixed_decimals(lon, 10), fixed_decimals(alt, 3))


def pose_line(values: list[Column], digits: int = 6) -> Column:
    """The numbers with blanks between; null if one is missing."""
    texts = [fixed_decimals(v, digits) for v in values]
    return F.concat(texts[0], *[F.concat(F.lit(" "), t) for t in texts[1:]])


def write_ordered(df: DataFrame, path: str, order: list[str], kind: str = "csv", parts: int | None = None) -> None:
    """Files whose names follow the order, each sorted; no single writer task."""
    split = df.repartitionByRange(parts, *order) if parts else df.repartitionByRange(*order)
    writer = split.sortWithinPartitions(*order).write.mode("errorifexists")
    if kind == "csv":
        writer.option("header", True).option("quote", '"').option("escape", '"').csv(path)
    elif kind == "json":
        writer.json(path)
    else:
        writer.text(path)


def markdown_row(columns: list[Column]) -> Column:
    cells = [F.coalesce(c.cast("string"), F.lit("None")) for c in columns]
    return F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))


def _position(p: Column, separator: str) -> Column:
    between = F.lit(separator)
    return F.concat(plain_number(p["lon"], 8), between, plain_number(p["lat"], 8), between, plain_number(p["height"], 2))


def _listed(places: Column, separator: str) -> Column:
    """The places that are known; null if none is, as string aggregation gives."""
    return F.nullif(F.array_join(places, separator), F.lit(""))


def geojson_feature(kind: Column, name: Column, result: Column, ring: Column) -> Column:
    """One Feature text; outlines are closed, routes are lines, single points are points."""
    places = F.transform(ring, lambda p: F.concat(F.lit("["), _position(p, ","), F.lit("]")))
    closed = _listed(F.concat(places, F.array(places[0])), ",")
    shape = (
        F.when(kind == "point", F.concat(F.lit('{"type":"Point","coordinates":'), places[0], F.lit("}")))
        .when(kind.isin("area", "volume"), F.concat(F.lit('{"type":"Polygon","coordinates":[['), closed, F.lit("]]}")))
        .otherwise(F.concat(F.lit('{"type":"LineString","coordinates":['), _listed(places, ","), F.lit("]}")))
    )
    properties = F.to_json(F.struct(name.alias("name"), kind.alias("tool"), result.alias("result")))
    return F.concat(F.lit('{"type":"Feature","properties":'), properties, F.lit(',"geometry":'), shape, F.lit("}"))


def kml_placemark(kind: Column, name: Column, ring: Column) -> Column:
    escaped = name
    # Markup characters and their entities.
    for raw, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        escaped = F.replace(escaped, F.lit(raw), F.lit(entity))
    places = F.transform(ring, lambda p: _position(p, ","))
    closed = _listed(F.concat(places, F.array(places[0])), " ")
    shape = (
        F.when(kind == "point", F.concat(F.lit("<Point><coordinates>"), places[0], F.lit("</coordinates></Point>")))
        .when(kind.isin("area", "volume"), F.concat(
            F.lit("<Polygon><outerBoundaryIs><LinearRing><coordinates>"), closed, F.lit("</coordinates></LinearRing></outerBoundaryIs></Polygon>")))
        .otherwise(F.concat(F.lit("<LineString><tessellate>1</tessellate><coordinates>"), _listed(places, " "), F.lit("</coordinates></LineString>")))
    )
    return F.concat(F.lit("<Placemark><name>"), escaped, F.lit("</name>"), shape, F.lit("</Placemark>"))


def quoted_row(columns: list[Column]) -> Column:
    """CSV text with every cell quoted and quotes doubled."""
    cells = [F.concat(F.lit('"'), F.replace(F.coalesce(c.cast("string"), F.lit("")), F.lit('"'), F.lit('""')), F.lit('"')) for c in columns]
    return F.concat_ws(",", *cells)


def short_time(v: Column) -> Column:
    """Twelve significant digits without trailing zeros, for times below 10^11 seconds."""
    text = v.cast("string")
    for whole in range(1, 12):
        decimals = 12 - whole
        shown = F.regexp_replace(F.round(v, decimals).cast(f"decimal({whole + decimals + 1},{decimals})").cast("string"), r"\.?0+$", "")
        low = 0.0 if whole == 1 else 10.0 ** (whole - 1)
        text = F.when((F.abs(v) >= low) & (F.abs(v) < 10.0**whole), shown).otherwise(text)
    return text


def manifest_entry(name: Column, frame: Column, time: Column) -> Column:
    """Canonical JSON of one frame's identity, keys sorted, no blanks."""
    return F.to_json(F.struct(name.alias("image_name"), frame.cast("string").alias("source_frame"), short_time(time).alias("time_s")))


def telemetry_entry() -> Column:
    return F.format_string("%.9f,%.12f,%.12f,%.6f\n", "time_s", "latitude", "longitude", "altitude_m")


def fingerprint(rows: DataFrame, key: str, order: list[str], entry: Column, joint: str = "", start: str = "", end: str = "", hot: bool | None = None) -> DataFrame:
    """SHA-256 of a key's ordered entries, with their count and the method.

    Entries are cut into blocks of ``BLOCK_ENTRIES`` at every size and however the ranks are
    computed. A key of one block has that block's digest, the SHA-256 of its byte stream
    (method ``stream``); a longer one the digest of its blocks' digests (method ``blocks``),
    as one byte stream cannot be hashed in parts.
    """
    lines = rows.select(key, *order, entry.alias("_e"))
    placed = ordered(lines, [key], order, {"_rank": rank()}, hot=hot)
    placed = placed.withColumn("_block", F.floor((F.col("_rank") - 1) / BLOCK_ENTRIES))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("_rank", "_e"))), lambda s: s["_e"])
    stream = F.sha2(F.concat(F.lit(start), F.array_join(parts, joint), F.lit(end)), 256)
    blocks = placed.groupBy(key, "_block").agg(F.count(F.lit(1)).alias("_n"), stream.alias("_d"))
    digests = F.transform(F.array_sort(F.collect_list(F.struct("_block", "_d"))), lambda s: s["_d"])
    several = F.count(F.lit(1)) > 1
    return blocks.groupBy(key).agg(
        F.sum("_n").alias("entries"),
        F.when(several, F.sha2(F.array_join(digests, ""), 256)).otherwise(F.first("_d")).alias("sha256"),
        F.when(several, "blocks").otherwise("stream").alias("method"),
    )
