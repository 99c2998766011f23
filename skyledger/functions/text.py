"""Formatting, grading and parsing of values as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

DASH = "—"


def finite(v: Column) -> Column:
    return v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))


def _or_dash(v: Column, text: Column) -> Column:
    return F.when(finite(v), text).otherwise(DASH)


def half_up(v: Column) -> Column:
    return F.floor(v + 0.5).cast("bigint")


def length(m: Column) -> Column:
    a = F.abs(m)
    return _or_dash(
        m,
        F.when(a >= 10000, F.format_string("%.1f km", m / 1000.0))
        .when(a >= 1000, F.format_string("%.2f km", m / 1000.0))
        .when(a >= 100, F.format_string("%.1f m", m))
        .otherwise(F.format_string("%.2f m", m)),
    )


def area(m2: Column) -> Column:
    return _or_dash(
        m2,
        F.when(m2 >= 1e6, F.format_string("%.3f km²", m2 / 1e6))
        .when(m2 >= 1e5, F.format_string("%.2f ha", m2 / 1e4))
        .when(m2 >= 100, F.concat(F.format_number(half_up(m2), 0), F.lit(" m²")))
        .otherwise(F.format_string("%.1f m²", m2)),
    )


def volume(m3: Column) -> Column:
    return _or_dash(
        m3,
        F.when(m3 >= 1e6, F.format_string("%.2f million m³", m3 / 1e6)).otherwise(
            F.concat(F.format_number(half_up(m3), 0), F.lit(" m³"))
        ),
    )


def height(m: Column) -> Column:
    return _or_dash(m, F.format_string("%.1f m", m))


def percent(x: Column, digits: int = 1) -> Column:
    return _or_dash(x, F.format_string(f"%.{digits}f%%", x * 100.0))


def slope(ratio: Column) -> Column:
    return _or_dash(ratio, F.format_string("%.1f%% (%.1f°)", ratio * 100.0, F.atan(ratio) / (math.pi / 180)))


def duration(seconds: Column) -> Column:
    total = half_up(seconds)
    return _or_dash(seconds, F.format_string("%d:%02d min", F.floor(total / 60), total % 60))


def grade(v: Column, good: float, warn: float, higher_is_better: bool = True) -> Column:
    if higher_is_better:
        rated = F.when(v >= good, "good").when(v >= warn, "warn").otherwise("bad")
    else:
        rated = F.when(v <= good, "good").when(v <= warn, "warn").otherwise("bad")
    return F.when(finite(v), rated).otherwise("info")


def file_name(path: Column) -> Column:
    return F.element_at(F.split(F.replace(F.trim(path), F.lit("\\"), F.lit("/")), "/"), -1)


def integer_text(text: Column) -> Column:
    """Whole numbers without a fraction part; other text stays."""
    number = F.trim(text).try_cast("double")
    whole = finite(number) & (number == F.floor(number))
    return F.when(whole, number.cast("bigint").cast("string")).otherwise(F.trim(text))


def digest(text: Column) -> Column:
    """Lower-case hex digest without its algorithm prefix; blank is missing."""
    plain = F.regexp_replace(F.lower(F.trim(text)), "^sha256:", "")
    return F.when(F.trim(text) != "", plain)


def resolution(text: Column) -> tuple[Column, Column]:
    """Width and height of a ``W x H`` text."""
    pattern = r"^\s*(\d+)\s*[xX]\s*(\d+)\s*$"
    return tuple(F.regexp_extract(text, pattern, i).try_cast("int") for i in (1, 2))


def frame_rate(text: Column) -> Column:
    """Positive rate from a number or a rational such as ``30000/1001``."""
    parts = F.split(text, "/", 2)
    top, bottom = parts[0].try_cast("double"), F.get(parts, F.lit(1)).try_cast("double")
    ratio = F.when(F.size(parts) == 1, top).when(bottom != 0, top / bottom)
    return F.when(finite(ratio) & (ratio > 0), ratio)


def literal_type(text: Column) -> Column:
    """How a literal reads: bool, none, int, float or string."""
    t = F.lower(F.trim(text))
    return (
        F.when(t.isin("true", "false"), "bool")
        .when(t.isin("none", "null"), "none")
        .when(t.rlike(r"^[+-]?\d+$"), "int")
        .when(t.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)(e[+-]?\d+)?$") | t.rlike(r"^[+-]?(inf|infinity|nan)$"), "float")
        .otherwise("string")
    )


def triplets(df, column: str, *keep: str):
    """``fn:key:value,...`` texts as long rows; the value may hold further colons."""
    item = F.explode(F.filter(F.split(column, ","), lambda i: i != ""))
    parts = F.split("item", ":", 3)
    return (
        df.select(*keep, item.alias("item"))
        .filter(F.size(parts) == 3)
        .select(
            *keep, parts[0].alias("fn"), parts[1].alias("key"), parts[2].alias("value"),
            literal_type(parts[2]).alias("value_type"),
        )
    )
