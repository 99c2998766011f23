"""Greedy minimum-gap resampling and flown path length."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql import Window as W

from ..functions.geo import local_distance
from ..scale import is_hot, lag, ordered, running_sum


def _following(times: np.ndarray, last: np.ndarray, gap: float) -> np.ndarray:
    """Index of the first time whose difference from ``last`` reaches ``gap``."""
    j = np.searchsorted(times, last + gap, side="left")
    # The rule is on the difference, so step over rounding at the boundary.
    while True:
        back = (j > 0) & (times[np.maximum(j - 1, 0)] - last >= gap)
        if not back.any():
            break
        j = np.where(back, j - 1, j)
    while True:
        inside = j < len(times)
        short = inside & (times[np.minimum(j, len(times) - 1)] - last < gap)
        if not short.any():
            return j
        j = np.where(short, j + 1, j)


def _walk(times: np.ndarray, start: int, gap: float) -> list[int]:
    nxt = _following(times, times, gap)
    kept, i = [], start
    while i < len(times):
        kept.append(i)
        i = int(nxt[i])
    return kept


def greedy_resample(
    df: DataFrame,
    keys: list[str],
    time: str,
    order: list[str],
    min_gap: float = 1.0,
    keep_last: bool = False,
    hot: bool | None = None,
    chunk_s: float = 3600.0,
) -> DataFrame:
    """Keep the first row per key, then each row at least ``min_gap`` after the last kept one.

    The chain only depends on distinct times, so it runs on the distinct (key, time) pairs and
    the first row of each kept time is returned. Huge keys run by time chunk: every chunk
    reports where each possible entry leaves it, a small table chains the chunks, and a
    second pass marks the kept times.
    """
    if hot is None:
        hot = is_hot(df, keys)
    times = df.select(*keys, F.col(time).cast("double").alias("_t")).distinct()
    schema = ", ".join(f"{k} {dict(df.dtypes)[k]}" for k in keys) + ", _t double"
    if not hot:

        def mark(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("_t", ignore_index=True)
            return pdf.iloc[_walk(pdf["_t"].to_numpy(), 0, min_gap)]

        kept = times.groupBy(*keys).applyInPandas(mark, schema)
    else:
        kept = _chunked_chain(times, keys, schema, min_gap, max(chunk_s, 4 * min_gap))
    if keep_last:
        ends = times.groupBy(*keys).agg(F.max("_t").alias("_t"))
        kept = kept.unionByName(ends).distinct()
    firsts = df.groupBy(*keys, F.col(time).cast("double").alias("_t")).agg(
        F.min_by(F.struct(*[F.col(c) for c in df.columns]), F.struct(*order)).alias("_row")
    )
    # The kept times are of the order of all rows and compress well, so that they would pass for a small table.
    return firsts.join(kept.hint("merge"), [*keys, "_t"]).select("_row.*")


def _chunked_chain(times: DataFrame, keys: list[str], schema: str, gap: float, chunk_s: float) -> DataFrame:
    chunk = F.floor(F.col("_t") / chunk_s).cast("bigint")
    own = times.withColumn("_chunk", chunk).withColumn("_tail", F.lit(False))
    # The tail of the previous chunk holds every entry that can still block the first rows.
    tails = own.filter((F.col("_chunk") + 1) * chunk_s - F.col("_t") <= gap).select(
        *keys, "_t", (F.col("_chunk") + 1).alias("_chunk"), F.lit(True).alias("_tail")
    )
    both = own.unionByName(tails)

    def steps(pdf: pd.DataFrame) -> pd.DataFrame:
        here = np.sort(pdf.loc[~pdf["_tail"], "_t"].to_numpy())
        if not len(here):
            return pd.DataFrame(columns=[*keys, "_chunk", "_entry", "_exit"])
        entries = np.concatenate([[-np.inf], np.sort(pdf.loc[pdf["_tail"], "_t"].to_numpy())])
        nxt = _following(here, here, gap)
        at = _following(here, entries, gap)
        at[0] = 0
        exits = np.where(at < len(here), here[np.minimum(at, len(here) - 1)], entries)
        while (at < len(here)).any():
            live = at < len(here)
            exits = np.where(live, here[np.minimum(at, len(here) - 1)], exits)
            at = np.where(live, nxt[np.minimum(at, len(here) - 1)], at)
        # Chains merge, so one row per run of equal exits is enough: entry = last of the run.
        last_of_run = np.append(exits[1:] != exits[:-1], True)
        out = {k: pdf[k].iloc[0] for k in keys}
        return pd.DataFrame(
            {**out, "_chunk": pdf["_chunk"].iloc[0], "_entry": entries[last_of_run], "_exit": exits[last_of_run]}
        )

    key_schema = schema.rsplit(", _t double", 1)[0]
    table = both.groupBy(*keys, "_chunk").applyInPandas(
        steps, f"{key_schema}, _chunk bigint, _entry double, _exit double"
    )

    def chain(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["_chunk", "_entry"], ignore_index=True)
        rows, last = [], -np.inf
        for number, part in pdf.groupby("_chunk", sort=True):
            start = number * chunk_s
            entry = last if start - last < gap else -np.inf
            rows.append((number, entry))
            at = int(np.searchsorted(part["_entry"].to_numpy(), entry, side="left"))
            last = float(part["_exit"].iloc[at])
        out = pd.DataFrame(rows, columns=["_chunk", "_enter"])
        for k in keys:
            out[k] = pdf[k].iloc[0]
        return out[[*keys, "_chunk", "_enter"]]

    enters = table.groupBy(*keys).applyInPandas(chain, f"{key_schema}, _chunk bigint, _enter double")
    entered = own.drop("_tail").join(enters, [*keys, "_chunk"])

    def mark(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_t", ignore_index=True)
        t, enter = pdf["_t"].to_numpy(), pdf["_enter"].iloc[0]
        start = 0 if np.isneginf(enter) else int(_following(t, np.array([enter]), gap)[0])
        return pdf.iloc[_walk(t, start, gap)][[*keys, "_t"]]

    return entered.groupBy(*keys, "_chunk").applyInPandas(mark, schema)


def path_table(
    samples: DataFrame, keys: list[str], min_gap: float = 1.0, hot: bool | None = None
) -> DataFrame:
    """Cumulative flown metres at ~``1/min_gap`` Hz, one row per distinct time."""
    if hot is None:
        hot = is_hot(samples, keys)
    coarse = greedy_resample(samples, keys, "time_s", ["sample_id"], min_gap, keep_last=True, hot=hot)
    order = ["time_s", "sample_id"]
    back = ordered(
        coarse,
        keys,
        order,
        {"_prev": lag(F.struct("latitude", "longitude", "altitude_m"))},
        hot=hot,
    )
    p = F.col("_prev")
    step = F.coalesce(
        local_distance(
            p["latitude"], p["longitude"], p["altitude_m"],
            F.col("latitude"), F.col("longitude"), F.col("altitude_m"),
        ),
        F.lit(0.0),
    )
    return ordered(
        back.withColumn("_step", step), keys, order, {"path_m": running_sum(F.col("_step"))}, hot=hot
    ).select(*keys, "sample_id", "time_s", "path_m")
