"""Split scans and quantiles equal the plain ones on a table with one hot key."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from skyledger import scale
from skyledger.operators import resample, suppression


def hot_table(spark):
    base = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 50).alias("k"),
        (F.col("id") * 7919 % 3001).alias("t"),
        F.when(F.col("id") % 4 == 0, None).otherwise((F.col("id") * 31 % 997).cast("double")).alias("v"),
    )
    return base


def test_ordered_split_equals_plain(spark):
    df = hot_table(spark)
    specs = {
        "a": scale.lag(F.col("v")), "b": scale.lead(F.col("v")), "c": scale.running_sum(F.col("v")), "d": scale.running_max(F.col("v")),
        "e": scale.last_known(F.col("v")), "f": scale.next_known(F.col("v")), "g": scale.rank(),
    }
    plain = scale.ordered(df, ["k"], ["t"], specs, hot=False)
    split = scale.ordered(df, ["k"], ["t"], specs, hot=True, part_rows=100)
    assert sorted(map(str, plain.collect())) == sorted(map(str, split.collect()))


def test_split_quantiles_are_numpy_linear(spark):
    df = hot_table(spark).filter("v is not null")
    wanted = [scale.Quantile("p50", F.col("v"), 0.5), scale.Quantile("p95", F.col("v"), 0.95)]
    plain = {r.k: (r.p50, r.p95) for r in scale.grouped(df, ["k"], [], wanted, hot=False).collect()}
    split = {r.k: (r.p50, r.p95) for r in scale.grouped(df, ["k"], [F.count("v").alias("n")], wanted, hot=True).collect()}
    rows = df.toPandas()
    for k, part in rows.groupby("k"):
        assert np.allclose(plain[k], np.percentile(part["v"], [50, 95]))
        assert np.allclose(split[k], plain[k])


def test_greedy_resample_by_chunks_equals_one_pass(spark):
    df = spark.range(4000).select(
        (F.col("id") % 3).alias("k"), F.col("id").alias("sample_id"), (F.col("id") * 37 % 3989 / 10.0).alias("time_s")
    )
    one = resample.greedy_resample(df, ["k"], "time_s", ["sample_id"], 1.0, keep_last=True, hot=False)
    many = resample.greedy_resample(df, ["k"], "time_s", ["sample_id"], 1.0, keep_last=True, hot=True, chunk_s=20.0)
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, many.collect()))


def test_suppression_rounds_equal_the_sequential_pass(spark):
    pairs = spark.range(900).select(
        (F.col("id") % 2).alias("seq"), (F.col("id") * 7 % 211).alias("i"), (F.col("id") * 7 % 211 + 11 + F.col("id") * 13 % 97).alias("j"),
        (F.col("id") * 7919 % 10007).cast("double").alias("score"),
    ).dropDuplicates(["seq", "i", "j"])
    one = suppression.suppress_loop_pairs(pairs, "seq", 9, hot=False)
    many = suppression.suppress_loop_pairs(pairs, "seq", 9, hot=True)
    assert one.count() > 0
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, many.collect()))


def test_split_quantile_of_the_whole_table(spark):
    df = hot_table(spark)
    wanted = [scale.Quantile("m", F.col("v"), 0.25)]
    want = np.percentile(df.dropna().toPandas()["v"], 25)
    for hot in (False, True):
        assert np.isclose(scale.grouped(df, [], [F.count("v").alias("n")], wanted, hot=hot).first().m, want)
