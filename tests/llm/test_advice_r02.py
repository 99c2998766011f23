
from __future__ import annotations

import random
from collections import Counter

from pyspark.sql import functions as F

from skyledger.llm import mixing
from skyledger.llm.kneser_ney import quality, thresholds

from .cases import prose


def test_quality_limit_is_a_quantile(spark):
    # Costs per token of 0.001 to 1: a limit beyond the costliest trusted text is no quantile of them.
    rows = [("en", float(k), 1000) for k in range(1, 1001)]
    limits = {r["lang"]: r["limit"] for r in thresholds(spark.createDataFrame(rows, "lang string, cost double, tokens long")).collect()}
    assert set(limits) == {"en", None}
    for limit in limits.values():
        assert sum((c + 60 * 0.5005) / (n + 60) > limit for _, c, n in rows) == 5


def test_quality_of_a_language_with_few_labels(spark):
    kinds = "doc_id long, text string, lang string"
    for given in (1, 2):
        rows = [(k, prose(40 + k % 30, k), "xx" if k < 300 else "yy") for k in range(340)]
        labels = [(k, 1, 0) for k in range(300 + given)]
        judged = quality(spark.createDataFrame(rows, kinds), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
        kept = [r["keep"] for r in judged.filter("lang = 'yy'").collect()]
        assert len(kept) == 40 and sum(kept) >= 38


def test_mix_leaves_no_document_that_fits(spark, monkeypatch):
    rng = random.Random(5)
    rows = [(k, "abc"[k % 3], rng.choice((1, 2, 7, 40, 900, 5000))) for k in range(600)]
    rows += [(k, s, n) for k, s, n in rows[:90]] * 3
    docs = spark.createDataFrame(rows, "doc_id long, source string, words long")
    for few in (20_000, 100, 0):
        monkeypatch.setattr(mixing, "FEW_DOCS", few, raising=False)
        got = mixing.mix_sources(docs, F.col("words"), F.array("source"), mixing.cycle_weights(5, 2, 1), seed=3).collect()
        times = Counter(r["doc_id"] for r in got)
        for s in "abc":
            mine = [r for r in got if r["source"] == s]
            gap = round(mine[0]["parts"][0]["target"]) - sum(r["taken"] for r in mine)
            least = min(r["copies"] for r in mine)
            open_ = [r["size"] * times[r["doc_id"]] for r in mine if r["copies"] == least < 2]
            assert gap >= 0 and (not gap or gap < min(open_, default=1 << 60))
