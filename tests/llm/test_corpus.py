from __future__ import annotations

import hashlib
import itertools
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyledger.llm.block_topk import Blocks, block_topk
from skyledger.llm.common import n_words
from skyledger.llm.components import components
from skyledger.llm.imatch import build_lexicon, compare_with_edits, document_frequencies, fingerprints, terms_of
from skyledger.llm.mixing import cycle_weights, fill_targets, min_cost_flow, mix_sources, route
from skyledger.llm.overlap_join import Rule, overlap_join
from skyledger.llm.packing import LENGTHS, pack_documents, padded_tokens, plan_bins

from .cases import document_rows, documents, nothing, prose

SF = "/root/testdata/sf0.001"


def groups_of(links, nodes):
    top = {n: n for n in nodes}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        top[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def shingles(text, words):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[k : k + words]) for k in range(len(w) - words + 1)) if len(w) >= words else frozenset([tuple(w)] if w else [])


def brute_components(rows, rule):
    """(n, component) of each (id, text), ids unique."""
    sets = {i: shingles(t, rule.words) for i, t in rows}
    links = [
        (a, b) for a, b in itertools.combinations(sorted(i for i in sets if sets[i]), 2)
        if 100 * len(sets[a] & sets[b]) >= rule.percent * len(sets[a] | sets[b])
    ]
    return {i: (len(sets[i]), c) for i, c in groups_of(links, sets).items()}


def test_components(spark):
    rng = random.Random(3)
    links = [(rng.randrange(200), rng.randrange(200)) for _ in range(130)] + [(300 + k, 301 + k) for k in range(60)] + [(7, 7), (7, None)]
    want = groups_of([x for x in links if None not in x and x[0] != x[1]], {n for x in links if None not in x and x[0] != x[1] for n in x})
    df = spark.createDataFrame(links, "a long, b long")
    assert {r[0]: r[1] for r in components(df).collect()} == want
    assert components(nothing(df)).count() == 0


@pytest.mark.parametrize("rule", [Rule(4, 85), Rule(5, 80, long_list=2, block_nodes=3, frequent=2, name_bits=8)])
def test_overlap_join_on_documents(spark, rule):
    rng = random.Random(8)
    base = prose(120, 40, 90).split()
    rows = [(r[0], r[1]) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").limit(120).collect()]
    for k in range(40):  # a family whose members differ by a few words
        words = list(base)
        for _ in range(rng.randint(0, 5)):
            words[rng.randrange(len(words))] = f"new{rng.randrange(999)}"
        rows.append((10_000 + k, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r[0]: (r[1], r[2]) for r in overlap_join(df, rule).collect()}
    want = brute_components(rows, rule)
    assert got == want
    assert len({c for _, c in want.values()}) < len(want)


def test_overlap_join_on_awkward_rows(spark):
    df = documents(spark)
    got = Counter(tuple(r) for r in overlap_join(df, Rule(4, 85)).collect())
    rows = [(k if i is None else i, t) for k, (i, t, *_) in zip(itertools.count(1000), document_rows())]
    unique = brute_components(dict(rows).items(), Rule(4, 85))
    want = Counter((None if i >= 1000 else i, unique[i][0], None if i >= 1000 else unique[i][1]) for i, _ in rows)
    assert got == want
    assert overlap_join(nothing(df)).count() == 0


def brute_topk(rows, queries, k):
    whole = []
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            whole.append((i, [math.floor(256 * float(x)) for x in v]))
    out = []
    for q, a in whole:
        if q in queries:
            scored = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in whole if i != q)
            out += [(q, rank, i, -s) for rank, (s, i) in enumerate(scored[:k], 1)]
    return Counter(out)


def test_block_topk(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=8).astype("float32").tolist()) for i in range(300)]
    rows += [(300 + i, rows[50][1]) for i in range(90)]  # many ties
    rows += [(400, None), (410, [None] * 8), (420, [math.nan] * 8), (430, [math.inf, *[0.0] * 7]), (440, [1.0, 2.0]), (None, rows[0][1])]
    df = spark.createDataFrame([(*r, "x", "x") for r in rows], "vec_id long, embedding array<float>, id string, shard string")
    queries = {i for i, _ in rows if i is not None and i % 10 == 0}
    got = block_topk(df, F.col("vec_id") % 10 == 0, 5)
    assert Counter(tuple(r) for r in got.collect()) == brute_topk(rows, queries, 5)
    few = df.filter("vec_id < 3")
    assert Counter(tuple(r) for r in block_topk(few, F.col("vec_id") == 0, 5).collect()) == brute_topk(rows[:3], {0}, 5)
    assert block_topk(nothing(df), F.col("vec_id") == 0).count() == 0


def test_blocks_are_pruned():
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(40, 16)) * 200
    vectors = np.repeat(centres, 64, axis=0) + rng.normal(size=(2560, 16)) * 5
    vectors = vectors.astype("int64")
    ids = np.arange(2560)
    scores, found, scored = Blocks(ids, vectors).search(ids[:50], vectors[:50], 5, np.full(50, -(2**63)), np.full(50, -1))
    exact = vectors[:50] @ vectors.T
    for q in range(50):
        exact[q, q] = -(2**62)
        assert found[q].tolist() == np.lexsort((ids, -exact[q]))[:5].tolist()
    assert scored < 0.2 * 50 * 40


def test_targets_and_flow():
    sizes, weights = {"a": 100, "b": 10, "c": 50, None: 40}, cycle_weights(5, 2, 1)(["b", None, "a", "c"])
    assert weights == {"a": 5, "b": 2, "c": 1, None: 5}
    targets = fill_targets(sizes, weights, 300, 2)
    assert targets == {"a": targets["a"], "b": 20.0, "c": targets["c"], None: 80.0}
    assert math.isclose(sum(targets.values()), 300) and all(targets[s] <= 2 * sizes[s] for s in sizes)
    assert math.isclose(targets["a"] / targets["c"], 5)
    assert fill_targets({"a": 0}, {"a": 5}, 0.0, 2) == {"a": 0.0}
    arcs = [("s", "p", 2, 0), ("s", "p", 2, 1), ("s", "q", 1, 0), ("s", "q", 1, 1), ("p", "x", 4, 0), ("p", "y", 4, 0), ("q", "y", 2, 0), ("x", "t", 2, 0), ("y", "t", 2, 0)]
    best = None
    for flow in itertools.product(*(range(c + 1) for _, _, c, _ in arcs)):
        if all(sum(f * ((b == v) - (a == v)) for f, (a, b, _, _) in zip(flow, arcs)) == 0 for v in "pqxy"):
            key = (-sum(f for f, a in zip(flow, arcs) if a[0] == "s"), sum(f * a[3] for f, a in zip(flow, arcs)))
            best = key if best is None else min(best, key)
    flow = min_cost_flow(arcs, "s", "t")
    assert (-sum(flow[:4]), sum(f * a[3] for f, a in zip(flow, arcs))) == best
    # A document in two sources is repeated only when both quotas demand it.
    sent = route({("a",): 10, ("a", "b"): 10, ("b",): 10}, {"a": 15, "b": 15}, 2)
    assert sum(f for p in sent.values() for _, f in p) == 30 and max(sum(f for _, f in p) for p in sent.values()) == 10


def test_mixing(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("size", F.lit("clash")).withColumn("copies", F.lit(9))
    mix = lambda df, members: mix_sources(df, n_words(F.col("text")), members, cycle_weights(5, 2, 1))
    rows = mix(docs, F.array("source")).collect()
    assert sorted(map(str, rows)) == sorted(map(str, mix(docs.repartition(7), F.array("source")).collect()))
    assert sorted(r["doc_id"] for r in rows) == sorted(r[0] for r in docs.select("doc_id").collect())
    taken, sizes, targets, most = Counter(), Counter(), {}, Counter()
    for r in rows:
        assert r["size"] == len((r["text"] or "").encode().split()) and r["taken"] == r["copies"] * r["size"] <= 2 * r["size"]
        taken[r["source"]] += r["taken"]
        sizes[r["source"]] += r["size"]
        most[r["source"]] = max(most[r["source"]], r["size"])
        targets[r["source"]] = r["parts"][0]["target"]
        assert len(r["parts"]) == 1
    for s in sizes:
        assert targets[s] - most[s] <= taken[s] <= targets[s] + 1
    both = mix(docs, F.when(F.col("doc_id") % 3 == 0, F.array("source", F.lit("src0"))).when(F.col("doc_id") % 7 != 0, F.array("source")))
    assert both.count() == docs.count() and both.filter("size(parts) = 0 and taken > 0").count() == 0
    odd = documents(spark)
    got = mix(odd, F.array("source"))
    assert got.count() == odd.count() and got.filter("size = 0 and taken > 0").count() == 0
    assert mix(nothing(odd), F.array("source")).count() == 0


def plain_best_fit(sizes, capacity):
    rooms = []
    for s in sorted(sizes, reverse=True):
        fit = [i for i, r in enumerate(rooms) if r >= s]
        if fit:
            rooms[min(fit, key=lambda i: rooms[i])] -= s
        else:
            rooms.append(capacity - s)
    return len(rooms)


def test_plan_is_best_fit_and_chooses_lengths():
    rng = random.Random(4)
    for trial in range(30):
        sizes = [rng.randint(1, 64) for _ in range(rng.randint(1, 200))]
        plan = plan_bins(dict(Counter(sizes)), (64,))
        assert sum(b.count for b in plan.bins) == plain_best_fit(sizes, 64)
        several = plan_bins(dict(Counter(sizes)), (16, 32, 64))
        assert several.cost <= plan.cost
        assert all(b.used <= b.capacity and b.capacity in (16, 32, 64) for b in several.bins)
        assert Counter({s: sum(b.count * n for b in several.bins for k, n in b.content if k == s) for s in set(sizes)}) == Counter(sizes)
    assert {b.capacity for b in plan_bins({20: 1, 60: 1}, (32, 64)).bins} == {32, 64}


def check_packing(rows, lengths, most=8192):
    """Every length whole, in bins that no two pieces overlap in."""
    bins, pieces = defaultdict(list), Counter()
    for r in rows:
        pieces[r["doc_id"]] += r["length"]
        if r["length"]:
            bins[(r["bin_id"], r["bin_capacity"])].append((r["bin_offset"], r["length"]))
        else:
            assert r["bin_id"] is None
    assert pieces == lengths
    assert len({b for b, _ in bins}) == len(bins)
    for (_, capacity), held in bins.items():
        held.sort()
        assert capacity in LENGTHS and held[0][0] == 0 and held[-1][0] + held[-1][1] <= capacity
        assert all(a + n == b for (a, n), (b, _) in zip(held, held[1:]))
        used = sum(n for _, n in held)
        assert capacity == min(c for c in LENGTHS if c >= used)
    return sum(map(padded_tokens, (c for _, c in bins)))


def test_packing(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    lengths = Counter()
    for r in docs.collect():
        lengths[r["doc_id"]] += len((r["text"] or "").split()) + 1
    cost = check_packing(pack_documents(docs, n_words(F.col("text")) + 1).collect(), lengths)
    assert sum(lengths.values()) <= cost < 1.05 * sum(lengths.values()) + 9000
    odd = documents(spark)
    lengths = Counter()
    for i, t, *_ in document_rows():
        lengths[i] += len((t or "").encode().split())
    check_packing(pack_documents(odd, F.when(F.col("text").isNotNull(), n_words(F.col("text")))).collect(), lengths)
    assert pack_documents(nothing(odd), F.lit(3)).count() == 0


def test_imatch(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    rows = sorted((r[0], r[1] or "") for r in docs.collect())
    counts = Counter(t for _, text in rows for t in terms_of(text))
    least = math.ceil(0.02 * len(rows))
    got = {bytes(r["term"]): r["df"] for r in document_frequencies(docs.repartition(6), 0.02).collect()}
    assert got == {t: n for t, n in counts.items() if n >= least}
    lexicon = build_lexicon(docs, 0.02, 0.2)
    assert set(lexicon.rows) == {t for t, n in counts.items() if least <= n <= 0.2 * len(rows)}
    found = {r["doc_id"]: r for r in compare_with_edits(docs.repartition(4), lexicon).collect()}
    by_text = {}
    for k, (i, text) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        r = found[i]
        assert (r["n_chars"], r["edited_sha256"]) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert by_text.setdefault(text, r["fingerprint"]) == r["fingerprint"]
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
    plain = {r[0]: r[1] for r in fingerprints(docs, lexicon).collect()}
    assert plain == {i: r["fingerprint"] for i, r in found.items()}
    mean = lambda c: np.mean([r[c] for r in found.values()])
    assert mean("near_edited") > 0.12 > 0.03 > mean("near_next")


def test_imatch_on_awkward_rows(spark):
    odd = documents(spark)
    lexicon = build_lexicon(odd)
    got = compare_with_edits(odd, lexicon).collect()
    rows = sorted(((r[0], r[1] or "") for r in document_rows()), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    want = Counter()
    for (i, text), (_, after) in zip(rows, rows[1:] + rows[:1]):
        half = len(text) // 2
        want[(i, hashlib.sha256((text[: len(text) - half] + after[:half]).encode()).hexdigest())] += 1
    assert Counter((r["doc_id"], r["edited_sha256"]) for r in got) == want
    assert compare_with_edits(nothing(odd), build_lexicon(nothing(odd))).count() == 0
