"""Merkle manifests, ranked search and language identification beside brute force, on awkward rows and empty tables."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from skyledger.llm import language_id, lexical, merkle
from tests.oracle import compare

from .cases import documents, nothing, prose

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op12_merkle_manifest", "op13_ranked_search"])
def test_query_agrees_with_sql(spark, duckdb_tables, name):
    assert compare(__spark_entry__.queries()[name](spark, SF), __spark_entry__.oracle_sql()[name], duckdb_tables) is None


# --- Merkle manifest


def sha(*values):
    return hashlib.sha256("".join(values).encode()).hexdigest()


def brute_manifest(rows, told):
    """Rows are (doc_id, source, lang, n_chars, text); ``told`` the same as verifiers hold them."""

    def leaf(r):
        return sha(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in r])

    def tree(nodes):
        """The root of hashes and every node's siblings upwards, as (before, after) pairs."""
        found = [[] for _ in nodes]
        spot = list(range(len(nodes)))
        while len(nodes) > 1:
            runs = [nodes[i : i + 3] for i in range(0, len(nodes), 3)]
            for k, s in enumerate(spot):
                run = runs[s // 3]
                found[k].append(("".join(run[: s % 3]), "".join(run[s % 3 + 1 :])))
                spot[k] = s // 3
            nodes = [sha(*run) for run in runs]
        return nodes[0], found

    groups = {}
    for r, t in zip(rows, told):
        groups.setdefault(r[1], []).append((r, t))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in names:
        groups[g].sort(key=lambda p: (p[0][0] is not None, p[0][0] or 0, leaf(p[0])))
        trees[g] = tree([leaf(r) for r, _ in groups[g]])
    root, tops = tree([trees[g][0] for g in names])
    out = []
    for g, top in zip(names, tops):
        for (r, t), path in zip(groups[g], trees[g][1]):
            node = leaf(t)
            for before, after in path + top:
                node = sha(before, node, after)
            proof = sha(*[b + a for b, a in path + top])
            out.append((r[0], leaf(r), trees[g][0], root, proof, node, node == root))
    return Counter(out)


def manifest_of(df):
    got = merkle.merkle_manifest(df, {"text": F.when(F.col("doc_id") % 2 == 0, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))})
    return Counter(tuple(r) for r in got.collect())


def wanted(df):
    rows = [tuple(r) for r in df.select("doc_id", "source", "lang", "n_chars", "text").collect()]
    told = [r[:4] + (r[4].replace("\n", "") if r[4] is not None and r[0] is not None and r[0] % 2 == 0 else r[4],) for r in rows]
    return brute_manifest(rows, told)


def test_manifest_equals_definition(spark, monkeypatch):
    odd = documents(spark)
    assert manifest_of(odd) == wanted(odd)
    monkeypatch.setattr(merkle, "PART_ROWS", 7)  # groups reach over many parts
    rng = random.Random(3)
    rows = [(rng.randrange(80), rng.choice(["big", "big", "big", "a", None, "é", ""]), "x", None, rng.choice(["a\nb", "", None])) for _ in range(150)]
    rows.append((1, "alone", None, 3, "last"))
    many = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(5)
    got = manifest_of(many)
    assert got == wanted(many)
    assert {v[-1] for v in got} == {True, False}
    one = many.filter("source = 'alone'")
    assert manifest_of(one) == wanted(one)
    assert manifest_of(nothing(odd)) == Counter()


# --- ranked search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
SMALL = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def test_terms():
    for text in ["", None, " \t", "Ab-cD_e 9x ÄÖ字 İ \x7f\x80y", "".join(map(chr, range(0x250))), prose(200, 4)]:
        assert [t.decode() for t in lexical.terms_of(text)] == TERM.findall((text or "").translate(SMALL))


def brute_search(docs, items, k):
    held = [(i, Counter(TERM.findall((t or "").translate(SMALL)))) for i, t in docs]
    held = [(i, c) for i, c in held if c]
    n_docs, all_terms = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in items:
        asked = Counter(TERM.findall((text or "").translate(SMALL)))
        scored = []
        for i, c in held:
            m = 25 + 75 * sum(c.values()) * n_docs // all_terms
            s = sum(q * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t, q in asked.items() if t in c)
            if s > 0:
                scored.append((-s, i is None, i or 0, i))
        out += [(item, r, x[3], -x[0]) for r, x in enumerate(sorted(scored)[:k], 1)]
    return Counter(out)


@pytest.mark.parametrize("block, rounds", [(20_000, 16), (30, 2), (8, 1)])
def test_search_equals_definition(spark, monkeypatch, block, rounds):
    monkeypatch.setattr(lexical, "BLOCK_TERMS", block)
    monkeypatch.setattr(lexical, "ROUND_BLOCKS", rounds)
    monkeypatch.setattr(lexical, "MERGED_TASKS", 2)
    odd = documents(spark)
    asked = [(1, prose(20, 3, 50)), (2, prose(20, 3, 50) + " and more"), (2, "tie one"), (3, "TIE one one one tie"), (None, "w é 字"), (4, None), (5, ""),
             (6, "nothing like it"), (7, "the a b c d"), (8, "x" * 9000)]
    items = spark.createDataFrame([(i, t, "x", 1) for i, t in asked], "item_id long, text string, doc_id string, row int")
    got = Counter(tuple(r) for r in lexical.ranked_search(odd, items, 4).collect())
    docs = [(r["doc_id"], r["text"]) for r in odd.collect()]
    assert got == brute_search(docs, asked, 4)
    assert lexical.ranked_search(nothing(odd), items).count() == 0
    assert lexical.ranked_search(odd, nothing(items)).count() == 0


def test_shared_sums():
    rng = random.Random(1)
    shared = [rng.sample(range(300), 12) for _ in range(6)]
    items = [Counter(rng.choices(range(300), k=15) + shared[k % 6] + shared[(k * k) % 6]) for k in range(60)] + [Counter(), Counter([5] * 9)]
    pairs, sums = lexical.mine(items, 300)

    def expand(s):
        return Counter([s]) if s < 300 else expand(pairs[s - 300][0]) + expand(pairs[s - 300][1])

    assert [sum(map(expand, ss), Counter()) for ss in sums] == items
    assert len(pairs) + sum(map(len, sums)) < 0.7 * sum(sum(c.values()) for c in items)  # sums are shared


# --- language


def held_out(i):
    return i is not None and zlib.crc32(str(i).encode()) % 4 == 2


def test_language_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    got = {r["doc_id"]: r for r in __spark_entry__.queries()["op11_nearest_centroid"](spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").collect()
    assert set(got) == {r["doc_id"] for r in docs}
    assert all(r["held_out"] == held_out(i) and 0 <= r["score"] <= 1 for i, r in got.items())
    right = [got[r["doc_id"]]["lang_pred"] == r["lang"] for r in docs if held_out(r["doc_id"])]
    assert len(right) > 200 and np.mean(right) >= 0.99


def test_prediction_never_reads_its_own_label(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    query = __spark_entry__.queries()["op11_nearest_centroid"]
    swapped = docs.withColumn("lang", F.when(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit("xx")).otherwise(F.col("lang")))
    learn = F.crc32(F.col("doc_id").cast("string")) % 4 != 2
    a = Counter(tuple(r) for r in language_id.identify(docs, learn).collect())
    b = Counter(tuple(r) for r in language_id.identify(swapped, learn).collect())
    assert a == b
    assert Counter((r["doc_id"], r["lang_pred"]) for r in query(spark, SF).collect()) == Counter((i, n) for i, n, *_ in a.elements())


def test_language_blocks_agree(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    docs = docs.unionByName(docs.limit(20))
    once = language_id.identify(docs, F.lit(True))
    monkeypatch.setattr(language_id, "BLOCK_LANGUAGES", 1)
    cut = language_id.identify(docs, F.lit(True))
    near = lambda df: Counter((r[0], r[1], round(r[2], 5), r[3], r[4]) for r in df.collect())
    assert near(once) == near(cut)


def test_vectors_are_tf_idf():
    idf = np.linspace(1, 3, 1 << language_id.BITS).astype("float32")
    text = "Über  die-Brücke, ja 7 ja"
    grams = Counter()
    chain = " über die brücke ja ja "
    for size in (1, 2, 3):
        grams.update(g for g in (chain[i : i + size] for i in range(len(chain) - size + 1)) if g != " ")
    assert language_id.counts(text).sum() == sum(grams.values())
    assert np.count_nonzero(language_id.counts(text)) == len(grams)  # no two of these share a coordinate
    row = language_id.vectors([text, "12 !", ""], idf)
    assert np.allclose(np.linalg.norm(row, axis=1), [1, 0, 0], atol=1e-6)
    want = np.sqrt(language_id.counts(text)) * idf
    assert np.allclose(row[0], want / np.linalg.norm(want), atol=1e-6)


def test_language_of_awkward_rows(spark):
    odd = documents(spark)
    got = language_id.identify(odd, F.col("doc_id").isNotNull()).collect()
    assert len(got) == odd.count()
    texts = {r["doc_id"]: r["text"] for r in odd.collect()}
    for r in got:
        lettered = language_id.has_letter(texts[r["doc_id"]] or "")
        assert (r["nearest"] in ("en", "fr")) == lettered and 0 <= r["score"] <= 1
        assert (r["lang"] == "und") == r["rejected"] and (lettered or r["rejected"])
    alone = language_id.identify(odd, F.lit(False)).collect()
    assert len(alone) == odd.count() and {r["lang"] for r in alone} == {"und"}
    assert language_id.identify(nothing(odd), F.lit(True)).count() == 0
    far = language_id.identify(
        odd.unionByName(odd.filter("doc_id = 7").withColumn("text", F.lit("ѬѬѬ ꙮꙮ")).withColumn("doc_id", F.lit(99).cast("long"))), F.col("doc_id") < 50
    )
    assert far.filter("doc_id = 99").first()["rejected"]
