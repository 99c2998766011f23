"""Ranked lexical search of many items at once, with shared sub-expressions.

An item's score is a sum of term weights, so items that share terms share partial sums. Items
are dealt to blocks of bounded size, similar ones together. Within a block the plan is mined
once: items list their terms in one order, neighbours that meet in several lists become a new
symbol, and so on with the symbols until no two meet twice. The symbols form a directed acyclic
graph: terms at the bottom, shared sums above them, items on top.

The documents are read once per round of blocks to count (documents, terms, and documents per
queried term) and to keep what the queries need of each: its length and the occurrences of
queried terms. Then every task scores its documents in small batches. A symbol's accumulator,
the partial scores of the batch's documents, is computed once, from those of its two parts, and
read by every item above it. A task keeps the best documents per item; those are merged per
item and group of tasks, then per item. Every document with a queried term is scored.
"""

from __future__ import annotations

import math
import pickle
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql import Window as W

from ..session import cut_lineage
from .common import sliced

BLOCK_TERMS = 20_000
ROUND_BLOCKS = 16
CELLS = 4_000_000
MERGED_TASKS = 64

#: Bytes of UTF-8 that separate terms become spaces, A-Z become small; all else stays.
_TERM_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def terms_of(text: str | None) -> list[bytes]:
    """Maximal runs of digits, letters a-z and characters beyond ASCII, with A-Z lower-cased."""
    return text.encode().translate(_TERM_BYTES).split() if text else []


# --- the plan of a block of items


def mine(items: list[Counter], n_terms: int) -> tuple[list[tuple[int, int]], list[list[int]]]:
    """Shared sums of the items' term multisets.

    Returns pairs (the k-th defines symbol ``n_terms`` + k from two earlier symbols) and per
    item the symbols whose sum it is, repeats included. Items list their terms in one order, the
    most shared first and terms of the same items side by side, so shared sets stand together.
    Each round joins the neighbours that meet at least twice, those that meet more often first.
    """
    holders = defaultdict(list)
    for i, c in enumerate(items):
        for x in c:
            holders[x].append(i)
    place = {x: k for k, x in enumerate(sorted(holders, key=lambda x: (-len(holders[x]), holders[x], x)))}
    lists = [sorted(c.elements(), key=place.__getitem__) for c in items]
    pairs: list[tuple[int, int]] = []
    while True:
        met = Counter(p for symbols in lists for p in zip(symbols, symbols[1:]))
        named: dict[tuple[int, int], int] = {}
        for i, symbols in enumerate(lists):
            joined, at = [], 0
            while at < len(symbols):
                pair = tuple(symbols[at : at + 2])
                here = met[pair]
                if here > 1 and here >= met[tuple(symbols[at + 1 : at + 3])]:
                    if pair not in named:
                        named[pair] = n_terms + len(pairs)
                        pairs.append(pair)
                    joined.append(named[pair])
                    at += 2
                else:
                    joined.append(symbols[at])
                    at += 1
            lists[i] = joined
        if not named:
            return pairs, lists


class Plan:
    """A block's terms, its shared sums by level, and its items' symbols, ready for arrays."""

    def __init__(self, rows: list[int], terms: list[list[bytes]]):
        names = sorted({t for ts in terms for t in ts})
        number = {t: k for k, t in enumerate(names)}
        self.rows, self.terms = np.array(rows, "int64"), names
        pairs, sums = mine([Counter(number[t] for t in ts) for ts in terms], len(names))
        depth = [0] * len(names)
        for a, b in pairs:
            depth.append(1 + max(depth[a], depth[b]))
        self.symbols = len(depth)
        by_depth = defaultdict(list)
        for k, (a, b) in enumerate(pairs, len(names)):
            by_depth[depth[k]].append((k, a, b))
        self.levels = [np.array(by_depth[d], "int64").T for d in sorted(by_depth)]
        self.parts = np.array([s for ss in sums for s in ss], "int64")
        self.starts = np.cumsum([0, *[len(ss) for ss in sums]])[:-1]

    def scores(self, impacts: np.ndarray) -> np.ndarray:
        """Items x documents from terms x documents."""
        sums = np.empty((self.symbols, impacts.shape[1]), "int64")
        sums[: len(self.terms)] = impacts
        for new, a, b in self.levels:
            sums[new] = sums[a] + sums[b]
        return np.add.reduceat(sums[self.parts], self.starts, axis=0)


def _plans(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("row")
    plan = Plan(pdf["row"].tolist(), [terms_of(t) for t in pdf["text"]])
    return pd.DataFrame({"block": pdf["block"].iloc[:1], "plan": [pickle.dumps(plan)]})


def _dealt(items: DataFrame) -> tuple[DataFrame, int]:
    """Items (row, text, n) with their block: about ``BLOCK_TERMS`` terms each, neighbours by least term hash; and the number of blocks."""
    total = items.agg(F.sum("n")).first()[0] or 0
    blocks = math.ceil(total / BLOCK_TERMS)
    if not blocks:
        return items.withColumn("block", F.lit(0)), 0
    ranged = items.repartitionByRange(blocks, "near", "row").withColumn("_part", F.spark_partition_id())
    ranged = cut_lineage(ranged)
    # A part may come out large; it is then cut by a hash, so that a block stays bounded.
    sizes = ranged.groupBy("_part").agg(F.ceil(F.sum("n") / (2 * BLOCK_TERMS)).alias("_cuts"))
    cut = ranged.join(sizes, "_part").withColumn("_cut", F.pmod(F.xxhash64("row"), F.col("_cuts")))
    names = cut.groupBy("_part", "_cut").agg(F.count(F.lit(1)).alias("_n"))
    names = names.withColumn("block", F.row_number().over(W.orderBy("_part", "_cut")) - 1).drop("_n")
    dealt = cut_lineage(cut.join(names, ["_part", "_cut"]).select("block", "row", "text"))
    return dealt, dealt.agg(F.max("block")).first()[0] + 1


# --- documents: what queries need of them


class Vocabulary:
    """The queried terms of a round, numbered from 0."""

    def __init__(self, plans: list[Plan]):
        self.terms = sorted({t for p in plans for t in p.terms})
        self.number = {t: k for k, t in enumerate(self.terms)}


HITS = "id long, n long, terms binary, counts binary"


def _hits(vocabulary):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = vocabulary.value.number
        for batch, texts in sliced(batches, "text"):
            sizes, found, counts = [], [], []
            for text in texts:
                terms = terms_of(text)
                sizes.append(len(terms))
                hit = np.fromiter(filter(None.__ne__, map(number.get, terms)), "<u4")
                seen, times = np.unique(hit, return_counts=True)
                found.append(seen.astype("<u4").tobytes())
                counts.append(times.astype("<u4").tobytes())
            yield pa.RecordBatch.from_pydict({
                "id": batch.column("id"), "n": pa.array(sizes, pa.int64()), "terms": pa.array(found, pa.binary()),
                "counts": pa.array(counts, pa.binary()),
            })

    return scan


def _document_counts(n_terms: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(n_terms, "int64")
        for batch in batches:
            terms = np.frombuffer(b"".join(batch.column("terms").to_pylist()), "<u4")
            held += np.bincount(terms, minlength=n_terms)
        some = np.flatnonzero(held)
        yield pa.RecordBatch.from_pydict({"term": pa.array(some, pa.int64()), "df": pa.array(held[some], pa.int64())})

    return count


# --- scoring


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def damping(n: int, n_docs: int, all_terms: int) -> int:
    return 100 - 75 + 75 * n * n_docs // all_terms


class Best:
    """The k best documents per item so far: higher scores first, then lower ids."""

    def __init__(self, items: int, k: int):
        self.k = k
        self.scores, self.ids = [np.zeros(0, "int64")] * items, [np.zeros(0, "int64")] * items
        self.bar = np.ones(items, "int64")

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        """``scores``: items x documents. A score below the k-th, or of 0, cannot come in."""
        good = scores >= self.bar[:, None]
        for i in np.flatnonzero(good.any(axis=1)).tolist():
            s = np.concatenate([self.scores[i], scores[i, good[i]]])
            d = np.concatenate([self.ids[i], ids[good[i]]])
            first = np.lexsort((d, -s))[: self.k]
            self.scores[i], self.ids[i] = s[first], d[first]
            if len(first) == self.k:
                self.bar[i] = s[first[-1]]


FOUND = "row long, id long, score long, part int"
#: Stands for a missing id, which comes after all others among equal scores.
NO_ID = (1 << 63) - 1


def _scored(plans, vocabulary, weights, n_docs: int, all_terms: int, k: int):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        number, w = vocabulary.value.number, weights.value
        todo = [(p, np.array([number[t] for t in p.terms], "int64"), Best(len(p.rows), k)) for p in plans.value]
        widest = max((p.symbols + len(p.parts) for p in plans.value), default=1)
        step = max(16, min(1024, CELLS // widest))
        spot = np.full(len(vocabulary.value.terms), -1, "int64")
        for batch in batches:
            for start in range(0, batch.num_rows, step):
                piece = batch.slice(start, step)
                blobs = piece.column("terms").to_pylist()
                terms = np.frombuffer(b"".join(blobs), "<u4").astype("int64")
                if not len(terms):
                    continue
                tf = np.frombuffer(b"".join(piece.column("counts").to_pylist()), "<u4").astype("int64")
                doc = np.repeat(np.arange(len(blobs)), [len(b) // 4 for b in blobs])
                m = np.array([damping(n, n_docs, all_terms) for n in piece.column("n").to_pylist()], "int64")
                impact = w[terms] * (1_000_000_000 * tf // (1000 * tf + 8 * m[doc]))
                ids = np.array([NO_ID if i is None else i for i in piece.column("id").to_pylist()], "int64")
                for plan, own, best in todo:
                    spot[own] = np.arange(len(own))
                    at = spot[terms]
                    here = at >= 0
                    impacts = np.zeros((len(own), len(blobs)), "int64")
                    impacts[at[here], doc[here]] = impact[here]
                    best.add(plan.scores(impacts), ids)
                    spot[own] = -1
        for plan, _, best in todo:
            sizes = [len(s) for s in best.scores]
            if sum(sizes):
                ids = np.concatenate(best.ids)
                yield pa.RecordBatch.from_pydict({
                    "row": pa.array(np.repeat(plan.rows, sizes), pa.int64()), "id": pa.array(ids, pa.int64(), mask=ids == NO_ID),
                    "score": pa.array(np.concatenate(best.scores), pa.int64()), "part": pa.array([part] * len(ids), pa.int32()),
                })

    return score


def _first(found: DataFrame, by: list[str], k: int) -> DataFrame:
    place = F.row_number().over(W.partitionBy(*by).orderBy(F.desc("score"), F.asc_nulls_last("id")))
    return found.withColumn("rank", place).filter(F.col("rank") <= k)


def ranked_search(
    docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """Per row of ``items`` its ``k`` best documents: ``item_col``, rank (from 1), ``id_col`` and score (above 0).

    Equal scores rank by ascending id, documents without an id last; rows that repeat an id are
    documents each, items that repeat an id are searched each. A null, empty or termless text
    finds nothing and is found by nothing, and does not count among the documents. Texts of any
    length are read whole; empty tables give no rows; other columns are not read.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    asked = items.select(F.col(item_col).alias("item"), F.col(item_text_col).alias("text")).withColumn("row", F.monotonically_increasing_id())
    asked = cut_lineage(asked)
    # Terms as the documents' own rule has them, only to size blocks and to bring similar items together.
    split = F.split(F.lower(F.coalesce("text", F.lit(""))), r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    terms = F.filter(split, lambda t: t != "")
    sized = asked.withColumn("n", F.size(terms)).withColumn("near", F.array_min(F.transform(terms, lambda t: F.xxhash64(t))))
    dealt, blocks = _dealt(sized.filter("n > 0").select("row", "text", "n", "near"))
    planned = cut_lineage(dealt.groupBy("block").applyInPandas(_plans, "block int, plan binary")) if blocks else None
    parts = []
    for first in range(0, blocks, ROUND_BLOCKS):
        # A round's plans are bounded by ROUND_BLOCKS blocks of about BLOCK_TERMS terms.
        chosen = planned.filter(F.col("block").between(first, first + ROUND_BLOCKS - 1)).orderBy("block").collect()
        plans = [pickle.loads(r["plan"]) for r in chosen]
        words = Vocabulary(plans)
        send = spark.sparkContext.broadcast
        vocabulary = send(words)
        hits = cut_lineage(rows.mapInArrow(_hits(vocabulary), HITS).filter("n > 0"))
        n_docs, all_terms = hits.agg(F.count(F.lit(1)), F.sum("n")).first()
        if not n_docs:
            break
        counted = hits.select("terms").mapInArrow(_document_counts(len(words.terms)), "term long, df long")
        weights = np.zeros(len(words.terms), "int64")
        for r in counted.groupBy("term").agg(F.sum("df").alias("df")).collect():
            weights[r["term"]] = weight(n_docs, r["df"])
        score = _scored(send(plans), vocabulary, send(weights), n_docs, all_terms, k)
        found = hits.mapInArrow(score, FOUND)
        # Tasks in groups first, so that no item gathers rows of every task at once.
        some = _first(found.withColumn("_group", F.floor(F.col("part") / MERGED_TASKS)), ["row", "_group"], k)
        parts.append(cut_lineage(_first(some.drop("_group", "rank"), ["row"], k)))
    found = parts[0] if parts else spark.createDataFrame([], f"{FOUND}, rank int")
    for other in parts[1:]:
        found = found.unionByName(other)
    return found.join(asked.select("row", "item"), "row").select(
        F.col("item").alias(item_col), "rank", F.col("id").alias(id_col), "score"
    )
