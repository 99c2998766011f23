"""I-Match fingerprints from several randomised lexicons.

The lexicon holds the terms within a band of document frequency, relative to the number of
documents, so it has at most (mean distinct terms of a document / lower bound) terms whatever
the corpus: a proven bound, which lets every worker hold it. Each of several subsets keeps
every lexicon term with a fixed chance, decided by a hash. A document's signature in a subset
is a hash over its sorted distinct terms there. Subsets come at several densities, so that
short and long documents alike find one in which they keep a term or two: there, documents
of similar vocabulary agree often, others hardly ever.

Document frequencies are exact and take two passes, as a term within the band must reach the
lower bound in the rows of some task: the first pass finds those, the second counts them.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import part_count, sliced

LEAST_SHARE, MOST_SHARE = 0.002, 0.2
DENSITIES = (1 / 4, 1 / 16, 1 / 64, 1 / 256, 1 / 1024)
SUBSETS = 24
DIGITS = 4
FEW_TERMS = 8
#: Candidate terms up to this number are sent to every task; beyond it the join decides for itself.
BROADCAST_TERMS = 1_000_000
HELD_TERMS = 2_000_000
ODD = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)


def terms_of(text: str) -> set[bytes]:
    """Distinct words of a text, ASCII letters lower-cased."""
    return set(text.encode().lower().split())


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(ODD[1])
    x = (x ^ (x >> np.uint64(27))) * np.uint64(ODD[2])
    return x ^ (x >> np.uint64(31))


def term_hashes(terms: list[bytes]) -> np.ndarray:
    return pd.util.hash_array(np.array([*terms, None], dtype=object)[:-1], categorize=False) if terms else np.zeros(0, "uint64")


def subset_values(hashes: np.ndarray) -> np.ndarray:
    """A row per term, a column per subset: the term's share in that subset's signature, 0 where it is not in it."""
    seeds = _mix(np.arange(1, 1 + len(DENSITIES) * SUBSETS, dtype="uint64") * np.uint64(ODD[0]))
    mixed = _mix(hashes[:, None] ^ seeds[None, :])
    limits = np.repeat([int(d * 2**64) - 1 for d in DENSITIES], SUBSETS).astype("uint64")
    value = _mix(mixed + np.uint64(ODD[0])) >> np.uint64(32)
    return np.where(mixed <= limits, value | np.uint64(1), np.uint64(0))


@dataclass
class Lexicon:
    """Terms within the band, with their share in every subset."""

    rows: dict[bytes, int]
    values: np.ndarray

    @classmethod
    def of(cls, terms: list[bytes]) -> Lexicon:
        terms = sorted(terms)
        return cls({t: i for i, t in enumerate(terms)}, subset_values(term_hashes(terms)).astype("uint32"))

    def signatures(self, text: str) -> np.ndarray:
        """One number per subset, 0 where the document has no term in it.

        A document with few terms in the band is described by all its terms instead.
        """
        terms = terms_of(text)
        known = sorted(filter(None.__ne__, map(self.rows.get, terms)))
        if len(known) >= FEW_TERMS:
            parts = self.values[known].astype("uint64")
        else:
            parts = subset_values(term_hashes(sorted(terms)))
        total = parts.sum(axis=0, dtype="uint64")
        # Equal term lists give equal sums, and the mix spreads the others.
        mask = np.uint64(16**DIGITS - 1)
        short = _mix(total + np.uint64(ODD[0])) % mask + np.uint64(1)
        return np.where((parts != 0).any(axis=0), short, np.uint64(0)).astype("uint32")


def as_text(signatures: np.ndarray) -> str:
    return "".join([f"{s:0{DIGITS}x}" for s in signatures.tolist()])


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of equal signatures among those of the sparsest density at which half of the subsets keep a term.

    Two documents without terms are alike (1.0).
    """
    informative = ((a != 0) | (b != 0)).reshape(len(DENSITIES), SUBSETS)
    equal = ((a == b) & (a != 0)).reshape(len(DENSITIES), SUBSETS)
    counts = informative.sum(axis=1)
    usable = np.flatnonzero(counts * 2 >= SUBSETS)
    level = usable[-1] if len(usable) else int(counts.argmax())
    return float(equal[level].sum() / counts[level]) if counts[level] else 1.0


def _local_counts(share: float | None):
    """Terms with the number of rows that hold them, per task; with ``share`` only those above that share of its rows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        n = 0

        def out(least):
            kept = [(t, c) for t, c in found.items() if c >= least]
            return pa.RecordBatch.from_pydict({
                "term": pa.array([t for t, _ in kept], pa.binary()), "n": pa.array([c for _, c in kept], pa.int64())
            })

        for batch, texts in sliced(batches, "text"):
            for text in texts:
                found.update(terms_of(text))
            n += len(texts)
            if len(found) > HELD_TERMS:
                # What is handed on early counts as a task of its own, so no frequent term is lost.
                yield out(share * n if share else 0)
                found.clear()
                n = 0
        yield out(share * n if share else 0)

    return count


def _known_counts(terms):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        for _, texts in sliced(batches, "text"):
            for text in texts:
                found.update(terms.value & terms_of(text))
        yield pa.RecordBatch.from_pydict({
            "term": pa.array(list(found), pa.binary()), "n": pa.array(list(found.values()), pa.int64())
        })

    return count


def document_frequencies(df: DataFrame, least: float = LEAST_SHARE, text_col: str = "text") -> DataFrame:
    """Exact (term, df, docs) of every term in at least ``least`` of all rows."""
    texts = df.select(F.col(text_col).alias("text"))
    docs = texts.count()
    likely = texts.mapInArrow(_local_counts(least), "term binary, n long").select("term").distinct()
    terms = [bytes(r[0]) for r in likely.limit(BROADCAST_TERMS + 1).collect()]
    if len(terms) <= BROADCAST_TERMS:
        counts = texts.mapInArrow(_known_counts(df.sparkSession.sparkContext.broadcast(frozenset(terms))), "term binary, n long")
    else:
        counts = texts.mapInArrow(_local_counts(None), "term binary, n long").join(likely, "term", "left_semi")
    return counts.groupBy("term").agg(F.sum("n").alias("df")).filter(F.col("df") >= least * docs).withColumn("docs", F.lit(docs))


def build_lexicon(df: DataFrame, least: float = LEAST_SHARE, most: float = MOST_SHARE, text_col: str = "text") -> Lexicon:
    """Terms whose document frequency lies in the band [least, most] of all rows."""
    found = document_frequencies(df, least, text_col).filter(F.col("df") <= F.greatest(most * F.col("docs"), F.lit(1)))
    return Lexicon.of([bytes(r[0]) for r in found.select("term").collect()])


def _mark(lexicon, bounds: list[int]):
    edges = np.array(bounds, "int64")

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in sliced(batches, "text"):
            fixed = batch.column("fixed").to_pylist()
            spots = np.searchsorted(edges, np.asarray(batch.column("at")), side="right")
            yield pa.RecordBatch.from_pydict({
                "bucket": pa.array([s if f is None else f for s, f in zip(spots.tolist(), fixed)], pa.int32()),
                "extra": pa.array([f is not None for f in fixed]), "at": batch.column("at"), "id": batch.column("id"),
                "text": pa.array(texts, pa.string()),
                "marks": pa.array([lexicon.value.signatures(t).astype("<u2").tobytes() for t in texts], pa.binary()),
            })

    return mark


def _compare(lexicon, id_type: pa.DataType):
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None

        def row(one, after):
            _, i, text, marks = one
            half = len(text) // 2
            edited = text[: len(text) - half] + after[2][:half]
            own, new = np.frombuffer(marks, "<u2"), lexicon.value.signatures(edited)
            return (
                i, len(text), hashlib.sha256(edited.encode()).hexdigest(), as_text(own), as_text(new),
                likeness(own, new), likeness(own, np.frombuffer(after[3], "<u2")),
            )

        for batch in batches:
            rows = []
            for bucket, extra, i, text, marks in zip(*(batch.column(c).to_pylist() for c in ("bucket", "extra", "id", "text", "marks"))):
                one = (bucket, i, text, marks)
                if held is not None and held[0] == bucket:
                    rows.append(row(held, one))
                # The first row borrowed from the next bucket ends this one.
                held = None if extra else one
            names = ("id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
            types = (id_type, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
            columns = zip(*rows) if rows else [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], list(names))

    return compare


def _bucket_of(bounds: list[int]):
    edges = np.array(bounds, "int64")

    def bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spots = np.searchsorted(edges, np.asarray(batch.column("at")), side="right")
            yield batch.append_column("bucket", pa.array(spots, pa.int32()))

    return bucket


def compare_with_edits(df: DataFrame, lexicon: Lexicon, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text, and how alike they are.

    The edited text ends with the beginning of the next document, by ascending id (repeated
    ids by text), the last one's next being the first. Null ids come first, null texts are
    empty, an empty text stays empty. An empty table gives no rows. The rows of a range of
    ids pass through one sorted task; only the first document of each range is sent twice.
    """
    rows = df.select(
        F.col(id_col).alias("id"), F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63))).alias("at"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )
    kind = rows.schema["id"].dataType.simpleString()
    size = rows.agg(F.count(F.lit(1)), F.sum(F.octet_length("text"))).first()
    parts = part_count(size[1] or 0, 16 << 20)
    bounds: list[int] = []
    if parts > 1:
        steps = [i / parts for i in range(1, parts)]
        bounds = sorted(set(rows.agg(F.percentile_approx("at", steps, max(10_000, 20 * parts))).first()[0] or []))
    firsts = rows.select("at").mapInArrow(_bucket_of(bounds), "at long, bucket int").groupBy("bucket").agg(F.min("at"))
    # One row per range.
    heads = sorted((r[0], r[1]) for r in firsts.collect())
    borrowed = [(at, heads[i - 1][0]) for i, (_, at) in enumerate(heads)]
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast(lexicon)
    loans = spark.createDataFrame(borrowed, "at long, fixed int")
    extras = rows.join(F.broadcast(loans), "at").select("id", "at", "text", "fixed")
    both = rows.withColumn("fixed", F.lit(None).cast("int")).unionByName(extras)
    marked = both.mapInArrow(
        _mark(shared, bounds), f"bucket int, extra boolean, at long, id {kind}, text string, marks binary"
    )
    dealt = marked.repartition(2 * parts, "bucket").sortWithinPartitions("bucket", "extra", "at", "text")
    from pyspark.sql.pandas.types import to_arrow_type

    out = (
        f"id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
        "near_edited double, near_next double"
    )
    found = dealt.mapInArrow(_compare(shared, to_arrow_type(rows.schema["id"].dataType)), out)
    return found.withColumnRenamed("id", id_col)


def _fingerprints(lexicon):
    def fingerprint(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in sliced(batches, "text"):
            prints = [as_text(lexicon.value.signatures(t)) for t in texts]
            yield batch.drop_columns(["text"]).append_column("fingerprint", pa.array(prints, pa.string()))

    return fingerprint


def fingerprints(df: DataFrame, lexicon: Lexicon, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(``id_col``, fingerprint) of every row; null texts count as empty, whose fingerprint is all zeros."""
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    shared = df.sparkSession.sparkContext.broadcast(lexicon)
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(_fingerprints(shared), f"id {kind}, fingerprint string").withColumnRenamed("id", id_col)
