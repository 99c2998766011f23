"""Language of texts by the nearest of several centroids per language.

A text becomes the TF-IDF vector of its letter n-grams of one to three, in lower case, where
anything but letters is one gap; n-grams are hashed to ``1 << BITS`` coordinates, so vectors,
document frequencies and centroids have a fixed size whatever the corpus. Document frequencies
are counted over all learned texts. Each language's centroids come from spherical k-means over
a bounded sample of its different texts (``SAMPLE``, the least hashes of the texts). A text
gets the language of the centroid of largest cosine.

Every learned text is then scored as all others are, and the quantile of its languages'
cosines is the distance beyond which a text is rejected: it is unlike all that was learned.
"""

from __future__ import annotations

import functools
import re
import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..session import cut_lineage
from .common import sliced

BITS = 14
CENTROIDS = 4
SAMPLE = 1_024
ROUNDS = 8
REJECTED = 0.001
BLOCK_LANGUAGES = 128
BROADCAST_LANGUAGES = 100_000
UNKNOWN = "und"

_ODD = (np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D))
_LETTER = re.compile(r"[^\W\d_]")


@functools.lru_cache(maxsize=1)
def _is_letter() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(sys.maxunicode + 1)])


def has_letter(text: str) -> bool:
    return _LETTER.search(text) is not None


def gram_hashes(text: str) -> np.ndarray:
    """Coordinates of the letter n-grams of one to three; a gap stands before, after and between words."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    codes = np.where(_is_letter()[codes], codes, np.uint32(0))
    codes = np.concatenate([[np.uint32(0)], codes, [np.uint32(0)]])
    codes = codes[np.concatenate([[True], (codes[1:] != 0) | (codes[:-1] != 0)])]
    one = (codes + np.uint32(1)) * _ODD[0]
    two = (one[:-1] ^ (one[:-1] >> np.uint32(15))) * _ODD[1] + codes[1:] * _ODD[2]
    three = (two[:-1] ^ (two[:-1] >> np.uint32(13))) * _ODD[0] + codes[2:] * _ODD[1]
    every = np.concatenate([one[codes != 0], two, three])
    return (every ^ (every >> np.uint32(16))) * _ODD[2] >> np.uint32(32 - BITS)


def counts(text: str) -> np.ndarray:
    return np.bincount(gram_hashes(text), minlength=1 << BITS)


def vectors(texts: list[str], idf: np.ndarray) -> np.ndarray:
    """A row per text: square roots of counts times ``idf``, of length 1 (0 without letters)."""
    out = np.empty((len(texts), 1 << BITS), "float32")
    for k, text in enumerate(texts):
        out[k] = counts(text) if has_letter(text) else 0
    np.sqrt(out, out=out)
    out *= idf
    norms = np.sqrt(np.einsum("ij,ij->i", out, out))
    return out / np.maximum(norms, 1e-12)[:, None]


def _document_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = np.zeros(1 << BITS, "int64")
    for _, texts in sliced(batches, "text"):
        for text in filter(has_letter, texts):
            held += counts(text) > 0
    some = np.flatnonzero(held)
    yield pa.RecordBatch.from_pydict({"gram": pa.array(some, pa.int64()), "n": pa.array(held[some], pa.int64())})


def _sparse(idf):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in sliced(batches, "text", 1 << 18):
            found = vectors(texts, idf.value)
            rows = [(np.flatnonzero(v), v) for v in found]
            yield pa.RecordBatch.from_pydict({
                "lang": batch.column("lang"), "key": batch.column("key"),
                "at": pa.array([i.astype("<u2").tobytes() for i, _ in rows], pa.binary()),
                "value": pa.array([v[i].astype("<f2").tobytes() for i, v in rows], pa.binary()),
            })

    return scan


def cluster(rows: np.ndarray, k: int, rounds: int = ROUNDS) -> np.ndarray:
    """At most ``k`` unit centroids of unit rows: far points to begin with, then means of the nearest rows."""
    mean = rows.mean(axis=0)
    chosen = [int((rows @ mean).argmax())]
    near = rows @ rows[chosen[0]]
    while len(chosen) < k and near.min() < 1 - 1e-6:
        # The point at the tenth of the distances, not the outermost: junk lies there.
        chosen.append(int(np.argsort(near, kind="stable")[len(near) // 10]))
        near = np.maximum(near, rows @ rows[chosen[-1]])
    centres = rows[chosen]
    for _ in range(rounds):
        owner = (rows @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, owner, rows)
        norms = np.linalg.norm(sums, axis=1)
        centres = (sums / np.maximum(norms, 1e-12)[:, None])[norms > 0]
    return centres


def _centroids(k: int):
    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("key")
        rows = np.zeros((len(pdf), 1 << BITS), "float32")
        for r, (at, value) in enumerate(zip(pdf["at"], pdf["value"])):
            rows[r, np.frombuffer(at, "<u2")] = np.frombuffer(value, "<f2")
        rows = rows[np.linalg.norm(rows, axis=1) > 0]
        found = cluster(rows, k) if len(rows) else rows
        return pd.DataFrame({"lang": [pdf["lang"].iloc[0]] * len(found), "centroid": [c.astype("<f4").tobytes() for c in found]})

    return fit


def fit_centroids(learned: DataFrame, k: int = CENTROIDS, sample: int = SAMPLE) -> tuple[np.ndarray, list[tuple[str, np.ndarray]]]:
    """The idf of all learned texts, and (lang, centroid) of the languages in order.

    ``learned`` has text and lang, neither null. The sample of a language is about ``sample``
    of its different texts, at most twice as many.
    """
    spark = learned.sparkSession
    total, dfs = learned.count(), np.zeros(1 << BITS, "int64")
    for r in learned.select("text").mapInArrow(_document_counts, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect():
        dfs[r["gram"]] = r["n"]
    idf = (np.log((1 + total) / (1 + dfs)) + 1).astype("float32")
    # Texts below a hash that lets through about ``sample`` of a language; copies are one text.
    sizes = learned.groupBy("lang").agg(F.count(F.lit(1)).alias("_n"))
    key = F.xxhash64("text")
    share = F.pmod(key, F.lit(1 << 40)) / float(1 << 40)
    sizes = cut_lineage(sizes.select(F.col("lang").alias("_lang"), "_n"))
    few = F.broadcast(sizes) if sizes.count() <= BROADCAST_LANGUAGES else sizes
    picked = learned.join(few, F.col("lang") == F.col("_lang")).filter(share * F.col("_n") < sample)
    picked = picked.groupBy("lang", key.alias("key")).agg(F.first("text").alias("text"))
    vectors_ = cut_lineage(picked.mapInArrow(_sparse(spark.sparkContext.broadcast(idf)), "lang string, key long, at binary, value binary"))
    # Fewer different texts than rows never let through more; chance alone stays far below twice.
    found = vectors_.groupBy("lang").applyInPandas(_centroids(k), "lang string, centroid binary")
    rows = sorted(((r["lang"], bytes(r["centroid"])) for r in found.collect()), key=lambda r: r)
    return idf, [(lang, np.frombuffer(c, "<f4")) for lang, c in rows]


def _nearest(idf, block, kept: list[str]):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs = sorted({lang for lang, _ in block.value})
        matrix = np.stack([c for _, c in block.value], axis=1)
        starts = np.searchsorted([lang for lang, _ in block.value], langs)
        for batch, texts in sliced(batches, "text", 1 << 18):
            lettered = np.array([has_letter(t) for t in texts], bool)
            cosines = np.clip(vectors(texts, idf.value) @ matrix, 0, 1)
            best = np.maximum.reduceat(cosines, starts, axis=1)
            top = best.argmax(axis=1)  # the first language of equal ones
            scores = np.where(lettered, best[np.arange(len(texts)), top], 0).astype("float64")
            yield batch.select(kept).append_column("lettered", pa.array(lettered)).append_column("score", pa.array(scores)).append_column(
                "nearest", pa.array([langs[t] if ok else None for t, ok in zip(top, lettered)], pa.string())
            )

    return score


def identify(
    df: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", k: int = CENTROIDS,
    sample: int = SAMPLE, rejected: float = REJECTED,
) -> DataFrame:
    """Per row: ``id_col``, nearest (language, null without letters), score (cosine), rejected and lang.

    Learned are the rows that fulfil ``learn`` and have a language and a letter; a row's own
    language and id have no part in its prediction. A text is rejected below the ``rejected``
    quantile of the cosines of its nearest language's learned texts; ``lang`` is ``und`` for it
    and for texts without letters (null and empty ones too), which are always rejected, and so
    is every text when nothing is learned. Equal cosines go to the first language by name.
    Repeated rows are predicted each, equal texts alike, whole texts of any length; an empty
    table gives no rows.
    """
    send = df.sparkSession.sparkContext.broadcast
    rows = df.select(
        F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"),
        F.coalesce(learn, F.lit(False)).alias("learn"),
    )
    idf, centroids = fit_centroids(rows.filter("learn and text is not null and lang is not null").select("text", "lang"), k, sample)
    plain = rows.withColumn("learn", F.col("learn") & F.col("lang").isNotNull()).select("id", "text", "learn", F.xxhash64("text").alias("key"))
    kinds = f"id {df.schema[id_col].dataType.simpleString()}, learn boolean, key long, lettered boolean, score double, nearest string"
    names = sorted({lang for lang, _ in centroids})
    blocks = [set(names[i : i + BLOCK_LANGUAGES]) for i in range(0, len(names), BLOCK_LANGUAGES)]
    if not blocks:
        nothing = F.lit(None).cast("string")
        return rows.select(
            F.col("id").alias(id_col), nothing.alias("nearest"), F.lit(0.0).alias("score"), F.lit(True).alias("rejected"), F.lit(UNKNOWN).alias("lang")
        )
    shared = send(idf)
    found = None
    for names in blocks:
        block = send([c for c in centroids if c[0] in names])
        part = plain.mapInArrow(_nearest(shared, block, ["id", "learn", "key"]), kinds)
        found = part if found is None else found.unionByName(part)
    if len(blocks) > 1:
        # A row per block of languages; rows of one id and text are alike, and are counted.
        ordered = F.struct((-F.col("score")).alias("far"), F.col("nearest"))
        found = found.groupBy("id", "learn", "key", "lettered").agg(F.min(ordered).alias("best"), F.count(F.lit(1)).alias("rows"))
        times = F.explode(F.array_repeat(F.lit(1), (F.col("rows") / len(blocks)).cast("int")))
        found = found.select("id", "learn", "lettered", (-F.col("best")["far"]).alias("score"), F.col("best")["nearest"].alias("nearest"), times.alias("_"))
    found = cut_lineage(found.select("id", "learn", "lettered", "score", "nearest"))
    limits = found.filter("learn and lettered").groupBy(F.col("nearest").alias("_nearest")).agg(
        F.percentile_approx("score", rejected, 10_000).alias("_limit")
    )
    # At most one row per language that has centroids, which the driver held already.
    judged = found.join(F.broadcast(limits), F.col("nearest") == F.col("_nearest"), "left")
    far = ~F.col("lettered") | (F.col("score") < F.coalesce("_limit", F.lit(0.0)))
    return judged.select(
        F.col("id").alias(id_col), "nearest", "score", far.alias("rejected"), F.when(far, UNKNOWN).otherwise(F.col("nearest")).alias("lang")
    )
