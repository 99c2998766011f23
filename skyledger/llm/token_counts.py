"""Token counts of whole texts; huge ones are encoded as overlapping chunks on many tasks.

A document longer than ``chunk_chars`` is cut into chunks that overlap. Each chunk is encoded
with offsets, on its own task, and reports for both overlap zones where its pre-tokens begin
and how many tokens lie before. Two neighbours are spliced at the first common boundary that
is proven stable:

* the scan into pre-tokens moves forward only, so what follows a boundary does not depend on
  what precedes it: if the left chunk (right from its own start on, by induction) and the right
  chunk both have a boundary at one place, the right one is right from there on;
* boundaries near a chunk's cut end, where the pattern may still look ahead, do not count;
* nor does a place whose next character could combine with the one before it when the text is
  normalised.

Where a pair has no such place (one endless word, say), the document is encoded anew with
overlaps and chunks several times as wide, in the end as one chunk, which is the plain call.
"""

from __future__ import annotations

import unicodedata
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import cut_lineage
from .common import part_count, sliced
from .pieces import field_counter, load_tokenizer

CHUNK_CHARS = 1 << 15
OVERLAP_CHARS = 256
WIDEN = 8
MARGIN_CHARS = 32

#: Starters that may still combine with what precedes them, beside marks (fixed values of the standard).
LATE_JAMO = ((0x1161, 0x1175), (0x11A8, 0x11C2), (0x16D63, 0x16D6A))


def begins_afresh(ch: str) -> bool:
    """True where normalisation never joins this character to the one before."""
    code = ord(ch)
    return not unicodedata.category(ch).startswith("M") and not any(a <= code <= b for a, b in LATE_JAMO)


def chunk_edges(tok, text: str, start: int, overlap: int, first: bool, last: bool) -> dict:
    """Encode one chunk: its token count, and the boundaries in its head and tail zones."""
    enc = tok.encode(text, add_special_tokens=False)
    words, offsets = enc.word_ids, enc.offsets
    starts = [i for i in range(1, len(words)) if words[i] != words[i - 1] or words[i] is None]
    sound = starts if last else starts[:-2]
    sound = [(offsets[i][0], i) for i in sound if offsets[i - 1][1] <= offsets[i][0] and begins_afresh(text[offsets[i][0]])]
    end = len(text) if last else len(text) - MARGIN_CHARS
    head = [] if first else [(p + start, i) for p, i in sound if p < overlap and p <= end]
    tail = [] if last else [(p + start, i) for p, i in sound if len(text) - overlap <= p <= end]
    return {
        "total": len(words),
        "head_at": [p for p, _ in head], "head_n": [i for _, i in head],
        "tail_at": [p for p, _ in tail], "tail_n": [i for _, i in tail],
    }


def splice(chunks: list[dict]) -> int | None:
    """Tokens of a document from its chunks in order; None where a pair has no common boundary."""
    total, begun = 0, 0
    for left, right in zip(chunks, chunks[1:]):
        common = sorted(set(left["tail_at"]) & set(right["head_at"]))
        if not common:
            return None
        upto = left["tail_n"][bisect_left(left["tail_at"], common[0])]
        total += upto - begun
        begun = right["head_n"][bisect_left(right["head_at"], common[0])]
    return total + chunks[-1]["total"] - begun


def _cut(step: int, overlap: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in sliced(batches, "text"):
            for key, text in zip(batch.column("key").to_pylist(), texts):
                spans = range(0, max(1, len(text) - overlap), step)
                for i, a in enumerate(spans):
                    yield pa.RecordBatch.from_pydict({
                        "key": [key], "i": pa.array([i], pa.int32()), "start": [a],
                        "last": [i + 1 == len(spans)], "chunk": [text[a : a + step + overlap]],
                    })

    return cut


EDGES = "key string, i int, total long, head_at array<long>, head_n array<long>, tail_at array<long>, tail_n array<long>"


def _edges(path: str, overlap: int):
    def edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = load_tokenizer(path)
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                found = chunk_edges(tok, r["chunk"], r["start"], overlap, r["i"] == 0, r["last"])
                rows.append({"key": r["key"], "i": r["i"], **found})
            if rows:
                yield pa.RecordBatch.from_pylist(rows, _EDGES_ARROW)

    return edges


_LONGS = pa.list_(pa.int64())
_EDGES_ARROW = pa.schema([
    ("key", pa.string()), ("i", pa.int32()), ("total", pa.int64()),
    ("head_at", _LONGS), ("head_n", _LONGS), ("tail_at", _LONGS), ("tail_n", _LONGS),
])


def _spliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys = batch.column("key").to_pylist()
        totals = [splice(chunks) for chunks in batch.column("chunks").to_pylist()]
        yield pa.RecordBatch.from_pydict({"key": keys, "n_tokens": pa.array(totals, pa.int64())})


def _huge_counts(huge: DataFrame, path: str, step: int, overlap: int) -> DataFrame:
    """(key, n_tokens) of every distinct text of ``huge`` (key, text)."""
    size = huge.agg(F.sum(F.octet_length("text")), F.max(F.length("text"))).first()
    if not size[0]:
        return huge.select("key", F.lit(0).cast("long").alias("n_tokens")).limit(0)
    parts = part_count(size[0], 4 << 20)
    done, left = None, huge
    while True:
        # Copies of a text meet in one key, and the map side drops them before the shuffle.
        chunks = left.mapInArrow(_cut(step, overlap), "key string, i int, start long, last boolean, chunk string")
        spread = chunks.groupBy("key", "i").agg(
            F.first("start").alias("start"), F.first("last").alias("last"), F.first("chunk").alias("chunk")
        ).repartition(parts, "key", "i")
        edges = spread.mapInArrow(_edges(path, overlap), EDGES)
        rows = edges.groupBy("key").agg(F.array_sort(F.collect_list(F.struct(
            "i", "total", "head_at", "head_n", "tail_at", "tail_n"))).alias("chunks"))
        counts = cut_lineage(rows.mapInArrow(_spliced, "key string, n_tokens long"))
        good = counts.filter("n_tokens is not null")
        done = good if done is None else done.unionByName(good)
        if step > size[1] or counts.filter("n_tokens is null").isEmpty():
            return done
        step, overlap = step * WIDEN, overlap * WIDEN
        left = huge.join(counts.filter("n_tokens is null").select("key"), "key", "left_semi")


def _small_counts(path: str):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = field_counter(path)
        for batch, texts in sliced(batches, "text"):
            out = batch.drop_columns(["text"])
            yield out.append_column("n_tokens", pa.array(counter.count(texts), pa.int64()))

    return count


def token_counts(
    df: DataFrame, path: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text",
    chunk_chars: int = CHUNK_CHARS, overlap_chars: int = OVERLAP_CHARS,
) -> DataFrame:
    """``id_col``, n_bytes, n_tokens and over_limit of every row, for a vocabulary that drops white space.

    Null and empty texts count 0 bytes and 0 tokens; null ids and repeated rows are kept, a row
    each; an empty table gives no rows; other columns, whatever their names, are not read.
    Every text is counted whole.
    """
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    rows = rows.withColumn("n_bytes", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long"))
    big = F.coalesce(F.length("text"), F.lit(0)) > chunk_chars
    kind = df.schema[id_col].dataType.simpleString()
    small = rows.filter(~big).mapInArrow(_small_counts(path), f"id {kind}, n_bytes long, n_tokens long")
    huge = rows.filter(big).withColumn("key", F.sha2("text", 256))
    counts = _huge_counts(huge.select("key", "text"), path, chunk_chars, overlap_chars)
    joined = huge.drop("text").join(counts, "key", "left").select("id", "n_bytes", "n_tokens")
    return small.unionByName(joined).select(
        F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")
    )
