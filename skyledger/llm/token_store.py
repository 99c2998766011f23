"""A file format for token ids in which short documents are cheap to reach.

Every document is one zstandard frame of its ids. All frames share a dictionary trained on
serialized id arrays, so that short ones compress too; a segment row names the dictionary by
its SHA-256. A segment holds the frames of consecutive documents one after another, with the
offset of each frame, so one document is read without decompressing its neighbours.

Layout of a store folder, all written by Spark's own writer:
``dictionary`` one row (sha256, content, width, end_id); ``segments`` rows (bucket, segment,
before, dict_sha256, doc_ids, n_tokens, offsets, payload), in ascending order of ids, where
``before`` counts the tokens earlier in the bucket; ``starts`` rows (bucket, tokens before it).
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql import Window as W

from .common import part_count, sliced, text_batches, tidy
from .pieces import byte_encoder

DICT_BYTES = 64 << 10
SAMPLE_DOCS = 2_000
BUCKET_DOCS = 8_192
SAMPLE_CHARS = 4_096
SEGMENT_BYTES = 2 << 20
SEGMENT_DOCS = 4_096
SLICE_CHARS = 4 << 20
LEVEL = 1


def train_dictionary(encoded: list[bytes], size: int = DICT_BYTES) -> bytes:
    """The shared dictionary; empty where the sample is too small to train one."""
    try:
        return zstandard.train_dictionary(size, [e for e in encoded if len(e) >= 8]).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b""


def _shared(content: bytes):
    return zstandard.ZstdCompressionDict(content) if content else None


def _encode(path: str, end_id: int, width: int, content: bytes, bounds: list):
    end = int(end_id).to_bytes(width, "little")
    edges = np.array(bounds, dtype="int64")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = byte_encoder(path, width)
        packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=_shared(content))
        for batch, texts in sliced(batches, "text", SLICE_CHARS):
            ids = batch.column("id")
            packed = [e + end for e in encoder.encode(texts)]
            spots = np.searchsorted(edges, np.asarray(ids.fill_null(np.iinfo("int64").min)), side="right")
            yield pa.RecordBatch.from_pydict({
                "bucket": pa.array(spots, pa.int32()), "id": ids,
                "n": pa.array([len(p) // width for p in packed], pa.int64()),
                "frame": pa.array([packer.compress(p) for p in packed], pa.binary()),
            })

    return encode


_SEGMENT = pa.schema([
    ("bucket", pa.int32()), ("segment", pa.int32()), ("before", pa.int64()), ("dict_sha256", pa.string()), ("doc_ids", pa.list_(pa.int64())),
    ("n_tokens", pa.list_(pa.int64())), ("offsets", pa.list_(pa.int64())), ("payload", pa.binary()),
])
SEGMENT = (
    "bucket int, segment int, before long, dict_sha256 string, doc_ids array<long>, n_tokens array<long>, "
    "offsets array<long>, payload binary"
)


def _segments(digest: str):
    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, number, before, ids, sizes, frames, held = None, 0, 0, [], [], [], 0

        def flush():
            offsets = np.concatenate([[0], np.cumsum([len(f) for f in frames])]).tolist()
            return pa.RecordBatch.from_pylist([{
                "bucket": bucket, "segment": number, "before": before, "dict_sha256": digest, "doc_ids": ids, "n_tokens": sizes,
                "offsets": offsets, "payload": b"".join(frames),
            }], _SEGMENT)

        for batch in batches:
            for b, i, n, frame in zip(*(batch.column(c).to_pylist() for c in ("bucket", "id", "n", "frame"))):
                if frames and (b != bucket or held + len(frame) > SEGMENT_BYTES or len(frames) >= SEGMENT_DOCS):
                    yield flush()
                    number, before, ids, sizes, frames, held = number + 1, before + sum(sizes), [], [], [], 0
                if b != bucket:
                    bucket, number, before = b, 0, 0
                ids.append(i), sizes.append(n), frames.append(frame)
                held += len(frame)
        if frames:
            yield flush()

    return segments


def _sampled(rows: DataFrame, n_rows: int) -> DataFrame:
    """The windows that train the dictionary: of the documents whose hash lets through about ``SAMPLE_DOCS``; equal rows are one."""
    drawn = F.xxhash64("id", "text")
    chosen = rows.withColumn("drawn", drawn).filter(F.pmod("drawn", F.lit(1 << 40)) * float(n_rows) < float(SAMPLE_DOCS << 40))
    start = F.pmod(F.shiftrightunsigned("drawn", 42), F.greatest(F.lit(1), F.length("text") - SAMPLE_CHARS + 1)).cast("int")
    return chosen.select("drawn", F.substring("text", start + 1, F.lit(SAMPLE_CHARS)).alias("window")).groupBy("drawn").agg(F.first("window").alias("window"))


def write_store(
    df: DataFrame, folder: str, path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", width: int = 2
) -> None:
    """Encode every text of ``df``, add ``end_id`` to each and write the store to ``folder``.

    Ids are written ascending, null ids first; repeated ids follow one another in order of
    length, then content. A null text is empty and holds the end id alone; an empty table
    gives a store without segments. ``width`` is the bytes of an id (2 up to 65,536 ids).
    The dictionary is trained on about ``SAMPLE_DOCS`` documents that a hash draws from the whole table, at a
    window of ``SAMPLE_CHARS`` characters whose place the hash gives too; every document is encoded
    and written whole.
    """
    spark = df.sparkSession
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    n_rows = rows.count()
    parts = part_count(n_rows, BUCKET_DOCS)
    bounds = []
    if parts > 1:
        steps = [i / parts for i in range(1, parts)]
        bounds = rows.agg(F.percentile_approx("id", steps, max(10_000, 20 * parts))).first()[0] or []
    sample_texts = [r["window"] for r in _sampled(rows, n_rows).orderBy("drawn").collect()]
    encoder, step = byte_encoder(path, width), SLICE_CHARS // SAMPLE_CHARS
    content = train_dictionary([e for i in range(0, len(sample_texts), step) for e in encoder.encode(sample_texts[i : i + step])])
    digest = hashlib.sha256(content).hexdigest()
    frames = rows.mapInArrow(tidy(_encode(path, end_id, width, content, bounds)), "bucket int, id long, n long, frame binary")
    ordered = frames.repartition(2 * parts, "bucket").sortWithinPartitions("bucket", "id", "n", "frame")
    with text_batches(spark):
        ordered.mapInArrow(tidy(_segments(digest)), SEGMENT).write.parquet(f"{folder}/segments")
    head = spark.createDataFrame([(digest, bytearray(content), width, end_id)], "sha256 string, content binary, width int, end_id int")
    head.coalesce(1).write.parquet(f"{folder}/dictionary")
    # One row per bucket, so the running sum is over a short table.
    totals = spark.read.parquet(f"{folder}/segments").groupBy("bucket").agg(
        F.sum(F.aggregate("n_tokens", F.lit(0).cast("long"), lambda a, x: a + x)).alias("tokens")
    )
    before = F.sum("tokens").over(W.partitionBy(F.lit(0)).orderBy("bucket").rowsBetween(W.unboundedPreceding, -1))
    totals.select("bucket", F.coalesce(before, F.lit(0)).alias("start")).write.parquet(f"{folder}/starts")


def _crc(raw: bytes, width: int) -> int:
    return zlib.crc32(np.frombuffer(raw, f"<u{width}").astype("<u4").tobytes())


def _decode(content: bytes, width: int, digest: bool):
    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpacker = zstandard.ZstdDecompressor(dict_data=_shared(content))
        for batch in batches:
            for s in (batch.slice(i, 1).to_pylist()[0] for i in range(batch.num_rows)):
                payload = memoryview(s["payload"])
                raw = [unpacker.decompress(payload[a:b]) for a, b in zip(s["offsets"], s["offsets"][1:])]
                n = np.array(s["n_tokens"], dtype="int64")
                first = s["start"] + s["before"]
                yield pa.RecordBatch.from_pydict({
                    "id": pa.array(s["doc_ids"], pa.int64()),
                    "start": pa.array(first + np.cumsum(n) - n, pa.int64()), "n_tokens": pa.array(n, pa.int64()),
                    **(
                        {"ids_crc32": pa.array([_crc(r, width) for r in raw], pa.int64())}
                        if digest else {"ids": pa.array(raw, pa.binary())}
                    ),
                })

    return decode


def read_store(spark: SparkSession, folder: str, digest: bool = False) -> DataFrame:
    """Rows (id, start, n_tokens, ids) of a store, ids as little-endian numbers of the store's width.

    With ``digest`` the CRC-32 of the ids as 32-bit numbers, ``ids_crc32``, takes their place.
    """
    head = spark.read.parquet(f"{folder}/dictionary").first()
    content, width = bytes(head["content"]), head["width"]
    if hashlib.sha256(content).hexdigest() != head["sha256"]:
        raise ValueError(f"{folder}: the dictionary does not match its hash")
    segments = spark.read.parquet(f"{folder}/segments").filter(F.col("dict_sha256") == head["sha256"])
    # One short row per bucket; the payloads stay where they are unless that table is large.
    last = "ids_crc32 long" if digest else "ids binary"
    return segments.join(spark.read.parquet(f"{folder}/starts"), "bucket").mapInArrow(
        tidy(_decode(content, width, digest)), f"id long, start long, n_tokens long, {last}"
    )


def read_document(spark: SparkSession, folder: str, doc_id: int) -> list[list[int]]:
    """Ids of one document (of each row with that id), decompressing its frames alone."""
    head = spark.read.parquet(f"{folder}/dictionary").first()
    unpacker = zstandard.ZstdDecompressor(dict_data=_shared(bytes(head["content"])))
    spot = F.explode(F.sequence(F.lit(0), F.size("doc_ids") - 1))
    found = (
        spark.read.parquet(f"{folder}/segments").filter(F.array_contains("doc_ids", F.lit(doc_id)))
        .select("*", spot.alias("k")).filter(F.col("doc_ids")[F.col("k")] == doc_id)
    )
    frames = found.select(F.expr("substring(payload, cast(offsets[k] + 1 as int), cast(offsets[k + 1] - offsets[k] as int))"))
    return [np.frombuffer(unpacker.decompress(bytes(r[0])), dtype=f"<u{head['width']}").tolist() for r in frames.collect()]


def store_digests(spark: SparkSession, folder: str, id_col: str = "doc_id") -> DataFrame:
    """Per document of the store: start, n_tokens and the CRC-32 of its ids as 32-bit words."""
    return read_store(spark, folder, digest=True).withColumnRenamed("id", id_col)
