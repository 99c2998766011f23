"""Exact top-k inner products by block-at-a-time pruning.

A vector is a document with two terms per component, one for its positive and one for its
negated value; a query weighs the term of its own sign with its magnitude. Vectors are put
into coherent ranges (nearest of a few pivots, then id) and cut into blocks. A block keeps
its forward index (the vectors) and the maximum of every term. A query sums the maxima of
its terms per block, which bounds every score inside, visits blocks by falling bound, scores
each through its forward index, and stops once no bound reaches its k-th score; at a tie
the smallest id of the block decides.

Blocks are grouped into shards, and a batch of queries meets a shard in one task. Queries
first visit the shard they live in themselves, which gives the k-th score they start from
elsewhere. Queries times shards are met, the least work for a stated query set, in blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import Window as W

from ..session import cut_lineage
from .common import part_count

BLOCK_ROWS = 64
SHARD_BLOCKS = 64
QUERY_BATCH = 2_048
PIVOTS = 64
LOWEST = np.iinfo(np.int64).min
EXACT_IN_FLOAT = 2.0**53


def _quantise(values: list) -> list[np.ndarray | None]:
    """floor(256 x) of each vector; None where it is null or holds a null or non-finite component."""
    out = []
    for v in values:
        if v is None or any(x is None for x in v):
            out.append(None)
            continue
        wide = np.floor(np.asarray(v, dtype="float64") * 256)
        out.append(wide.astype("int64") if np.isfinite(wide).all() else None)
    return out


def _place(pivots: np.ndarray, width: int):
    """Pad to ``width``, quantise, and give the nearest pivot by cosine."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, ints = batch.column("id").to_pylist(), _quantise(batch.column("vector").to_pylist())
            kept = [(i, q, v) for i, q, v in zip(ids, batch.column("is_query").to_pylist(), ints) if v is not None and i is not None]
            if not kept:
                continue
            full = np.zeros((len(kept), width), "int64")
            for row, (_, _, v) in zip(full, kept):
                row[: len(v)] = v
            near = (full.astype("float64") @ pivots.T).argmax(1) if len(pivots) else np.zeros(len(kept), "int64")
            yield pa.RecordBatch.from_pydict({
                "pivot": pa.array(near, pa.int32()), "id": pa.array([i for i, _, _ in kept], pa.int64()),
                "is_query": pa.array([bool(q) for _, q, _ in kept]),
                "ints": pa.array([r.tobytes() for r in full], pa.binary()),
            })

    return place


class Blocks:
    """The blocks of a shard: forward indexes and term maxima."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, rows: int = BLOCK_ROWS):
        self.cuts = np.arange(0, len(ids), rows)
        self.ids, self.rows = ids, rows
        self.top = float(np.abs(vectors).max(initial=0))
        self.vectors = vectors
        self.most = np.maximum.reduceat(vectors, self.cuts, axis=0)  # maxima of the positive terms
        self.least = np.minimum.reduceat(vectors, self.cuts, axis=0)  # negated: maxima of the negative terms
        self.first_id = np.minimum.reduceat(ids, self.cuts)

    def search(self, qids: np.ndarray, queries: np.ndarray, k: int, floor: np.ndarray, floor_id: np.ndarray):
        """Per query its best (score, id) here, each at least (floor, floor_id); -1 ids where fewer. Also blocks scored."""
        reach = float(np.abs(queries).max(initial=0)) * self.top * max(1, queries.shape[1])
        kind = "float64" if reach < EXACT_IN_FLOAT else "int64"
        vectors, asked = self.vectors.astype(kind), queries.astype(kind)
        bound = np.maximum(asked, 0) @ self.most.astype(kind).T + np.minimum(asked, 0) @ self.least.astype(kind).T
        order = np.lexsort((np.broadcast_to(self.first_id, bound.shape), -bound), axis=1)
        scores = np.full((len(qids), k), LOWEST, "int64")
        ids = np.full((len(qids), k), -1, "int64")
        scored = 0
        active = np.arange(len(qids))
        for step in range(len(self.cuts)):
            block = order[active, step]
            edge = bound[active, block].astype("int64")
            kth, kth_id = scores[active, -1], ids[active, -1]
            kth_id = np.where(floor[active] > kth, floor_id[active], kth_id)
            kth = np.maximum(kth, floor[active])
            # The block may still hold one that is better, or as good with a smaller id.
            alive = (edge > kth) | ((edge == kth) & (self.first_id[block] <= kth_id))
            # Bounds fall from here on, so a bound below the k-th score ends the query.
            over = edge < kth
            todo = alive.nonzero()[0]
            for b in np.unique(block[todo]):
                rows = active[todo[block[todo] == b]]
                a, z = self.cuts[b], min(self.cuts[b] + self.rows, len(self.ids))
                got = (asked[rows] @ vectors[a:z].T).astype("int64")
                own = np.broadcast_to(self.ids[a:z], got.shape)
                here = own == qids[rows, None]
                got = np.where(here, LOWEST, got)
                both = np.concatenate([scores[rows], got], 1)
                names = np.concatenate([ids[rows], np.where(here, -1, own)], 1)
                best = np.lexsort((names, -both), axis=1)[:, :k] if both.min() > LOWEST else _best(both, names, k)
                scores[rows], ids[rows] = np.take_along_axis(both, best, 1), np.take_along_axis(names, best, 1)
                scored += len(rows)
            active = active[~over]
            if not len(active):
                break
        return scores, ids, scored


def _best(both: np.ndarray, names: np.ndarray, k: int) -> np.ndarray:
    """Order by falling score, then rising id; empty places (LOWEST) last."""
    # -LOWEST overflows, so empty places are ranked by a flag of their own.
    empty = names == -1
    return np.lexsort((names, -np.where(empty, 0, both), empty), axis=1)[:, :k]


def _vectors(blobs: list[bytes], width: int) -> np.ndarray:
    return np.frombuffer(b"".join(blobs), "int64").reshape(len(blobs), width)


def _home(k: int, width: int):
    """Per query its k-th (score, id) within its own shard, to start from elsewhere."""

    def home(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["pivot", "id"])
        blocks = Blocks(pdf["id"].to_numpy(), _vectors(list(pdf["ints"]), width))
        asked = pdf[pdf["is_query"]]
        n = len(asked)
        scores, ids, _ = blocks.search(
            asked["id"].to_numpy(), _vectors(list(asked["ints"]), width), k, np.full(n, LOWEST), np.full(n, -1)
        )
        return pd.DataFrame({
            "query_id": asked["id"], "ints": asked["ints"], "home": asked["shard"],
            "floor": scores[:, -1], "floor_id": ids[:, -1],
        })

    return home


def _meet(k: int, width: int):
    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": [], "blocks_scored": []}).astype("int64")
        left = left.sort_values(["pivot", "id"])
        blocks = Blocks(left["id"].to_numpy(), _vectors(list(left["ints"]), width))
        qids = right["query_id"].to_numpy()
        scores, ids, scored = blocks.search(
            qids, _vectors(list(right["ints"]), width), k, right["floor"].to_numpy(), right["floor_id"].to_numpy()
        )
        kept = ids != -1
        return pd.DataFrame({
            "query_id": np.repeat(qids, k)[kept.ravel()], "vec_id": ids[kept], "score": scores[kept], "blocks_scored": scored,
        })

    return meet


def block_topk(
    df: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding",
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest integer inner products of each query, exactly.

    Components become floor(256 x). Vectors that are null or hold a null or non-finite
    component take no part, nor do rows without an id; a shorter vector counts 0 beyond its
    end. Candidates are all rows but those of the query's own id; ties go to the smaller id.
    Rows that repeat one id are one candidate each. Fewer candidates than k give fewer rows,
    an empty table none. Ids are not negative. Scores beyond 64 bits wrap.
    """
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vector"), is_query.alias("is_query"))
    size = rows.agg(F.count(F.lit(1)), F.max(F.size("vector"))).first()
    width = max(1, size[1] or 1)
    step = max(1, size[0] // PIVOTS)
    # Pivots only shape the blocks; the result is exact with any. At most 4 x PIVOTS vectors are fetched.
    sample = rows.filter(F.pmod(F.xxhash64("id"), F.lit(step)) == 0).select("vector").limit(4 * PIVOTS).collect()
    found = [v.astype("float64") for v in _quantise([r[0] for r in sample]) if v is not None and v.any()][:PIVOTS]
    pivots = np.zeros((len(found), width))
    for row, v in zip(pivots, found):
        row[: len(v)] = v / np.linalg.norm(v)
    placed = cut_lineage(rows.mapInArrow(_place(pivots, width), "pivot int, id long, is_query boolean, ints binary"))
    shards = part_count(size[0], BLOCK_ROWS * SHARD_BLOCKS)
    dealt = placed.repartitionByRange(shards, "pivot", "id").withColumn("shard", F.spark_partition_id())
    dealt = cut_lineage(dealt)
    asked = cut_lineage(dealt.groupBy("shard").applyInPandas(
        _home(k, width), "query_id long, ints binary, home int, floor long, floor_id long"
    ))
    batches = part_count(asked.count(), QUERY_BATCH)
    asked = asked.withColumn("batch", F.pmod(F.xxhash64("query_id"), F.lit(batches)))
    last = dealt.agg(F.max("shard")).first()[0] or 0
    everywhere = asked.select("*", F.explode(F.sequence(F.lit(0), F.lit(last))).alias("shard"))
    blocks = dealt.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(batches - 1).cast("long"))).alias("batch"))
    met = blocks.groupBy("shard", "batch").cogroup(everywhere.groupBy("shard", "batch")).applyInPandas(
        _meet(k, width), "query_id long, vec_id long, score long, blocks_scored long"
    )
    first = W.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec_id"))
    return met.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
