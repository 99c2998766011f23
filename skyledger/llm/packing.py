"""Best-fit packing into bins of several permitted sequence lengths.

Equal lengths are interchangeable, so the plan is made on the histogram of lengths, which is
bounded by the longest permitted length whatever the number of documents: classes are placed
longest first, each into the open bins it fills best (all bins of one content at a time).
Where none has room, the bin size of least cost for the class is opened. Sizes are judged
jointly: plans for several credits for room left over are made, every bin is downsized to the
smallest length that holds its contents, and the cheapest plan is kept. Documents find their
place by their rank within their length class.
"""

from __future__ import annotations

import bisect
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from ..scale import ordered, rank
from ..session import cut_lineage

LENGTHS = (512, 1024, 2048, 4096, 8192)
CREDITS = (0.0, 0.5, 0.8, 0.95, 1.0)


def padded_tokens(capacity: int) -> float:
    """Cost of a sequence: its positions, with a little for starting one."""
    return capacity + 16.0


@dataclass
class Bins:
    """So many bins of one content: (length, how many of it in each bin) in order of placement."""

    capacity: int
    count: int
    content: tuple = ()
    used: int = 0


@dataclass
class Plan:
    bins: list[Bins]
    cost: float = 0.0
    slots: dict[int, list[tuple]] = field(default_factory=dict)


def _pack(counts: dict[int, int], lengths: tuple[int, ...], cost: Callable[[int], float], credit: float) -> list[Bins]:
    rooms: list[int] = []  # sorted distinct amounts of room among open bins
    by_room: dict[int, list[Bins]] = {}
    full: list[Bins] = []
    rate = min(cost(c) / c for c in lengths) * credit

    def put(b: Bins) -> None:
        room = b.capacity - b.used
        if not b.count:
            return
        if not room:
            full.append(b)
            return
        if room not in by_room:
            bisect.insort(rooms, room)
            by_room[room] = []
        by_room[room].append(b)

    def place(b: Bins, size: int, each: int, n: int) -> None:
        put(Bins(b.capacity, n, (*b.content, (size, each)), b.used + each * size))

    for size in sorted(counts, reverse=True):
        left = counts[size]
        while left:
            at = bisect.bisect_left(rooms, size)
            if at < len(rooms):
                room = rooms[at]
                b = by_room[room].pop()
                if not by_room[room]:
                    del by_room[room], rooms[at]
            else:
                fits = [c for c in lengths if c >= size]
                capacity = min(fits, key=lambda c: ((cost(c) - rate * (c - c // size * size)) / (c // size), c))
                each = capacity // size
                b = Bins(capacity, -(-left // each))
                room = capacity
            each = room // size
            whole = min(b.count, left // each)
            rest = left - whole * each if whole < b.count else 0
            place(b, size, each, whole)
            if rest and whole < b.count:
                place(b, size, rest, 1)
                whole_used = whole + 1
            else:
                rest, whole_used = 0, whole
            put(Bins(b.capacity, b.count - whole_used, b.content, b.used))
            left -= whole * each + rest
    return full + [b for group in by_room.values() for b in group]


def plan_bins(
    counts: dict[int, int], lengths: tuple[int, ...] = LENGTHS, cost: Callable[[int], float] = padded_tokens
) -> Plan:
    """The cheapest plan for so many items of each length (1 to the longest permitted)."""
    best = None
    for credit in CREDITS:
        bins = _pack(counts, lengths, cost, credit)
        for b in bins:
            b.capacity = lengths[bisect.bisect_left(lengths, b.used)]
        plan = Plan(bins, sum(b.count * cost(b.capacity) for b in bins))
        if best is None or plan.cost < best.cost:
            best = plan
    first = 0
    seen: dict[int, int] = {}
    for b in best.bins:
        offset = 0
        for size, each in b.content:
            begin = seen.get(size, 0)
            best.slots.setdefault(size, []).append((begin, each, first, offset, b.capacity))
            seen[size] = begin + each * b.count
            offset += each * size
        first += b.count
    return best


def pack_documents(
    df: DataFrame, length: Column, lengths: tuple[int, ...] = LENGTHS, cost: Callable[[int], float] = padded_tokens,
    id_col: str = "doc_id",
) -> DataFrame:
    """Rows (``id_col``, piece, length, bin_id, bin_capacity, bin_offset) for every document.

    A document longer than the longest permitted length is cut into pieces of that length and
    a rest, none dropped. Documents of null or no length have one row, piece 0 of length 0,
    without a bin. Null ids and repeated rows are packed like others. An empty table gives no
    rows; other columns are not read.
    """
    lengths = tuple(sorted(lengths))
    most = lengths[-1]
    whole = df.select(F.col(id_col).alias("id"), F.greatest(F.coalesce(length.cast("long"), F.lit(0)), F.lit(0)).alias("n"))
    pieces = F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.ceil(F.col("n") / most), F.lit(1)) - 1))
    items = whole.select("id", "n", pieces.alias("piece"))
    items = cut_lineage(
        items.select("id", "piece", F.least(F.col("n") - F.col("piece") * most, F.lit(most)).cast("int").alias("length"))
    )
    # At most as many rows as the longest permitted length.
    counts = {r[0]: r[1] for r in items.filter("length > 0").groupBy("length").agg(F.count(F.lit(1))).collect()}
    plan = plan_bins(counts, lengths, cost)
    slots = df.sparkSession.createDataFrame(
        list(plan.slots.items()),
        "length int, slots array<struct<begin:long,each:int,first:long,offset:int,capacity:int>>",
    )
    ranked = ordered(items.filter("length > 0"), ["length"], ["id", "piece"], {"at": rank()}, hot=True)
    spot = F.element_at(F.filter("slots", lambda s: s["begin"] < F.col("at")), -1)
    found = ranked.join(slots, "length").select("id", "piece", "length", (F.col("at") - 1).cast("long").alias("k"), spot.alias("s"))
    inside = F.col("k") - F.col("s.begin")
    packed = found.select(
        F.col("id").alias(id_col), "piece", "length", (F.col("s.first") + F.floor(inside / F.col("s.each"))).cast("long").alias("bin_id"),
        F.col("s.capacity").alias("bin_capacity"),
        (F.col("s.offset") + F.pmod(inside, F.col("s.each")) * F.col("length")).cast("int").alias("bin_offset"),
    )
    empty = items.filter("length = 0").select(
        F.col("id").alias(id_col), "piece", "length", F.lit(None).cast("long").alias("bin_id"),
        F.lit(None).cast("int").alias("bin_capacity"), F.lit(None).cast("int").alias("bin_offset"),
    )
    return packed.unionByName(empty)
