"""Mixing overlapping sources to target weights with a min-cost flow.

Documents are aggregated by membership pattern (the set of sources they belong to), so the
network has one node per pattern and per source, however many documents there are. A
pattern's tokens can be sent once at no cost, a second time at cost 1 a token, and so on
(convex repetition costs), to any of its sources, up to each source's quota. The flow of a
pattern is then laid out along its documents in seeded order: each document that fits into
what is left of the flow is taken whole, any other is passed over, to the end of the order.
Once few are left that may fit, those that fill the rest best are found by their possible sums.
"""

from __future__ import annotations

from collections import defaultdict, deque
from collections.abc import Callable, Hashable

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import Window as W

from ..session import cut_lineage


#: Patterns are metadata, one row each on the driver; more than this is a mistake in the membership column.
MOST_PATTERNS = 100_000
DOCS_A_BUCKET = 10_000
#: So few documents that may still fit are walked through on the driver.
FEW_DOCS = 20_000
#: Bytes that the possible sums of them may hold.
SUM_BYTES = 64 << 20
FIRST, LAST = -(1 << 63), (1 << 63) - 1


def fill_targets(sizes: dict, weights: dict, total: float, most: float) -> dict:
    """Shares of ``total`` by weight, none above ``most`` times its size; the excess is shared anew by weight."""
    targets, open_ = {}, [k for k in sizes]
    left = total
    while open_:
        weight = sum(weights[k] for k in open_)
        full = [k for k in open_ if left * weights[k] / weight > most * sizes[k]]
        if not full:
            targets |= {k: left * weights[k] / weight for k in open_}
            break
        for k in full:
            targets[k] = float(most * sizes[k])
        left -= sum(targets[k] for k in full)
        open_ = [k for k in open_ if k not in targets]
    return targets


def min_cost_flow(arcs: list[tuple[Hashable, Hashable, int, int]], source: Hashable, sink: Hashable) -> list[int]:
    """Flow on each arc (tail, head, capacity, cost) of a cheapest maximum flow, by successive shortest paths."""
    head, room, cost, out = [], [], [], defaultdict(list)
    for a, b, cap, c in arcs:
        out[a].append(len(head)), head.append(b), room.append(cap), cost.append(c)
        out[b].append(len(head)), head.append(a), room.append(0), cost.append(-c)
    while True:
        dist, via, queue, waiting = {source: 0}, {}, deque([source]), {source}
        while queue:
            v = queue.popleft()
            waiting.discard(v)
            for e in out[v]:
                if room[e] and (head[e] not in dist or dist[v] + cost[e] < dist[head[e]]):
                    dist[head[e]], via[head[e]] = dist[v] + cost[e], e
                    if head[e] not in waiting:
                        waiting.add(head[e])
                        queue.append(head[e])
        if sink not in dist:
            return [room[2 * i + 1] for i in range(len(arcs))]
        path, v = [], sink
        while v != source:
            path.append(via[v])
            v = head[via[v] ^ 1]
        step = min(room[e] for e in path)
        for e in path:
            room[e] -= step
            room[e ^ 1] += step


def route(patterns: dict[tuple, int], quotas: dict, copies: int) -> dict[tuple, list[tuple[object, int]]]:
    """(source, tokens) each pattern sends; parts of the network that share no source are solved on their own."""
    parent: dict = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for p in patterns:
        for s in p:
            parent[root(("s", s))] = root(("s", p[0]))
    parts = defaultdict(list)
    for p in patterns:
        if p:
            parts[root(("s", p[0]))].append(p)
    sent: dict = {}
    for part in parts.values():
        arcs = []
        for p in part:
            arcs += [("from", ("p", p), patterns[p], k) for k in range(copies)]
        for p in part:
            arcs += [(("p", p), ("s", s), copies * patterns[p], 0) for s in p]
        for s in dict.fromkeys(s for p in part for s in p):
            arcs.append((("s", s), "to", round(quotas[s]), 0))
        for (a, b, _, _), flow in zip(arcs, min_cost_flow(arcs, "from", "to")):
            if a != "from" and b != "to" and flow:
                sent.setdefault(a[1], []).append((b[1], flow))
    return sent


def code_points(name: str | None) -> tuple:
    """Sorts names by code point, null last."""
    return (name is None, name or "")


def cycle_weights(*weights: float) -> Callable[[list], dict]:
    return lambda names: {n: weights[i % len(weights)] for i, n in enumerate(sorted(names, key=code_points))}


def _tidy(df: DataFrame, size: Column, members: Column, seed: int) -> DataFrame:
    """``df`` as one struct, beside its size, pattern and seeded place."""
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    rows = df.select(
        row.alias("_row"), F.coalesce(size.cast("long"), F.lit(0)).alias("_size"),
        F.coalesce(F.array_sort(F.array_distinct(members)), F.array().cast("array<string>")).alias("_members"),
    )
    return rows.select(
        "_row", "_size", "_members", F.to_json("_members").alias("_pattern"), F.xxhash64(F.lit(seed), F.col("_row")).alias("_place")
    )


def _first_misfits(places: DataFrame, rest: DataFrame, docs: int) -> dict[str, tuple[int, int]]:
    """Per pattern that does not fit into ``rest`` tokens: what the documents before the first that does not fit hold, and its place."""
    bits = max(1, (-(-docs // DOCS_A_BUCKET)).bit_length())
    dealt = places.withColumn("_bucket", F.shiftright("_place", 64 - bits))
    sums = dealt.groupBy("_pattern", "_bucket").agg(F.sum("_size").alias("_sum"))
    so_far = W.partitionBy("_pattern").orderBy("_bucket")
    sums = sums.withColumn("_upto", F.sum("_sum").over(so_far)).join(F.broadcast(rest), "_pattern")
    # The bucket in which the rest runs out, and what lies before it.
    edge = sums.filter("_upto > rest and _upto - _sum <= rest").select("_pattern", "_bucket", "rest", (F.col("_upto") - F.col("_sum")).alias("_before"))
    edge = edge.groupBy("_pattern").agg(F.min_by(F.struct("_bucket", "rest", "_before"), "_bucket").alias("e")).select("_pattern", "e.*")
    inside = dealt.join(F.broadcast(edge), ["_pattern", "_bucket"])
    by_place = inside.groupBy("_pattern", "_place", "_bucket", "rest", "_before").agg(F.sum("_size").alias("_sum"))
    here = W.partitionBy("_pattern").orderBy("_place").rowsBetween(W.unboundedPreceding, 0)
    upto = by_place.withColumn("_upto", F.col("_before") + F.sum("_sum").over(here))
    fits = F.col("_upto") <= F.col("rest")
    found = upto.groupBy("_pattern").agg(
        F.max(F.when(fits, F.col("_upto"))), F.first("_before"), F.min(F.when(~fits, F.col("_place")))
    )
    return {r[0]: (r[2] if r[1] is None else r[1], r[3]) for r in found.collect()}


def _best_sum(sizes: list[int], rest: int) -> tuple[list[int], int]:
    """Positions of the sizes that fill ``rest`` best, and how many were looked at, as far as ``SUM_BYTES`` reach."""
    sums, below = [1], (1 << (rest + 1)) - 1
    for size in sizes:
        if sums[-1] >> rest or len(sums) * (rest // 8 + 1) > SUM_BYTES:
            break
        sums.append((sums[-1] | sums[-1] << size) & below)
    want, chosen = sums[-1].bit_length() - 1, []
    for k in range(len(sums) - 1, 0, -1):
        if not sums[k - 1] >> want & 1:
            chosen.append(k - 1)
            want -= sizes[k - 1]
    return chosen, len(sums) - 1


def _walk(units: list[tuple[int, int, int]], first: int, rest: int) -> list[tuple[int, int, int]]:
    """Ranges as in ``fill_rests`` over (place, size of a document, size of all of the place), in order of place."""
    ranges, gap, k = [], rest, 0
    while k < len(units) and units[k][2] <= rest:
        rest -= units[k][2]
        k += 1
    if k:
        ranges.append((first, units[k - 1][0], gap))
    units = [u for u in units[k:] if u[2] <= rest]
    chosen, seen = _best_sum([u[2] for u in units], rest)
    taken = [units[i] for i in chosen]
    rest -= sum(u[2] for u in taken)
    for u in units[seen:]:
        if u[2] <= rest:
            taken.append(u)
            rest -= u[2]
    return ranges + [(place, place, one) for place, one, _ in taken]


def fill_rests(places: DataFrame, rest: dict[str, int], docs: int) -> dict[str, list[tuple[int, int, int]]]:
    """Per pattern the ranges (first place, last place, gap) whose documents of at most ``gap`` tokens are taken.

    Each round takes, of the documents that fit into what is left, all before the first that no
    longer does; the next goes on behind that one, and what it passes over fits no later gap either.
    """
    spark = places.sparkSession
    ranges: dict = defaultdict(list)
    left = {p: (FIRST, n) for p, n in rest.items() if n}
    while left:
        gaps = spark.createDataFrame([(p, first, n) for p, (first, n) in left.items()], "_pattern string, first long, rest long")
        fit = places.join(F.broadcast(gaps), "_pattern").filter("_place >= first and _size > 0 and _size <= rest")
        fit = fit.select("_pattern", "_place", "_size")
        few = fit.limit(FEW_DOCS + 1).collect()
        if len(few) <= FEW_DOCS:
            units: dict = defaultdict(dict)
            for p, place, size in few:
                units[p][place] = (size, units[p].get(place, (0, 0))[1] + size)
            for p, found in units.items():
                ranges[p] += _walk([(place, *found[place]) for place in sorted(found)], *left[p])
            break
        misfits = _first_misfits(fit, gaps.select("_pattern", "rest"), docs)
        for p, (first, n) in list(left.items()):
            held, place = misfits.get(p, (n, LAST + 1))
            if held:
                ranges[p].append((first, place - 1, n))
            if held < n and place < LAST:
                left[p] = (place + 1, n - held)
            else:
                del left[p]
    return ranges


def mix_sources(
    df: DataFrame, size: Column, members: Column, weigh: Callable[[list], dict], share: float = 1.5, copies: int = 2,
    seed: int = 17,
) -> DataFrame:
    """``df`` with size, taken (tokens the mix takes, repeats counted), copies and a row per source in ``parts``.

    ``members`` is the array of a document's sources; null members form a source of their own,
    and a null or empty array takes no part (taken 0). ``parts`` is array<struct<source,
    source_size, target>>. No document is taken more than ``copies`` times. Selection depends
    on ``seed`` and the document's columns alone, so reruns agree; repeated rows are documents
    each and are chosen together. Documents of size 0 are taken 0 tokens and no copies. Input
    columns named like the four new ones are replaced. An empty table gives no rows.

    Only (pattern, place, size) is shuffled; the documents themselves stay where they are and
    meet a plan of one row per pattern.
    """
    tidy = _tidy(df, size, members, seed)
    places = cut_lineage(tidy.select("_pattern", "_members", "_place", "_size"))
    totals = places.groupBy("_pattern").agg(F.first("_members").alias("m"), F.sum("_size").alias("n"), F.count(F.lit(1)).alias("docs"))
    rows = totals.limit(MOST_PATTERNS + 1).collect()
    if len(rows) > MOST_PATTERNS:
        raise ValueError(f"more than {MOST_PATTERNS} membership patterns")
    patterns = {tuple(r["m"]): r["n"] for r in rows}
    sizes: dict = defaultdict(int)
    for p, n in patterns.items():
        for s in p:
            sizes[s] += n
    whole = sum(n for p, n in patterns.items() if p)
    targets = fill_targets(dict(sizes), weigh(list(sizes)), share * whole, copies) if whole else {s: 0.0 for s in sizes}
    sent = route(patterns, targets, copies)

    spark = df.sparkSession
    flow = {r["_pattern"]: sum(f for _, f in sent.get(tuple(r["m"]), [])) for r in rows}
    every = {r["_pattern"]: flow[r["_pattern"]] // r["n"] if r["n"] else 0 for r in rows}
    rest = {r["_pattern"]: flow[r["_pattern"]] % r["n"] if r["n"] else 0 for r in rows}
    ranges = fill_rests(places, rest, sum(r["docs"] for r in rows))
    plan = spark.createDataFrame(
        [
            (r["_pattern"], every[r["_pattern"]], ranges.get(r["_pattern"], []),
             [(s, sizes[s], float(targets[s])) for s in r["m"]])
            for r in rows
        ],
        "_pattern string, _every long, _ranges array<struct<first:long,last:long,gap:long>>, "
        "parts array<struct<source:string,source_size:long,target:double>>",
    )
    chosen = F.exists("_ranges", lambda r: F.col("_place").between(r["first"], r["last"]) & (F.col("_size") <= r["gap"]))
    times = F.when(F.col("_size") > 0, F.col("_every") + F.when(chosen, 1).otherwise(0)).otherwise(0)
    new = ("size", "taken", "copies", "parts")
    # One row per pattern, and their number is checked above.
    return tidy.join(F.broadcast(plan), "_pattern").select(
        *[F.col("_row")[c].alias(c) for c in df.columns if c not in new], F.col("_size").alias("size"),
        (times * F.col("_size")).cast("long").alias("taken"), times.cast("int").alias("copies"), "parts",
    )
