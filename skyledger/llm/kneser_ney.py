"""Quality by an interpolated modified Kneser-Ney n-gram model of trusted text.

Tokens are the characters of the text as they stand, up to 32,766 different ones (the most
frequent of the trusted texts; others count as one unknown character), but a word that repeats
the one before it is one token of its own, as is usual in text preparation. Every trusted text is
counted; n-gram counts are pre-aggregated in each task, then sharded by n-gram. All
statistics of the model come from joins of the count tables: continuation counts from the
next longer n-grams, the three discounts of each order from its counts of counts, and the
interpolation weight of a context from its followers. No table of the model is collected,
broadcast or laid out whole; it grows with the trusted text and stays in shards.

Documents meet it by joins too. A first scan asks for every n-gram that occurs, once per task;
the different n-grams asked are priced by joins with the probability and back-off shards, order
by order. Documents are then dealt evenly into groups of bounded text, the prices of a group's
n-grams are joined to it, and its documents add them up. The text is shuffled once: the group's
request for prices and the adding up share that exchange.

A document's score is its mean negative log-probability per token, drawn towards that of its
language by a few tokens' worth, as short texts vary more. It is rejected above a threshold
its language sets itself: a quantile of trusted texts, each scored by a model that has not
counted it. Those models are the same counts without one fold's, kept apart by a column.
"""

from __future__ import annotations

import functools
import itertools
import operator
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..session import cut_lineage
from .common import give_back, part_count, sliced, tidy

ORDER = 4
BITS = 15
PRIOR_TOKENS = 60
FOLDS = 2
QUANTILE = 0.995
HELD_TOKENS = 1 << 21
#: Below a power of two, as the buffers that hand a group over double in size.
GROUP_BYTES = 24 << 20
SLICE_CHARS = 1 << 20
BATCH_ROWS = 256
BROADCAST_LABELS = 4_000_000

#: The model of all folds; model k is without fold k.
WHOLE = -1
START, UNKNOWN, FIRST_TOKEN = 0, 1, 2
_CODES = 0x110000


#: Stands for a word that repeats the one before it, space included; a noncharacter, so no text should hold it.
REPEATED = "\uffff"


def tokenized(text: str) -> str:
    """The text with one token in place of each word that repeats the one before it, as no n-gram of letters spans two words."""
    words = text.split(" ")
    if not any(map(operator.eq, words, itertools.islice(words, 1, None))):
        return text
    out, last = [words[0]], words[0]
    for w in words[1:]:
        out.append(REPEATED if w and w == last else " " + w)
        last = w
    return "".join(out)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def _character_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = np.zeros(_CODES, "int64")
    for _, texts in sliced(batches, "text"):
        held += np.bincount(_codes("".join(map(tokenized, texts))), minlength=_CODES)
    some = np.flatnonzero(held)
    yield pa.RecordBatch.from_pydict({"code": pa.array(some, pa.int64()), "n": pa.array(held[some], pa.int64())})


def alphabet(texts: DataFrame) -> np.ndarray:
    """The code points that have tokens of their own, by number; at most 2 to the power of ``BITS``, less two."""
    counts = texts.select("text").mapInArrow(tidy(_character_counts), "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))
    rows = counts.orderBy(F.desc("n"), "code").limit((1 << BITS) - FIRST_TOKEN).collect()
    return np.array([r["code"] for r in rows], "int64")


@functools.lru_cache(maxsize=2)
def _token_table(letters: bytes) -> np.ndarray:
    found = np.frombuffer(letters, "<i8")
    table = np.full(_CODES, UNKNOWN, "int64")
    table[found] = np.arange(FIRST_TOKEN, FIRST_TOKEN + len(found))
    return table


class Tokens:
    """Texts as n-gram numbers: the token and those before it, each text begun by start marks."""

    def __init__(self, letters: np.ndarray, order: int):
        self.letters, self.order = letters.astype("<i8").tobytes(), order

    @property
    def kinds(self) -> int:
        """Tokens that may follow: the letters and the unknown one."""
        return len(self.letters) // 8 + 1

    def grams(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The n-grams of all texts in a row, and how many each has."""
        texts = list(map(tokenized, texts))
        lengths = np.array([len(t) for t in texts], "int64")
        lead = self.order - 1
        ids = _token_table(self.letters)[_codes("".join(texts))]
        # Each text stands behind its own start marks; the places of the marks are dropped again.
        padded = np.full(len(ids) + lead * (len(texts) + 1), START, "int64")
        owner = np.repeat(np.arange(1, len(texts) + 1), lengths)
        places = np.arange(len(ids)) + lead * owner
        padded[places] = ids
        out = np.zeros(len(ids), "int64")
        for k in range(lead, -1, -1):
            out = out << BITS | padded[places - k]
        return out, lengths


def _counts(tokens):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = defaultdict(list), 0

        def out():
            for fold, grams in held.items():
                found, counts = np.unique(np.concatenate(grams), return_counts=True)
                yield pa.RecordBatch.from_pydict({
                    "fold": pa.array([fold] * len(found), pa.int32()), "gram": pa.array(found, pa.int64()), "n": pa.array(counts, pa.int64())
                })

        for batch, texts in sliced(batches, "text", SLICE_CHARS):
            folds = np.asarray(batch.column("fold"))
            for fold in np.unique(folds).tolist():
                held[fold].append(tokens.value.grams([t for t, f in zip(texts, folds) if f == fold])[0])
                n += len(held[fold][-1])
            if n > HELD_TOKENS:
                yield from out()
                held.clear()
                n = 0
        yield from out()

    return count


def _counted(texts: DataFrame, tokens) -> DataFrame:
    """(fold, gram, n) of ``texts`` (fold, text)."""
    counts = texts.select("fold", "text").mapInArrow(tidy(_counts(tokens)), "fold int, gram long, n long")
    return cut_lineage(counts.groupBy("fold", "gram").agg(F.sum("n").alias("n")))


def _by_model(counts: DataFrame, folds: list[int]) -> DataFrame:
    """(model, gram, n): the counts of all folds as one model, and per fold those of the others."""
    models = F.array(F.lit(WHOLE), *[F.when(F.col("fold") != k, F.lit(k)) for k in folds])
    each = counts.select(F.explode(F.array_compact(models)).alias("model"), "gram", "n")
    return cut_lineage(each.groupBy("model", "gram").agg(F.sum("n").alias("n")))


def _discounts(counts: DataFrame) -> dict[int, list[float]]:
    """Per model the discounts of n-grams counted once, twice and more often, from the counts of counts; kept within (0, count)."""
    seen: dict[int, dict] = defaultdict(dict)
    for r in counts.groupBy("model", F.least("n", F.lit(5)).alias("k")).agg(F.count(F.lit(1)).alias("m")).collect():
        seen[r["model"]][r["k"]] = r["m"]
    out = {}
    for model, found in seen.items():
        n1, n2, n3, n4 = (max(1, found.get(k, 0)) for k in (1, 2, 3, 4))
        y = n1 / (n1 + 2 * n2)
        raw = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)
        out[model] = [min(max(d, 0.1), k - 0.1) for k, d in enumerate(raw, 1)]
    return out


def _low(gram: Column, tokens: int) -> Column:
    return gram.bitwiseAND(F.lit((1 << (BITS * tokens)) - 1))


def train(counts: DataFrame, order: int, kinds: int) -> tuple[DataFrame, DataFrame]:
    """The models of ``counts`` (model, gram, n) as (model, order, gram, p) and (model, order, context, backoff).

    These are the probabilities of the n-grams seen and the weights of the contexts seen. No
    counts give empty tables, and every token then has the uniform probability.
    """
    levels = {order: counts}
    for k in range(order - 1, 0, -1):
        # Below the highest order an n-gram counts the distinct tokens seen before it.
        levels[k] = cut_lineage(levels[k + 1].groupBy("model", _low(F.col("gram"), k).alias("gram")).agg(F.count(F.lit(1)).alias("n")))
    probabilities = weights = None
    for k in range(1, order + 1):
        off = F.lit(0.0)
        for model, (d1, d2, d3) in _discounts(levels[k]).items():
            off = F.when(F.col("model") == model, F.when(F.col("n") == 1, d1).when(F.col("n") == 2, d2).otherwise(d3)).otherwise(off)
        per = levels[k].groupBy("model", F.shiftright("gram", BITS).alias("context")).agg(
            F.sum("n").cast("double").alias("total"), F.sum(off).alias("mass")
        )
        per = per.withColumn("backoff", F.col("mass") / F.col("total"))
        seen = levels[k].withColumn("context", F.shiftright("gram", BITS)).join(per, ["model", "context"])
        own = F.greatest(F.col("n") - off, F.lit(0.0)) / F.col("total")
        if k == 1:
            level = seen.select("model", "gram", (own + F.col("backoff") / kinds).alias("p"))
        else:
            lower = probabilities.filter(F.col("order") == k - 1).select("model", F.col("gram").alias("tail"), F.col("p").alias("q"))
            seen = seen.withColumn("own", own).withColumn("tail", _low(F.col("gram"), k - 1)).join(lower, ["model", "tail"])
            level = seen.select("model", "gram", (F.col("own") + F.col("backoff") * F.col("q")).alias("p"))
        level = cut_lineage(level.withColumn("order", F.lit(k)))
        per = per.select("model", "context", "backoff", F.lit(k).alias("order"))
        probabilities = level if probabilities is None else probabilities.unionByName(level)
        weights = per if weights is None else weights.unionByName(per)
    return probabilities, cut_lineage(weights)


def priced(asked: DataFrame, probabilities: DataFrame, weights: DataFrame, order: int, kinds: int) -> DataFrame:
    """(model, gram, p) of distinct n-grams ``asked`` (model, gram) of ``order``, seen or not.

    An unseen n-gram has the weight of its context, 1 if that is unseen too, times the
    probability of the n-gram without its first token.
    """
    tail = _low(F.col("gram"), order - 1)
    known = probabilities.filter(F.col("order") == order).select("model", "gram", F.col("p").alias("_p"))
    context = weights.filter(F.col("order") == order).select("model", F.col("context").alias("_context"), "backoff")
    found = asked.join(known, ["model", "gram"], "left").withColumn("_context", F.shiftright("gram", BITS)).join(context, ["model", "_context"], "left")
    back = F.coalesce("backoff", F.lit(1.0))
    if order == 1:
        return found.select("model", "gram", F.coalesce("_p", back / kinds).alias("p"))
    shorter = priced(asked.select("model", tail.alias("gram")).distinct(), probabilities, weights, order - 1, kinds)
    shorter = shorter.select("model", F.col("gram").alias("_tail"), F.col("p").alias("_q"))
    found = found.withColumn("_tail", tail).join(shorter, ["model", "_tail"])
    return found.select("model", "gram", F.coalesce("_p", back * F.col("_q")).alias("p"))


def _by_key(grams: np.ndarray, lengths: np.ndarray, keys: list) -> Iterator[tuple]:
    """The n-grams of the texts of each key, None left out."""
    for key in {k for k in keys if k is not None}:
        yield key, grams[np.repeat([k == key for k in keys], lengths)]


def _asked(tokens, text: str):
    """The different n-grams of every group."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch, texts in sliced(batches, text, SLICE_CHARS):
            grams, lengths = tokens.value.grams(texts)
            for group, found in _by_key(grams, lengths, batch.column("_group").to_pylist()):
                found = pd.unique(found)
                held[group] = pd.unique(np.concatenate([held[group], found])) if group in held else found
        for group, grams in held.items():
            yield pa.RecordBatch.from_pydict({"group": pa.array([group] * len(grams), pa.int64()), "gram": pa.array(grams, pa.int64())})

    return ask


def _added_up(tokens, text: str, keep: list[str]):
    def add(documents: pa.Table, prices: pa.Table) -> pa.Table:
        known = np.asarray(prices.column("gram"))
        by = np.argsort(known)
        known = known[by]
        price = {m: np.asarray(prices.column(_price(m)))[by] for m in (WHOLE, *range(FOLDS))}

        def costs(found: np.ndarray, lengths: np.ndarray, model: int) -> np.ndarray:
            if not len(found):
                return np.zeros(len(lengths))
            spots, names = pd.factorize(found)
            owner = np.repeat(np.arange(len(lengths)), lengths)
            return np.bincount(owner, weights=price[model][np.searchsorted(known, names)][spots], minlength=len(lengths))

        sums, counts, held = [np.zeros(0)], [np.zeros(0, "int64")], [np.zeros(0)]
        for batch, texts in sliced(iter(documents.to_batches(max_chunksize=BATCH_ROWS)), text, SLICE_CHARS):
            found, lengths = tokens.value.grams(texts)
            folds = batch.column("_fold").to_pylist()
            sums.append(costs(found, lengths, WHOLE))
            counts.append(lengths)
            out = np.full(len(texts), np.nan)
            for fold, grams in _by_key(found, lengths, folds):
                mine = np.array([f == fold for f in folds])
                out[mine] = costs(grams, lengths[mine], fold)
            held.append(out)
        sums, counts, held = (np.concatenate(x) for x in (sums, counts, held))
        del prices, price, known
        give_back()
        out = documents.select(keep).append_column("cost", pa.array(sums)).append_column("tokens", pa.array(counts))
        return out.append_column("held", pa.array(held, mask=np.isnan(held)))

    return add


def _price(model: int) -> str:
    return f"cost{model - WHOLE}"


def scored(rows: DataFrame, keep: list[str], text: str, probabilities: DataFrame, weights: DataFrame, tokens, text_bytes: int) -> DataFrame:
    """Columns ``keep`` of ``rows`` with cost (summed negative log-probability of the text), tokens, and ``held``:
    the cost by the model without the row's own ``_fold``, null where that is null."""
    groups = part_count(text_bytes, GROUP_BYTES)
    order, kinds = tokens.value.order, tokens.value.kinds
    models = [WHOLE, *range(FOLDS)]
    every = rows.select(text, F.lit(0).cast("long").alias("_group")).mapInArrow(tidy(_asked(tokens, text)), "group long, gram long")
    every = cut_lineage(every.select("gram").distinct().select(F.explode(F.array(*map(F.lit, models))).alias("model"), "gram"))
    found = priced(every, probabilities, weights, order, kinds)
    prices = cut_lineage(found.groupBy("gram").agg(*[F.max(F.when(F.col("model") == m, -F.log("p"))).alias(_price(m)) for m in models]))
    # Evenly dealt whatever the rows hold, so copies and repeated ids never gather.
    turn = F.pmod(F.monotonically_increasing_id() + 7919 * F.spark_partition_id(), F.lit(groups))
    dealt = rows.select(*dict.fromkeys([*keep, text, "_fold"])).withColumn("_group", turn).repartition(groups, "_group")
    answers = dealt.mapInArrow(tidy(_asked(tokens, text)), "group long, gram long").join(prices, "gram")
    names = ", ".join([f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep] + ["cost double", "tokens long", "held double"])
    return dealt.groupBy("_group").cogroup(answers.groupBy("group")).applyInArrow(_added_up(tokens, text, keep), names)


def thresholds(scored: DataFrame, quantile: float = QUANTILE, least_texts: float | None = None) -> DataFrame:
    """(lang, mean, limit) per language of held-out trusted texts with cost, tokens; and for the null language, all of them.

    A quantile needs a text beyond it: a language of fewer than ``least_texts``, 1 / (1 - ``quantile``)
    if not given, takes its mean and the quantile of all texts' distances from their languages'
    means, but no limit below that of all texts, as the mean of a few texts may be far too low.
    """
    least_texts = 1 / (1 - quantile) - 1e-6 if least_texts is None else least_texts
    every = scored.filter("tokens > 0")
    both = every.unionByName(every.filter("lang is not null").withColumn("lang", F.lit(None).cast("string")))
    means = both.groupBy("lang").agg((F.sum("cost") / F.sum("tokens")).alias("mean"))
    shrunk = (F.col("cost") + PRIOR_TOKENS * F.col("mean")) / (F.col("tokens") + PRIOR_TOKENS)
    # One row per language; the sketch is bounded, so a language of any size fits one row.
    means = means.withColumnRenamed("lang", "lang_of_mean")
    joined = both.join(F.broadcast(means), F.col("lang").eqNullSafe(F.col("lang_of_mean"))).select("lang", "mean", shrunk.alias("s"))
    cut = lambda value: F.percentile_approx(value, quantile, 10_000)
    found = joined.groupBy("lang").agg(F.first("mean").alias("mean"), cut("s").alias("own"), F.count(F.lit(1)).alias("texts"))
    # The rows of the null language are those of all texts.
    most, far = joined.agg(
        cut(F.when(F.col("lang").isNull(), F.col("s"))), cut(F.when(F.col("lang").isNotNull(), F.col("s") - F.col("mean")))
    ).first()
    shifted = F.greatest(F.lit(most), F.col("mean") + F.lit(far))
    enough = F.col("lang").isNull() | (F.col("texts") >= least_texts)
    return found.select("lang", "mean", F.when(enough, F.col("own")).otherwise(shifted).alias("limit"))


def quality(
    df: DataFrame, labels: DataFrame, trusted: Column | None = None, id_col: str = "doc_id", text_col: str = "text",
    lang_col: str = "lang", order: int = ORDER, quantile: float = QUANTILE, columns: list[str] | None = None,
) -> DataFrame:
    """``df``, or those ``columns`` of it, with perplexity (per token, null without any), ``limit`` and ``keep``.

    Trusted are the rows whose id has a label row that fulfils ``trusted`` (quality 1, toxic 0)
    and none that does not. All of them are counted; each of ``FOLDS`` folds, by a hash of the
    id, sets the thresholds with the costs that the other folds' counts give it. A language
    without trusted texts, null included, takes the limit over all languages, and one of few
    the greater of that and its mean with the distance usual over all; without any trusted text
    all is kept. Empty and null texts
    are rejected. Repeated rows are scored each; no row is lost or doubled; columns of the
    same names as the new ones are replaced. An empty table gives no rows.
    """
    spark = df.sparkSession
    trusted = trusted if trusted is not None else (F.col("quality") == 1) & (F.col("toxic") == 0)
    good = labels.select(F.col(id_col).alias("_label"), F.coalesce(trusted, F.lit(False)).alias("ok")).groupBy("_label").agg(F.min("ok").alias("ok"))
    good = good.filter("ok").select("_label")
    good = F.broadcast(good) if good.limit(BROADCAST_LABELS + 1).count() <= BROADCAST_LABELS else good
    # The caller's columns travel under numbers, so that no name of theirs meets one used here.
    returned = [c for c in columns or df.columns if c not in ("perplexity", "limit", "keep")]
    plain = df.select(*dict.fromkeys([*returned, id_col, text_col, lang_col]))
    numbered = {c: f"_c{k}" for k, c in enumerate(plain.columns)}
    text, lang, own_id = numbered[text_col], numbered[lang_col], F.col(numbered[id_col])
    fold = F.when(F.col("_label").isNotNull(), F.pmod(F.xxhash64(own_id), F.lit(FOLDS)).cast("int"))
    rows = plain.toDF(*numbered.values()).join(good, own_id == F.col("_label"), "left").withColumn("_fold", fold).drop("_label")
    labelled = rows.filter("_fold is not null").select(F.col("_fold").alias("fold"), F.col(text).alias("text"))
    tokens = Tokens(alphabet(labelled), order)
    shared = spark.sparkContext.broadcast(tokens)
    counts = _by_model(_counted(labelled, shared), list(range(FOLDS)))
    probabilities, weights = train(counts, order, tokens.kinds)
    n_bytes = rows.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()[0]
    keep = [numbered[c] for c in dict.fromkeys([*returned, lang_col])]
    found = cut_lineage(scored(rows, keep, text, probabilities, weights, shared, n_bytes))
    limits = thresholds(found.filter("held is not null").select(F.col(lang).alias("lang"), F.col("held").alias("cost"), "tokens"), quantile)
    bounds = {r["lang"]: (r["mean"], r["limit"]) for r in limits.collect()}
    return _judged(found, {c: numbered[c] for c in returned}, F.col(lang), bounds)


def _judged(found: DataFrame, columns: dict[str, str], lang: Column, bounds: dict) -> DataFrame:
    """The verdicts; the limits, a row per language of trusted texts, are joined."""
    everywhere = bounds.get(None, (0.0, float("inf")))
    table = found.sparkSession.createDataFrame(
        [(lang, *map(float, b)) for lang, b in bounds.items() if lang is not None], "_lang string, _mean double, _limit double"
    )
    joined = found.join(F.broadcast(table) if len(bounds) <= BROADCAST_LABELS else table, lang == F.col("_lang"), "left")
    mean, limit = F.coalesce("_mean", F.lit(float(everywhere[0]))), F.coalesce("_limit", F.lit(float(everywhere[1])))
    drawn = (F.col("cost") + PRIOR_TOKENS * mean) / (F.col("tokens") + PRIOR_TOKENS)
    return joined.select(
        *[F.col(number).alias(name) for name, number in columns.items()], F.when(F.col("tokens") > 0, F.exp(F.col("cost") / F.col("tokens"))).alias("perplexity"), limit.alias("limit"),
        ((F.col("tokens") > 0) & (drawn <= limit)).alias("keep"),
    )
