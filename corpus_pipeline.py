"""From raw documents to packed training sequences, one operator of the subpackage ``llm`` per stage.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. All but the
last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from skyledger.llm.common import n_words, table, workers_find_package
from skyledger.llm.kneser_ney import quality
from skyledger.llm.mixing import cycle_weights, mix_sources
from skyledger.llm.overlap_join import Rule, overlap_join
from skyledger.llm.packing import pack_documents
from skyledger.session import cut_lineage

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
BROADCAST_IDS = 2_000_000


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity is within their language's limit.

    Null and empty texts are rejected; a null language takes the limit over all languages; a null
    id is never trusted; repeated rows are judged alike; an empty table gives no rows.
    """
    workers_find_package(spark)
    return quality(docs, table(spark, sf_dir, "labels")).filter("keep").select(COLUMNS)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one of least id (null last); equal rows become one.

    Rows are told apart by id and text together, so of two texts under one id each stays unless it
    has a near copy, and rows without an id are compared like all others. Null, empty and wordless
    texts are linked with nothing and stay; an empty table gives no rows.
    """
    workers_find_package(spark)
    keyed = docs.select(COLUMNS).withColumn("_key", F.xxhash64("doc_id", "text"))
    groups = overlap_join(keyed, Rule(words=5, percent=80), id_col="_key").select("_key", F.col("component_id").alias("_group"))
    groups = cut_lineage(groups.groupBy("_key", "_group").agg(F.count(F.lit(1)).alias("_rows")))
    named = groups.join(keyed.select("_key", "doc_id").distinct(), "_key")
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "_key")
    first = named.groupBy("_group").agg(F.min(order).alias("_first")).select(F.col("_first")["_key"].alias("_key"))
    few = lambda keys: F.broadcast(keys) if keys.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS else keys
    copies = cut_lineage(groups.select("_key").join(cut_lineage(first), "_key", "left_anti"))
    left = keyed.join(few(copies), "_key", "left_anti")
    again = cut_lineage(groups.filter("_rows > 1").select("_key"))
    if again.isEmpty():
        return left.select(COLUMNS)
    once = left.join(few(again), "_key", "left_semi").dropDuplicates(["_key", "doc_id", "text"])
    return left.join(few(again), "_key", "left_anti").unionByName(once).select(COLUMNS)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sources at weights 5, 2 and 1, repeating, of 150 % of all words; a document taken twice is two rows.

    A null source is a source, the last one; texts without words may be taken and weigh nothing;
    ties of the seeded order fall by id; repeated rows are documents each; an empty table gives no rows.
    """
    workers_find_package(spark)
    mixed = mix_sources(docs.select(COLUMNS), n_words(F.col("text")), F.array("source"), cycle_weights(5, 2, 1))
    times = F.explode(F.array_repeat(F.lit(1), F.col("copies")))
    return mixed.filter("copies > 0").select(*COLUMNS, times.alias("_copy")).select(COLUMNS)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, of its words and an end mark, at its place in sequences of 512 to 8192.

    Null and empty texts are an end mark alone; a longer text goes over several sequences; rows of
    one length are interchangeable and repeated rows are packed each; an empty table gives no rows.
    """
    workers_find_package(spark)
    return pack_documents(docs, n_words(F.col("text")) + 1)


STAGES = [
    ("quality classifier", quality_classifier),
    ("n-gram Jaccard join", ngram_jaccard_join),
    ("mixing sources to target weights", source_mixing),
    ("best-fit packing", best_fit_packing),
]

#: A perplexity has no SQL form; the tests hold the stages against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES):
            docs = cut_lineage(docs)
    return docs
