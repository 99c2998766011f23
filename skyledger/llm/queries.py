"""The registered queries of this subpackage, each thin: a table in, its operator, digest columns out."""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import shared_folder
from .common import n_words, table, workers_find_package
from .block_topk import block_topk
from .chat import chat_digests, format_chats
from .imatch import build_lexicon, compare_with_edits
from .kneser_ney import quality
from .language_id import UNKNOWN, identify
from .lexical import ranked_search
from .merkle import merkle_manifest
from .mixing import cycle_weights, mix_sources
from .overlap_join import Rule, overlap_join
from .packing import pack_documents
from .site_templates import main_texts
from .token_counts import token_counts
from .token_store import store_digests, write_store

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(fn):
    @functools.wraps(fn)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        workers_find_package(spark)
        return fn(spark, sf_dir)

    QUERIES[fn.__name__] = run
    return run


def scratch(spark: SparkSession, what: str) -> str:
    return f"{shared_folder(spark)}/{what}/{uuid.uuid4().hex}"


@_query
def op1_site_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_texts(table(spark, sf_dir, "pages"))


@_query
def op2_block_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return block_topk(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


ORACLES["op2_block_topk"] = """
with v as (
    select vec_id, [floor(256 * x::double)::bigint for x in embedding] as q from embeddings
    where embedding is not null and len([x for x in embedding if x is null or not isfinite(x)]) = 0
), s as (
    select a.vec_id as query_id, b.vec_id, list_sum([a.q[i] * b.q[i] for i in range(1, 1 + len(a.q))])::bigint as score
    from v a join v b on b.vec_id <> a.vec_id where a.vec_id % 50 = 0
)
select query_id, row_number() over (partition by query_id order by score desc, vec_id)::integer as rank, vec_id, score
from s qualify rank <= 5
"""


@_query
def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document, of its words and an end mark, packed into sequences of 512 to 8192."""
    return pack_documents(table(spark, sf_dir, "documents"), n_words(F.col("text")) + 1)


@_query
def op4_overlap_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlap_join(table(spark, sf_dir, "documents"), Rule(words=4, percent=85))


@_query
def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@_query
def op6_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch(spark, "token_store")
    write_store(table(spark, sf_dir, "documents"), folder, public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    return store_digests(spark, folder)


@_query
def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", n_words(F.col("text")).alias("words"))
    mixed = mix_sources(docs, F.col("words"), F.array("source"), cycle_weights(5, 2, 1), share=1.5, copies=2)
    part = F.col("parts")[0]
    return mixed.select(
        "doc_id", "size", "source", part["source_size"].alias("source_size"), part["target"].alias("target"), "taken"
    )


@_query
def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    said = "</s>[INST] ok [/INST]"
    chats = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], chats.schema)
    folder = scratch(spark, "chats")
    format_chats(chats.unionByName(probe), path).write.parquet(folder)
    return chat_digests(spark.read.parquet(folder), path)


@_query
def op9_imatch_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return compare_with_edits(docs, build_lexicon(docs))


@_query
def op10_kneser_ney_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's perplexity under the trusted text, its language's limit and the verdict."""
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), columns=["doc_id", "lang"])


@_query
def op11_nearest_centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's language; a rejected one keeps its nearest language here and is marked."""
    docs = table(spark, sf_dir, "documents")
    held_out = lambda i: F.coalesce(F.crc32(i.cast("string")) % 4 == 2, F.lit(False))
    found = identify(docs, F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    return found.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), F.coalesce("nearest", F.lit(UNKNOWN)).alias("lang_pred"), "score", "rejected"
    )


@_query
def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document proven by its siblings, half of them from a text without its line ends."""
    told = F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    return merkle_manifest(table(spark, sf_dir, "documents"), {"text": told})


def _leaf_sql(text: str) -> str:
    return "sha256(" + " || ".join(
        f"case when {c} is null then '-' else strlen({c}::varchar)::varchar || ':' || {c}::varchar end"
        for c in ("doc_id", "source", "lang", "n_chars", text)
    ) + ")"


ORACLES["op12_merkle_manifest"] = f"""
with recursive crc as (
    select list(list_reduce(range(8)::bigint[], lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, i::bigint)
                order by i) as t
    from range(256) r(i)
), told as (
    select d.*, case when xor(list_reduce([ord(x)::bigint for x in string_split(doc_id::varchar, '')],
            lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)]), 4294967295::bigint), 4294967295::bigint) % 2 = 0
        then replace(text, chr(10), '') else text end as held
    from documents d, crc
), leaves as (
    select doc_id, coalesce('=' || source, '') as g, {_leaf_sql("text")} as leaf, {_leaf_sql("held")} as told from told
), placed as (
    select *, row_number() over () as rid, row_number() over (partition by g order by doc_id nulls first, leaf) - 1 as pos,
           count(*) over (partition by g) as n
    from leaves
), tree as (
    select g, 0 as lvl, pos, n, leaf as h from placed
    union all
    select g, lvl + 1, pos // 3, (n + 2) // 3, sha256(string_agg(h, '' order by pos)) from tree where n > 1 group by g, lvl, pos // 3, n
), tops as (
    select g, row_number() over (order by g) - 1 as pos, count(*) over () as n, h from tree where n = 1
), top_tree as (
    select 0 as lvl, pos, n, h from tops
    union all
    select lvl + 1, pos // 3, (n + 2) // 3, sha256(string_agg(h, '' order by pos)) from top_tree where n > 1 group by lvl, pos // 3, n
), up as (
    select rid, g, 0 as lvl, pos, n, told as folded, '' as proof from placed
    union all
    select u.rid, u.g, u.lvl + 1, u.pos // 3, (u.n + 2) // 3,
           sha256(string_agg(case when s.pos = u.pos then u.folded else s.h end, '' order by s.pos)),
           u.proof || coalesce(string_agg(s.h, '' order by s.pos) filter (s.pos <> u.pos), '')
    from up u join tree s on s.g = u.g and s.lvl = u.lvl and s.pos // 3 = u.pos // 3 where u.n > 1
    group by u.rid, u.g, u.lvl, u.pos, u.n, u.folded, u.proof
), top_up as (
    select u.rid, 0 as lvl, t.pos, t.n, u.folded, u.proof, t.h as subroot from up u join tops t on t.g = u.g where u.n = 1
    union all
    select u.rid, u.lvl + 1, u.pos // 3, (u.n + 2) // 3,
           sha256(string_agg(case when s.pos = u.pos then u.folded else s.h end, '' order by s.pos)),
           u.proof || coalesce(string_agg(s.h, '' order by s.pos) filter (s.pos <> u.pos), ''), u.subroot
    from top_up u join top_tree s on s.lvl = u.lvl and s.pos // 3 = u.pos // 3 where u.n > 1
    group by u.rid, u.lvl, u.pos, u.n, u.folded, u.proof, u.subroot
)
select p.doc_id, p.leaf, u.subroot, r.h as root, sha256(u.proof) as proof_sha256, u.folded as folded_root, u.folded = r.h as verified
from placed p join top_up u on u.rid = p.rid and u.n = 1, (select h from top_tree where n = 1) r
"""


@_query
def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents of every benchmark item."""
    return ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=10)


_TERMS_SQL = r"""regexp_extract_all(translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"""

ORACLES["op13_ranked_search"] = f"""
with doc as (
    select row_number() over () as d, doc_id, {_TERMS_SQL.format(text="text")} as terms from documents
), sized as (select d, doc_id, len(terms)::bigint as n from doc where len(terms) > 0
), corpus as (select count(*)::bigint as n_docs, sum(n)::bigint as all_terms from sized
), occurs as (
    select d, term, count(*)::bigint as tf from (select d, unnest(terms) as term from doc) group by d, term
), freq as (select term, count(*)::bigint as df from occurs group by term
), item as (
    select row_number() over () as i, item_id, {_TERMS_SQL.format(text="text")} as terms from benchmark
), asked as (
    select i, item_id, term, count(*)::bigint as times from (select i, item_id, unnest(terms) as term from item) group by i, item_id, term
), weights as (
    select term, floor(1000 * ln((2 * n_docs + 2)::double / (2 * df + 1)))::bigint as w from freq, corpus
), scored as (
    select i, item_id, doc_id, d,
           sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * n_docs) // all_terms))))::bigint as score
    from asked join occurs using (term) join weights using (term) join sized using (d), corpus
    group by i, item_id, doc_id, d
)
select item_id, row_number() over (partition by i order by score desc, doc_id nulls last)::integer as rank, doc_id, score
from scored where score > 0 qualify rank <= 10
"""
