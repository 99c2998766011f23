from __future__ import annotations

import itertools
import math
import random
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from skyledger.llm import kneser_ney
from skyledger.llm.kneser_ney import BITS, REPEATED, START, UNKNOWN, WHOLE, Tokens, alphabet, quality, scored, thresholds, tokenized, train
from skyledger.llm.overlap_join import Rule
from skyledger.llm.site_templates import Page, main_texts

from .cases import documents, nothing, prose
from .test_corpus import brute_components, check_packing

SF = "/root/testdata/sf0.001"


def page(body: str, title: str = "t") -> str:
    return f"<!DOCTYPE html><html><head><title>{title}</title><script>var a='</p>';</script></head><body>{body}</body></html>"


def test_site_templates(spark):
    template = "<div class='x1'><p>Our site, since 1990</p><ul><li>home<li>about</ul></div>"
    rows = []
    for k in range(12):
        rows.append((k, f"http://Site.example.com/{k}", page(
            f"{template}<nav>menu {k}</nav><div class='top-ad'>buy {k}</div><div id='story{k}'><h1>Title&nbsp;{k} &amp; more</h1>"
            f"<p>Body   of <b>pa</b>ge {k}<br>next<p>Shared line</div><section class='comments'><p>nice {k}</p></section>{template}"
        )))
    # Outside an article a line on every page is template as well. On another host the same block is text.
    rows.append((50, "http://other.example.com/", page(f"{template}<p>alone</p>")))
    rows.append((51, "http://other.example.com/a", page(
        "<header><h1>Site</h1></header><main><article><header><h1>Kept</h1></header>one <i>t</i>wo<aside>no</aside><p>three</p>"
        "<form><label>mail</label></form><div class='share'>x</div></article></main><footer>foot</footer>")))
    rows += [(60, None, None), (61, "odd", ""), (62, "odd", "no markup at all &lt;"), (63, "", "<p>open <b>bold<p>next</b><div hidden>h</div>"),
             (64, "http://deep.example.com", "<div>" * 3000 + "deep" + "</div>" * 3000), (65, "odd", "<script>only</script>")]
    rows.append(rows[-2])
    df = spark.createDataFrame([(*r, "x", "x") for r in rows], "page_id long, url string, html string, host string, text string")
    got = Counter(tuple(r) for r in main_texts(df).collect())
    want = {k: f"Title {k} & more Body of page {k} next" for k in range(12)}
    want |= {50: "Our site, since 1990 home about alone", 51: "Kept one two three", 60: "", 61: "", 62: "no markup at all <", 63: "open bold next",
             64: "deep", 65: ""}
    assert got == Counter((i, u, want[i], len(want[i])) for i, u, _ in rows)
    assert main_texts(nothing(df)).count() == 0


def test_template_shares_respect_paragraphs():
    p = Page("<article><p>said everywhere</p><div>call to action</div><p>own</p></article>")
    everywhere = dict.fromkeys(p.hashes, 1.0)
    assert p.main_text(everywhere) == "said everywhere own"
    assert p.main_text({}) == "said everywhere call to action own"


def test_odd_marked_sections_do_not_stop_a_page():
    for odd in ("<![x[ b ]]>", "<![", "<![ ]>", "<![CDATA[ b ]]>", "<![if !IE]>", "<![endif]>", "<![é[", "<!x>", "<!-", "<?php a ?>", "</ x>"):
        for html in (f"<p>a</p>{odd}", f"{odd}<p>a</p>", f"<p>a</p>{odd}<p>c</p>"):
            assert "a" in Page(html).main_text({}) or odd in ("<![", "<![é[", "<!-")
    assert Page("<p>a</p><![x[ b ]]>c").main_text({}) == "a c"
    rng = random.Random(2)
    for _ in range(3000):
        Page("".join(rng.choice(["<", "!", "[", "]", ">", "-", "p", "/", "x ", "=", "'", "&", "#", ";", "CDATA", "<div>"]) for _ in range(30)))


def brute_model(lists, order, kinds):
    """Interpolated modified Kneser-Ney straight from its definition, over lists of tokens."""
    top = Counter()
    for ids in lists:
        ids = [START] * (order - 1) + ids
        top.update(tuple(ids[i : i + order]) for i in range(len(ids) - order + 1))
    levels = {order: top}
    for k in range(order - 1, 0, -1):
        levels[k] = Counter(g[1:] for g in levels[k + 1])
    off, stats = {}, {}
    for k, counts in levels.items():
        n = Counter(min(c, 5) for c in counts.values())
        n1, n2, n3, n4 = (max(1, n[i]) for i in (1, 2, 3, 4))
        y = n1 / (n1 + 2 * n2)
        off[k] = [0, *(min(max(d, 0.1), i - 0.1) for i, d in enumerate((1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3), 1))]
        stats[k] = defaultdict(lambda: [0, 0.0])
        for g, c in counts.items():
            stats[k][g[:-1]][0] += c
            stats[k][g[:-1]][1] += off[k][min(c, 3)]

    def p(g):
        if not g:
            return 1 / kinds
        k, lower = len(g), p(g[1:])
        if g[:-1] not in stats[k]:
            return lower
        total, mass = stats[k][g[:-1]]
        c = levels[k].get(g, 0)
        return (max(c - off[k][min(c, 3)], 0) if c else 0) / total + mass / total * lower

    return p


def test_costs_equal_definition(spark, monkeypatch):
    monkeypatch.setattr(kneser_ney, "GROUP_BYTES", 1 << 10)  # several groups
    monkeypatch.setattr(kneser_ney, "SLICE_CHARS", 300)
    texts = [prose(60, k, 50) for k in range(12)] + ["", "Und Und Und", "SHOUT it 12! \U0001d4b3 \ud7ff"]
    given = [(k % 2, t) for k, t in enumerate(texts)]
    learned = spark.createDataFrame([*given, (0, None)], "fold int, text string").repartition(4)
    asked = [prose(30, 77, 50), "Unseen Wörds!! 字", "a a a a", "", texts[3]]
    for order in (2, 4):
        letters = alphabet(learned)
        number = {chr(c): k for k, c in enumerate(letters, 2)}
        assert set(number) == set("".join(map(tokenized, texts))) and REPEATED in number
        ids = lambda t: [number.get(c, UNKNOWN) for c in tokenized(t)]
        tokens = Tokens(letters, order)
        shared = spark.sparkContext.broadcast(tokens)
        counts = kneser_ney._by_model(kneser_ney._counted(learned, shared), [0, 1])
        probabilities, weights = train(counts, order, tokens.kinds)
        rows = spark.createDataFrame([(k, m, t) for k, t in enumerate(asked) for m in (None, 0, 1)], "id long, _fold int, words string")
        found = scored(rows, ["id", "_fold"], "words", probabilities, weights, shared, 5_000).collect()
        got = {(r["id"], WHOLE if r["_fold"] is None else r["_fold"]): r for r in found}
        assert len(found) == len(got) == 3 * len(asked)
        for m in (WHOLE, 0, 1):
            p = brute_model([ids(t) for f, t in given if f != m], order, tokens.kinds)
            for k, t in enumerate(asked):
                chain = [START] * (order - 1) + ids(t)
                want = -sum(math.log(p(tuple(chain[i : i + order]))) for i in range(len(tokenized(t))))
                cost = got[k, m]["held" if m != WHOLE else "cost"]
                assert math.isclose(cost, want, rel_tol=1e-9, abs_tol=1e-9) and got[k, m]["tokens"] == len(tokenized(t))
                assert got[k, m]["cost"] == got[k, WHOLE]["cost"] and got[k, WHOLE]["held"] is None
            contexts = {tuple(([START] * (order - 1) + ids(t))[i : i + order - 1]) for t in texts for i in range(len(tokenized(t)))}
            for c in list(contexts)[:20]:  # a distribution after every context
                assert math.isclose(sum(p((*c, x)) for x in range(1, tokens.kinds + 1)), 1, rel_tol=1e-9)


def test_repeated_words_are_tokens():
    assert tokenized("For For For x For\nFor  a  b") == f"For{REPEATED}{REPEATED} x For\nFor  a  b"
    assert tokenized("") == "" and tokenized("a b") == "a b" and tokenized("  ") == "  "


def test_ngram_numbers(spark):
    tokens = Tokens(np.array([ord(c) for c in "abé"]), 3)
    grams, lengths = tokens.grams(["ab", "", "éz"])
    join = lambda *ids: sum(i << BITS * k for k, i in enumerate(reversed(ids)))
    assert grams.tolist() == [join(0, 0, 2), join(0, 2, 3), join(0, 0, 4), join(0, 4, 1)] and lengths.tolist() == [2, 0, 2]
    assert tokens.grams([])[0].tolist() == [] and tokens.grams(["", ""])[0].tolist() == []


def test_limits_of_few_and_many_texts(spark):
    rows = [("aa", 900.0 + k, 1000) for k in range(300)] + [("bb", 100.0 + k, 1000) for k in range(5)]
    held = spark.createDataFrame(rows, "lang string, cost double, tokens long")
    default = {r["lang"]: r["limit"] for r in thresholds(held).collect()}
    own = {r["lang"]: r["limit"] for r in thresholds(held, least_texts=5).collect()}
    assert default["bb"] == default[None] and own["bb"] < 0.2 < default["bb"] and own["aa"] == default["aa"]


def test_quality_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").withColumn("keep", F.lit("clash"))
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    # Labels of odd ids are never seen by the model.
    judged = quality(docs, labels.filter("doc_id % 2 = 0"))
    assert judged.count() == docs.count()
    seen = judged.join(labels.filter("doc_id % 2 = 1"), "doc_id").select("quality", "toxic", "keep").collect()
    good = [r["keep"] for r in seen if r["quality"] == 1 and not r["toxic"]]
    bad = [r["keep"] for r in seen if r["quality"] == 0]
    assert len(good) > 50 and len(bad) > 10
    assert np.mean(good) >= 0.98 and np.mean(bad) <= 0.1


def test_quality_on_awkward_rows(spark):
    odd = documents(spark)
    labels = spark.createDataFrame(
        [(i, 1, 0, "x") for i in (3, 4, 5, 9, 9, 10, 13)] + [(7, 0, 0, "x"), (None, 1, 0, "x"), (8, None, None, "x"), (8, 1, 0, "x")],
        "doc_id long, quality int, toxic int, text string",
    )
    got = quality(odd, labels)
    assert got.count() == odd.count()
    assert got.filter("keep is null or (coalesce(text, '') = '' and (keep or perplexity is not null))").count() == 0
    assert set(odd.columns) - {"keep"} <= set(got.columns)
    assert quality(nothing(odd), labels).count() == 0
    alone = quality(odd, nothing(labels))  # no trusted text: nothing but empty texts is rejected
    assert alone.filter("keep <> (coalesce(text, '') <> '')").count() == 0


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality classifier", "n-gram Jaccard join", "mixing sources to target weights", "best-fit packing"]
    judge, join, mix, pack = (f for _, f in corpus_pipeline.STAGES)
    kept = judge(spark, docs, SF).cache()
    assert kept.columns == corpus_pipeline.COLUMNS
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    clean = docs.join(labels.filter("quality = 1 and toxic = 0"), "doc_id")
    assert kept.join(clean, "doc_id", "left_semi").count() >= 0.98 * clean.count()
    rows = {r["doc_id"]: r["text"] for r in kept.collect()}
    want = brute_components(rows.items(), Rule(5, 80))
    single = join(spark, kept, SF).cache()
    assert single.columns == corpus_pipeline.COLUMNS
    assert sorted(r[0] for r in single.select("doc_id").collect()) == sorted(i for i, (_, c) in want.items() if i == c)
    doubled = join(spark, kept.unionByName(kept), SF)
    assert sorted(r[0] for r in doubled.select("doc_id").collect()) == sorted(i for i, (_, c) in want.items() if i == c)
    mixed = mix(spark, single, SF).cache()
    assert mixed.columns == corpus_pipeline.COLUMNS
    times = Counter(r[0] for r in mixed.select("doc_id").collect())
    assert max(times.values()) <= 2 and set(times) <= set(rows)
    lengths = Counter()
    for r in mixed.collect():
        lengths[r["doc_id"]] += len(r["text"].encode().split()) + 1
    check_packing(pack(spark, mixed, SF).collect(), lengths)


def test_pipeline_on_awkward_rows(spark):
    odd = documents(spark).select(*corpus_pipeline.COLUMNS, F.lit("x").alias("_copy"))
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, odd, SF)
        assert out.count() > 0
        assert stage(spark, nothing(odd), SF).count() == 0
