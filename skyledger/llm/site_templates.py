"""Main text of web pages by removing site templates.

Every element subtree is hashed (tag, classes, text, children). Spark counts, per host, on how
many different pages a subtree occurs, and subtrees on a good share of a host's pages are its
template, which is deleted from each of them. What is meant to be read stays: paragraphs and
headings inside the article are never template, however often a site repeats them. Elements
that declare themselves furniture (menus, forms, adverts, reader comments and so on) go too,
as a site may vary their content from page to page. Of the rest, the article is taken.

A host's templates are at most (mean subtrees of its pages / ``SHARE``), so the list of a host
is bounded; hosts of any size are counted by partial aggregation.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import cut_lineage
from .common import sliced

SHARE = 0.2
LEAST_PAGES = 5
ARTICLE_SHARE = 0.5
BROADCAST_HASHES = 2_000_000

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark meter output q ruby rb rp rt s samp "
    "small span strike strong sub sup time tt u var wbr img".split()
)
FURNITURE = frozenset(
    "head script style noscript template nav footer aside form iframe svg math canvas object applet button select option "
    "textarea dialog menu audio video datalist progress title".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar".split())
NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner sidebar nav navbar "
    "navigation menu breadcrumb breadcrumbs footer masthead cookie cookies consent gdpr notice notices notification popup modal overlay "
    "newsletter subscribe subscription signup login social share sharing related recommended widget widgets comment comments "
    "commentlist disqus reply replies respond pagination pager toolbar skip copyright alert paywall".split()
)
HEADER_NAMES = frozenset(("header", "topbar"))
CONTENT_NAMES = frozenset("content article post entry story main text body".split())
PARAGRAPHS = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li dd dt td th figcaption br hr".split())
#: A start tag of the key closes an open element of the value that no block in between shields.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"}),
    "option": ({"option"}, {"select"}),
}
_TOKENS = re.compile(r"[^a-z0-9]+")


class Page(HTMLParser):
    """The events of a page (texts, and None where a block ends) and the range of events of each element."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.events: list[str | None] = []
        self.tags: list[str] = []
        self.parents: list[int] = []
        self.spans: list[list[int]] = []
        self.hashes: list[int] = []
        self.names: list[frozenset] = []
        self.hidden: list[bool] = []
        self.leads: list[bool] = []  # holds an article, a main element or a first heading
        self.titled: list[bool] = []  # holds a heading
        self._open: list[int] = []
        self._parts: list[list[bytes]] = []
        self.feed(html)
        self.close()
        while self._open:
            self._end()

    def parse_marked_section(self, i, report=1):
        """``<![`` with a name the standard parser does not know is a comment up to the next ``>``."""
        try:
            return super().parse_marked_section(i, report)
        except AssertionError:
            return self.parse_bogus_comment(i)

    def _break(self) -> None:
        if self.events and self.events[-1] is not None:
            self.events.append(None)

    def _end(self) -> None:
        node = self._open.pop()
        if self.tags[node] not in INLINE:
            self._break()
        parts = self._parts.pop()
        digest = hashlib.blake2b(b"\x00".join(parts), digest_size=8).digest()
        self.hashes[node] = int.from_bytes(digest, "little", signed=True)
        self.spans[node][1] = len(self.events)
        if self._open:
            self._parts[-1].append(digest)
            above = self._open[-1]
            self.leads[above] |= self.leads[node] or self.tags[node] in ("article", "main", "h1")
            self.titled[above] |= self.titled[node] or self.tags[node] in ("h1", "h2", "h3")

    def handle_starttag(self, tag, attrs):
        if tag not in INLINE:
            self._break()
            # An open paragraph ends where a block begins.
            for depth in range(len(self._open) - 1, -1, -1):
                held = self.tags[self._open[depth]]
                if held == "p" and tag not in VOID:
                    while len(self._open) > depth:
                        self._end()
                    break
                if held not in INLINE:
                    break
        if tag in CLOSES:
            ends, shields = CLOSES[tag]
            for depth in range(len(self._open) - 1, -1, -1):
                held = self.tags[self._open[depth]]
                if held in shields:
                    break
                if held in ends:
                    while len(self._open) > depth:
                        self._end()
        if tag in VOID:
            return
        said = {k: v or "" for k, v in attrs}
        names = frozenset(filter(None, _TOKENS.split(f"{said.get('class', '')} {said.get('id', '')}".lower())))
        self.parents.append(self._open[-1] if self._open else -1)
        self._open.append(len(self.tags))
        self.tags.append(tag)
        self.spans.append([len(self.events), 0])
        self.hashes.append(0)
        self.names.append(names)
        styled = said.get("style", "").replace(" ", "").lower()
        self.hidden.append(
            "hidden" in said or said.get("aria-hidden", "").lower() == "true" or "display:none" in styled
            or said.get("role", "").lower() in ROLES
        )
        self.leads.append(False)
        self.titled.append(False)
        self._parts.append([tag.encode(), " ".join(sorted(names)).encode()])

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if tag not in INLINE:
            self._break()
        for depth in range(len(self._open) - 1, -1, -1):
            if self.tags[self._open[depth]] == tag:
                while len(self._open) > depth:
                    self._end()
                return

    def handle_data(self, data):
        self.events.append(data)
        if self._parts and (bare := " ".join(data.split())):
            self._parts[-1].append(bare.encode("utf-8", "surrogatepass"))

    def furniture(self) -> list[bool]:
        """Which elements declare themselves no part of the text."""
        out, inside = [], []
        for tag, parent, names, hidden, leads, titled in zip(
            self.tags, self.parents, self.names, self.hidden, self.leads, self.titled
        ):
            within = parent >= 0 and (inside[parent] or self.tags[parent] in ("article", "main"))
            inside.append(within)
            out.append(
                tag in FURNITURE or hidden
                or (tag not in ("html", "body", "article", "main") and not leads and bool(names & NAMES))
                or (tag == "article" and bool(names & NAMES) and not leads)
                or ((tag == "header" or (tag == "div" and bool(names & HEADER_NAMES) and not leads)) and not (within and titled))
            )
        return out

    def within_article(self) -> list[bool]:
        out: list[bool] = []
        for tag, parent in zip(self.tags, self.parents):
            out.append(tag in ("article", "main") or (parent >= 0 and out[parent]))
        return out

    def main_text(self, templates: dict[int, float]) -> str:
        """The text of the article, without furniture and template subtrees (hash to share of the host's pages)."""
        gone = np.zeros(len(self.events) + 1, "int64")
        dropped = self.furniture()
        for node, inside in enumerate(self.within_article()):
            share = templates.get(self.hashes[node], 0.0)
            needed = SHARE if not inside else 2.0 if self.tags[node] in PARAGRAPHS | {"article", "main"} else ARTICLE_SHARE
            if dropped[node] or (share >= needed and not self.leads[node]):
                gone[self.spans[node][0]] += 1
                gone[self.spans[node][1]] -= 1
        gone = np.cumsum(gone)[:-1] > 0
        sizes = np.array([0 if e is None or g else len(e.strip()) for e, g in zip(self.events, gone)], "int64")
        upto = np.concatenate([[0], np.cumsum(sizes)])
        held = lambda node: int(upto[self.spans[node][1]] - upto[self.spans[node][0]])
        start, end = 0, len(self.events)
        for wanted in (
            lambda n: self.tags[n] == "article", lambda n: self.tags[n] == "main",
            lambda n: self.tags[n] in ("div", "section") and self.names[n] & CONTENT_NAMES and self.leads[n],
        ):
            found = [n for n in range(len(self.tags)) if wanted(n) and held(n)]
            if found:
                start, end = self.spans[max(found, key=lambda n: (held(n), -n))]
                break
        blocks, now = [], []
        for event, g in zip(self.events[start:end], gone[start:end].tolist()):
            if event is None:
                blocks.append("".join(now))
                now = []
            elif not g:
                now.append(event)
        blocks.append("".join(now))
        return " ".join(b for b in (" ".join(x.split()) for x in blocks) if b)


def subtrees(page: Page) -> list[int]:
    """Hashes of the subtrees that could be template: not the page's frame, nor its paragraphs."""
    out = set()
    for node, inside in enumerate(page.within_article()):
        tag = page.tags[node]
        if tag in ("html", "head", "body", "article", "main") or page.leads[node] or (inside and tag in PARAGRAPHS) or tag in INLINE:
            continue
        out.add(page.hashes[node])
    return sorted(out)


def _hash_pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, pages in sliced(batches, "text"):
        found = [subtrees(Page(p)) for p in pages]
        digests = [int.from_bytes(hashlib.blake2b(p.encode(), digest_size=8).digest(), "little", signed=True) for p in pages]
        yield pa.RecordBatch.from_pydict({
            "host": batch.column("host"), "digest": pa.array(digests, pa.int64()), "trees": pa.array(found, pa.list_(pa.int64())),
        })


def host_templates(rows: DataFrame) -> DataFrame:
    """(host, trees: array<struct<tree, share>>) of subtrees on a good share of a host's different pages."""
    pages = rows.select("host", "text").mapInArrow(_hash_pages, "host string, digest long, trees array<long>")
    # A page that is copied counts once: what it repeats is no template.
    pages = cut_lineage(pages.dropDuplicates(["host", "digest"]))
    counts = pages.select("host", F.explode("trees").alias("tree")).groupBy("host", "tree").agg(F.count(F.lit(1)).alias("n"))
    sizes = pages.groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    common = counts.filter(F.col("n") >= LEAST_PAGES).join(sizes, "host").withColumn("share", F.col("n") / F.col("pages"))
    return common.filter(F.col("share") >= SHARE).groupBy("host").agg(F.collect_list(F.struct("tree", "share")).alias("trees"))


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, pages in sliced(batches, "text"):
        templates = [{t["tree"]: t["share"] for t in trees or ()} for trees in batch.column("trees").to_pylist()]
        texts = [Page(p).main_text(t) if p else "" for p, t in zip(pages, templates)]
        yield pa.RecordBatch.from_pydict({
            "id": batch.column("id"), "url": batch.column("url"), "text": pa.array(texts, pa.string()),
            "n_chars": pa.array([len(t) for t in texts], pa.int64()),
        })


def main_texts(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(``id_col``, ``url_col``, text, n_chars) of every page.

    The text is that of the article (or main element, or else what is left of the page), its
    character references decoded, white space within a block as one space, blocks joined by
    one space. Null and empty pages have the text ''. Pages without a host, of null or odd
    addresses, share one. Hosts of fewer than ``LEAST_PAGES`` different pages have no
    template. Repeated rows are kept; an empty table gives no rows; other columns are not read.
    """
    host = F.regexp_extract(F.lower(F.coalesce(F.col(url_col), F.lit(""))), r"^[a-z][a-z0-9+.-]*://([^/?#]*)", 1)
    rows = df.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("text"), host.alias("host"))
    templates = cut_lineage(host_templates(rows))
    few = (templates.agg(F.sum(F.size("trees"))).first()[0] or 0) <= BROADCAST_HASHES
    joined = rows.join(F.broadcast(templates) if few else templates, "host", "left").select("id", "url", "text", "trees")
    kind = rows.schema["id"].dataType.simpleString()
    out = joined.mapInArrow(_extract, f"id {kind}, url string, text string, n_chars long")
    return out.withColumnRenamed("id", id_col).withColumnRenamed("url", url_col)
