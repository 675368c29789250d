"""Main text of HTML pages by wrapper induction.

Each host has a reference page, its first. Every page's tree of blocks is aligned with its host's reference by simple tree
matching, and Spark counts, for every node of a reference, the pages that have it, its different texts and their
length. That is the host's wrapper: nodes whose text hardly ever changes are template, the others are slots; the content
root is the innermost node that holds most of the text in slots, menus, forms and the like not counted. A page is then
aligned once more: its text is what lies under the node aligned with the content root, without template nodes and without
parts that their element, role, class or id marks as something else. What was never aligned, as further paragraphs or
further nodes beside the content root with its label, is content. Statistics are over different pages, told apart by
their longer texts, so that a group of copies, however large, doesn't make an article template.

Any two pages of a host make a wrapper. A host's only page, or a page that doesn't have the content root, is judged by its own
marks alone.

References are one row per host; they are broadcast after a check of their size, else joined by host and a salt.

Defined results: null html gives an empty text; pages without url or host have a wrapper of their own kind, none; repeated
rows come out alike; further columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from orderlake.llm import dom
from orderlake.llm.common import cut, table
from orderlake.llm.vocabulary import chunks

LEAST = 2
#: Different texts in a hundred pages of a node that is template.
CONSTANT_PERCENT = 2
#: The share of a host's slot text that the content root holds, in percent.
ROOT_PERCENT = 60
#: Texts of so many characters tell pages apart; shorter ones, as dates, only in pages that have no others.
LONG_TEXT = 40
BROADCAST_ROWS, BROADCAST_CHARS, SALTS = 10_000, 8_000_000, 64


def host(url: str = "url") -> F.Column:
    return F.lower(F.coalesce(F.regexp_extract(F.col(url), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#]*)", 1), F.lit("")))


def with_host(pages: DataFrame, per_host: DataFrame, chars: str) -> DataFrame:
    """pages (with host, salt) and what there is for their hosts."""
    n = per_host.agg(F.count("*").alias("n"), F.coalesce(F.sum(chars), F.lit(0)).alias("c")).first()
    if n["n"] <= BROADCAST_ROWS and n["c"] <= BROADCAST_CHARS:
        return pages.join(F.broadcast(per_host), "host", "left").drop("salt")
    salted = per_host.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return pages.join(salted, ["host", "salt"], "left").drop("salt")


@lru_cache(maxsize=64)
def reference(text: str) -> tuple[dom.Node, dict[int, int]]:
    root = dom.parse(text)
    return root, {id(n): i for i, n in enumerate(dom.walk(root))}


def digest(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def identity(page: dom.Node) -> int:
    """Equal for copies: of the page's longer texts outside parts marked as aside."""
    texts, stack = [], [page]
    while stack:
        node = stack.pop()
        if not node.aside:
            texts.append(node.own())
            stack.extend(reversed(node.children()))
    return digest("\n".join([t for t in texts if len(t) >= LONG_TEXT] or texts))


def aligned(joined: DataFrame) -> DataFrame:
    """host, node, value (a hash of the text), page (its identity), chars, links: of every node of a reference, once in
    each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple, tuple[int, int]] = {}

        def flush() -> pa.RecordBatch:
            keys, sums = list(found), list(found.values())
            columns = [pa.array([k[i] for k in keys], t) for i, t in enumerate((pa.string(), pa.int32(), pa.int64(), pa.int64()))]
            columns += [pa.array([s[i] for s in sums], pa.int64()) for i in range(2)]
            found.clear()
            return pa.record_batch(columns, ["host", "node", "value", "page", "chars", "links"])

        for batch in batches:
            for part in chunks(batch, "html", 4_000_000):
                for name, text, ref in zip(*(part.column(c).to_pylist() for c in ("host", "html", "ref")), strict=True):
                    root, number = reference(ref)
                    page = dom.parse(text)
                    same = identity(page)
                    for node, other in dom.match(page, root)[1]:
                        own = node.own()
                        key = (name, number[id(other)], digest(own), same)
                        found[key] = max(found.get(key, (0, 0)), (len(own), min(node.links, len(own))))
                if len(found) > 200_000:
                    yield flush()
        yield flush()

    return joined.select("host", "html", "ref").mapInArrow(run, "host string, node int, value long, page long, chars long, links long")


def wrappers(pages: DataFrame) -> DataFrame:
    """host, ref, nodes (array of node, n, values, chars, links; n is the different pages). pages: host, salt, page_id,
    html."""
    refs = cut(pages.where("html IS NOT NULL AND host <> ''").groupBy("host").agg(F.min_by("html", "page_id").alias("ref"), F.count("*").alias("pages")).where(F.col("pages") >= LEAST))
    joined = with_host(pages.where("html IS NOT NULL"), refs.withColumn("c", F.length("ref")), "c").where("ref IS NOT NULL")
    found = aligned(joined).groupBy("host", "node", "value", "page").agg(F.max("chars").alias("chars"), F.max("links").alias("links"))
    found = cut(found)
    sums = found.groupBy("host", "node", "value").agg(F.sum("chars").alias("chars"), F.sum("links").alias("links")).groupBy("host", "node").agg(F.count("*").alias("values"), F.sum("chars").alias("chars"), F.sum("links").alias("links"))
    nodes = found.select("host", "node", "page").distinct().groupBy("host", "node").agg(F.count("*").alias("n")).join(sums, ["host", "node"])
    lists = nodes.groupBy("host").agg(F.sort_array(F.collect_list(F.struct("node", "n", "values", "chars", "links"))).alias("nodes"))
    return refs.select("host", "ref").join(lists, "host")


@lru_cache(maxsize=64)
def judged(ref: str, nodes: tuple[tuple[int, int, int, int, int], ...]) -> tuple[dom.Node, int | None, frozenset[int]]:
    """The reference, the id() of its content root if there is one, those of its template nodes."""
    root, number = reference(ref)
    stats = {x[0]: x[1:] for x in nodes}
    order = list(dom.walk(root))
    fixed, mass, aside = set(), {}, {}
    for node in order:
        aside[id(node)] = node.aside or (node.parent is not None and aside[id(node.parent)])
        n, values, chars, links = stats.get(number[id(node)], (0, 0, 0, 0))
        if chars and n >= LEAST and 100 * values <= max(100, CONSTANT_PERCENT * n):
            fixed.add(id(node))
        mass[id(node)] = 0 if aside[id(node)] or id(node) in fixed else max(chars - links, 0)
    for node in reversed(order):
        if node.parent is not None:
            mass[id(node.parent)] += mass[id(node)]
    whole = mass[id(root)]
    if not whole:
        return root, None, frozenset()
    here = root
    while (inner := max((c for c in here.children()), key=lambda c: mass[id(c)], default=None)) is not None and 100 * mass[id(inner)] >= ROOT_PERCENT * whole and inner.children():
        here = inner
    return root, id(here) if here is not root else None, frozenset(fixed)


def main_text(text: str, ref: str | None, nodes: tuple | None) -> str:
    page = dom.parse(text)
    starts, leave = [], set()
    if ref is not None and nodes:
        root, content, fixed = judged(ref, nodes)
        if content is not None:
            pairs = dom.match(page, root)[1]
            start = next((node for node, other in pairs if id(other) == content), None)
            leave = {id(node) for node, other in pairs if id(other) in fixed and node is not start}
            if start is not None:
                met = {id(node) for node, _ in pairs}
                starts = [c for c in start.parent.children() if c is start or (c.key == start.key and id(c) not in met and not c.aside)]
    if not starts:
        starts, leave = dom.own_roots(page), set()
    return "\n".join(filter(None, (dom.text_of(x, leave) for x in starts)))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per input row: id, url, text."""
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), host(url_col).alias("host"))
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int"))
    found = cut(wrappers(rows))
    joined = with_host(rows, found.withColumn("c", F.length("ref") + 40 * F.size("nodes")), "c").drop("c")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "html", 4_000_000):
                out = []
                for text, ref, nodes in zip(*(part.column(c).to_pylist() for c in ("html", "ref", "nodes")), strict=True):
                    out.append(main_text(text, ref, None if nodes is None else tuple(tuple(n.values()) for n in nodes)) if text else "")
                yield pa.record_batch([part.column("page_id"), part.column("url"), pa.array(out, pa.string())], [id_col, "url", "text"])

    kind = dict(rows.dtypes)["page_id"]
    return joined.select("page_id", "url", "html", "ref", "nodes").mapInArrow(run, f"`{id_col}` {kind}, url string, text string")


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))
