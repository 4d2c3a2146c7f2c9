"""Main text of web pages by a site style tree.

Each page is parsed once to its blocks of text, each with the path of the elements around it and the zone that their
names give it: noise, article, or unknown. All distinct pages of a host, whatever they name, are merged by path; a copy of
a page tells nothing about the site. A content node's importance falls with the entropy of its blocks over those pages: a
block on every page carries none, a block on one page all of it. A presentation node's importance is the entropy of its
child layouts. The zone is a prior, which the entropy outweighs as pages are merged: an article's branch that repeats
goes, a branch outside that differs on many pages stays. Noise is left out: menus, ads and comments differ from page to
page as well, so that entropy says nothing for them. All counting is by host, path and the hash of a block,
pre-aggregated before the shuffle, and pages are joined with the few nodes of their host that overturn their prior.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sugarmill.llm.common import slices, written

#: Branches of less importance are removed.
LEAST = 0.35
NOISE, ARTICLE, OUTSIDE, UNKNOWN = 0, 1, 2, 3
#: Prior importance by zone, and the number of further pages that weigh as much. OUTSIDE are the unknown branches of a page that names its article.
PRIORS = {ARTICLE: (0.9, 4.0), OUTSIDE: (0.1, 20.0), UNKNOWN: (1.0, 0.0)}
#: Nodes against their prior that are broadcast; more are joined by a shuffle.
MOST_SENT = 200_000
#: Weight of content against presentation.
CONTENT = 0.8

TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>", re.S)
ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))|\b(hidden)\b", re.S)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
RAW = frozenset("script style title textarea noscript template svg iframe object math select".split())
NOISE_TAGS = RAW | frozenset("head nav footer aside form button dialog menu".split())
ARTICLE_TAGS = frozenset(("article", "main"))
#: Words in classes, ids and roles that name a page's parts.
NOISE_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu menubar footer sidebar aside widget widgets complementary contentinfo"
    " related recommended share sharing social newsletter subscribe signup login search breadcrumb breadcrumbs pagination pager cookie cookies consent gdpr notice notices alert popup modal overlay"
    " comment comments commentlist disqus respond reply replies copyright masthead topbar toolbar tags skip".split()
)
HEADER_NAMES = frozenset(("header", "banner"))
ARTICLE_NAMES = frozenset(("article-body", "articlebody", "article-content", "entry-content", "post-content", "post-body", "story-body", "main-content", "article", "main"))
#: A start tag ends open elements of these kinds, up to the container.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr"}), "th": ({"td", "th"}, {"tr"}), "option": ({"option"}, {"select"})}
BLOCKS = "row long, page_id long, url string, host string, blocks array<struct<path:string,zone:int,text:string>>, layouts array<struct<path:string,layout:string>>"


def named(tag: str, attributes: str) -> tuple[str, set[str], bool]:
    """An element's label, the words of its class, id and role, and whether it is hidden."""
    if not attributes.strip(" /"):
        return tag, set(), False
    names, words, hidden = [], set(), False
    for m in ATTRIBUTE.finditer(attributes):
        key = (m[1] or m[5] or "").lower()
        value = (m[2] or m[3] or m[4] or "").lower()
        if key in ("class", "id", "role"):
            names.append(value)
            for v in value.split():
                words.add(v)
                words.update(re.split(r"[-_]+", v))
        elif key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and re.search(r"display\s*:\s*none", value):
            hidden = True
    return tag + "".join("." + n.replace(" ", ".").replace("/", "") for n in names)[:80], words, hidden


def zone_of(tag: str, words: set[str], hidden: bool, above: int) -> int:
    """An element's zone under its parent's; noise stays noise."""
    if above == NOISE or hidden or tag in NOISE_TAGS or words & NOISE_NAMES or (above != ARTICLE and (tag == "header" or words & HEADER_NAMES)):
        return NOISE
    return ARTICLE if tag in ARTICLE_TAGS or words & ARTICLE_NAMES else above


def parsed(page: str) -> tuple[list[tuple[str, int, str]], list[tuple[str, str]]]:
    """(path, zone, text) blocks in page order, and (path, child tags) of the elements that hold others."""
    blocks: list[tuple[str, int, str]] = []
    stack: list[tuple[str, str, int, list[str]]] = [("", "", UNKNOWN, [])]  # tag, path, zone, child tags
    layouts: list[tuple[str, str]] = []
    text: list[str] = []
    at = 0

    def flush() -> None:
        if text:
            joined = " ".join(html.unescape("".join(text)).split())
            text.clear()
            if joined:
                k = len(stack) - 1
                while k and stack[k][0] in INLINE:
                    k -= 1
                blocks.append((stack[k][1], stack[-1][2], joined))

    def pop_to(k: int) -> None:
        for tag, path, _, children in stack[k:]:
            if children and tag not in INLINE:
                layouts.append((path, " ".join(dict.fromkeys(children))))
        del stack[k:]

    def close(tags: set[str], until: set[str]) -> None:
        for k in range(len(stack) - 1, 0, -1):
            if stack[k][0] in tags:
                return pop_to(k)
            if stack[k][0] in until:
                return None

    n = len(page)
    while at < n:
        m = TOKEN.search(page, at)
        if m is None:
            text.append(page[at:])
            break
        if m.start() > at:
            text.append(page[at : m.start()])
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            if page.startswith("<![CDATA[", m.start()):
                text.append(html.escape(page[m.start() + 9 : at].removesuffix("]]>")))
            continue
        inline = tag in INLINE
        if m[1] or m[4]:
            if not inline:
                flush()
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == tag:
                    if inline and stack[k][2] != stack[k - 1][2]:
                        flush()
                    pop_to(k)
                    break
            continue
        if not inline:
            flush()
            if tag not in VOID:
                if tag in ENDS:
                    close(*ENDS[tag])
                close({"p"}, {"div", "article", "section", "main", "body", "td", "th", "li", "blockquote", "aside", "form", "button", "object"})
        if tag in VOID:
            continue
        attributes = m[3] or m[6] or ""
        label, words, hidden = named(tag, attributes)
        _, path, above, children = stack[-1]
        zone = zone_of(tag, words, hidden, above)
        if tag in RAW and not attributes.rstrip().endswith("/"):
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            at = end.end() if end else n
            continue
        if inline and zone != above:
            flush()
        if not inline:
            children.append(label)
        stack.append((tag, f"{path}/{label}" if len(path) < 600 else path, zone, []))
    flush()
    pop_to(1)
    if any(z == ARTICLE for _, z, _ in blocks):
        blocks = [(p, OUTSIDE if z == UNKNOWN else z, t) for p, z, t in blocks]
    return blocks, layouts


def host_of(url: Column) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def parse(pages: DataFrame) -> DataFrame:
    """One row of ``BLOCKS`` for each page; ``row`` tells rows apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        row = TaskContext.get().partitionId() << 36
        block = pa.list_(pa.struct([("path", pa.string()), ("zone", pa.int32()), ("text", pa.string())]))
        layout = pa.list_(pa.struct([("path", pa.string()), ("layout", pa.string())]))
        for piece in slices(batches, 64):
            found = [parsed(h or "") for h in piece.column(3).to_pylist()]
            blocks = [[dict(zip(("path", "zone", "text"), b, strict=True)) for b in bs] for bs, _ in found]
            layouts = [[{"path": p, "layout": x} for p, x in sorted(dict(reversed(ls)).items())] for _, ls in found]
            yield pa.RecordBatch.from_arrays([pa.array(range(row, row + len(found)), pa.int64()), *piece.columns[:3], pa.array(blocks, block), pa.array(layouts, layout)], names=["row", "page_id", "url", "host", "blocks", "layouts"])
            row += len(found)

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), host_of(F.col("url").cast("string")).alias("host"), F.col("html").cast("string").alias("html")).mapInArrow(run, BLOCKS)


def distinct_pages(tree: DataFrame) -> DataFrame:
    """(host, blocks, layouts) once for all pages of a host with the same blocks, texts as hashes and without noise."""
    kept = F.filter("blocks", lambda b: b["zone"] != NOISE)
    short = F.transform(kept, lambda b: F.struct(b["path"].alias("path"), b["zone"].alias("zone"), F.xxhash64(b["text"]).alias("text")))
    pages = tree.select("host", F.array_distinct(short).alias("blocks"), F.xxhash64("blocks").alias("digest"), "layouts")
    return pages.filter(F.size("blocks") > 0).dropDuplicates(["host", "digest"]).drop("digest")


def importance(pages: DataFrame) -> DataFrame:
    """(host, path, zone, importance) of the nodes of every host's merged tree, for the zones that each has on some page; noise has none."""
    one = pages.select("host", F.explode(F.array_distinct(F.transform(F.filter("blocks", lambda b: b["zone"] != NOISE), lambda b: F.struct(b["path"].alias("path"), F.xxhash64(b["text"]).alias("f"))))).alias("b")).select("host", "b.*")
    content = one.groupBy("host", "path", "f").agg(F.count("*").alias("k")).groupBy("host", "path").agg(F.count("*").alias("l"), F.sum(F.log("k")).alias("s"))
    zones = pages.select("host", F.explode(F.array_distinct(F.transform(F.filter("blocks", lambda b: b["zone"] != NOISE), lambda b: F.struct(b["path"].alias("path"), b["zone"].alias("zone"))))).alias("b"))
    # a path has one zone on a page, but for elements that some page names twice
    seen = zones.groupBy("host", "b.path", "b.zone").agg(F.count("*").alias("m")).groupBy("host", "path").agg(F.sum("m").alias("m"), F.collect_set("zone").alias("zones"))
    of_content = F.when(F.col("m") > 1, 1 - F.col("s") / (F.col("l") * F.log("m"))).otherwise(1.0)
    styles = pages.select("host", F.explode("layouts").alias("x")).groupBy("host", "x.path", F.xxhash64("x.layout").alias("layout")).agg(F.count("*").alias("k"))
    node = styles.groupBy("host", "path").agg(F.sum("k").alias("n"), F.sum(F.col("k") * F.log("k")).alias("s"))
    of_layout = F.when(F.col("n") > 1, (F.log("n") - F.col("s") / F.col("n")) / F.log("n")).otherwise(1.0)
    node = node.select(F.col("host").alias("h"), F.col("path").alias("parent"), of_layout.alias("presentation"))
    rows = content.join(seen, ["host", "path"]).withColumn("content", of_content).withColumn("up", F.regexp_replace("path", "/[^/]*$", ""))
    rows = rows.join(node, (F.col("host") == F.col("h")) & (F.col("up") == F.col("parent")), "left")
    stat = CONTENT * F.col("content") + (1 - CONTENT) * F.coalesce("presentation", F.lit(1.0))
    more, weighed = F.col("m") - 1, F.lit(0.0)
    for zone, (prior, weight) in PRIORS.items():
        shared = (prior * weight + more * stat) / (weight + more) if weight else stat
        weighed = F.when(F.col("zone") == zone, shared).otherwise(weighed)
    return rows.withColumn("zone", F.explode("zones")).select("host", "path", "zone", weighed.alias("importance"))


def extract(pages: DataFrame, least: float = LEAST) -> DataFrame:
    """(page_id, url, text) of every page: its blocks in page order without the low branches, joined by line feeds.

    Null and empty pages have an empty text, null urls are one host, repeated rows come out each, other columns are left
    out, an empty table gives none.
    """
    tree = written(parse(pages))
    stays = [z for z, (prior, _) in PRIORS.items() if prior >= least]  # by prior alone
    against = importance(distinct_pages(tree)).filter((F.col("importance") >= least) != F.col("zone").isin(stays))
    against = written(against.select("host", "path", "zone"))
    rows = tree.drop("layouts")
    as_node = lambda b: F.struct(b["path"].alias("path"), b["zone"].alias("zone"))
    if against.count() <= MOST_SENT:
        turned = against.groupBy("host").agg(F.collect_set(F.struct("path", "zone")).alias("turned"))
        rows = rows.join(F.broadcast(turned), "host", "left")
    else:
        nodes = rows.select("row", "host", F.explode(F.array_distinct(F.transform("blocks", as_node))).alias("b")).select("row", "host", "b.path", "b.zone")
        turned = nodes.join(against, ["host", "path", "zone"]).groupBy("row").agg(F.collect_set(F.struct("path", "zone")).alias("turned"))
        rows = rows.join(turned, "row", "left")
    left = F.filter("blocks", lambda b: (b["zone"] != NOISE) & (b["zone"].isin(stays) != F.coalesce(F.array_contains("turned", as_node(b)), F.lit(False))))
    return rows.select("page_id", "url", F.array_join(F.transform(left, lambda b: b["text"]), "\n").alias("text"))
