"""HTML main text by site style trees.

Pages of a host are merged into one tree of style nodes: an element's node is its path of tags
with class and id. A node's importance is a weighted mean of two: of its contents, 1 less the mean
entropy (to the base of the number of pages) with which a content is spread over the host's pages,
and of its presentation, the same for the sequences of its children's tags. A host with few pages
tells little, so its estimate is drawn to that of the node's style on all hosts, and that to a
neutral one, as if they were so many pages more: evidence grows without a step. Branches that HTML
or a name says are no article go, too, as readers' comments and forms differ on each page. Branches of low importance (menus, notices and adverts that
repeat) are removed from each page, but not a wrapper with a telling name that holds most of the
page's text and its heading, nor a branch without which next to nothing would be left.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from urllib.parse import urlsplit

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import released, table, written

#: Importance below which a branch is removed, outside and inside article and main.
LOW, LOW_INSIDE = 0.8, 0.3
#: Importance where nothing is known, and how many pages' evidence it, and all hosts', weigh.
NEUTRAL, PRIOR_PAGES = 0.95, 4.0
#: Weight of presentation in importance.
LOOK_SHARE = 0.1
#: Share of a page's text above which a branch stays against its name, where it holds a heading or
#: an article, and against its importance.
WRAPS, NEARLY_ALL = 0.5, 0.9
#: Nodes to remove that are broadcast at most; more of them are joined to the pages by host.
BROADCAST_NODES = 200_000

_RAW = {"script", "style", "noscript", "template", "iframe", "textarea", "title", "svg", "math"}
#: Of these, elements of other languages, which may close themselves; and those that run on to the end where none is closed.
_FOREIGN, _ENDLESS = {"svg", "math"}, {"script", "style", "iframe", "textarea", "title"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_INLINE = set("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr audio canvas iframe math noscript object picture script style svg template textarea video".split())
_NOISE_TAGS = set("nav aside footer head button select menu dialog datalist".split())
#: Tags that often are no article but may as well wrap a whole page.
_FORM_TAGS = {"form", "fieldset"}
_NOISE_ROLES = set("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar status".split())
_NOISE_WORDS = set(
    "ad ads advert adverts advertisement advertising banner promo promotion sponsor sponsored comment comments disqus reply replies respond sidebar menu nav navbar navigation breadcrumb breadcrumbs"
    " footer masthead cookie cookies consent gdpr notice notices notification alert newsletter subscribe signup login share sharing social related recommended widget popup modal overlay pagination pager copyright toolbar skip".split()
)
#: Of these, names of what readers write: never a wrapper.
_READERS = set("comment comments disqus reply replies respond".split())
#: Words that turn a name into a statement about something else, as in has-sidebar or ads-free.
_STATE_WORDS = set("has with without no non not is are open closed free enabled disabled".split())
#: Words that, beside one that says no article, say nothing more: of what kind its box is, where it stands and what it lists.
_BOX_WORDS = set(
    "bar block body box boxes button buttons card container content cell column entry field fields form frame group header heading holder icon icons inline inner input item items label layer"
    " line link links list module node outer page panel part post posts article articles stories story row section slot small space stack strip tab tabs text thread title top bottom left right"
    " center first last main side under above below unit user view widgets wrap wrapper wide zone area home site primary secondary sub global mobile desktop more show".split()
)
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_TEXTUAL = set("p h1 h2 h3 h4 h5 h6 li blockquote pre td th dd dt figcaption".split())
_TAG = re.compile(r"<(?:!--.*?(?:-->|\Z)|!\[CDATA\[.*?(?:\]\]>|\Z)|[!?][^>]*+>?|(/?)([A-Za-z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+'|[\"'])*+)>?)", re.S)
_END = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I) for tag in _RAW}
_ATTR = re.compile(r"\b(class|id|role|hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_NAME_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_P = (1 << 61) - 1
_BASE = 0x1D3F_0A5B_77C2_9E15
#: What a branch's markup says: nothing, perhaps no article (it may wrap one), no article.
PLAIN, WEAK, STRONG = 0, 1, 2


@dataclass
class Element:
    """A branch: its style node, what its markup says, its blocks, and whether it holds a heading of
    first order, an article or main that no name rules out."""

    tag: str
    parent: int
    node: int
    kind: int
    inside: bool
    named: bool
    first: int
    end: int = 0
    holds: bool = False
    doubted: bool = False
    children: list[str] = field(default_factory=list)


@dataclass
class Page:
    """Blocks of text, and elements in the order in which they open; blocks of a branch are one range."""

    blocks: list[str] = field(default_factory=list)
    elements: list[Element] = field(default_factory=list)

    def nodes(self) -> dict[int, tuple[list[tuple[int, int]], bool]]:
        """node -> ((content, presentation) hashes of its occurrences, whether in article or main);
        containers, and text elements with a name outside articles.

        Contents are hashed from prefix sums over blocks, so nesting costs nothing.
        """
        total, power = [0], [1]
        for block in self.blocks:
            total.append((total[-1] * _BASE + xxhash.xxh3_64_intdigest(block) + 1) % _P)
            power.append(power[-1] * _BASE % _P)
        out: dict[int, tuple[list[tuple[int, int]], bool]] = {}
        for e in self.elements:
            if e.tag in _INLINE or (e.tag in _TEXTUAL and (e.inside or not e.named)):
                continue
            content = (total[e.end] - total[e.first] * power[e.end - e.first]) % _P
            seen, inside = out.get(e.node, ([], False))
            seen.append((content, xxhash.xxh3_64_intdigest(" ".join(e.children))))
            out[e.node] = seen, inside or e.inside and not e.doubted
        return out

    def text(self, low: set[int]) -> str:
        """The blocks outside branches that are ruled out; `low`: nodes of low importance."""
        upto = [0]
        ruled = 0  # first block after the last strong branch
        cuts = iter([(e.first, e.end) for e in self.elements if e.kind == STRONG])
        cut = next(cuts, None)
        for i, block in enumerate(self.blocks):
            while cut and cut[0] <= i:
                ruled, cut = max(ruled, cut[1]), next(cuts, None)
            upto.append(upto[-1] + (0 if i < ruled else len(block)))
        kept = [True] * len(self.blocks)
        past = 0
        for e in self.elements:
            if e.first < past or e.first == e.end:
                continue
            held = upto[e.end] - upto[e.first]
            if e.kind == STRONG:
                gone = True
            elif e.kind == WEAK:
                gone = not (e.holds and held > WRAPS * upto[-1] or e.tag in _FORM_TAGS and held and held == upto[-1])
            else:
                gone = e.node in low and held <= NEARLY_ALL * upto[-1]
            if gone:
                kept[e.first : e.end] = [False] * (e.end - e.first)
                past = e.end
        return "\n".join(b for b, k in zip(self.blocks, kept, strict=True) if k)


def _kind(tag: str, attrs: dict[str, str], inside: bool) -> tuple[int, bool]:
    """What an element's own tag and attributes say, and whether its name casts doubt on it.

    Within an article a name rules out only what all its parts speak against, and no heading or text;
    one that goes on, as in social-history, is a reason to expect more of the branch's importance.
    """
    if tag in _NOISE_TAGS or (tag == "header" and not inside) or "hidden" in attrs or attrs.get("role", "").lower() in _NOISE_ROLES:
        return STRONG, False
    if tag in ("html", "body", "main") or inside and tag in _TEXTUAL:
        words = []
    else:
        words = (attrs.get("class", "") if tag == "article" else f"{attrs.get('class', '')} {attrs.get('id', '')}").split()
    parts = [{x.lower() for x in _NAME_PARTS.findall(w)} for w in words]
    parts = [p for p in parts if p & _NOISE_WORDS and not p & _STATE_WORDS]
    doubted = inside and any(parts)
    if inside:
        parts = [p for p in parts if p <= _NOISE_WORDS | _BOX_WORDS]
    if any(p & _READERS for p in parts):
        return STRONG, doubted
    return WEAK if parts or tag in _FORM_TAGS or attrs.get("role", "").lower() == "form" else PLAIN, doubted


def parse(source: str | None, names: bool = True) -> Page:
    """A page's blocks and elements; without `names` no tag, role, class or id rules a branch out.

    Time is in proportion to the source: what is open is found by tag, and each element closes once.
    """
    page, source = Page(), source or ""
    stack: list[int] = []  # open elements
    at_tag: dict[str, list[int]] = {}  # places in the stack of open elements by tag
    lists: list[int] = []  # places of open lists and tables
    text: list[str] = []

    def flush() -> None:
        if text:
            block = " ".join(html.unescape("".join(text)).split())
            text.clear()
            if block:
                page.blocks.append(block)

    def close_from(place: int) -> None:
        while len(stack) > place:
            e = page.elements[stack.pop()]
            at_tag[e.tag].pop()
            if lists and lists[-1] == len(stack):
                lists.pop()
            e.end = len(page.blocks)
            e.holds = e.kind != STRONG and (e.holds or e.kind == PLAIN and e.tag in ("h1", "article", "main"))
            if e.holds and e.parent >= 0:
                page.elements[e.parent].holds = True

    at = 0
    while m := _TAG.search(source, at):
        if m.start() > at:
            text.append(source[at : m.start()])
        at = m.end()
        tag = m[2]
        if tag is None:
            continue
        tag = tag.lower()
        block = tag not in _INLINE
        if block:
            flush()
        elif tag == "br":
            text.append(" ")
        if m[1]:
            if at_tag.get(tag):
                close_from(at_tag[tag][-1])
            continue
        if tag in _FOREIGN and m[3].endswith("/"):
            continue
        if tag in _RAW:
            end = _END[tag].search(source, at)
            if end or tag in _ENDLESS:
                at = end.end() if end else len(source)
                continue
        if tag in _VOID:
            continue
        if block and at_tag.get("p"):
            close_from(at_tag["p"][0])  # a block ends an open paragraph, and what was open in it
        for other in _CLOSES.get(tag, ()):
            # only within the same list or table
            if at_tag.get(other) and at_tag[other][-1] > (lists[-1] if lists else -1):
                close_from(at_tag[other][-1])
        attrs = {a[0].lower(): a[1] or a[2] or a[3] for a in _ATTR.findall(m[3])} if m[3] else {}
        up = stack[-1] if stack else -1
        parent = page.elements[up] if stack else None
        classes = " ".join(sorted(attrs.get("class", "").split()))
        key = f"{tag}.{classes}#{re.sub('[0-9]+', '0', attrs.get('id', ''))}"
        node = xxhash.xxh3_64_intdigest(key, parent.node if parent else 0) & 0x7FFFFFFFFFFFFFFF
        within = bool(parent) and parent.inside
        if block and parent:
            parent.children.append(key)
        kind, doubted = _kind(tag, attrs, within) if names else (PLAIN, False)
        landmark = within or tag in ("article", "main") or attrs.get("role") == "main"
        page.elements.append(Element(tag, up, node, kind, landmark, bool(classes or attrs.get("id")), len(page.blocks), doubted=doubted))
        at_tag.setdefault(tag, []).append(len(stack))
        if tag in ("ul", "ol", "dl", "table", "select"):
            lists.append(len(stack))
        stack.append(len(page.elements) - 1)
    if at < len(source):
        text.append(source[at:])
    flush()
    close_from(0)
    return page


def host(url: str | None) -> str:
    try:
        return (urlsplit(url or "").hostname or "").lower()
    except ValueError:
        return ""


def style_tree(pages: DataFrame) -> DataFrame:
    """(host, node, inside, n_pages, importance) of the merged pages (url, html).

    Pages whose whole text is the same count once. Sums go by (host, node, content), combined
    before they are shuffled, so a host's pages never meet in one place.
    """
    names = ["host", "page", "node", "inside", "content", "look"]

    @released
    def nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            urls, sources = (batch.column(batch.schema.get_field_index(c)) for c in ("url", "html"))
            for url, source in zip(urls.to_pylist(), sources, strict=True):
                page, name = parse(source.as_py()), host(url)
                key = xxhash.xxh3_64_intdigest("\n".join(page.blocks))
                for node, (seen, inside) in page.nodes().items():
                    content, look = (xxhash.xxh3_64_intdigest(repr(sorted(x))) for x in zip(*seen, strict=True))
                    rows.append((name, key, node, inside, content, look))
            if rows:
                columns = list(zip(*rows, strict=True))
                longs = [pa.array([x - (1 << 64) if x >> 63 else x for x in columns[i]], pa.int64()) for i in (1, 2, 4, 5)]
                yield pa.RecordBatch.from_arrays([pa.array(columns[0]), longs[0], longs[1], pa.array(columns[3]), longs[2], longs[3]], names=names)

    found = pages.select("url", "html").mapInArrow(nodes, "host string, page long, node long, inside boolean, content long, look long")
    each = found.groupBy("host", "page", "node").agg(F.max("inside").alias("inside"), F.min("content").alias("content"), F.min("look").alias("look"))
    counts = written(each.groupBy("host", "node", "content", "look").agg(F.count("*").alias("n"), F.max("inside").alias("inside")), "style-contents")

    def spread(by: list[str]) -> DataFrame:
        """Pages and entropy of each node of `by`: a content on n of m pages has entropy log n / log m, and weighs n."""
        f, m = F.col("n").cast("double"), F.col("m").cast("double")
        parts = []
        for what in ("content", "look"):
            sums = counts.groupBy(*by, what).agg(F.sum("n").alias("n"), F.max("inside").alias("inside"))
            sums = sums.groupBy(*by).agg(F.sum("n").alias("m"), F.sum(f * F.log(f)).alias("spread"), F.max("inside").alias("inside"))
            parts.append(sums.select(*by, "m", "inside", F.when(m > 1, 1 - F.col("spread") / (m * F.log(m))).otherwise(1.0).alias(what)))
        both = parts[0].join(parts[1].select(*by, "look"), by)
        return both.select(*by, "m", "inside", ((1 - LOOK_SHARE) * F.col("content") + LOOK_SHARE * F.col("look")).alias("seen"))

    def drawn(seen: Column, m: Column, prior: Column) -> Column:
        return ((m - 1) * seen + PRIOR_PAGES * prior) / (m - 1 + PRIOR_PAGES)

    everywhere = spread(["node"]).select("node", drawn(F.col("seen"), F.col("m"), F.lit(NEUTRAL)).alias("prior"))
    tree = spread(["host", "node"]).join(everywhere, "node")
    return tree.select("host", "node", "inside", F.col("m").alias("n_pages"), drawn(F.col("seen"), F.col("m"), F.col("prior")).alias("importance"))


def low_nodes(tree: DataFrame) -> DataFrame:
    """(host, node) of a tree's nodes of low importance."""
    return tree.where(F.col("importance") < F.when(F.col("inside"), LOW_INSIDE).otherwise(LOW)).select("host", "node")


def main_text(pages: DataFrame, names: bool = True) -> DataFrame:
    """`page_id, url, text, n_chars` of each row of `pages` (page_id, url, html).

    Blocks in page order, one a line: character references decoded, white space as one space,
    trimmed; empty for null or empty html and for pages of which nothing is left. A null or odd url
    has the host ''. Rows that repeat give a row each; an empty table gives none. Further columns
    play no part. Without `names` importance alone decides.
    """
    spark = pages.sparkSession
    low = written(low_nodes(style_tree(pages)), "low-nodes")
    shown = pages.select("page_id", "url", "html")
    if low.count() <= BROADCAST_NODES:
        drop: dict[str, set[int]] = {}
        for row in low.collect():
            drop.setdefault(row[0], set()).add(row[1])
        shared = spark.sparkContext.broadcast(drop)
        shown = shown.withColumn("drop", F.lit(None).cast("array<bigint>"))
    else:
        shared = spark.sparkContext.broadcast(None)
        # by the tree's own host(): Spark's URL functions know no host of some URLs
        by_host = low.groupBy("host").agg(F.collect_set("node").alias("drop"))
        shown = shown.withColumn("host", F.udf(host, "string")("url")).join(by_host, "host", "left").select("page_id", "url", "html", "drop")

    @released
    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            urls, sources, drops = (batch.column(batch.schema.get_field_index(c)) for c in ("url", "html", "drop"))
            texts = []
            for i, url in enumerate(urls.to_pylist()):
                gone = set(drops[i].as_py() or ()) if shared.value is None else shared.value.get(host(url), set())
                texts.append(parse(sources[i].as_py(), names).text(gone))
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("page_id")), urls, pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return shown.mapInArrow(extract, "page_id long, url string, text string, n_chars long")


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of all `pages`; see `main_text`."""
    return main_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
