"""Main text of web pages by site style trees.

The pages of a host are merged into one tree: an element is the path of tags, classes and ids that leads to it. At each
element two things vary from page to page: its presentation, the tags of its children, and its content, the blocks of
text below it. The importance of an element is composed of the entropy of its presentations and of how little its
contents repeat; branches that look and read alike on many pages of a host are furniture and are taken out of each page.
What HTML itself declares (menus, footers, asides, forms, adverts and comments by tag, role or class) has no importance
on any page; the element `article`, else `main`, has all of it where a page has one, unless main has MUCH more text beside
its articles. A class or a form is a weak sign: a page that has no other text keeps what only such signs would take.
"""

from __future__ import annotations

import html
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grainmill.llm._common import ship, table

#: A branch goes if it is on MIN_PAGES different pages of the host or more, and its importance is below LEAST.
MIN_PAGES, LEAST, GAMMA = 8, 0.3, 0.9
#: Times the text of its articles that main has beside them, and characters at least, to count as the page's text itself.
MUCH, MUCH_CHARS = 4, 500
#: Furniture paths up to this number are broadcast (8 bytes each); more are joined by host.
BROADCAST_PATHS = 2_000_000

VOID = set("area base br col embed hr img input link meta param source track wbr keygen frame".split())
RAW = set("script style noscript template iframe object svg textarea select canvas audio video title head".split())
#: Of these, what the page leaves open has no text up to its end, as in browsers; of the others only the tag is passed over.
TO_THE_END = set("script style iframe textarea title".split())
MATH = set("math mi mn mo ms mtext mrow msup msub msubsup mfrac msqrt mroot mover munder munderover mmultiscripts mprescripts mtable mtr mlabeledtr mtd mstyle mpadded mphantom mspace menclose merror mfenced maction semantics".split())
#: Also these are inline, with a space before and after.
SPACED = set("br mtr mtd mspace annotation annotation-xml".split())
INLINE = MATH | SPACED | set("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr nobr".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "thead": {"tr", "td", "th"}, "tbody": {"tr", "td", "th", "thead"}, "tfoot": {"tr", "td", "th", "tbody"}}
SCOPES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "option": {"select"}, "thead": {"table"}, "tbody": {"table"}, "tfoot": {"table"}}

FURNITURE_TAGS = set("nav footer aside form button dialog menu menuitem fieldset datalist".split())
FURNITURE_ROLES = set("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar form".split())
FURNITURE_WORDS = set(
    "ad ads adv advert adverts advertisement advertising adbox adsense banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies copyright disclaimer disqus "
    "dropdown footer gdpr header login masthead menu modal nav navbar navigation newsletter notice notices notification overlay pager pagination popup promo promoted promotion "
    "related reply replies respond share sharing sidebar signup skip social sponsor sponsored subscribe subscription toolbar topbar widget widgets".split()
)
WHOLE = {"html", "body", "main", "article"}
#: Elements of running text: in an article or main, and without class or id, they are content however often it repeats.
RUNNING = set("p h1 h2 h3 h4 h5 h6 blockquote pre ul ol li dl dt dd table thead tbody tfoot tr td th figure figcaption".split())

TOKEN = re.compile(r"""<!--.*?(?:--!?>|\Z)|<[!?][^>]*+>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:"[^"]*+"|'[^']*+'|[^>"']++)*+)>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)([^<>]*+)>""", re.S)
ATTRIBUTE = re.compile(r"""([a-zA-Z_:@][^\s=>"'/]*+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
#: Raw elements that stand in running text: what is before and after them is one block. (A drawing is a block of its own.)
IN_TEXT = RAW - {"title", "head", "svg"}
#: Furniture by tag that can also be around a page's text.
WEAK_TAGS = {"form", "fieldset"}
RAW_TAG = {tag: re.compile(rf"<(/?){tag}(?![a-z0-9:-])((?:\"[^\"]*+\"|'[^']*+'|[^>\"']++)*+)>", re.I) for tag in RAW}
RAW_END = {tag: re.compile(rf"</{tag}\b", re.I) for tag in RAW}


class Element:
    __slots__ = ("tag", "path", "furniture", "strong", "place", "children", "fixed")

    def __init__(self, tag: str, label: str, parent: Element | None, furniture: bool, strong: bool = True):
        self.tag = tag
        self.path = zlib.crc32(label.encode(), parent.path if parent else 0) | (zlib.adler32(label.encode(), (parent.path >> 32 if parent else 1) or 1) << 32)
        self.furniture = furniture or (parent is not None and parent.furniture)
        self.strong = (furniture and strong) or (parent is not None and parent.strong)
        self.place = 2 if tag == "article" else max(parent.place if parent else 0, 1 if tag == "main" else 0)
        self.children: list[str] = []
        self.fixed = tag in WHOLE or (self.place > 0 and tag in RUNNING and label == ">" + tag)


def _attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(text)} if text.strip(" \n\t\r/") else {}


def _words(attributes: dict[str, str]) -> list[str]:
    named = f"{attributes.get('class', '')} {attributes.get('id', '')}"
    return [w for w in re.split(r"[^a-z]+", re.sub(r"(?<=[a-z])(?=[A-Z])", " ", named).lower()) if w]


def _is_furniture(tag: str, attributes: dict[str, str], parent: Element | None) -> tuple[bool, bool]:
    """Whether an element is declared to be furniture, and whether by more than its class, its id or by being a form."""
    strong = _is_strong(tag, attributes, parent)
    words = set(_words(attributes))
    if tag in WHOLE:
        return strong or (tag == "article" and bool(words & {"comment", "comments", "reply"})), strong or tag == "article"
    return strong or tag in WEAK_TAGS or (tag != "header" and bool(words & FURNITURE_WORDS)), strong


def _is_strong(tag: str, attributes: dict[str, str], parent: Element | None) -> bool:
    if (tag in FURNITURE_TAGS and tag not in WEAK_TAGS) or attributes.get("role", "").lower() in FURNITURE_ROLES:
        return True
    if "hidden" in attributes or attributes.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", attributes.get("style", "")):
        return True
    return tag == "header" and not (parent and parent.place)


def _behind(page: str, tag: str, at: int) -> int:
    """Where the text goes on behind an element of RAW whose tag ends at `at`: behind its own end tag, if it has one."""
    if tag in TO_THE_END:
        end = RAW_END[tag].search(page, at)
        close = page.find(">", end.end()) if end else -1
        return close + 1 if close >= 0 else len(page)
    depth = 1
    for m in RAW_TAG[tag].finditer(page, at):
        if m[1]:
            depth -= 1
        elif tag != "svg" or not m[2].endswith("/"):
            depth += 1
        if not depth:
            return m.end()
    return at


def blocks(page: str) -> tuple[list[tuple[str, list[Element]]], list[Element]]:
    """A page's blocks of text in page order, each with its ancestors, and all its elements. Any text is a page."""
    found, elements, stack, text, at = [], [], [], [], 0

    def flush():
        if text:
            joined = " ".join(html.unescape("".join(text)).split())
            if joined:
                found.append((joined, list(stack)))
            text.clear()

    for m in iter(lambda: TOKEN.search(page, at), None):
        text.append(page[at : m.start()])
        at = m.end()
        closing, tag, rest = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if tag is None:
            continue
        tag = tag.lower()
        if tag in INLINE:
            if tag in SPACED:
                text.append(" ")
            continue
        if tag in IN_TEXT:
            at = at if closing else _behind(page, tag, at)
            continue
        flush()
        if closing:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i].tag == tag:
                    del stack[i:]
                    break
            continue
        if tag == "head":  # without its own end it ends where the body begins
            end = re.compile(r"</head\b[^>]*>|(?=<body\b)", re.I).search(page, at)
            at = end.end() if end else at
            continue
        if tag in RAW:
            at = at if rest.rstrip().endswith("/") else _behind(page, tag, at)
            continue
        if tag in VOID:
            continue
        if tag not in CLOSES or tag in ("dt", "dd"):  # a block ends an open paragraph
            for i in range(len(stack) - 1, -1, -1):
                if stack[i].tag == "p":
                    del stack[i:]
                    break
                if stack[i].tag in ("td", "th", "button", "object", "table", "article", "section", "div"):
                    break
        for i in range(len(stack) - 1, -1, -1):
            if stack[i].tag in SCOPES.get(tag, ()):
                break
            if stack[i].tag in CLOSES.get(tag, ()):
                del stack[i:]
                break
        attributes = _attributes(rest)
        parent = stack[-1] if stack else None
        label = ">" + ".".join([tag, *sorted(set(_words(attributes)))])
        element = Element(tag, label, parent, *_is_furniture(tag, attributes, parent))
        if parent:
            parent.children.append(label)
        elements.append(element)
        if not rest.rstrip().endswith("/"):
            stack.append(element)
    tail = page[at:]
    text.append(re.sub(r"<(?:/?[a-zA-Z][^<>]*|![^<>]*)\Z", "", tail))  # a tag that the page's end cuts off
    flush()
    return found, elements


def main_text(page: str | None, host_key: int, furniture) -> str:
    """The page's blocks in its article, else its main, else anywhere, that are in no furniture; joined by empty lines."""
    if not page:
        return ""
    found, _ = blocks(page)
    named = [(t, a) for t, a in found if not (a and a[-1].furniture)]
    if not named:  # all of it is in a form, or in an element of a telling class
        named = [(t, a) for t, a in found if not (a and a[-1].strong)]
    rows = [(t, a) for t, a in named if not any(_key(host_key, e.path) in furniture for e in a if not e.fixed)] if furniture else named
    rows = rows or named  # a site of one repeated text still has that text
    size = [sum(len(t) for t, a in rows if (a[-1].place if a else 0) == place) for place in range(3)]
    most = 2 if size[2] else 1 if size[1] else 0
    if most == 2 and size[1] > max(MUCH * size[2], MUCH_CHARS):  # an article that is only a teaser
        most = 1
    return "\n\n".join(t for t, a in rows if (a[-1].place if a else 0) >= most)


def _key(host_key: int, path: int) -> int:
    return ((host_key * 0x9E3779B97F4A7C15 ^ path) * 0xBF58476D1CE4E5B9 & 0xFFFFFFFFFFFFFFFF) - (1 << 63)


def _hash(text: str) -> int:
    data = text.encode("utf-8", "surrogatepass")
    return zlib.crc32(data) | zlib.adler32(data[::-1]) << 32


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _tree_rows(batches):
    """For each element path of a page: that it is there (kind 0), its presentations (1) and the contents below it (2)."""
    for batch in batches:
        out: list[tuple[int, int, int, int]] = []
        for page, host in zip(batch.column("html").to_pylist(), batch.column("host").to_pylist(), strict=True):
            if not page or not host:
                continue
            found, elements = blocks(page)
            mine, whole = _hash(host), _signed(_hash(page))
            rows = {(_key(mine, e.path), 0, 0) for e in elements} | {(_key(mine, e.path), 1, _signed(_hash(" ".join(e.children)))) for e in elements}
            for text, ancestors in found:
                h = _signed(_hash(text))
                rows |= {(_key(mine, e.path), 2, h) for e in ancestors if not e.fixed}
            out += [(*r, whole) for r in rows]
        columns = np.array(out, dtype=np.int64).reshape(-1, 4)
        yield pa.RecordBatch.from_arrays([pa.array(columns[:, 0]), pa.array(columns[:, 1].astype(np.int32)), pa.array(columns[:, 2]), pa.array(columns[:, 3])], names=["path", "kind", "feature", "page"])


def importances(pages: DataFrame) -> DataFrame:
    """path, n_pages, importance of each element path of each host, of pages(host, html). Equal pages of a host count once.

    Of an element on m pages: presentation = entropy of its child sequences to the base m; content = the mean over the
    blocks below it of 1 - log_m(pages that have the block). With one page both are 1. They are composed as
    (1 - GAMMA) * presentation + GAMMA * content; an element without content has its presentation's importance.
    """
    rows = pages.select("host", "html").mapInArrow(_tree_rows, "path long, kind int, feature long, page long")
    n = rows.groupBy("path", "kind", "feature").agg(F.count_distinct("page").alias("n"))
    part = n.groupBy("path").agg(
        F.max(F.when(F.col("kind") == 0, F.col("n"))).alias("m"),
        F.sum(F.when(F.col("kind") == 1, F.col("n"))).alias("styles"),
        F.sum(F.when(F.col("kind") == 1, F.col("n") * F.log("n"))).alias("style_logs"),
        F.avg(F.when(F.col("kind") == 2, F.log("n"))).alias("content_log"),
    )
    m = F.log(F.col("m").cast("double"))
    presentation = F.when(F.col("m") == 1, 1.0).otherwise((F.log("styles") - F.col("style_logs") / F.col("styles")) / m)
    content = F.when(F.col("m") == 1, 1.0).otherwise(1 - F.col("content_log") / m)
    return part.select("path", F.col("m").alias("n_pages"), F.coalesce((1 - GAMMA) * presentation + GAMMA * content, presentation).alias("importance"))


def _extract(shared, keep: list[str]):
    def run(batches):
        for batch in batches:
            pages, hosts = batch.column("html").to_pylist(), batch.column("host").to_pylist()
            named = batch.column("furniture").to_pylist() if shared is None else None
            texts = [main_text(p, _hash(h or ""), shared.value if named is None else set(named[i] or ())) for i, (p, h) in enumerate(zip(pages, hosts, strict=True))]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*keep, "text", "n_chars"])

    return run


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for each row of pages(page_id, url, html).

    A null or empty html has an empty text. A page without a host (null url, or none in it) is its own site, from which
    nothing is learnt. White space inside a block, also what references such as &nbsp; stand for, becomes one space;
    blocks are joined by an empty line. Rows that repeat each give a row, and count as one page of their host.
    The statistics are sums over all pages, by element and content, so a host of any size is no task's own.
    """
    spark = pages.sparkSession
    ship(spark)
    host = F.lower(F.regexp_extract("url", r"(?s)^.*?://([^/?#]*)", 1))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", F.coalesce(host, F.lit("")).alias("host"))
    low = importances(rows.where("host <> '' and html is not null")).where((F.col("n_pages") >= MIN_PAGES) & (F.col("importance") < LEAST))
    schema = "page_id long, url string, text string, n_chars long"
    found = low.select("path").limit(BROADCAST_PATHS + 1).collect()
    if len(found) <= BROADCAST_PATHS:
        return rows.mapInArrow(_extract(spark.sparkContext.broadcast(frozenset(r["path"] for r in found)), ["page_id", "url"]), schema)
    by_host = rows.select("host", "html").mapInArrow(_host_paths, "host string, path long").distinct().join(low, "path", "left_semi").groupBy("host").agg(F.collect_list("path").alias("furniture"))
    return rows.join(by_host, "host", "left").mapInArrow(_extract(None, ["page_id", "url"]), schema)


def _host_paths(batches):
    for batch in batches:
        out = {(h, _key(_hash(h), e.path)) for p, h in zip(batch.column("html").to_pylist(), batch.column("host").to_pylist(), strict=True) if p and h for e in blocks(p)[1]}
        yield pa.RecordBatch.from_arrays([pa.array([h for h, _ in out], pa.string()), pa.array([k for _, k in out], pa.int64())], names=["host", "path"])


def op3_html_text(spark, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
