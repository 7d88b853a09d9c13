"""Main text of web pages by tree scoring.

Blocks of text give points, for their length and commas, to the elements that
hold them, the nearest most. An element's points shrink with the share of its
text that stands in links. The best element, with those siblings that score or
read like it, is the article.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Blocks shorter than this give no points.
LEAST = 25
#: How much of a block's points its holder, the holder's parent, ... receive.
SHARES = (1.0, 0.5, 1 / 3, 0.25, 0.2, 1 / 6)
#: A sibling joins the article from this share of the best score on.
SIBLING = 0.2
#: A list or other group whose text is links to this share is a menu.
LINKS = 0.6

# Elements and words of page furniture.
BLOCKS = set("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody tfoot thead tr ul caption".split())
RAW = set("script style title textarea noscript iframe template svg math object select option datalist canvas audio video noembed noframes xmp".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: Elements of RAW that a slash closes, and those whose content goes on after the next block tag if they are not closed.
FOREIGN = {"svg", "math"}
ENDLESS = FOREIGN | {"object"}
#: Inside these, HTML may stand within svg and math.
HOLDS_HTML = {"foreignobject", "annotation-xml", "desc"}
FURNITURE = set("nav aside footer header dialog menu button".split())
ROLES = set("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form".split())
UNLIKELY = set("ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disclaimer discussion disqus footer gdpr header login masthead menu modal nav navbar navigation newsletter notice notices notification pager pagination paywall popup promo promoted promotion recommended related replies reply respond responses share sharing sidebar signup skip social sponsor sponsored subscribe subscription tags toolbar widget widgets".split())
LIKELY = set("article articlebody body content entry main page post prose story text".split())

TAG = re.compile(r"""<(?:!--.*?(?:-->|\Z)|[!?][^>]*+>?|(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z))""", re.S)
ATTRIBUTE = re.compile(r"""([a-zA-Z_:@][^\s=/>]*+)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>"']++)))?""")
UNQUOTED = re.compile(r"""=\s*[^\s"'>]+/\Z""")
WORDS = re.compile(r"[a-z]+")


def end_of(tag: str, source: str, at: int) -> int:
    """Where an element of ENDLESS that opened before ``at`` ends: after its end tag, or else before the next
    block tag. Block tags end svg and math even where an end tag follows, unless they stand in HOLDS_HTML."""
    depth, held, block, skip = 1, 0, -1, at
    for m in TAG.finditer(source, at):
        name = (m[2] or m[5] or "").lower()
        if m.start() < skip or not name:
            continue
        closing, written = (m[1] or m[4]) == "/", m[3] or m[6] or ""
        closed = tag in FOREIGN and written.endswith("/") and not UNQUOTED.search(written)
        if name == tag and not closed:
            depth += -1 if closing else 1
            if not depth:
                return m.end()
        elif name in ("script", "style") and not closing and not closed:
            end = re.compile(rf"</{name}(?=[\s/>]|\Z)", re.I).search(source, m.end())
            skip = end.start() if end else skip
        elif name in BLOCKS:
            block = m.start() if block < 0 else block
            if tag in FOREIGN and not held:
                return m.start()
        elif name in HOLDS_HTML and not closed:
            held = max(0, held - 1) if closing else held + 1
    return block if block >= 0 else len(source)


@dataclass
class Node:
    tag: str
    parent: int
    dropped: bool = False
    unlikely: bool = False
    score: float = 0.0
    chars: int = 0
    links: int = 0


@dataclass
class Page:
    nodes: list[Node] = field(default_factory=lambda: [Node("", -1)])
    #: Text, its characters in links, and the holder, in page order.
    blocks: list[tuple[str, int, int]] = field(default_factory=list)


def parse(source: str) -> Page:
    """The tree of block elements; inline elements only tell links from other text."""
    page, open_ = Page(), [0]
    text: list[str] = []
    linked: list[str] = []
    depth = at = 0  # of links; position

    def close_block() -> None:
        nonlocal text, linked
        words = clean("".join(text))
        if words:
            page.blocks.append((words, len(clean("".join(linked))), open_[-1]))
        text, linked = [], []

    def add(piece: str) -> None:
        text.append(piece)
        if depth:
            linked.append(piece)

    def leave(until: tuple[str, ...], stop: tuple[str, ...] = ()) -> None:
        """Close the innermost open element of ``until``, unless one of ``stop`` holds it."""
        for k in range(len(open_) - 1, 0, -1):
            tag = page.nodes[open_[k]].tag
            if tag in until:
                del open_[k:]
                return
            if tag in stop:
                return

    for m in TAG.finditer(source):
        if m.start() < at:
            continue  # inside a script or the like
        if m.start() > at:
            add(source[at : m.start()])
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        closing = (m[1] or m[4]) == "/"
        if not tag:
            continue
        if tag in ENDLESS and not closing:
            written = m[3] or m[6] or ""
            if tag not in FOREIGN or not written.endswith("/") or UNQUOTED.search(written):
                at = end_of(tag, source, at)
            add(" ")
        elif tag in RAW and not closing:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)[^>]*+>?", re.I).search(source, at)
            at = end.end() if end else len(source)
            add(" ")
        elif tag == "a":
            if depth and not closing:
                linked.append(" ")
            depth = 0 if closing else 1
        elif tag in BLOCKS or tag == "button":
            close_block()
            depth = 0 if tag != "button" else depth
            if closing:
                leave((tag,), () if tag in ("body", "html", "article", "main") else ("article", "main"))
                continue
            if tag in BLOCKS:
                leave(("p",), ("article", "main", "section", "div", "td", "li", "blockquote", "figure", "aside", "nav", "form"))
            if tag == "li":
                leave(("li",), ("ul", "ol", "menu", "dir"))
            elif tag in ("dt", "dd"):
                leave(("dt", "dd"), ("dl",))
            elif tag == "tr":
                leave(("tr",), ("table",))
            if tag not in VOID:
                page.nodes.append(of_attributes(tag, m[3] or m[6] or "", open_[-1]))
                open_.append(len(page.nodes) - 1)
        elif tag in ("br", "td", "th", "img"):
            add(" ")
    add(source[at:])
    close_block()
    return page


def clean(text: str) -> str:
    return " ".join((html.unescape(text) if "&" in text else text).split())


def of_attributes(tag: str, written: str, parent: int) -> Node:
    node = Node(tag, parent, dropped=tag in FURNITURE)
    if written and not written.isspace():
        names = {k.lower(): html.unescape(a or b or c or "") for k, a, b, c in ATTRIBUTE.findall(written)}
        hidden = "hidden" in names or names.get("aria-hidden", "").lower() == "true"
        style = re.sub(r"\s", "", names.get("style", "").lower())
        node.dropped |= hidden or "display:none" in style or "visibility:hidden" in style
        node.dropped |= names.get("role", "").lower() in ROLES
        labels = {w for k in ("class", "id") for w in WORDS.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", names.get(k, "")).lower())}
        node.unlikely = bool(labels & UNLIKELY) and not (tag in ("html", "body", "main") or tag == "article" and not labels & {"comment", "comments", "reply"})
        node.score = 25.0 * (bool(labels & LIKELY or "articlebody" in names.get("itemprop", "").lower()) - node.unlikely)
    node.score += {"article": 30.0, "main": 20.0, "pre": 3.0, "blockquote": 3.0}.get(tag, 0.0)
    return node


def main_text(source: str) -> str:
    """The article of a page, one line per block."""
    page = parse(source)
    nodes = page.nodes
    for words, links, holder in page.blocks:
        for k in ancestors(nodes, holder):
            nodes[k].chars += len(words)
            nodes[k].links += links
    whole = nodes[0].chars
    # A label such as "has-sidebar" on what wraps the page is no furniture, nor is a form around it.
    wraps = {k for i, x in enumerate(nodes) if x.tag in ("article", "main") for k in ancestors(nodes, x.parent)}
    for k, x in enumerate(nodes):
        x.dropped |= (x.unlikely or x.tag == "form") and k not in wraps and 2 * x.chars < whole + 1
        x.dropped |= x.tag in ("ul", "ol", "dl", "table", "div", "section") and x.chars > 0 and x.links > LINKS * x.chars and 2 * x.chars < whole + 1
        if x.parent >= 0:
            x.dropped |= nodes[x.parent].dropped  # parents come first
    blocks = [b for b in page.blocks if not nodes[b[2]].dropped]
    if not blocks:
        return ""

    given: dict[int, float] = {}
    for words, links, holder in blocks:
        if len(words) >= LEAST:
            points = (1 + words.count(",") + min(len(words) // 100, 3)) * (1 - links / len(words))
            for share, k in zip(SHARES, list(ancestors(nodes, holder))[nodes[holder].tag in ("p", "li", "pre", "dd", "tr", "blockquote") :], strict=False):
                given[k] = given.get(k, 0.0) + share * points
    scores = {k: (v + nodes[k].score) * (1 - nodes[k].links / max(1, nodes[k].chars)) for k, v in given.items()}
    best = max(scores, key=lambda k: (scores[k], -k)) if scores else 0
    if not scores or nodes[best].tag not in ("article", "main"):
        # An article element that holds the best, or the only one there is, is the article.
        around = [k for k in ancestors(nodes, best) if nodes[k].tag in ("article", "main")]
        alone = [k for k, x in enumerate(nodes) if x.tag in ("article", "main") and not x.dropped]
        best = around[-1] if around else alone[0] if len(alone) == 1 and not scores else best
    kept = {best}
    if best:
        level = max(10.0, SIBLING * scores.get(best, 0.0))
        for k, x in enumerate(nodes):
            if x.parent == nodes[best].parent and k != best and not x.dropped and x.chars:
                prose = x.tag in ("p", "pre", "blockquote") and x.links < 0.25 * x.chars and x.chars > 80
                if scores.get(k, 0.0) >= level or prose or x.tag in ("h1", "h2") and k < best:
                    kept.add(k)
    return "\n".join(words for words, _, holder in blocks if any(k in kept for k in ancestors(nodes, holder)))


def ancestors(nodes: list[Node], k: int):
    while k >= 0:
        yield k
        k = nodes[k].parent


RESULT = T.StructType([T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])


@F.arrow_udf(RESULT)
def extracted(column: pa.Array) -> pa.Array:
    texts = [main_text(x.as_py() or "") for x in column]
    return pa.StructArray.from_arrays([pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], RESULT.names)


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", source: str = "html") -> DataFrame:
    """``key``, ``url``, ``text``, ``n_chars``: one row per row of ``pages``, in one narrow stage.

    Null or empty html gives an empty text; repeated rows are repeated; other
    columns are ignored; no rows give no rows.
    """
    rows = pages.select(F.col(key).alias("_key"), F.col(url).alias("_url"), extracted(F.col(source)).alias("_x"))
    return rows.select(F.col("_key").alias(key), F.col("_url").alias(url), "_x.text", "_x.n_chars")
