"""Main text of web pages with site templates removed.

A page is parsed into elements; each container element's subtree has a digest of its
tags and texts.  Spark counts per host on how many different pages a subtree occurs,
copies of a page counting once; subtrees that recur on ``LEAST_PAGES`` of them, however
large the host is, are the site's template and are deleted.  What is a menu, header, footer, sidebar, notice, advert,
form, script, style or comment section by its tag, role or class is left out as well;
a class or id never takes the page's article or main element with it.
The article, or without one the body, then gives one line per block.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .url_filter import host_of

# A subtree is template from so many different pages of its host.
LEAST_PAGES = 5

_TAG = re.compile(
    r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)(>|\Z)|<(/?)([a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)""",
    re.DOTALL,
)
_ATTRIBUTE = re.compile(r"""(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
_RAW = {"script", "style", "textarea", "title", "iframe", "noembed", "noframes", "xmp"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_BLOCKS = {
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "div", "dl", "dt", "fieldset", "figcaption",
    "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "html", "li", "main", "nav", "ol", "p", "pre", "section",
    "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}
# A start tag that ends an open element: its own kind, up to the element that holds it.
_ENDS = {"li": ({"li"}, {"ul", "ol"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}),
         "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
_CLOSE_PARAGRAPH = _BLOCKS - {"td", "th", "tr", "tbody", "thead", "tfoot", "caption", "html", "body"}
_CONTAINERS = {"aside", "details", "div", "dl", "footer", "form", "header", "nav", "ol", "section", "table", "ul"}
_LEFT_OUT = {
    "aside", "button", "dialog", "footer", "form", "head", "header", "iframe", "input", "menu", "nav", "noembed", "noframes", "noscript", "object",
    "script", "select", "style", "svg", "template", "textarea", "title",
}
_ROLES = {"alert", "banner", "complementary", "contentinfo", "dialog", "form", "menu", "menubar", "navigation", "search"}
_NAMES = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "sponsor", "sponsored", "promo", "banner", "cookie", "cookies", "consent",
    "gdpr", "notice", "popup", "modal", "newsletter", "subscribe", "sidebar", "sidebars", "menu", "menus", "nav", "navbar", "navigation",
    "breadcrumb", "breadcrumbs", "header", "masthead", "footer", "comment", "comments", "disqus", "replies", "respond", "social", "share", "login",
}
_COMMENTS = {"comment", "comments", "disqus", "replies", "respond"}
# Words after a name that still mean the thing itself (ad-slot, sidebar-left), and before it, what only has one (with-sidebar).
_PARTS = {
    "area", "bar", "block", "body", "bottom", "box", "btn", "button", "buttons", "center", "col", "column", "container", "content", "form", "group", "inner",
    "item", "items", "left", "link", "links", "list", "outer", "panel", "primary", "right", "secondary", "section", "signup", "slot", "toolbar", "top", "unit",
    "widget", "widgets", "wrap", "wrapper",
}
_HAVING = {"has", "have", "no", "not", "with", "without"}
_NEVER = {"html", "body", "main"}


@lru_cache(65_536)
def _kind(attributes: str) -> tuple[bool, bool, bool]:
    """Whether role, class or id name something to leave out: by role, by class or id, and a comment section."""
    role = named = comments = False
    for name, *values in _ATTRIBUTE.findall(attributes):
        value = "".join(values).lower()
        if name.lower() == "role":
            role |= bool(set(re.split(r"[^a-z0-9]+", value)) & _ROLES)
            continue
        for token in value.split():
            words = [w for w in re.split(r"[^a-z0-9]+", token) if w]
            while len(words) > 1 and (words[-1] in _PARTS or words[-1].isdigit()):
                words.pop()
            if words and words[-1] in _NAMES and words[0] not in _HAVING:
                named, comments = True, comments or words[-1] in _COMMENTS
    return role, named, comments


class Element:
    __slots__ = ("tag", "names", "children", "digest", "left_out", "behind")

    def __init__(self, tag: str, attributes: str):
        self.tag, self.children, self.digest = tag, [], b""
        self.names = attributes
        self.left_out = tag in _LEFT_OUT
        self.behind = 0  # left out by class or id alone: 1, a comment section 2
        if attributes and not self.left_out and tag not in _NEVER:
            role, named, comments = _kind(attributes)
            self.left_out = role or named
            self.behind = 0 if role else named + comments

    @property
    def is_main(self) -> bool:
        return self.tag in ("article", "main") or bool(re.search(r"""role\s*=\s*["']?main\b""", self.names, re.IGNORECASE))


def parse(html: str) -> tuple[Element, list[Element]]:
    """The tree of a page, and its elements in page order; tags that are missing or misplaced are tolerated."""
    root = Element("html", "")
    stack, every, open_tags, at = [root], [root], {"html": 1}, 0

    def pop() -> None:
        open_tags[stack.pop().tag] -= 1

    while at < len(html):
        m = _TAG.search(html, at)
        if m is None:
            stack[-1].children.append(html[at:])
            break
        if m.start() > at:
            stack[-1].children.append(html[at : m.start()])
        at = m.end()
        name = m.group(2) or m.group(6)
        if not name:
            continue
        tag, closing, attributes = name.lower(), bool(m.group(1) or m.group(5)), m.group(3) or ""
        if closing:
            if open_tags.get(tag) and tag != "html":
                while stack[-1].tag != tag:
                    pop()
                pop()
            continue
        if m.end() == len(html) and not m.group().endswith(">"):
            break  # a tag that the page's end cuts off
        if tag == "html":
            continue
        if tag in _CLOSE_PARAGRAPH and open_tags.get("p"):
            while stack[-1].tag != "p":
                pop()
            pop()
        if tag in _ENDS:
            ends, until = _ENDS[tag]
            if any(open_tags.get(t) for t in ends):
                k = len(stack) - 1
                while k and stack[k].tag not in until and stack[k].tag not in ends:
                    k -= 1
                if stack[k].tag in ends:
                    while len(stack) > k:
                        pop()
        element = Element(tag, attributes)
        every.append(element)
        stack[-1].children.append(element)
        if tag in _RAW:
            end = re.compile(rf"</{tag}(?=[\s/>]|\Z)", re.IGNORECASE).search(html, at)
            element.children.append(html[at : end.start() if end else len(html)])
            if end:
                close = html.find(">", end.end())
                at = close + 1 if close >= 0 else len(html)
            else:
                at = len(html)
        elif tag not in _VOID and not attributes.rstrip().endswith("/") or tag in _BLOCKS - _VOID:
            stack.append(element)
            open_tags[tag] = open_tags.get(tag, 0) + 1
    return root, every


def digest(every: list[Element]) -> None:
    """Digest of every subtree, from the leaves up; white space does not count."""
    for element in reversed(every):
        h = hashlib.blake2b(element.tag.encode(), digest_size=8)
        for child in element.children:
            if isinstance(child, str):
                child = " ".join(child.split())
                h.update(b"t" + child.encode("utf-8", "replace") if child else b"")
            else:
                h.update(b"e" + child.digest)
        element.digest = h.digest()


def _number(raw: bytes) -> int:
    return int.from_bytes(raw, "big", signed=True)


def main_text(root: Element, template: set[int]) -> str:
    """Blocks of the main element without what is left out, one line each.

    A main element counts wherever a class or id would hide it, an article only if no other
    is left and it does not stand in a comment section.
    """
    met, todo = [], [(root, 0)]
    while todo:
        element, behind = todo.pop()
        if element.left_out and not element.behind or element.digest and element.tag in _CONTAINERS and _number(element.digest) in template:
            continue
        behind = max(behind, element.behind)
        if element.is_main:
            met.append((element, behind))
        else:
            todo += [(c, behind) for c in reversed(element.children) if isinstance(c, Element)]
    mains = [e for e, behind in met if not behind or e.tag != "article"] or [e for e, behind in met if behind == 1]
    blocks, words = [], []

    def end_block() -> None:
        text = " ".join(entities.unescape("".join(words)).split())
        if text:
            blocks.append(text)
        words.clear()

    for main in mains or [root]:
        todo = [main]
        while todo:
            node = todo.pop()
            if node is None:
                end_block()
            elif isinstance(node, str):
                words.append(node)
            elif node is not main and (node.left_out or node.tag in _CONTAINERS and _number(node.digest) in template):
                if node.tag in _BLOCKS:
                    end_block()
            else:
                if node.tag in _BLOCKS:
                    end_block()
                    todo.append(None)
                elif node.tag == "br":
                    words.append(" ")
                todo += reversed(node.children)
        end_block()
    return "\n".join(blocks)


def _subtrees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Containers of each page, with the digest of the page's own text."""
    for batch in batches:
        rows = []
        for key, host, html in zip(*(c.to_pylist() for c in batch.columns)):
            root, every = parse(html or "")
            digest(every)
            page = _number(hashlib.blake2b(main_text(root, set()).encode("utf-8", "replace"), digest_size=8).digest())
            rows += [(key, host, _number(x), page) for x in {e.digest for e in every if e.tag in _CONTAINERS}]
        columns = list(zip(*rows)) or [[]] * 4
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["key", "host", "subtree", "page"])


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = []
        for html, template in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
            root, every = parse(html or "")
            if template:
                digest(every)
            found.append(main_text(root, set(template or ())))
        columns = [*batch.columns[:2], pa.array(found, pa.string()), pa.array([len(t) for t in found], pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, names=["page_id", "url", "text", "n_chars"])


def templates(pages: DataFrame, least_pages: int = LEAST_PAGES) -> DataFrame:
    """``key, template``: for each page row that has some, the digests of its template subtrees."""
    keyed = pages.select(F.xxhash64("page_id", "url", "html").alias("key"), host_of(F.col("url")).alias("host"), "html")
    found = keyed.mapInArrow(_subtrees, "key long, host string, subtree long, page long")
    different = found.select("host", "subtree", "page").distinct()
    often = different.groupBy("host", "subtree").agg(F.count("*").alias("pages")).where(f"pages >= {least_pages}").select("host", "subtree")
    return found.join(often, ["host", "subtree"]).groupBy("key").agg(F.collect_set("subtree").alias("template"))


def extract(pages: DataFrame, least_pages: int = LEAST_PAGES) -> DataFrame:
    """``page_id, url, text, n_chars`` of every page row.

    Blocks stand in page order, one line each; white space inside a block is one
    space; character references are decoded.  A null html is empty and gives an
    empty text; pages without a host share the empty host; repeated rows each get
    their text; other columns are ignored; an empty table gives an empty result.
    """
    key = F.xxhash64("page_id", "url", "html").alias("key")
    rows = pages.select("page_id", "url", "html", key).join(templates(pages, least_pages), "key", "left")
    kinds = [f"{c} {pages.schema[c].dataType.simpleString()}" for c in ("page_id", "url")]
    return rows.select("page_id", "url", "html", "template").mapInArrow(_texts, f"{', '.join(kinds)}, text string, n_chars long")
