"""Pages of HTML to text, links, images and files: one Arrow pass, with the splitting of links left to columns."""

from __future__ import annotations

import re
from collections.abc import Iterator, Set
from html.parser import HTMLParser
from urllib.parse import urljoin, urlsplit

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.lexicon import SKIPPED_HOSTS
from ..functions.text import normalized_url
from ..session import small_batches

SCHEMA = "text string, links array<string>, images array<struct<url:string,alt:string>>, files array<string>"
DROPPED = {"script", "style", "noscript", "iframe", "embed", "object"}
CHROME_TAGS, CHROME_CLASSES = {"nav", "header", "footer"}, {"menu", "navigation", "sidebar", "widget"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
BLOCKS = {"p", "div", "ul", "ol", "table", "h1", "h2", "h3", "h4", "h5", "h6", "section", "article", "main", "header", "footer", "nav", "aside", "form", "pre", "blockquote", "hr", "dl"}
ASSET = re.compile(r"\.(?:pdf|docx?|xlsx?|pptx?|jpg|jpeg|png|gif|svg|css|js)$", re.I)
PDF_IN_TEXT = re.compile(r"(?:https?://\S+\.pdf|wp-content/uploads/[^\s\"']+\.pdf)", re.I)
ONCLICK = re.compile(r"(?:location|window\.open)\s*[=(]\s*[\"']([^\"']+)[\"']")


class Node:
    __slots__ = ("attrs", "children", "tag")

    def __init__(self, tag: str, attrs: dict[str, str]):
        self.tag, self.attrs, self.children = tag, attrs, []

    def walk(self) -> Iterator[Node]:
        stack = [self]
        while stack:
            node = stack.pop()
            yield node
            stack += [c for c in reversed(node.children) if isinstance(c, Node)]

    def text(self) -> str:
        out, stack = [], [self]
        while stack:
            x = stack.pop()
            if isinstance(x, str):
                out.append(x)
            else:
                stack += reversed(x.children)
        return "".join(out)

    def classes(self) -> set[str]:
        return set(self.attrs.get("class", "").split())


class Tree(HTMLParser):
    """A forgiving tree: open paragraphs and items end where others begin, and all ends at the end of input. Nodes do not know
    their parents, so that a page's tree goes as soon as it is read."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.root = Node("#root", {})
        self.open = [self.root]  #: the node at hand, last, and those around it
        self.feed(html)
        self.close()

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in BLOCKS:
            self.end_open("p", {"body", "div", "article", "section", "main", "td", "li"})
        if tag == "li":
            self.end_open("li", {"ul", "ol"})
        node = Node(tag, {k: v or "" for k, v in reversed(attrs)})
        self.open[-1].children.append(node)
        if tag not in VOID:
            self.open.append(node)

    def end_open(self, tag: str, within: Set[str] = frozenset()) -> None:
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].tag in within:
                return
            if self.open[k].tag == tag:
                del self.open[k:]
                return

    def handle_endtag(self, tag: str) -> None:
        self.end_open(tag)

    def handle_data(self, data: str) -> None:
        self.open[-1].children.append(data)


def drop(root: Node, gone) -> None:
    for node in root.walk():
        node.children = [c for c in node.children if isinstance(c, str) or not gone(c)]


def clean(text: str) -> str:
    return re.sub(r"##\s+", "\n## ", re.sub(r"\s+", " ", text)).strip()


def page_text(root: Node) -> str:
    """All headings of the main part, then its paragraphs and items of over ten characters."""
    nodes = list(root.walk())
    tests = (lambda n: n.tag == "main", lambda n: n.tag == "article", lambda n: "content" in n.classes(), lambda n: n.attrs.get("id") == "content", lambda n: "main-content" in n.classes(), lambda n: n.tag == "body")
    part = next((n for test in tests for n in nodes if test(n)), root)
    inside = list(part.walk())[1:]
    out = [f"\n## {t}\n" for n in inside if re.fullmatch("h[1-6]", n.tag) and (t := n.text().strip())]
    out += [t for n in inside if (n.tag in ("p", "li") or n.classes() & {"text", "description", "info"}) and len(t := n.text().strip()) > 10]
    return clean("\n\n".join(out) if out else part.text())


def absolute(href: str, base: str) -> str | None:
    try:
        url = urljoin(base, href.strip())
        parts = urlsplit(url)
    except ValueError:
        return None
    if not parts.scheme or (parts.scheme in ("http", "https") and not parts.hostname):
        return None
    return url + "/" if parts.scheme in ("http", "https") and not parts.path and not parts.query and not parts.fragment else url


def page_links(nodes: list[Node], base: str) -> list[str]:
    """Addresses in the order of anchors, attributes and scripts' targets, then of any href or root-relative src."""
    hrefs = [n.attrs["href"] for n in nodes if n.tag == "a" and n.attrs.get("href")]
    for n in nodes:
        if own := next((n.attrs[k] for k in ("data-href", "data-link", "data-url") if n.attrs.get(k)), None):
            hrefs.append(own)
        if m := ONCLICK.search(n.attrs.get("onclick", "")):
            hrefs.append(m[1])
    hrefs += [n.attrs["href"] for n in nodes if n.attrs.get("href")]
    hrefs += [n.attrs["src"] for n in nodes if n.attrs.get("src", "").startswith("/") and not ASSET.search(n.attrs["src"])]
    out, seen = [], set()
    for href in hrefs:
        href = href.split("#")[0]
        if href and href not in seen and not href.startswith(("javascript:", "mailto:", "tel:")):
            seen.add(href)
            if url := absolute(href, base):
                out.append(url.split("#")[0])
    return list(dict.fromkeys(out))


def page_files(nodes: list[Node], body: str, base: str) -> list[str]:
    """Addresses on the page's host that may be files: anchors, data attributes, bare PDF addresses in the text."""
    found = [n.attrs["href"] for n in nodes if n.tag == "a" and n.attrs.get("href")]
    found += [n.attrs[k] for n in nodes for k in ("data-pdf", "data-file", "data-url", "data-src") if n.attrs.get(k)]
    found += [re.sub(r"[.,;:!?)\]}>'\"`]+$", "", m) for m in PDF_IN_TEXT.findall(body)]
    found += [v for n in nodes for k in ("href", "src", "data-href") if ".pdf" in (v := n.attrs.get(k, ""))]
    host = urlsplit(base).hostname
    return list(dict.fromkeys(u for x in found if (u := absolute(x, base)) and urlsplit(u).hostname == host))


def extracted(html: str | None, url: str, strip_chrome: bool) -> dict:
    root = Tree(html or "").root
    drop(root, lambda n: n.tag in DROPPED)
    if strip_chrome:
        drop(root, lambda n: n.tag in CHROME_TAGS or n.classes() & CHROME_CLASSES)
    nodes = list(root.walk())
    images = {u: n.attrs.get("alt") for n in reversed(nodes) if n.tag == "img" and n.attrs.get("src") and (u := absolute(n.attrs["src"], url))}
    return {"text": page_text(root), "links": page_links(nodes, url), "images": [{"url": u, "alt": a} for u, a in reversed(images.items())], "files": page_files(nodes, root.text(), url)}


def extract(html: Column, url: Column, strip_chrome: bool = True) -> Column:
    """text, links, images and files of a page. With strip_chrome, navigation goes before links are read.
    Pages come to a worker in small batches, whatever their number."""
    if spark := SparkSession.getActiveSession():
        small_batches(spark)

    @F.pandas_udf(SCHEMA)
    def run(html: pd.Series, url: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([extracted(h, u or "", strip_chrome) for h, u in zip(html, url, strict=True)], columns=["text", "links", "images", "files"])

    return run(html, url)


def split_links(links: DataFrame, page_host: str = "host", link: str = "link") -> DataFrame:
    """Adds url (without fragment) and kind: internal on the page's host, external elsewhere by http(s), null for
    hosts that only serve assets and for what has no host."""
    url = normalized_url(F.col(link))
    host = F.lower(F.try_parse_url(url, F.lit("HOST")))
    skipped = host.rlike("(?:^|\\.)(?:" + "|".join(h.replace(".", "\\.") for h in SKIPPED_HOSTS) + ")$")
    kind = F.when(host == F.col(page_host), "internal").when(url.rlike("^https?://") & ~skipped, "external")
    return links.withColumn("url", url).withColumn("kind", kind)
