"""Review pages and listing pages: HTML to records and links, and the crawl over them."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tastegrid.functions.runtime import spread
from tastegrid.functions.strings import url_join
from tastegrid.operators.graph import reachable

_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_HIDDEN = frozenset(("script", "style"))
_BLOCKS = frozenset("p h1 h2 h3 h4 h5 h6 div table tr td th ul ol li".split())

FIELDS = ("rating", "roaster", "title", "blind_assessment", "notes", "bottom_line")
_RECORD = T.StructType([*(T.StructField(f, T.StringType()) for f in FIELDS), T.StructField("extras", T.MapType(T.StringType(), T.StringType()))])


class Node:
    """An element with its children, which are elements and texts."""

    __slots__ = ("attributes", "children", "name", "parent")

    def __init__(self, name: str, attributes: dict[str, str], parent: Node | None) -> None:
        self.name, self.attributes, self.parent, self.children = name, attributes, parent, []

    def text(self) -> str:
        return "".join(c if isinstance(c, str) else c.text() for c in self.children)

    def walk(self):
        """This element and those in it, in the order of the document."""
        yield self
        for c in self.children:
            if isinstance(c, Node):
                yield from c.walk()

    def all(self, name: str):
        return (n for n in self.walk() if n.name == name and n is not self)


class _Tree(HTMLParser):
    """A lenient tree: unclosed elements end with what encloses them, texts of scripts and styles are left out."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("", {}, None)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in _BLOCKS and self.at.name == "p":
            self.at = self.at.parent
        if tag in ("tr", "td", "th", "li"):
            up = self._open({"tr": ("tr",), "td": ("td", "th"), "th": ("td", "th"), "li": ("li",)}[tag], until="ul" if tag == "li" else "table")
            self.at = up.parent if up else self.at
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(node)
        if tag not in _VOID:
            self.at = node

    def _open(self, names: tuple[str, ...], until: str) -> Node | None:
        node = self.at
        while node is not None and node.name != until:
            if node.name in names:
                return node
            node = node.parent
        return None

    def handle_endtag(self, tag: str) -> None:
        node = self.at
        while node is not None and node.name != tag:
            node = node.parent
        if node is not None and node.parent is not None:
            self.at = node.parent

    def handle_data(self, data: str) -> None:
        if self.at.name not in _HIDDEN:
            self.at.children.append(data)


def tree(html: str) -> Node:
    parser = _Tree()
    parser.feed(html)
    parser.close()
    return parser.root


def _by_class(root: Node, name: str, class_: str) -> str | None:
    found = next((n for n in root.all(name) if class_ in n.attributes.get("class", "").split()), None)
    return None if found is None else found.text().strip()


def _headline(root: Node, words: str) -> Node | None:
    """The first h2 whose only content is a text with these words."""
    for n in root.all("h2"):
        own = [c for c in n.children if isinstance(c, Node)]
        if not own and words in n.text():
            return n
    return None


def _after_headline(root: Node, words: str, name: str) -> str | None:
    head, seen = _headline(root, words), False
    for n in root.walk():
        if seen and n.name == name:
            return n.text().strip()
        seen = seen or n is head
    return None


def _notes(root: Node) -> str | None:
    head = _headline(root, "Notes")
    if head is None:
        return None
    texts, seen = [], False
    for c in head.parent.children:
        if c is head:
            seen = True
        elif seen and isinstance(c, Node):
            if c.name == "h2":
                break
            texts.append(c.text().strip())
    return re.sub(r"\s+", " ", "".join(texts))


def _specifications(root: Node) -> dict[str, str]:
    """Rows of two cells of all tables; keys in lower case without colons, the last value of a key wins."""
    found = {}
    for table in root.all("table"):
        for row in table.all("tr"):
            cells = list(row.all("td"))
            if len(cells) == 2:
                found[cells[0].text().strip().lower().replace(":", "")] = cells[1].text().strip()
    return found


def review_record(html: str) -> dict[str, object]:
    """The fields of a review page; rows of its tables go to ``extras`` or over the field of their name."""
    root = tree(html)
    record: dict[str, object] = {
        "rating": _by_class(root, "span", "review-template-rating"),
        "roaster": _by_class(root, "p", "review-roaster"),
        "title": _by_class(root, "h1", "review-title"),
        "blind_assessment": _after_headline(root, "Blind Assessment", "p"),
        "notes": _notes(root),
        "bottom_line": _after_headline(root, "Bottom Line", "p"),
    }
    extras = _specifications(root)
    record |= {f: extras.pop(f) for f in FIELDS if f in extras}
    return record | {"extras": extras}


@F.pandas_udf(_RECORD)
def parse_review(pages: pd.Series) -> pd.DataFrame:
    nothing = dict.fromkeys(FIELDS) | {"extras": None}
    return pd.DataFrame([nothing if p is None else review_record(p) for p in pages], columns=[*FIELDS, "extras"], dtype=object)


def review_records(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """url, the fields of a review page, extras; pages that could not be fetched (null) are left out."""
    had = spread(pages.where(F.col(html).isNotNull()).select(F.col(url).alias("url"), F.col(html).alias("html")))
    parsed = had.select("url", parse_review(F.col("html")).alias("r"))
    return parsed.select("url", "r.*")


@F.pandas_udf(T.ArrayType(T.StringType()))
def page_links(pages: pd.Series) -> pd.Series:
    """The href of each anchor of a page."""
    return pages.map(lambda p: None if p is None else [a.attributes["href"] for a in tree(p).all("a") if "href" in a.attributes])


def listing_links(pages: DataFrame, base: str, url: str = "url", html: str = "html") -> DataFrame:
    """from_url, to_url, kind: links of listing pages to further ones (``listing``) and to reviews (``review``).

    Links are told apart as written and kept absolute; others give no row, repeated ones one.
    """
    links = pages.where(F.col(html).isNotNull()).select(F.col(url).alias("from_url"), F.explode(page_links(F.col(html))).alias("href"))
    full = links.withColumn("to_url", url_join(F.lit(base), F.col("href")))
    review = F.col("href").contains("/review/") & ~F.col("href").endswith("/page") & (F.col("to_url") != base)
    kind = F.when(F.col("href").contains("/review/page/"), F.lit("listing")).when(review, F.lit("review"))
    return full.select("from_url", "to_url", kind.alias("kind")).where("kind is not null").distinct()


def crawl(pages: DataFrame, base: str, url: str = "url", html: str = "html") -> DataFrame:
    """review_url: the reviews that the listing pages which can be reached from ``base`` link to."""
    links = listing_links(pages, base, url, html)
    start = pages.sparkSession.createDataFrame([(base,)], "node string")
    edges = links.where("kind = 'listing'").select(F.col("from_url").alias("a"), F.col("to_url").alias("b"))
    visited = reachable(start, edges).select(F.col("node").alias("from_url"))
    return links.where("kind = 'review'").join(visited, "from_url", "left_semi").select(F.col("to_url").alias("review_url")).distinct()
