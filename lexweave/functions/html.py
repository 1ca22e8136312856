"""Html to Markdown: a tolerant tree and the block rules. Python, run as an Arrow UDF over whole batches."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..session import ship_package

#: Tags that make lines of their own, tags that mark text, tags without content.
BLOCKS = frozenset(("p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "div", "th", "td", "title", "blockquote", "cite", "br", "hr"))
INLINES = frozenset(("i", "em", "b", "strong", "u", "ins", "s", "del", "code", "span", "img", "br"))
VOID = frozenset(("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"))
#: Mark around the text of each inline tag.
MARKS = {"i": "*", "em": "*", "b": "**", "strong": "**", "u": "__", "ins": "__", "s": "~~", "del": "~~", "code": "`"}
#: What a span's style and class must hold for each mark, in order of precedence.
SPAN_RULES = (
    ("**", (("font-weight", ("bold",)),), ("bold", "strong")),
    ("*", (("font-style", ("italic",)),), ("italic", "em")),
    ("__", (("text-decoration", ("underline",)),), ("underline",)),
    ("~~", (("text-decoration", ("line-through",)),), ("strikethrough", "line-through")),
    ("`", (("font-family", ("monospace", "courier")),), ("code", "monospace")),
)


class Node:
    __slots__ = ("name", "attrs", "kids", "up")

    def __init__(self, name: str, attrs: dict | None = None, up: Node | None = None):
        self.name, self.attrs, self.kids, self.up = name, attrs or {}, [], up

    def text(self) -> str:
        return "".join(k if isinstance(k, str) else k.text() for k in self.kids if not isinstance(k, Comment))

    def walk(self):
        for k in self.kids:
            if isinstance(k, Node):
                yield k
                yield from k.walk()


class Comment(str):
    __slots__ = ()


class TreeBuilder(HTMLParser):
    """Void tags close themselves, an end tag closes up to its nearest opening tag, stray end tags are ignored; nothing
    else is closed by implication."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("")

    def handle_starttag(self, tag, attrs):
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.kids.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag, attrs):
        self.at.kids.append(Node(tag, {k: v or "" for k, v in attrs}, self.at))

    def handle_endtag(self, tag):
        node = self.at
        while node is not None and node.name != tag:
            node = node.up
        if node is not None and node.up is not None:
            self.at = node.up

    def handle_data(self, data):
        self.at.kids.append(data)

    def handle_comment(self, data):
        self.at.kids.append(Comment(data))


def has_text(node: Node) -> bool:
    """A direct child is text that is not blank (comments count) or an inline tag."""
    return any(k.strip() != "" if isinstance(k, str) else k.name in INLINES for k in node.kids)


def span_mark(node: Node) -> str:
    style, cls = node.attrs.get("style", "").lower(), node.attrs.get("class", "").lower()
    for mark, styles, classes in SPAN_RULES:
        if any(p in style and any(v in style for v in values) for p, values in styles) or any(c in cls for c in classes):
            return mark
    return ""


def inline_text(node: Node) -> str:
    """What an inline tag turns into; the outermost tag decides, the marks of tags inside are lost."""
    if node.name == "img":
        src = node.attrs.get("src", "")
        return f"!({src})" if src else ""
    text = node.text()
    if node.name == "br":
        return "~~~" if node.up is not None and node.up.name in ("p", "div") else text
    mark = span_mark(node) if node.name == "span" else MARKS.get(node.name, "")
    return f"{mark}{text}{mark}"


def flat_pieces(node: Node) -> list[str]:
    """Text pieces of a block in order, inline tags replaced."""
    out: list[str] = []
    for k in node.kids:
        if isinstance(k, Comment):
            continue
        if isinstance(k, str):
            out.append(k)
        elif k.name in INLINES and (k.name in ("img", "br") or k.text()):
            out.append(inline_text(k))
        else:
            out += flat_pieces(k)
    return out


def block_line(node: Node) -> str | None:
    if node.name == "hr":
        return "---"
    if node.name == "br":
        return "~~~"
    text = " ".join(p for p in (x.strip() for x in flat_pieces(node)) if p).replace("\n", " ")
    text = re.sub(r"\s*~~~\s*", "\n", text)
    if not text:
        return None
    if len(node.name) == 2 and node.name[0] == "h":
        return "#" * int(node.name[1]) + " " + text
    return {"li": "- ", "blockquote": "> "}.get(node.name, "") + text


def to_markdown(html: str | None) -> str | None:
    """Lines of all blocks with text of their own, in document order, blank lines between them; null stays null."""
    if html is None:
        return None
    builder = TreeBuilder()
    builder.feed(html)
    builder.close()
    for node in [builder.root, *builder.root.walk()]:
        node.kids = [k for k in node.kids if not (isinstance(k, Node) and k.name in ("script", "style"))]
    lines = []
    for node in builder.root.walk():
        if node.name in BLOCKS and (not has_text(node.up) if node.name in ("hr", "br") else has_text(node)):
            line = block_line(node)
            if line is not None:
                lines.append(line)
    return "\n\n".join(lines)


def html_markdown(html: Column) -> Column:
    """to_markdown as a vectorised column function."""
    spark = SparkSession.getActiveSession()
    if spark is not None:
        ship_package(spark)
    
    def convert(s: pd.Series) -> pd.Series:
        return s.map(to_markdown)

    return F.pandas_udf(convert, "string")(html)


def register(spark: SparkSession) -> None:
    """Make the function callable from SQL as html_markdown."""
    ship_package(spark)

    def convert(s: pd.Series) -> pd.Series:
        return s.map(to_markdown)

    spark.udf.register("html_markdown", F.pandas_udf(convert, "string"))
