"""Column builders for text. All stay in the JVM; nulls give nulls unless said otherwise."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Python's str.split and str.strip see it, for Java's regex.
WS = r"[\s\x1c-\x1f\x85\p{Z}]"


def let(fn: Callable[..., Column], *values: Column) -> Column:
    """fn of values that are worked out once. Expressions with lambda functions are not shared by code generation, so
    a value used several times, or inside a lambda, would otherwise be worked out each time."""
    bound = F.array(F.struct(*[v.alias(f"v{i}") for i, v in enumerate(values)]))
    return F.transform(bound, lambda s: fn(*[s[f"v{i}"] for i in range(len(values))]))[0]


def words(text: Column) -> Column:
    """White-space separated words; an empty array for blank text."""
    return F.filter(F.split(text, f"{WS}+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.size(words(text))


def strip(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(text, rf"\A{WS}+|{WS}+\z", "")


def squeeze(text: Column) -> Column:
    """Stripped, each run of white space one blank; equality of squeezed texts ignores layout."""
    return F.regexp_replace(strip(text), f"{WS}+", " ")


def word_set(text: Column) -> Column:
    return F.array_distinct(words(F.lower(text)))


def set_jaccard(a: Column, b: Column) -> Column:
    """Jaccard similarity of two arrays without repeats; 0 where both are empty."""
    both = F.size(F.array_intersect(a, b))
    return F.coalesce(F.try_divide(both.cast("double"), (F.size(a) + F.size(b) - both).cast("double")), F.lit(0.0))


def similarity(a: Column, b: Column) -> Column:
    """Jaccard similarity of lower-case word sets."""
    return let(set_jaccard, word_set(a), word_set(b))


def pieces(text: Column, pattern: str) -> Column:
    """Stripped, non-blank pieces between matches of a pattern."""
    return F.filter(F.transform(F.split(text, pattern), strip), lambda p: p != "")


def most_frequent(items: Column) -> Column:
    """How often the commonest element of an array occurs: runs of its sorted form, no shuffle and no pairs."""
    start = F.struct(F.lit(None).cast("string").alias("last"), F.lit(0).alias("run"), F.lit(0).alias("top"))

    def merge(acc: Column, w: Column) -> Column:
        run = F.when(acc["last"] == w, acc["run"] + 1).otherwise(1)
        return F.struct(w.alias("last"), run.alias("run"), F.greatest(acc["top"], run).alias("top"))

    return F.aggregate(F.array_sort(items), start, merge, lambda acc: acc["top"])


def language_code(name: Column) -> Column:
    """First two letters, lower case; `en` for a null or empty name."""
    return F.coalesce(F.nullif(F.lower(F.substring(name, 1, 2)), F.lit("")), F.lit("en"))


def safe_filename(name: Column) -> Column:
    return F.regexp_replace(name, r"[^\w\-_\. ]", "_")


def after_colon(text: Column) -> Column:
    """What follows the first colon, trimmed; the text itself where there is none."""
    at = F.instr(text, ":")
    return F.when(at > 0, strip(F.substring(text, at + 1, F.length(text)))).otherwise(text)


def split_filename(stem: Column) -> Column:
    """struct(author, title) of `Author - Title`."""
    at = F.instr(stem, " - ")
    author = F.when(at > 0, F.substring(stem, F.lit(1), at - 1)).otherwise("Unknown Author")
    return F.struct(author.alias("author"), F.when(at > 0, F.substring(stem, at + 3, F.length(stem))).otherwise(stem).alias("title"))


#: Characters that text proper begins and ends with.
TEXT_CHARS = r'a-zA-Z\u0080-￿"'


def strip_markdown(text: Column) -> Column:
    """struct(clean, prefix, suffix): leading and trailing marks taken off; the suffix only where there is a prefix.
    Null gives three empty strings."""
    t = strip(F.coalesce(text, F.lit("")))
    prefix = F.regexp_extract(t, rf"\A[^{TEXT_CHARS}]+", 0)
    rest = F.substring(t, F.length(prefix) + 1, F.length(t))
    suffix = F.when(prefix != "", F.regexp_extract(rest, rf"[^{TEXT_CHARS}]+\z", 0)).otherwise("")
    clean = F.substring(rest, F.lit(1), F.length(rest) - F.length(suffix))
    return F.struct(clean.alias("clean"), prefix.alias("prefix"), suffix.alias("suffix"))


def remove_xml_tags(text: Column, tag: str) -> Column:
    """Without elements of that name and their content, then without its stray opening tags. An empty name changes nothing."""
    if not tag:
        return text
    paired = F.regexp_replace(text, rf"(?is)<{tag}\b[^>]*>.*?</{tag}>", "")
    return F.regexp_replace(paired, rf"(?i)<{tag}\b[^>]*/?>", "")


def tight_tags(text: Column) -> Column:
    """White space after > and before < or a capital is dropped, and so is indentation."""
    return F.regexp_replace(F.regexp_replace(text, rf">{WS}+(?=[<A-Z])", ">"), rf"\n{WS}+", "\n")


def tagged(text: Column, tag: Column | str) -> Column:
    """Content of the first element of that name, stripped; empty where there is none."""
    name = tag if isinstance(tag, Column) else F.lit(tag)
    opened, closed = F.concat(F.lit("<"), name, F.lit(">")), F.concat(F.lit("</"), name, F.lit(">"))
    at = F.locate("\0", F.replace(text, opened, F.lit("\0")))
    rest = F.substring(text, at + F.length(opened), F.length(text))
    end = F.instr(rest, closed) if not isinstance(tag, Column) else F.locate("\0", F.replace(rest, closed, F.lit("\0")))
    return F.when((at > 0) & (end > 0), strip(F.substring(rest, F.lit(1), end - 1))).otherwise("")


#: Inline marks in the order in which they are replaced. (?d): only a line feed ends a line.
INLINE_MARKS = (
    (r"!\(([^)]+)\)", '<img src="$1"/>'),
    (r"`([^`]+)`", "<code>$1</code>"),
    (r"~~([^~]+)~~", "<s>$1</s>"),
    (r"(?d)\*\*(.+?)\*\*", "<strong>$1</strong>"),
    (r"\*([^*]+)\*", "<em>$1</em>"),
    (r"__([^_]+)__", "<u>$1</u>"),
)


def inline_markdown(text: Column) -> Column:
    return reduce(lambda t, m: F.regexp_replace(t, m[0], m[1]), INLINE_MARKS, text)


def line_html(line: Column) -> Column:
    """Html of one stripped line of Markdown."""
    level = F.length(F.regexp_extract(line, r"^(#{1,6}) ", 1))
    body = inline_markdown(F.substring(line, level + 2, F.length(line)))
    head = F.concat(F.lit("<h"), level.cast("string"), F.lit(">"), body, F.lit("</h"), level.cast("string"), F.lit(">"))

    def wrap(tag: str, skip: int) -> Column:
        return F.concat(F.lit(f"<{tag}>"), inline_markdown(F.substring(line, F.lit(skip + 1), F.length(line))), F.lit(f"</{tag}>"))

    return (
        F.when(level > 0, head)
        .when(line == "---", "<hr/>")
        .when(line == "***", "<br/>")
        .when(F.startswith(line, F.lit("- ")), wrap("li", 2))
        .when(F.startswith(line, F.lit("> ")), wrap("blockquote", 2))
        .otherwise(wrap("p", 0))
    )


def markdown_html(markdown: Column) -> Column:
    """struct(title, html): the title is the first heading of levels 1 to 4, with inline marks replaced."""
    lines = F.filter(F.transform(F.split(markdown, "\n"), strip), lambda x: x != "")
    heads = F.filter(lines, lambda x: x.rlike(r"^#{1,4} "))
    first = F.try_element_at(heads, F.lit(1))
    title = inline_markdown(F.regexp_replace(first, r"^#+ ", ""))
    return F.struct(title.alias("title"), F.array_join(F.transform(lines, line_html), "\n").alias("html"))


def paragraphs(markdown: Column) -> Column:
    """Non-blank pieces between blank lines, stripped."""
    return pieces(markdown, "\n\n")


def wrapped(text: Column, width: int) -> Column:
    """Lines of at most width characters, broken at blanks where there are any: greedy, as an array."""
    if width < 1:
        raise ValueError("width must be positive")
    tokens = F.regexp_extract_all(text, F.lit(rf"(?s)\S{{1,{width}}}(?:\s+|$)|\S{{{width}}}"), F.lit(0))
    start = F.struct(F.array().cast("array<string>").alias("lines"), F.lit("").alias("line"))

    def merge(acc: Column, token: Column) -> Column:
        fits = F.length(F.concat(acc["line"], strip(token))) <= width
        return F.struct(F.when(fits, acc["lines"]).otherwise(F.concat(acc["lines"], F.array(F.rtrim(acc["line"])))).alias("lines"), F.when(fits, F.concat(acc["line"], token)).otherwise(token).alias("line"))

    return F.aggregate(tokens, start, merge, lambda a: F.when(F.trim(a["line"]) == "", a["lines"]).otherwise(F.concat(a["lines"], F.array(F.rtrim(a["line"])))))


def side_by_side(left: Column, right: Column, width: int, gap: str = " | ") -> Column:
    """Two texts wrapped beside each other in columns of half the width (20 characters at least), as lines."""
    half = (max(width, 20) - len(gap)) // 2
    both = F.struct(wrapped(left, half).alias("l"), wrapped(right, half).alias("r"))
    n = F.greatest(F.size(both["l"]), F.size(both["r"]))
    rows = F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: i <= n)
    return F.transform(rows, lambda i: F.concat(F.rpad(F.coalesce(F.try_element_at(both["l"], i), F.lit("")), half, " "), F.lit(gap), F.coalesce(F.try_element_at(both["r"], i), F.lit(""))))
