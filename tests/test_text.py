import pytest
from pyspark.sql import functions as F

from lexweave.functions import quality, text
from lexweave.functions.html import to_markdown


def value(spark, column, *values):
    names = [f"c{i}" for i in range(len(values))]
    df = spark.createDataFrame([tuple(values)], ", ".join(f"{n} string" for n in names))
    return df.select(column(*[F.col(n) for n in names]).alias("x")).first().x


@pytest.mark.parametrize(("given", "expected"), [("**Hello**", ("Hello", "**", "**")), ("1. Hello World!", ("Hello World", "1. ", "!")), ("***", ("", "***", "")), (None, ("", "", "")), ("Hello!", ("Hello!", "", "")), ("", ("", "", ""))])
def test_strip_markdown(spark, given, expected):
    assert tuple(value(spark, text.strip_markdown, given)) == expected


def test_scalars(spark):
    assert value(spark, text.language_code, "German") == "ge"
    assert value(spark, text.language_code, None) == "en"
    assert value(spark, text.language_code, "") == "en"
    assert value(spark, text.after_colon, "Title: The book") == "The book"
    assert value(spark, text.after_colon, "The book") == "The book"
    assert tuple(value(spark, text.split_filename, "A. Writer - The Book - 2")) == ("A. Writer", "The Book - 2")
    assert tuple(value(spark, text.split_filename, "The Book")) == ("Unknown Author", "The Book")
    assert value(spark, text.safe_filename, "a/b:c é.md") == "a_b_c _.md"
    assert value(spark, text.squeeze, "  a\n\tb  ") == "a b"
    assert value(spark, lambda c: text.remove_xml_tags(c, "script"), "a <script>x</script> b<script/>") == "a  b"
    assert value(spark, lambda c: text.remove_xml_tags(c, ""), "a <b>") == "a <b>"
    assert value(spark, lambda c: text.tagged(c, "fr"), "x <fr> a\nb </fr> <fr>c</fr>") == "a\nb"
    assert value(spark, lambda c: text.tagged(c, "fr"), "none") == ""
    assert value(spark, lambda c: text.wrapped(c, 10), "one two three fourteen characters") == ["one two", "three", "fourteen", "characters"]
    assert value(spark, lambda c: text.wrapped(c, 4), "abcdefghij") == ["abcd", "efgh", "ij"]


def test_markdown_html(spark):
    got = value(spark, text.markdown_html, "# T **b**\n\n###### six\n- one\n> q\n---\n***\n`c` ~~s~~ __u__ !(a.png)")
    assert got.title == "T <strong>b</strong>"
    assert got.html.split("\n") == ["<h1>T <strong>b</strong></h1>", "<h6>six</h6>", "<li>one</li>", "<blockquote>q</blockquote>", "<hr/>", "<br/>", '<p><code>c</code> <s>s</s> <u>u</u> <img src="a.png"/></p>']
    assert value(spark, text.markdown_html, "###### only six").title is None


@pytest.mark.parametrize(("html", "expected"), [
    ("<h1>Title</h1><p>A <strong>b</strong> c.</p>", ["# Title", "A **b** c."]), ("<p>foo<b>bar</b>baz</p>", ["foo **bar** baz"]), ("<p><b>x</b>.</p>", ["**x** ."]),
    ("<p><b><i>x</i></b></p>", ["**x**"]), ("<p>a<br>b</p>", ["a\nb"]), ('<ul><li><a href="u">x</a></li></ul>', []), ('<li>go <a href="u">x</a></li>', ["- go x"]),
    ("<div>x<p>y</p></div>", ["x y", "y"]), ("<blockquote><p>q</p></blockquote>", ["q"]), ("<blockquote>q</blockquote>", ["> q"]), ('<p><img src="a.png" alt="z"></p>', ["!(a.png)"]),
    ("<p><b></b></p>", []), ("<div><hr></div>", ["---"]), ("<div>t<hr></div>", ["t"]), ('<p><span style="font-weight:bold">k</span></p>', ["**k**"]),
    ('<p><span class="emblem">k</span></p>', ["*k*"]), ("<script>x</script><style>y</style><p>z</p>", ["z"]), ("<title>T</title><footer>f</footer>", ["T"]),
    ("<article><p><b>H<br><p>y</p></article>", ["**Hy**", "y"]), ("", []),
])
def test_html(html, expected):
    assert [x for x in to_markdown(html).split("\n\n") if x] == expected


def test_html_null():
    assert to_markdown(None) is None


def python_fluency(t):
    sentences = [s.strip() for s in t.split(".") if s.strip()]
    if not sentences:
        return 100
    n = [len(s.split()) for s in sentences]
    k = len(n)
    w = t.lower().split()
    score = 1 - ((k * sum(x * x for x in n) - sum(n) ** 2) / (k * k)) / 1000 - max(map(w.count, w)) / len(w)
    return max(0, min(100, int(score * 100)))


@pytest.mark.parametrize("t", ["", "...", "One two. Three four five six.", "a a a a", "No stop at all", "x. " * 40, " .   b"])
def test_fluency(spark, t):
    assert value(spark, quality.fluency, t) == python_fluency(t)


def test_scores(spark):
    assert value(spark, quality.adequacy, "Same text", "Same text") == 100
    assert value(spark, quality.adequacy, "", "x") == 0
    assert value(spark, quality.adequacy, "x", " \n") == 0
    assert value(spark, text.similarity, "a b c", "b c d") == 0.5
    assert value(spark, text.similarity, "", "") == 0.0
    assert value(spark, quality.formatting_issues, "**a** *b <i>x</i> <br/>") == 2
    assert value(spark, quality.mistranslations, "one", "a b c d e f g") == 1
    assert value(spark, quality.untranslated_tokens, "Hello dear World, world", "hello WORLD!") == 3
    long = " ".join(["w"] * 60)
    empty = F.array().cast("array<struct<source:string,target:string>>")
    assert value(spark, lambda a, b: quality.bleeding(a, b, empty), long, "short") is True
    context = F.array(F.struct(F.lit("other words here").alias("source"), F.lit("the same reply").alias("target")))
    assert value(spark, lambda a, b: quality.bleeding(a, b, context), "a fresh source", "The same reply") is True
    assert value(spark, lambda a, b: quality.bleeding(a, b, context), "other words here", "The same reply") is False


def test_side_by_side(spark):
    got = value(spark, lambda a, b: text.side_by_side(a, b, 23), "one two three four", "un deux")
    assert got == ["one two    | un deux", "three four | "]
    assert value(spark, lambda a, b: text.side_by_side(a, b, 23), "", "") == []


def test_untranslated_segments(spark):
    import re

    pairs = [("Hello dear Wörld, ---- Hello", "hello ein wörld"), ("abc", "abc"), ("éclair éclair", "un éclair"), ("----", "x"), ("....", ""), ("well-known WORDS wordsmith", "Well-Known words"), ("masse Kelvin", "Maſſe elvin \u212aelvin"), ("ΛΌΓΟΣ wort", "λόγος wort_")]
    df = spark.createDataFrame([*pairs, (None, "x"), ("x", None)], "s string, t string")
    got = [r.n for r in df.select(quality.untranslated_segments(F.col("s"), F.col("t")).alias("n")).collect()]
    brute = [sum(bool(re.search(rf"\b{re.escape(w.lower().strip('.,!?;:()[]{}'))}\b", t, re.I)) for w in s.split() if len(w) > 3) for s, t in pairs]
    assert got == [*brute, None, None]


def test_tags(spark):
    assert value(spark, text.tight_tags, "<a> <b>\n   Text > x") == "<a><b>Text > x"


def test_sql_function(spark):
    from lexweave.functions import html

    html.register(spark)
    assert spark.sql("SELECT html_markdown('<p>a <i>b</i></p>') AS x").first().x == "a *b*"


def test_requests(spark):
    import json

    from lexweave.operators import context

    m = F.array(F.struct(F.lit("user").alias("role"), F.lit("x").alias("content")))
    r = spark.range(1).select(context.payload(m, "me@big").alias("p"), context.payload(m, "big").alias("q"), context.reply(F.lit('{"choices":[{"message":{"content":"ok"}}]}')).alias("r")).first()
    assert json.loads(r.p)["provider"] == {"order": ["me"]} and json.loads(r.p)["model"] == "big" and "provider" not in json.loads(r.q) and r.r == "ok"
