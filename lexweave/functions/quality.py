"""Quality scores of texts and translations as column expressions. Integer arithmetic wherever truncation decides."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let, most_frequent, pieces, set_jaccard, strip, word_count, word_set, words

#: Function words whose excess points to a mistranslation.
COMMON_WORDS = ("the", "and", "or", "but", "of", "in", "on", "at", "to", "for", "with", "by")
#: Marks that come in pairs.
PAIRED_MARKS = ("**", "*", "__", "~~", "`")


_RUN = re.compile(r"\w+")
#: Letters whose lower case is not one letter of its own, and those that share one.
_ODD_CASE = re.compile("[\u0130\u0131\u017f\u01c4-\u01cc\u01f1-\u01f3\u0345\u0390\u03b0\u03c2\u03d0-\u03d6\u03f0-\u03f5\u1c80-\u1c8a\u1e9b\u1e9e\u1fbe\u1fd3\u1fe3\u2126\u212a\u212b\ua64a\ua64b\ufb05\ufb06\u00b5\u00df]")


def bounded(x: Column) -> Column:
    """Truncated to an integer between 0 and 100."""
    return F.greatest(F.lit(0), F.least(F.lit(100), x.cast("int")))


def fluency(text: Column) -> Column:
    """100 less a penalty for uneven sentences (split at full stops) and for the commonest word; 100 without sentences."""

    def score(sizes: Column, w: Column) -> Column:
        total = F.aggregate(sizes, F.struct(F.lit(0).cast("long").alias("s"), F.lit(0).cast("long").alias("q")), lambda a, x: F.struct((a["s"] + x).alias("s"), (a["q"] + x * x).alias("q")))
        n = F.size(sizes).cast("double")

        def of(t: Column) -> Column:
            variance = (F.size(sizes) * t["q"] - t["s"] * t["s"]).cast("double") / (n * n)
            return bounded((F.lit(1.0) - variance / 1000 - F.try_divide(most_frequent(w).cast("double"), F.size(w).cast("double"))) * 100)

        return F.when(F.size(sizes) == 0, F.lit(100)).otherwise(let(of, total))

    return let(score, F.transform(pieces(text, r"\."), word_count), words(F.lower(text)))


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(F.least(a, b).cast("double"), F.greatest(a, b).cast("double")), F.lit(0.0))


def adequacy(source: Column, target: Column) -> Column:
    """30 for the ratio of word counts, 50 for the overlap of word sets, 20 for the ratio of lengths; 0 if either is empty."""

    def score(o: Column, t: Column, wo: Column, wt: Column) -> Column:
        overlap = let(set_jaccard, F.array_distinct(wo), F.array_distinct(wt))
        x = _ratio(F.size(wo), F.size(wt)) * 30 + overlap * 50 + _ratio(F.length(o), F.length(t)) * 20
        return F.when((o == "") | (t == ""), F.lit(0)).otherwise(bounded(x))

    return let(lambda o, t: let(score, o, t, words(o), words(t)), F.lower(strip(source)), F.lower(strip(target)))


def too_short(source: Column, target: Column, least: int = 50) -> Column:
    """The source has more than `least` words and the target under three tenths of them."""
    return (word_count(source) > least) & (word_count(target) < word_count(source) * 0.3)


def too_long(source: Column, least: int = 1000) -> Column:
    """The text has so many words that it is not sent to a model."""
    return word_count(source) >= least


def bleeding(source: Column, target: Column, context: Column) -> Column:
    """The target is far too short, or it repeats a target of the context whose source is another."""

    def near(s: Column, t: Column) -> Column:
        return F.exists(context, lambda c: (let(set_jaccard, t, word_set(c["target"])) > 0.8) & (let(set_jaccard, s, word_set(c["source"])) < 0.3))

    return too_short(source, target) | let(near, word_set(source), word_set(target))


def occurrences(text: Column, part: str) -> Column:
    """How often part occurs, without overlaps."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(part), F.lit("")))) / len(part)).cast("int")


def untranslated_tokens(source: Column, target: Column) -> Column:
    """Source words of more than three characters that are words of the target, each as often as it occurs."""

    def bare(w: Column) -> Column:
        return F.regexp_replace(w, r"\A[.,!?;:\"()\[\]{}]+|[.,!?;:\"()\[\]{}]+\z", "")

    have = F.array_distinct(F.transform(words(F.lower(target)), bare))
    mine = F.transform(F.filter(words(source), lambda w: F.length(w) > 3), lambda w: bare(F.lower(w)))
    return let(lambda h, m: F.size(F.filter(m, lambda w: (w != "") & F.array_contains(h, w))), have, mine)


def formatting_issues(target: Column) -> Column:
    """Marks left open, and opening tags whose inner text no closing tag has."""
    odd = sum((occurrences(target, m) % 2 for m in PAIRED_MARKS), F.lit(0))

    def unclosed(tags: Column) -> Column:
        def inner(ts: Column) -> Column:
            return F.transform(ts, lambda t: F.regexp_replace(t, r"\A[</>]+|[</>]+\z", ""))

        closing = inner(F.filter(tags, lambda t: F.startswith(t, F.lit("</"))))
        opening = inner(F.filter(tags, lambda t: ~F.startswith(t, F.lit("</"))))
        return let(lambda o, c: F.size(F.filter(o, lambda t: ~F.array_contains(c, t))), opening, closing)

    return odd + F.when(F.contains(target, F.lit("<")), let(unclosed, F.regexp_extract_all(target, F.lit("<[^>]+>"), F.lit(0)))).otherwise(F.when(target.isNotNull(), F.lit(0)))


def mistranslations(source: Column, target: Column) -> Column:
    """Points for a target far too short, far too long, or full of one function word."""

    def points(n: Column, m: Column, low: Column) -> Column:
        much = F.lit(False)
        for w in COMMON_WORDS:
            much = much | (occurrences(low, w) > m * 0.3)
        return sum((c.cast("int") for c in ((n > 10) & (m < n * 0.3), (n < 5) & (m > n * 5), much)), F.lit(0))

    return let(points, word_count(source), word_count(target), F.lower(target))


def content_terms(text: Column) -> Column:
    """Runs of four or more lower-case ASCII letters of the lower-cased text."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z]{4,}"), F.lit(0))


__all__ = ["adequacy", "bleeding", "bounded", "content_terms", "fluency", "formatting_issues", "mistranslations", "occurrences", "too_short", "untranslated_tokens", "word_set"]


def untranslated_segments(source: Column, target: Column) -> Column:
    """Source words of more than three characters that occur as whole words in the target, letter case ignored, by
    the rules of a regular expression: a word that is only marks matches any target with a word character. A word of word
    characters is looked up among the target's runs of them; only words with other marks inside, and letters with several lower
    cases, need an expression of their own. Python over batches, for those who need word boundaries exactly;
    `untranslated_tokens` compares words in the JVM."""
    def count(s: pd.Series, t: pd.Series) -> pd.Series:
        out = []
        for a, b in zip(s, t):
            if a is None or b is None:
                out.append(None)
                continue
            hit: dict[str, bool] = {}
            runs = set(_RUN.findall(b.lower()))
            odd = _ODD_CASE.search(b) is not None
            n = 0
            for w in (x.lower().strip('.,!?;:"()[]{}') for x in a.split() if len(x) > 3):
                if w not in hit:
                    hit[w] = w in runs or ((odd or not _RUN.fullmatch(w) or _ODD_CASE.search(w) is not None) and re.search(rf"\b{re.escape(w)}\b", b, re.IGNORECASE) is not None)
                n += hit[w]
            out.append(n)
        return pd.Series(out, dtype="Int32")

    return F.pandas_udf(count, "int")(source, target)
