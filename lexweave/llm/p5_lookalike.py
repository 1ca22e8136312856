"""Problem 5: text that looks the same but differs in its characters.

Method: script-aware repair. Widths, ligatures, accents, blanks and invisible characters have one form each. In a token
of mixed scripts the dominant script is that of its letters without a look-alike, or of most letters where all have one; the other
letters are substituted when all of them have look-alikes and the vocabulary of the corpus has the result: a word of one
script seen at least `least` times in values that are not suspect. Two rules go beyond that and are parameters:
`certain` repairs a mixed token whose dominant script is certain even if the vocabulary lacks the result (a rare name),
since no proper word mixes scripts; `whole` repairs a token wholly of another script than both its neighbours if the
vocabulary has the result. Nulls and values without letters give no row; empty tables give none; repeated rows each give
their own; extra columns are not read.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import small_side, stage
from .batches import map_pieces, scan_partitions
from .textkit import INVISIBLE, is_empty

#: Letters that are drawn alike, Cyrillic or Greek on the left, Latin on the right.
CYRILLIC_LATIN = dict(zip("асеорхуіјѕһԁԛԝүАВЕКМНОРСТХУІЈЅ", "aceopxyijshdqwyABEKMHOPCTXYIJS"))
GREEK_LATIN = dict(zip("οναικρυΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "ovaikpuABEZHIKMNOPTYX"))
LATIN_CYRILLIC = dict(zip("aceopxykABEKMHOPCTXY", "асеорхукАВЕКМНОРСТХУ"))
CYRILLIC_GREEK = dict(zip("оАВЕНКМОРТХ", "οΑΒΕΗΚΜΟΡΤΧ"))
#: Romanian letters written with a cedilla, and with the comma that belongs there.
CEDILLA = str.maketrans("şţŞŢ", "șțȘȚ")

#: Defaults of the two rules beyond the method (see above), and how often the vocabulary must have a word.
CERTAIN, WHOLE, LEAST = False, False, 2

_ODD_SPACE = r"\t\x0b\x0c\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_CONTROL = r"\x00-\x08\x0e-\x1f\x7f-\x84\x86-\x9f"
_WIDTH = r"\uff01-\uffee\ufb00-\ufb06\ufb13-\ufb17\U0001d400-\U0001d7ff"
_DROP_RE = re.compile(f"[{_CONTROL}{INVISIBLE}]")
_SPACE_RE = re.compile(f"[{_ODD_SPACE}]")
_WIDTH_RE = re.compile(f"[{_WIDTH}]+")
_TOKEN = re.compile(r"[^\W\d_]+")
_TOKEN_OR_TAG = re.compile(r"</?[^\W\d_]+|&[a-z]+;|[^\W\d_]+")

_ODD_RE = re.compile(f"[{_ODD_SPACE}{_CONTROL}{INVISIBLE}{_WIDTH}\u0300-\u036f\u0483-\u0487\u1dc0-\u1dff\u20d0-\u20ff\ufe20-\ufe2fşţŞŢ]")
_LATIN_RE, _OTHER_RE = re.compile(r"[A-Za-z\u00c0-\u024f\u1e00-\u1eff]"), re.compile(r"[\u0370-\u052f\u1f00-\u1fff]")


def suspect(value: str) -> bool:
    """Whether a value may be inconsistent; false only where it certainly is not."""
    if _ODD_RE.search(value):
        return True
    if value.isascii():
        return False
    return not unicodedata.is_normalized("NFC", value) or bool(_OTHER_RE.search(value)) and bool(_LATIN_RE.search(value))


def script(c: str) -> str:
    o = ord(c)
    if o < 0x250 or 0x1E00 <= o < 0x1F00:
        return "L"
    if 0x400 <= o < 0x530:
        return "C"
    if 0x370 <= o < 0x400 or 0x1F00 <= o < 0x2000:
        return "G"
    return "?"


_TO = {"L": {**CYRILLIC_LATIN, **GREEK_LATIN}, "C": LATIN_CYRILLIC, "G": {**{b: a for a, b in GREEK_LATIN.items()}, **CYRILLIC_GREEK}}


def _certain(c: str, s: str) -> bool:
    """A letter that can't stand in for one of another script."""
    if s == "G":
        return c not in GREEK_LATIN and c.lower() not in "γοε"
    if s == "L":
        return c not in LATIN_CYRILLIC and c not in "ijsIJSvVuNZhdqw"
    return c not in CYRILLIC_LATIN and c not in GREEK_LATIN and c not in "к"


def plain_form(text: str) -> str:
    """One form for widths, ligatures, accents, blanks and invisible characters; look-alikes are not touched."""
    t = _DROP_RE.sub("", text)
    t = _SPACE_RE.sub(" ", t)
    t = _WIDTH_RE.sub(lambda m: unicodedata.normalize("NFKC", m.group()), t)
    return unicodedata.normalize("NFC", t).translate(CEDILLA)


def token_repairs(text: str, certain: bool = CERTAIN, whole: bool = WHOLE) -> list[tuple[int, int, list[str], bool]]:
    """(start, end, repaired forms the likeliest first, needs the vocabulary) of each token with letters that may be look-alikes."""
    found = []
    tokens = [(m.start(), m.end(), m.group()) for m in _TOKEN_OR_TAG.finditer(text) if m.group()[0] not in "<&"]
    kinds = []
    for _, _, w in tokens:
        kinds.append("L" if w.isascii() else "".join(sorted({script(c) for c in w})))
    if len(set(kinds)) == 1 and len(kinds[0]) == 1:
        return found
    for i, (a, b, w) in enumerate(tokens):
        k = kinds[i]
        if "?" in k:
            continue
        needs = True
        if len(k) > 1:
            sure = {script(c) for c in w if _certain(c, script(c))}
            if len(sure) > 1:
                continue
            if sure:
                goals, needs = [next(iter(sure))], not certain
            else:
                counts = {s: sum(script(c) == s for c in w) for s in k}
                goals = sorted(counts, key=lambda s: -counts[s])
        else:
            near = [kinds[j] for j in (i - 1, i + 1) if 0 <= j < len(kinds)]
            if not whole or k not in "CLG" or not near or any(n != near[0] for n in near) or near[0] == k or near[0] not in ("L", "C", "G"):
                continue
            goals = [near[0]]
        forms = ["".join(c if script(c) == goal else _TO[goal].get(c, "\0") for c in w) for goal in goals]
        if forms := [f for f in forms if "\0" not in f]:
            found.append((a, b, forms, needs))
    return found


def consistent_form(text: str, attested: frozenset | set | None = None, certain: bool = CERTAIN, whole: bool = WHOLE) -> str:
    """The one form of a value. attested: lower-case repaired tokens that the vocabulary has."""
    t = plain_form(text)
    if t.isascii():
        return t
    out, at = [], 0
    for a, b, forms, needs in token_repairs(t, certain, whole):
        good = [f for f in forms if not needs or (attested is not None and f.lower() in attested)]
        if good:
            out += [t[at:a], good[0]]
            at = b
    return "".join(out) + t[at:]


VALUES = "id long, field string, value string, meta boolean"


def values_of(translations: DataFrame) -> DataFrame:
    """One row for each value: id, field, value."""
    pair = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in ("source", "target")])
    return translations.select("id", "source", "target").filter("id is not null").select("id", F.explode(pair).alias("x")).select("id", "x.field", "x.value")


def repairs(translations: DataFrame, certain: bool = CERTAIN, whole: bool = WHOLE, least: int = LEAST) -> DataFrame:
    """Values that differ from their consistent form: id, field, value, form, evidence, meta (metadata of a book: chapter
    0, paragraphs 0 to 4). One scan finds the suspects and counts each partition's one-script words outside them."""

    def step(state: Counter, c: dict[str, list]) -> dict[str, object]:
        plain: list[str] = []
        out: dict[str, list] = {k: [] for k in ("id", "field", "value", "meta", "sure", "pending")}
        for field in ("source", "target"):
            for i, v in enumerate(c[field]):
                if not v:
                    continue
                if not suspect(v):
                    plain.append(v)
                    continue
                if not any(ch.isalpha() for ch in v) or is_empty(v, c["source"][i] if field == "target" else None):
                    continue
                t = plain_form(v)
                fixes = token_repairs(t, certain, whole) if not t.isascii() else []
                sure = t != v or any(not f[3] for f in fixes)
                pending = sorted({x.lower() for f in fixes for x in f[2]})
                if sure or pending:
                    for k, x in zip(out, (c["id"][i], field, v, c["meta"][i], sure, pending)):
                        out[k].append(x)
        state.update(_TOKEN.findall(" ".join(plain).lower()))
        return out

    def end(state: Counter) -> dict[str, object]:
        words = [w for w in state if w.isascii() or len({script(x) for x in w}) == 1]
        return {"word": words, "n": [state[w] for w in words]}

    meta = F.coalesce(F.col("chapter") == 0, F.lit(False)) & F.coalesce(F.col("paragraph").between(0, 4), F.lit(False))
    t = translations.select("id", "source", "target", meta.alias("meta")).filter("id is not null")
    both = stage(scan_partitions(t, f"{VALUES}, sure boolean, pending array<string>, word string, n long", Counter, step, end, ("source", "target")), "suspects")
    scanned = both.filter("word is null").drop("word", "n")
    vocabulary = both.filter("word is not null").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least).select("word")
    tokens = scanned.select("id", "field", F.explode("pending").alias("word"))
    # a token that many values have meets the vocabulary once
    attested = tokens.select("word").distinct().join(vocabulary, "word", "left_semi")
    known = tokens.join(small_side(attested), "word").groupBy("id", "field").agg(F.collect_set("word").alias("known"))
    joined = scanned.drop("pending").join(known, ["id", "field"], "left").filter("sure or known is not null")

    def finish(c: dict[str, list]) -> dict[str, object]:
        forms = [consistent_form(v, set(k or ()), certain, whole) for v, k in zip(c["value"], c["known"])]
        keep = [i for i, f in enumerate(forms) if f != c["value"][i]]
        return {**{k: [c[k][i] for i in keep] for k in ("id", "field", "value", "meta")}, "form": [forms[i] for i in keep], "evidence": ["vocabulary" if c["known"][i] else "characters" for i in keep]}

    return map_pieces(joined, f"{VALUES}, form string, evidence string", finish, ("value",))


def p5_repairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every repaired value, metadata of books too."""
    return repairs(spark.read.parquet(f"{sf_dir}/translations.parquet")).drop("meta")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inconsistent values; metadata of books hold no cases by definition."""
    return repairs(spark.read.parquet(f"{sf_dir}/translations.parquet")).filter("not meta").select("id", "field")


def p5_consistent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every value in its one form: id, field, value (null stays null)."""
    t = spark.read.parquet(f"{sf_dir}/translations.parquet")
    # a row that is repeated has the same values and needs its form once
    fixed = repairs(t).groupBy("id", "field", "value").agg(F.first("form").alias("form"))
    return values_of(t).join(fixed, ["id", "field", "value"], "left").select("id", "field", F.coalesce("form", "value").alias("value"))


QUERIES = {"p5_found": p5_found, "p5_repairs": p5_repairs, "p5_consistent": p5_consistent}
