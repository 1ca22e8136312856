"""Problem 3: values cut off at a limit or in mid-transfer.

Method: for each model and each unit of length (characters, bytes, words) a right-censored log-normal is fitted by
maximum likelihood at every candidate limit, a length where open values pile up; each value at a limit gets its
posterior of being censored there. It is combined, as log odds, with the evidence of the ending: how much likelier the
last word is inside a sentence than at an end (counts over the whole corpus), and how the last sentence compares in
length with the source sentence it renders. Only open values (no final mark, though the source has one) are judged;
a source without a mark calls for evidence of a broken word.

Nulls: a null or empty target is no case and not counted in a model's total; a null model is a source of its own (''); a
null source counts as one with a final mark. Values of any length are read whole. Repeated rows each give their own row.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import small_side, stage
from .batches import fold_partitions, map_pieces
from .textkit import SENTENCE_END, _INVISIBLE_RE, fold, is_empty, language_of_label

_TAIL_TAGS = re.compile(r"(?:\s*<[^<>]*>?\s*)+$")
_CLOSERS = "\"”“’'‘*›»_~`)]}"
_MARKS = ".!?…"
_LAST = re.compile(r"[^\W_]+(?:['’][^\W_]+)*(?=[\W_]*$)")
_WORD = re.compile(r"[^\W_]+")
_LAST_RUN = re.compile(r"[^\W_]+$")
_MARK_RUN = re.compile(r"[.!?]+")
_ANCHOR = re.compile(r"\d+|[^\W\d_a-zà-ÿа-я][^\W\d_]{3,}")
UNITS = ("chars", "bytes", "words")
#: Beginnings of words are listed up to so many letters and found by comparison beyond.
LONG_WORD = 40


def model_key(model: str | None) -> str:
    return "" if model is None else model.rpartition("@")[2].strip().lower()


def body_of(value: str) -> str:
    """A value without markup put behind it; blanks that were cut with it stay."""
    m = _TAIL_TAGS.search(value) if "<" in value else None
    return value[: m.start()] if m and m.start() else value


def ending(value: str, keep_dots: bool = True) -> tuple[str, str]:
    """(mark at the end or '', text before closing marks). keep_dots: an ellipsis counts as a mark."""
    core = value.rstrip().rstrip(_CLOSERS + " \t\n  �​⁠﻿")
    if not keep_dots:
        core = core.rstrip(".… ")
    return (core[-1] if core and core[-1] in _MARKS else ""), core


def lengths(body: str) -> tuple[int, int, int]:
    b = body.rstrip("�")
    return len(b), len(b) if b.isascii() else len(b.encode("utf-8", "replace")), len(b.split())


def is_open(target: str, source: str | None) -> tuple[bool, bool, str, str]:
    """(target has no final mark, source has one, body, its core). Dots put behind a cut are no mark unless the source
    has them too."""
    body = body_of(target)
    mark, core = ending(body)
    s_core = ""
    s_mark = "."
    if source and not source.isspace():
        s_mark, s_core = ending(body_of(source))
    if mark and (core.endswith("…") or core.endswith("..")) and not (s_core.endswith("…") or s_core.endswith("..")):
        inner = core.rstrip(".… ")
        if inner and source is not None and not re.search(r"(?:\.\.|…)", source):
            return True, bool(s_mark), body, inner
    return not mark, bool(s_mark), body, core


def sentence_pieces(text: str) -> list[str]:
    out, at = [], 0
    for m in SENTENCE_END.finditer(text):
        if text[at : m.end()].strip():
            out.append(text[at : m.end()].strip())
        at = m.end()
    if text[at:].strip():
        out.append(text[at:].strip())
    return out


def ratio_key(source_lang: str | None, target_lang: str | None) -> str:
    return "@" if source_lang == "@" else f"{language_of_label(source_lang)}>{language_of_label(target_lang)}"


STATISTICS = "kind string, key string, size int, a double, b double, c double"


def new_statistics() -> dict:
    return {"w": Counter(), "e": Counter(), "h": defaultdict(lambda: [0, 0]), "r": defaultdict(lambda: [0, 0.0, 0.0])}


def final_words(text: str) -> list[str]:
    """Last word before each run of marks, where at most three other characters stand between."""
    out = []
    for piece in _MARK_RUN.split(text)[:-1]:
        last = piece.rsplit(None, 1)
        word = (last[-1] if last else "").rstrip(_CLOSERS)
        if not word and len(last) == 2:  # closing marks set off by a blank
            word = last[0].rsplit(None, 1)[-1].rstrip(_CLOSERS)
        if m := _LAST_RUN.search(word):
            out.append(m.group())
    return out


def add_statistics(st: dict, c: dict[str, list], words: bool = True) -> None:
    """Takes a piece in; words: count words too."""
    text = []
    for t, s, m, sl, tl in zip(c["target"], c["source"], c["model"], c["source_lang"], c["target_lang"]):
        if not t or t.isspace():
            continue
        opened, s_mark, body, _ = is_open(t, s)
        if not opened:
            text.append(t)
            if s_mark and s:
                if t.count(".") + t.count("!") + t.count("?") == 1 == s.count(".") + s.count("!") + s.count("?"):
                    x = math.log(len(body) / max(len(s), 1))
                    if abs(x) < 0.7:
                        r = st["r"][ratio_key(sl, tl)]
                        r[0] += 1
                        r[1] += x
                        r[2] += x * x
        if opened and len(t) < 40 and is_empty(t, s):
            continue
        k = model_key(m)
        for unit, size in zip(UNITS, lengths(body)):
            h = st["h"][unit, k, size]
            h[0] += 1
            h[1] += opened and s_mark
    joined = " ".join(text).lower()
    if words:
        st["w"].update(_WORD.findall(joined))
    st["e"].update(final_words(joined))


def statistics_rows(st: dict) -> dict[str, list]:
    rows = [("w", w, 0, float(n), float(st["e"].get(w, 0)), 0.0) for w, n in st["w"].items()]
    rows += [(u, k, size, float(n), float(o), 0.0) for (u, k, size), (n, o) in st["h"].items()]
    rows += [("r", k, 0, float(n), x, y) for k, (n, x, y) in st["r"].items()]
    return dict(zip(("kind", "key", "size", "a", "b", "c"), map(list, zip(*rows) if rows else [()] * 6)))


def summed_statistics(parts: DataFrame) -> DataFrame:
    return parts.groupBy("kind", "key", "size").agg(F.sum("a").alias("a"), F.sum("b").alias("b"), F.sum("c").alias("c"))


def corpus_statistics(translations: DataFrame) -> DataFrame:
    """Counts over all rows: words and words at sentence ends ('w'), lengths by model and unit with the open ones
    ('chars', 'bytes', 'words'), log length ratios by language pair ('r'): kind, key, size, a, b, c."""
    cols = translations.select("source", "target", "model", "source_lang", "target_lang").filter("target is not null and target <> ''")
    return summed_statistics(fold_partitions(cols, STATISTICS, new_statistics, add_statistics, statistics_rows, ("source", "target")))


def fit_censored(size: np.ndarray, n: np.ndarray, limit: int, censored: float, rounds: int = 40) -> tuple[float, float]:
    """Maximum likelihood of a log-normal from counts n of sizes and so many values censored at limit: mean, deviation."""
    x = np.log(np.maximum(size, 1.0))
    total = n.sum() + censored
    mu = (n * x).sum() / max(n.sum(), 1)
    sd = max(0.2, math.sqrt((n * (x - mu) ** 2).sum() / max(n.sum(), 1)))
    c = math.log(limit)
    for _ in range(rounds):  # expectation-maximisation: moments of the part beyond the limit
        z = (c - mu) / sd
        tail = max(1e-12, 0.5 * math.erfc(z / math.sqrt(2)))
        lam = math.exp(-z * z / 2) / math.sqrt(2 * math.pi) / tail
        e1 = mu + sd * lam
        e2 = mu * mu + sd * sd + sd * lam * (c + mu)
        m1 = ((n * x).sum() + censored * e1) / total
        m2 = ((n * x * x).sum() + censored * e2) / total
        mu, sd = m1, max(0.05, math.sqrt(max(m2 - m1 * m1, 1e-4)))
    return mu, sd


def limits_of_group(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    """Candidate limits of one model and unit with the posterior of a value of just that length being censored."""
    unit, model = key
    pdf = pdf.sort_values("size")
    size, n, o = pdf["size"].to_numpy(), pdf["a"].to_numpy(), pdf["b"].to_numpy()
    out = []
    at = dict(zip(size.tolist(), range(len(size))))
    width = {"chars": 12, "bytes": 12, "words": 4}[unit]
    for i in np.flatnonzero((o >= 4) & (o >= 0.3 * n)):
        around = [o[at[s]] if s in at else 0.0 for s in range(int(size[i]) - width, int(size[i]) + width + 1) if abs(s - size[i]) > (3 if unit == "bytes" else 1)]
        usual = np.mean(around) if around else 0.0
        if size[i] < 4 or o[i] < usual + 5 * math.sqrt(usual + 0.5):
            continue
        rest = n.copy()
        rest[i] -= o[i]
        mu, sd = fit_censored(size, rest, int(size[i]), float(o[i]))
        z = (math.log(size[i]) - mu) / sd
        beyond = 0.5 * math.erfc(z / math.sqrt(2))
        density = math.exp(-z * z / 2) / math.sqrt(2 * math.pi) / sd / size[i]
        rate = o[i] / (o[i] + n[size > size[i]].sum() + 1)
        natural = density * (usual + 1) / (n.sum() + 1)
        out.append((model, unit, int(size[i]), float(o[i]), mu, sd, float(beyond * rate / (beyond * rate + natural + 1e-12))))
    return pd.DataFrame(out, columns=["model_key", "unit", "limit", "hits", "mu", "sigma", "posterior"])


def limits(statistics: DataFrame) -> DataFrame:
    """The limits of every model, in the unit that explains them best: a unit stays only where its strongest limit has
    half the hits of the model's strongest."""
    h = statistics.filter(F.col("kind").isin(*UNITS)).select(F.col("kind").alias("unit"), "key", "size", "a", "b")
    found = h.groupBy("unit", "key").applyInPandas(limits_of_group, "model_key string, unit string, limit int, hits double, mu double, sigma double, posterior double")
    top = found.groupBy("model_key", "unit").agg(F.max("hits").alias("t"), F.collect_list(F.struct("limit", "hits", "mu", "sigma", "posterior")).alias("x"))
    best = top.groupBy("model_key").agg(F.max("t").alias("best"), F.collect_list(F.struct("unit", "t", "x")).alias("u"))
    return best.select("model_key", "best", F.explode("u").alias("u")).filter("u.t >= 0.5 * best").select("model_key", "u.unit", F.explode("u.x").alias("x")).select("model_key", "unit", "x.*")


OPENED = "model_key string, chars int, bytes int, words int, word string, llr_length double, shape double, s_mark boolean"


def length_ratios(stats: DataFrame) -> dict[str, tuple[float, float, float]]:
    """Mean and deviation of the log length ratio of each language pair, and its number; at most 65 pairs."""
    return {r.key: (r.b / r.a, math.sqrt(max(r.c / r.a - (r.b / r.a) ** 2, 0.0)), r.a) for r in stats.filter("kind = 'r'").collect()}


def open_rows(c: dict[str, list], ratio: dict[str, tuple[float, float, float]], omit: float) -> dict[str, list]:
    """The open values of a piece with what their endings tell."""
    out: dict[str, list] = {k: [] for k in ("id", "model_key", "chars", "bytes", "words", "word", "llr_length", "shape", "s_mark")}
    for i, t in enumerate(c["target"]):
        s = c["source"][i]
        opened, s_mark, body, core = is_open(t, s)
        if not opened or is_empty(t, s):
            continue
        clean = _INVISIBLE_RE.sub("", core)
        last = _LAST.search(clean)
        if not last or (s is not None and clean.strip() == s.strip()):
            continue
        llr = shape = 0.0
        if clean.rstrip()[-1:] in ",;:([{«„“‘" and s_mark:
            shape += 3.0
        if sum(map(clean.count, "“„«")) > sum(map(clean.count, "”»")) + ("„" in clean and clean.count("“")) and not clean.rstrip().endswith(("”", "»")):
            shape += 2.5
        if len(body) < len(t) or t[-1].isspace() or len(core) < len(ending(body)[1]):
            shape += 1.5
        if s:
            mine = sentence_pieces(clean)
            theirs = sentence_pieces(_INVISIBLE_RE.sub("", body_of(s)))
            if mine and theirs:
                tail = mine[-1]
                anchors = {fold(x) for x in _ANCHOR.findall(tail)}
                score = [len(anchors & {fold(x) for x in _ANCHOR.findall(p)}) for p in theirs]
                best = max(score)
                group = [p for p, x in zip(theirs, score) if x == best] if best else theirs[-1:]
                other = theirs[-1] if theirs[-1] in group else group[-1]
                mu, sd, n = ratio.get(ratio_key(c["source_lang"][i], c["target_lang"][i]), (0.0, 0.2, 0))
                if n < 30:
                    mu, sd = 0.0, 0.2
                sd = min(max(sd, 0.1), 0.3)
                r = len(tail) / max(len(other), 1) / math.exp(mu)
                x = math.log(max(r, 1e-3))
                # a whole sentence may also leave out a phrase of its source
                whole_p = (1 - omit) * math.exp(-x * x / (2 * sd * sd)) / (sd * math.sqrt(2 * math.pi)) + (omit * 2 * r if 0.5 < r < 0.95 else 0.0) + 0.02
                llr = math.log((r if r < 1.1 else 0.02) + 0.02) - math.log(whole_p)
                if best == 0 and len(theirs) > 1 and len(mine) < len(theirs):
                    llr = max(llr, 0.0)
        n_chars, n_bytes, n_w = lengths(body)
        word = unicodedata.normalize("NFC", last.group()).lower()
        word = re.split(r"['’]", word)[-1] or word
        for k, v in zip(out, (c["id"][i], model_key(c["model"][i]), n_chars, n_bytes, n_w, word, llr, shape, s_mark)):
            out[k].append(v)
    return out



def judge(translations: DataFrame, threshold: float = 0.5, omit: float = 0.2) -> DataFrame:
    """Every open value with its log odds of being cut: id, model_key, censor_posterior, log_odds, cut.

    omit: how often a whole sentence leaves out a phrase of its source."""
    stats = stage(corpus_statistics(translations), "lengths")
    ratio = length_ratios(stats)
    cols = translations.select("id", "source", "target", "model", "source_lang", "target_lang").filter("id is not null and target is not null and target <> ''")
    return decide(stage(map_pieces(cols, f"id long, {OPENED}", lambda c: open_rows(c, ratio, omit), ("source", "target")), "open"), stats, threshold)


def beginnings(words: DataFrame, wanted: DataFrame, most: int = LONG_WORD) -> DataFrame:
    """word, w_part of each wanted word: a cut inside a word of n letters leaves each of its n - 1 beginnings with the same chance.
    Beginnings of up to `most` letters are all counted; longer ones, which would be long chains, are found by their first
    `most` letters, so that words of any length count."""
    share = (F.col("a") / F.length("key")).alias("x")
    first = F.least(F.length("key") - 1, F.lit(most))
    short = words.filter(F.length("key") >= 2).select(F.explode(F.transform(F.sequence(F.lit(1), first), lambda i: F.substr("key", F.lit(1), i))).alias("word"), share)
    far = words.filter(F.length("key") > most + 1).select(F.substring("key", 1, most).alias("head"), "key", share)
    need = wanted.filter(F.length("word") > most).select("word", F.substring("word", 1, most).alias("head"))
    long = need.join(far, "head").filter(F.startswith("key", F.col("word")) & (F.length("word") < F.length("key"))).select("word", "x")
    return short.groupBy("word").agg(F.sum("x").alias("x")).unionByName(long).groupBy("word").agg(F.sum("x").alias("w_part"))


def decide(opened: DataFrame, stats: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Log odds of open values from the statistics of the corpus and its limits."""
    by_model = limits(stats).groupBy("model_key").agg(F.collect_list(F.struct("unit", "limit", "posterior")).alias("limits"))
    whole = stats.filter("kind = 'w'").agg(F.sum("a"), F.sum("b")).first()
    n_words, n_ends = (whole[0] or 1.0), (whole[1] or 1.0)
    words = stats.filter("kind = 'w'")
    vocabulary = words.select(F.col("key").alias("word"), F.col("a").alias("w_n"), F.col("b").alias("w_end"))
    # a word that many values end with is looked up once, and known by its broadcast while distinct words are few
    last = opened.select("word").distinct()
    facts = small_side(last.join(vocabulary, "word", "left").join(beginnings(words, last), "word", "left"))
    at_limit = F.expr("aggregate(coalesce(limits, array()), 0D, (m, x) -> greatest(m, CASE WHEN x.limit = CASE x.unit WHEN 'chars' THEN chars WHEN 'bytes' THEN bytes ELSE words END THEN x.posterior ELSE 0D END))")
    j = opened.join(facts, "word", "left").join(small_side(by_model), "model_key", "left").withColumn("censor_posterior", at_limit)
    n, e, part = (F.coalesce(c, F.lit(0.0)) for c in ("w_n", "w_end", "w_part"))
    inside = (0.5 * F.greatest(n - e, F.lit(0.0)) + 0.5 * part + 0.02) / n_words
    llr_word = F.least(F.greatest(F.log(inside / ((e + 0.3) / n_ends)), F.lit(-3.0)), F.lit(6.0))
    p = F.least(F.col("censor_posterior"), F.lit(0.999))
    llr_limit = F.when(p > 0, F.log(p / (1 - p)) + 1).otherwise(F.lit(0.0))
    odds = llr_word + F.least(F.greatest("llr_length", F.lit(-2.0)), F.lit(3.0)) + llr_limit + F.col("shape")
    plain = F.when(F.col("s_mark"), odds - 1.0).otherwise(odds - 3.0)
    broken = F.col("s_mark") | ((llr_word > 1) & (F.col("llr_length") > 0.2))
    return j.withColumn("log_odds", plain).select("id", "model_key", "word", "llr_length", llr_word.alias("llr_word"), "s_mark", "censor_posterior", "log_odds", ((F.col("log_odds") > math.log(threshold / (1 - threshold))) & broken).alias("cut"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/translations.parquet")).filter("cut").select("id")


def p3_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The limits found for each model, with the fitted distribution."""
    return limits(corpus_statistics(spark.read.parquet(f"{sf_dir}/translations.parquet"))).withColumn("posterior", F.round("posterior", 6))


def p3_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each model: its targets that are not empty, how many are cut, and the share."""
    t = spark.read.parquet(f"{sf_dir}/translations.parquet")
    key = F.coalesce(F.lower(F.trim(F.regexp_replace("model", r"^.*@", ""))), F.lit(""))
    total = t.filter("target is not null and trim(target) <> ''").groupBy(key.alias("model_key")).agg(F.count("*").alias("targets"))
    cut = judge(t).filter("cut").groupBy("model_key").agg(F.count("*").alias("cut"))
    return total.join(cut, "model_key", "left").select("model_key", "targets", F.coalesce("cut", F.lit(0)).alias("cut"), (F.coalesce("cut", F.lit(0)) / F.col("targets")).alias("share"))


QUERIES = {"p3_found": p3_found, "p3_limits": p3_limits, "p3_report": p3_report}
