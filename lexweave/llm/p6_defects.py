"""Problem 6: broken prompt and response pairs, each with its defect type.

Method: openings of responses that share nothing with their prompt (no name, no number) are clustered by MinHash over
three-character shingles (an opening has too few words for shingles of five), every pair of a bucket verified at a Jaccard
similarity of 0.8 unless other links join it; a cluster that recurs across unrelated prompts is a template. Word weights learned from the rows of templates against the
whole corpus tell templates that refuse from sentences that a story repeats: rows that open with a refusing template are
refusals (evidence 'template'), and so are rows that the weights recognise though put together in new ways (evidence
'words'). Copies, languages and cut endings are checked row by row. Texts of
any length are clustered and scored whole.

Nulls: a null target is `empty`; rows with a null or blank source, overlays and rows of model '' or 'copy' are not
judged; a book that `books` lacks has no wanted language, so no `wrong_language`. Each row has at most one defect, the
first that holds. Repeated rows each give their own. Whether prompts are unrelated is told by four minima of hashed words:
two prompts that share eight tenths of their words agree in most of them, two that share a tenth in hardly any.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import small_side, stage
from .batches import map_pieces, scan_partitions
from .hashed import SpanHash, codes_of, hashes_of, look_up, mix, spans
from .langid import K, LanguageModel, mixture
from .p2_language import adapted_to_words, add_label_words, fit_language_model, label_prior, label_word_rows
from .p3_truncation import OPENED, STATISTICS, add_statistics, decide, length_ratios, new_statistics, open_rows, sentence_pieces, statistics_rows, summed_statistics
from .textkit import _INVISIBLE_RE, HEADING, SEP, Sentences, fold, is_empty, language_of_label

#: Characters of a shingle, words of an opening, hashes and rows of a band, heads of a bucket, passes over heads.
SHINGLE, OPENING, HASHES, BAND, HEADS, PASSES = 3, 24, 32, 4, 16, 3
SKETCH = 4
#: Weight of a word that no refusal has.
UNKNOWN = -2.0
_QUOTED = re.compile(r"“[^“”\x01]*”|„[^„“”\x01]*[“”]|«[^«»\x01]*»")
_TAG = re.compile(r"<[^<>\x01]*>")
_WORD = re.compile(r"[^\W_]+")
_ANCHOR = re.compile(r"\d+|(?<![.!?]\s)(?<!^)[^\W\d_a-zà-ÿа-яăşţșț][^\W\d_]{3,}")
_END = re.compile(r"[.!?](?=\W|$)")
#: Latin spelling of Cyrillic letters, for names met in both scripts.
_LATIN = str.maketrans(dict(zip("абвгдежзийклмнопрстуфхцы", "abvgdejziiklmnoprstufhcy")))


def words_of(text: str) -> list[str]:
    t = _TAG.sub(" ", _INVISIBLE_RE.sub("", text))
    return [fold(w) for w in _WORD.findall(_QUOTED.sub(" ", t))]


def anchor_set(text: str) -> set[str]:
    """Numbers, and the first three letters of names inside sentences."""
    return {a if a.isdigit() else fold(a).translate(_LATIN)[:3] for a in _ANCHOR.findall(_INVISIBLE_RE.sub("", text))}


def unrelated(source: str, target: str) -> bool:
    """The source has names or numbers and the target none of them."""
    some = False
    for m in _ANCHOR.finditer(source):
        if m.group() in target:  # most names and numbers pass as they are
            return False
        some = True
    return some and not anchor_set(source) & anchor_set(target)


def opening_of(target: str) -> str:
    """Up to OPENING words of the first sentence, outside quotes."""
    t = _QUOTED.sub(" ", _TAG.sub(" ", _INVISIBLE_RE.sub("", target)))
    m = _END.search(t)
    return " ".join(fold(w) for w in _WORD.findall(t[: m.end()] if m else t)[:OPENING])


def prompt_sketch(source: str) -> list[int]:
    """SKETCH minima of hashed words: prompts that differ little share most of them."""
    words = {fold(w).encode() for w in _WORD.findall(source)}
    return [min((zlib.crc32(w, k * 2654435761 & 0xFFFFFFFF) for w in words), default=0) for k in range(SKETCH)]


def eligible(translations: DataFrame) -> DataFrame:
    return translations.filter("id is not null and coalesce(source_lang, '') <> '@' and source is not null and trim(source) <> '' and coalesce(lower(trim(model)), '?') not in ('', 'copy')")


_MULTIPLIERS = np.random.default_rng(23).integers(1, 1 << 63, HASHES, dtype=np.uint64) | np.uint64(1)


def signed(c: dict[str, list]) -> dict[str, object]:
    """Shingles and MinHash values of openings: opening, grams (distinct, hashed), mins; odd0, odd1: the bits that an odd
    number of shingles turn, so that two openings differ in as many shingles at least as in bits."""
    text = SEP.join(c["opening"]) + SEP
    codes = codes_of(text).astype(np.uint64)
    end = np.flatnonzero(codes == 1)
    start = np.concatenate([[0], end[:-1] + 1])
    padded = np.concatenate([codes, np.ones(SHINGLE, np.uint64)])
    h = np.zeros(len(codes), np.uint64)
    for k in range(SHINGLE):  # the last shingles of an opening run into its end and count as ends
        h = h * np.uint64(0x100000001B3) + padded[k : k + len(codes)]
    doc = np.searchsorted(end, np.arange(len(codes)))
    inside = np.arange(len(codes)) <= np.maximum(end[doc] - SHINGLE, start[doc])
    h, doc = (mix(h) >> np.uint64(33)).astype(np.int64)[inside], doc[inside]
    key = np.unique(doc << 31 | h)
    doc, h = key >> 31, key & ((1 << 31) - 1)
    at = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
    wide = mix(h.astype(np.uint64) + np.uint64(1))
    mins = np.stack([np.minimum.reduceat(mix(wide * m) >> np.uint64(1), at) for m in _MULTIPLIERS], 1).astype(np.int64)
    grams = np.split(h, at[1:])
    place = mix(wide) >> np.uint64(57)  # each shingle turns one of 128 bits
    turned = np.uint64(1) << (place & np.uint64(63))
    odd = {f"odd{k}": np.bitwise_xor.reduceat(np.where(place >> np.uint64(6) == k, turned, np.uint64(0)), at).astype(np.int64) for k in range(2)}
    return {"opening": c["opening"], "grams": [g.tolist() for g in grams], "mins": mins.tolist(), **odd, **{k: c[k] for k in ("low", "high")}}


def opening_clusters(openings: DataFrame) -> DataFrame:
    """openings: opening (distinct), low and high (arrays: least and greatest value of each prompt sketch behind it).
    Gives opening, cluster (a number), low and high of the whole cluster.

    Clusters are all that links join, links all pairs that share a bucket of a band and are alike. First, members of a
    bucket meet a few heads of it only, the least of each part of the bucket, and those without a likeness among the heads
    of a larger bucket come together again in buckets of one value more, PASSES times in all: this joins most of what is
    alike without expanding a bucket of one template into pairs. Then every pair of a bucket that is not yet known to be
    joined is compared (`unjoined_pairs`), and labels are carried along links until none changes."""
    signed_ = map_pieces(openings.filter("opening <> ''"), "opening string, grams array<int>, mins array<long>, odd0 long, odd1 long, low array<long>, high array<long>", signed, ("opening",))
    o = stage(signed_.withColumn("h", F.xxhash64("opening")), "openings")
    keys = [f"k{turn}" for turn in range(PASSES)]
    member = F.struct("h", "odd0", "odd1", F.size("grams").alias("size")).alias("m")

    def band(b: int) -> Column:
        """Keys of a band's bucket: its values, then one value more of another band for each further pass."""
        out = [F.xxhash64(F.lit(b), *[F.col("mins")[b * BAND + r] for r in range(BAND)])]
        for turn in range(1, PASSES):
            out.append(F.xxhash64(out[-1], F.col("mins")[((b + 1) * BAND + turn - 1) % HASHES]))
        return F.struct(*[c.alias(k) for c, k in zip(out, keys)])

    ga, gb = (o.select(F.col("h").alias(x), F.col("grams").alias(f"g{x}")) for x in "ab")

    def alike(pairs: DataFrame) -> DataFrame:
        """Those of pairs (a, b) that are alike; shingles are fetched once for each pair that has met in any bucket."""
        both = F.size(F.array_intersect("ga", "gb"))
        return stage(pairs.select("a", "b").distinct().join(ga, "a").join(gb, "b").filter(both * 1.8 >= 0.8 * (F.size("ga") + F.size("gb"))).select("a", "b"), "near")

    # only hashes and bits of openings meet
    buckets = stage(o.select(member, F.explode(F.array(*map(band, range(HASHES // BAND)))).alias("x")).select("m", "x.*"), "buckets")
    rest, near = buckets, []
    for turn, key in enumerate(keys):
        part = F.pmod(F.xxhash64("m.h", F.lit(turn)), F.lit(HEADS))
        heads = rest.groupBy(key, part.alias("part")).agg(F.min("m").alias("head"), F.count("*").alias("n"))
        heads = heads.groupBy(key).agg(F.collect_list("head").alias("heads"), F.sum("n").alias("n")).filter("n > 1")  # at most HEADS
        met = stage(rest.join(heads, key), "met")
        tried = met.select("m", key, F.explode("heads").alias("head")).filter(F.col("m.h") != F.col("head.h")).filter(maybe_alike("m", "head"))
        tried = tried.select(F.col("m.h").alias("h"), key, F.least("m.h", "head.h").alias("a"), F.greatest("m.h", "head.h").alias("b"))
        near.append(alike(tried))
        found = tried.join(near[-1], ["a", "b"], "left_semi").select("h", key).distinct()
        rest = met.filter(F.col("n") > F.size("heads")).withColumn("h", F.col("m.h")).join(found, ["h", key], "left_anti").select("m", *keys)
    known = near[0]
    for x in near[1:]:
        known = known.unionByName(x)
    known = known.distinct()
    label = joined(known, 1)
    links = known.unionByName(alike(unjoined_pairs(buckets.select(F.col(keys[0]).alias("key"), "m"), label)))
    label = joined(links)
    own = o.select("h", "opening", "low", "high").join(label, "h", "left").withColumn("cluster", F.coalesce("cluster", "h"))
    label = stage(own, "clusters")
    edge = lambda f, name: F.array(*[f(F.col(name)[k]) for k in range(SKETCH)]).alias(name)
    whole = label.groupBy("cluster").agg(edge(F.min, "low"), edge(F.max, "high"))
    return label.select("opening", "cluster").join(whole, "cluster").select("opening", "cluster", "low", "high")


def maybe_alike(x: str, y: str) -> Column:
    """False only where two members can't be alike: at a Jaccard similarity of 0.8 sets differ in a ninth of their sizes' sum."""
    differ = sum(F.bit_count(F.col(f"{x}.{odd}").bitwiseXOR(F.col(f"{y}.{odd}"))) for odd in ("odd0", "odd1"))
    return differ * 9 <= F.col(f"{x}.size") + F.col(f"{y}.size")


def unjoined_pairs(members: DataFrame, label: DataFrame, share: int = 20_000_000) -> DataFrame:
    """members: key (bucket), m; label: h, cluster of those that are joined to any. Gives all pairs (a, b) of a bucket that
    have not one label and may be alike. The members of a bucket's largest cluster don't meet each other, so that a bucket of one
    template is not expanded; a bucket of many pairs is shared out among tasks."""
    labelled = members.withColumn("h", F.col("m.h")).join(label, "h", "left").select("key", "m", F.coalesce("cluster", "h").alias("cluster"))
    sizes = labelled.groupBy("key", "cluster").agg(F.count("*").alias("n")).groupBy("key")
    mixed = sizes.agg(F.max(F.struct("n", "cluster")).alias("top"), F.sum("n").alias("n"), F.count("*").alias("k")).filter("k > 1")
    tasks = F.least(F.floor((F.col("n") - F.col("top.n")) * F.col("n") / share) + 1, F.lit(64))
    labelled = stage(labelled.join(mixed.select("key", F.col("top.cluster").alias("top"), tasks.cast("int").alias("tasks")), "key"), "unjoined")
    one = labelled.filter("cluster <> top").select("key", F.pmod(F.xxhash64("m.h"), F.col("tasks")).cast("int").alias("task"), "m", "cluster")
    two = labelled.select("key", F.explode(F.sequence(F.lit(0), F.col("tasks") - 1)).alias("task"), F.col("m").alias("w"), F.col("cluster").alias("other"), (F.col("cluster") == F.col("top")).alias("large"))
    met = one.join(two, ["key", "task"]).filter(F.col("cluster") != F.col("other")).filter(F.col("large") | (F.col("m.h") < F.col("w.h"))).filter(maybe_alike("m", "w"))
    return met.select(F.least("m.h", "w.h").alias("a"), F.greatest("m.h", "w.h").alias("b"))


def joined(pairs: DataFrame, rounds: int | None = None) -> DataFrame:
    """h, cluster of all members of pairs (a, b): the least member that links lead to, after so many rounds, or in the end."""
    links = stage(pairs.select(F.explode(F.array(F.struct(F.col("a").alias("h"), F.col("b").alias("rep")), F.struct(F.col("b").alias("h"), F.col("a").alias("rep")))).alias("x")).select("x.*"), "links")
    label = stage(links.groupBy("h").agg(F.min("rep").alias("rep")).select("h", F.least("h", "rep").alias("cluster")), "labels")
    done = 0
    while done != rounds:
        done += 1
        low = links.join(label.withColumnRenamed("h", "rep"), "rep").groupBy("h").agg(F.min("cluster").alias("low"))
        low = label.join(low, "h").select("h", F.col("cluster").alias("was"), F.least("cluster", "low").alias("cluster"))
        # a label's own label is at least as low: what is left of a chain halves in each round
        own = label.select(F.col("h").alias("cluster"), F.col("cluster").alias("own"))
        new = stage(low.join(own, "cluster", "left").select("h", "was", F.least("cluster", "own").alias("cluster")), "labels")
        label = new.select("h", "cluster")
        if done != rounds and new.filter("cluster <> was").isEmpty():
            break
    return label


def across_unrelated_prompts(least: int = 2) -> Column:
    """Whether prompts behind a cluster differ in at least so many of their sketch's values."""
    return sum(((F.col("low")[k] != F.col("high")[k]).cast("int") for k in range(SKETCH)), F.lit(0)) >= least


def suspect_rows(c: dict[str, list]) -> dict[str, list]:
    """Finished targets that share nothing with their source, with opening, sketch of the prompt and words."""
    out: dict[str, list] = {k: [] for k in ("id", "opening", "sketch", "words")}
    for i, (s, t) in enumerate(zip(c["source"], c["target"])):
        if t and _END.search(t[-6:]) and unrelated(s, t) and len(w := words_of(t)) >= 3 and not is_empty(t, s):
            for k, v in zip(out, (c["id"][i], opening_of(t), prompt_sketch(s), w)):
                out[k].append(v)
    return out


@dataclass
class Learned:
    """What one scan of the corpus gives: suspects (DataFrame), statistics of lengths and words, the language model
    adapted to the corpus, the word weights of refusals, and the rows that open with a refusal template (id)."""

    stats: DataFrame
    language: LanguageModel
    weights: dict[str, float]
    templates: DataFrame


def learn(translations: DataFrame, samples: LanguageModel) -> Learned:
    """One scan: suspects row by row, and for each partition its statistics and words by label."""
    table = translations.sparkSession.sparkContext.broadcast(samples.table)

    def start() -> dict:
        return {"s": new_statistics(), "l": [Counter() for _ in range(K + 1)]}

    def step(st: dict, c: dict[str, list]) -> dict[str, object]:
        add_statistics(st["s"], c, words=False)
        add_label_words(st["l"], c, LanguageModel(table.value))  # its words stand for the statistics' own
        return suspect_rows(c)

    def end(st: dict) -> dict[str, object]:
        for x in st["l"]:
            st["s"]["w"].update(x)
        a, b = statistics_rows(st["s"]), label_word_rows(st["l"][:K])
        m = len(b["word"])
        return {"kind": a["kind"] + ["l"] * m, "key": a["key"] + b["word"], "size": a["size"] + b["lang"], "a": a["a"] + b["n"], "b": a["b"] + [0.0] * m, "c": a["c"] + [0.0] * m}

    rows = eligible(translations).filter("target is not null and target <> ''").select("id", "source", "target", "model", "source_lang", "target_lang")
    both = stage(scan_partitions(rows, f"id long, opening string, sketch array<long>, words array<string>, {STATISTICS}", start, step, end, ("source", "target")), "scan")
    suspects = both.filter("kind is null").select("id", "opening", "sketch", "words")
    stats = stage(summed_statistics(both.filter("kind <> 'l'")), "lengths")
    words = both.filter("kind = 'l'").select(F.col("size").alias("lang"), F.col("key").alias("word"), F.col("a").alias("n"))
    positive = stage(template_rows(suspects), "templates")
    weights = learn_weights(suspects, positive, stats)
    return Learned(stats, adapted_to_words(samples, words), weights, refusing(positive, weights))


def template_rows(suspects: DataFrame) -> DataFrame:
    """Suspects whose opening belongs to a cluster that recurs across unrelated prompts: id, cluster, words."""
    edge = lambda f, name: F.array(*[f(F.col("sketch")[k]) for k in range(SKETCH)]).alias(name)
    openings = suspects.groupBy("opening").agg(edge(F.min, "low"), edge(F.max, "high"))
    templates = opening_clusters(openings).filter(across_unrelated_prompts()).select("opening", "cluster")
    return suspects.select("id", "opening", "words").join(templates, "opening").select("id", "cluster", "words")


def refusing(rows: DataFrame, weights: dict[str, float], threshold: float = 0.9) -> DataFrame:
    """Ids of the rows of templates that refuse: those whose rows weigh more than the threshold on average, since stories
    have sentences that recur too. A row counts whatever its own words weigh."""

    def weigh(c: dict[str, list]) -> dict[str, object]:
        return {"id": c["id"], "cluster": c["cluster"], "score": [sum(weights.get(x, UNKNOWN) for x in w) / max(len(w), 1) for w in c["words"]]}

    scored = stage(map_pieces(rows, "id long, cluster long, score double", weigh, ()), "template scores")
    good = scored.groupBy("cluster").agg(F.avg("score").alias("mean")).filter(F.col("mean") > threshold).select("cluster")
    return scored.join(small_side(good), "cluster", "left_semi").select("id")


def learn_weights(suspects: DataFrame, positive: DataFrame, stats: DataFrame, max_words: int = 200_000, rounds: int = 3, threshold: float = 0.9) -> dict[str, float]:
    """Log likelihood ratio of words in refusals (positive rows first, then the suspects that they single out) against
    all responses. Words of two refusals at least count; should there be more than max_words, those of most refusals leave the executors."""

    def folded(c: dict[str, list]) -> dict[str, object]:
        return {"word": [fold(w) for w in c["key"]], "n": c["a"]}

    background = stage(map_pieces(stats.filter("kind = 'w'").select("key", "a"), "word string, n double", folded, ("key",)).groupBy("word").agg(F.sum("n").alias("n")), "background")
    total_bg = background.agg(F.sum("n")).first()[0] or 1
    weights: dict[str, float] = {}
    for _ in range(rounds):
        counts = stage(positive.select(F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("m")), "counts")
        total = counts.agg(F.sum("m")).first()[0] or 0
        if not total:
            return {}
        llr = F.log((F.col("m") + 0.1) / total) - F.log((F.coalesce("n", F.lit(0)) + 1.0) / total_bg)
        top = counts.filter("m > 1").join(background, "word", "left").select("word", "m", llr.alias("w")).filter("w > 0").orderBy(F.desc("m"), "word").limit(max_words)
        weights = {r.word: min(float(r.w), 6.0) for r in top.select("word", "w").collect()}
        positive = _scored(suspects, weights, threshold)
    return weights


def _scored(suspects: DataFrame, weights: dict[str, float], threshold: float) -> DataFrame:
    """Suspects whose words weigh more than the threshold on average."""

    def keep(c: dict[str, list]) -> dict[str, object]:
        return {"words": [w for w in c["words"] if sum(weights.get(x, UNKNOWN) for x in w) > threshold * len(w)]}

    return map_pieces(suspects.select("words"), "words array<string>", keep, ())


class Weights:
    """Word weights as sorted hashes; a word that no refusal has weighs UNKNOWN."""

    def __init__(self, folded: dict[str, float]):
        words = sorted(folded)
        key = hashes_of(words, "fold")
        order = np.argsort(key)
        self.key, self.weight = key[order], np.array([folded[w] for w in words])[order]

    def of(self, x: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.key, x), max(len(self.key) - 1, 0))
        return np.where(self.key[at] == x, self.weight[at], UNKNOWN) if len(self.key) else np.full(len(x), UNKNOWN)


def refusal_scores(texts: list[str], weights: Weights, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each text, whatever its length: mean weight of its words outside quotes and tags, their number, and the share
    of them in sentences whose own mean is above the threshold."""
    n = len(texts)
    s = Sentences(texts)
    inside = look_up("letter", s.codes) | look_up("digit", s.codes)
    for pattern, mark in ((_TAG, "<"), (_QUOTED, "“„«")):
        if any(m in s.text for m in mark):
            for m in pattern.finditer(s.text):
                inside[m.start() : m.end()] = False
    w0, w1 = spans(inside)
    if not len(w0) or not len(s):
        return np.full(n, UNKNOWN), np.zeros(n, np.int64), np.zeros(n)
    w = weights.of(SpanHash(look_up("fold", s.codes)).of(w0, w1))
    at = np.searchsorted(s.start, w0, side="right") - 1
    size = np.bincount(at, minlength=len(s))
    total = np.bincount(at, weights=w, minlength=len(s))
    doc_size = np.bincount(s.doc, weights=size, minlength=n)
    mean = np.bincount(s.doc, weights=total, minlength=n) / np.maximum(doc_size, 1)
    high = np.bincount(s.doc, weights=np.where(total > threshold * np.maximum(size, 1), size, 0), minlength=n)
    return np.where(doc_size > 0, mean, UNKNOWN), doc_size.astype(np.int64), high / np.maximum(doc_size, 1)


def is_refusal(source: str, target: str, mean: float, n: int, high: float, threshold: float) -> bool:
    """Refusing words on the whole; or in sentences that hold most of a text unrelated to its source. One or two words must
    be unrelated too and stand for a longer source."""
    if n >= 3 and mean > threshold:
        return True
    if mean > threshold:
        return len(source.split()) >= 5 and unrelated(source, target)
    return high > 0.5 and n >= 8 and unrelated(source, target)


def maybe_copy(source: str, target: str) -> bool:
    """False only where the target can't be a copy: too few of the source's words occur in it."""
    source = source if source.isascii() else _INVISIBLE_RE.sub("", source)
    target = target if target.isascii() else _INVISIBLE_RE.sub("", target)
    a, b = set(source.lower().split()), target.lower()
    b = set((_TAG.sub(" ", b) if "<" in b else b).split())
    return 3 * len(a & b) >= len(a)


_WRAP = re.compile(r"^\W*(?:translation|text|traduction|übersetzung|traducción|traduzione|traducere|перевод)\s*:", re.I)


def is_copy(source: str, target: str) -> bool:
    """The target gives back the source as a whole, with small edits and wrapping at most."""
    s = [fold(w) for w in _WORD.findall(_TAG.sub(" ", _INVISIBLE_RE.sub("", source)))]
    t = [fold(w) for w in _WORD.findall(_WRAP.sub(" ", _TAG.sub(" ", _INVISIBLE_RE.sub("", target))))]
    if not s or not t or not any(c.isalpha() for c in source):
        return False
    if not 0.75 <= len(t) / len(s) <= 1.34 and not (len(s) < 4 and abs(len(t) - len(s)) <= 1):
        return False
    cs, ct = Counter(s), Counter(t)
    same = sum((cs & ct).values())
    for p in sentence_pieces(source):  # no sentence of any length may be translated
        w = [fold(x) for x in _WORD.findall(_INVISIBLE_RE.sub("", p))]
        if len(w) >= 3 and sum((Counter(w) & ct).values()) < 0.5 * len(w):
            return False
    if same >= 0.8 * max(len(s), len(t)):
        return True
    a, b = "".join(s), "".join(t)
    return len(s) <= 6 and same >= 0.5 * len(s) and abs(len(a) - len(b)) <= 2 and sum((Counter(a) & Counter(b)).values()) >= 0.92 * max(len(a), len(b))


def is_name(source: str) -> bool:
    """Only a name: up to five words, each with a capital, no sentence mark."""
    source = _INVISIBLE_RE.sub("", source)
    w = [x for x in _WORD.findall(source) if any(c.isalpha() for c in x)]
    return 0 < len(w) <= 5 and all(x[0].isupper() for x in w) and not source.lstrip().startswith("#") and not re.search(r"[.!?:“„«]", source)


def defects(translations: DataFrame, books: DataFrame, learned: Learned, threshold: float = 0.9, omit: float = 0.2) -> DataFrame:
    """id, defect, evidence of each eligible row whose target is defective; truncated only where nothing else holds. One
    scan labels all defects but truncation and picks out the open values, which are then judged; rows that open with a
    template come by their ids. evidence: 'template' or 'words' of refusals, else null."""
    sc = translations.sparkSession.sparkContext
    table, weight = sc.broadcast(learned.language.table), sc.broadcast(learned.weights)  # both of bounded size
    ratios = length_ratios(learned.stats)
    cache: dict = {}

    def scan(c: dict[str, list]) -> dict[str, object]:
        if "w" not in cache:
            cache["w"] = Weights(weight.value)
        mean, size, high = refusal_scores(c["target"], cache["w"], threshold)
        m = LanguageModel(table.value)
        n = len(c["id"])
        what: list[str | None] = [None] * n
        texts = [""] * n
        for i, (s, t) in enumerate(zip(c["source"], c["target"])):
            if t is None or is_empty(t, s):
                what[i] = "empty"
                continue
            if (mean[i] > threshold or high[i] > 0.5) and is_refusal(s, t, mean[i], size[i], high[i], threshold):
                what[i] = "refusal"
            elif maybe_copy(s, t) and is_copy(s, t):
                if not is_name(s):
                    what[i] = "copy"
            elif any(ch.isalpha() for ch in t):
                texts[i] = t
        wanted = np.array([language_of_label(x) for x in c["wanted"]])
        look = [i for i in range(n) if texts[i] and wanted[i] >= 0]
        quick = m.whole([texts[i].replace("\x01", " ") for i in look])
        for k, i in enumerate(look):  # clearly in the wanted language
            q = quick[k]
            if q[wanted[i]] - np.partition(q, -2)[-2] > 12.0 and q.argmax() == wanted[i]:
                texts[i] = ""
        s = Sentences(texts)
        if len(s):
            scores = m.score(s)
            lang, conf, _ = mixture(scores, s.doc, n, label_prior(c["wanted"], [None] * n))
            hit = np.bincount(s.doc, weights=(lang == wanted[s.doc]), minlength=n) > 0
            sums = np.zeros((n, scores.shape[1]))
            np.add.at(sums, s.doc, scores)
            for i in np.flatnonzero((s.n > 0) & ~hit & (wanted >= 0)):
                sure = 4.0 if len(_WORD.findall(HEADING.sub(" ", texts[i]))) > 3 else 6.0
                if not is_name(c["source"][i]) and sums[i].max() - sums[i, wanted[i]] > sure:
                    what[i] = "wrong_language"
        keep = [i for i in range(n) if what[i]]
        rest = [i for i in range(n) if not what[i]]
        opened = open_rows({k: [c[k][i] for i in rest] for k in ("id", "source", "target", "model", "source_lang", "target_lang")}, ratios, omit)
        m = len(opened["id"])
        out = {"id": [c["id"][i] for i in keep] + opened.pop("id"), "defect": [what[i] for i in keep] + [None] * m}
        return {**out, **{k: [None] * len(keep) + v for k, v in opened.items()}}

    rows = eligible(translations).select("id", "book", "source", "target", "model", "source_lang", "target_lang")
    wanted = books.select("book", F.col("target_lang").alias("wanted")).dropDuplicates(["book"])
    rows = rows.join(small_side(wanted), "book", "left").drop("book")
    both = stage(map_pieces(rows, f"id long, defect string, {OPENED}", scan, ("source", "target")), "defects")
    cut = decide(both.filter("defect is null").drop("defect"), learned.stats).filter("cut").select("id", F.lit("truncated").alias("defect"))
    found = both.filter("defect is not null").select("id", "defect").unionByName(cut)
    # a row may be repeated: its template is looked up once
    marked = found.join(small_side(learned.templates.distinct()).withColumn("template", F.lit(True)), "id", "full_outer")
    return marked.select("id", F.when(F.col("template"), "refusal").otherwise(F.col("defect")).alias("defect"), F.when(F.col("template"), "template").when(F.col("defect") == "refusal", "words").alias("evidence"))


def _defects(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = spark.read.parquet(f"{sf_dir}/translations.parquet")
    learned = learn(t, fit_language_model(spark.read.parquet(f"{sf_dir}/lang_samples.parquet")))
    return defects(t, spark.read.parquet(f"{sf_dir}/books.parquet"), learned)


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _defects(spark, sf_dir).select("id", "defect")


def p6_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each defect and what told it."""
    return _defects(spark, sf_dir).groupBy("defect", F.coalesce("evidence", F.lit("row")).alias("evidence")).agg(F.count("*").alias("rows"))


QUERIES = {"p6_found": p6_found, "p6_report": p6_report}
