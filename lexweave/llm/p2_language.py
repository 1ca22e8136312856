"""Problem 2: missing or wrong language labels.

Method: multilingual mixture inference (langid.py). Every stretch gets one of the languages of the model; a background
class, which stands for all others, takes confidence from text that fits none of them. Nulls: a null or empty target gives no row; a null label names no
language; a null source_lang only leaves out its prior. Texts of under `min_words` words give no row. Extra columns are
not read. Repeated rows each give their own result.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .batches import fold_partitions, map_pieces
from .langid import BITS, K, LanguageModel, gram_counts, mixture
from .textkit import LANGS, Sentences, is_empty, language_of_label

_WORD = re.compile(r"[^\W_]+")
#: Log likelihood of a character in the background class, above the mean of the languages. Text of the model's languages
#: reaches more (1.05 and above in 999 of 1,000 targets), of languages of other families less (0.1 to 0.7); near relations of its languages lie between.
BACKGROUND = 0.8
SEGMENTS = "id long, seg_pos int, lang string, confidence double, n_sentences int, n_words int, label string, wrong boolean, mixed boolean"


def fit_language_model(samples: DataFrame, max_samples: int = 20_000) -> LanguageModel:
    """Fit on at most max_samples labelled sample texts, in order of sample_id."""
    rows = samples.select("text", "lang").filter("text is not null and lang is not null").orderBy("sample_id").limit(max_samples).collect()
    return LanguageModel.fit([(r.text, language_of_label(r.lang)) for r in rows if language_of_label(r.lang) >= 0])


def add_label_words(st: list[Counter], c: dict[str, list], model: LanguageModel, doubt: float = 15.0) -> None:
    """Counts the words of every target whose stated language is not refuted by `doubt` nats; st: one counter for each
    language, and maybe one more for the words of all other targets."""
    texts = [(t or "").replace("\x01", " ") for t in c["target"]]
    label = np.array([language_of_label(x) for x in c["target_lang"]])
    q = model.whole(texts)
    good = (label >= 0) & (q.max(1) - q[np.arange(len(q)), label] < doubt)
    for k in range(K):
        if (mine := np.flatnonzero(good & (label == k))).size:
            st[k].update(_WORD.findall(" ".join(texts[i] for i in mine).lower()))
    if len(st) > K:
        st[K].update(_WORD.findall(" ".join(texts[i] for i in np.flatnonzero(~good)).lower()))


def label_word_rows(st: list[Counter]) -> dict[str, list]:
    return {"lang": [k for k, x in enumerate(st) for _ in x], "word": [w for x in st for w in x], "n": [float(n) for x in st for n in x.values()]}


def adapt_language_model(translations: DataFrame, model: LanguageModel) -> LanguageModel:
    """One round of expectation-maximisation over the corpus: the n-grams of words counted by add_label_words join those
    of the samples."""
    table = translations.sparkSession.sparkContext.broadcast(model.table)
    rows = translations.select("target", "target_lang").filter("target is not null and target <> ''")
    step = lambda st, c: add_label_words(st, c, LanguageModel(table.value))
    return adapted_to_words(model, fold_partitions(rows, "lang int, word string, n double", lambda: [Counter() for _ in range(K)], step, label_word_rows, ("target",)))


def adapted_to_words(model: LanguageModel, counted: DataFrame) -> LanguageModel:
    words = counted.groupBy("lang", "word").agg(F.sum("n").alias("n"))

    def grams(st: dict, c: dict[str, list]) -> None:
        lang = np.array(c["lang"])
        for k in np.unique(lang):
            mine = np.flatnonzero(lang == k)
            w = np.repeat([c["n"][i] for i in mine], [len(c["word"][i]) + 1 for i in mine])
            st["x"][:, k] += gram_counts(" " + "".join(c["word"][i] + " " for i in mine), np.concatenate([[0.0], w]))

    def blocks(st: dict) -> dict[str, object]:
        x = st["x"].astype(np.float32).reshape(64, -1)
        return {"block": list(range(64)), "x": [r.tobytes() for r in x]}

    parts = fold_partitions(words, "block int, x binary", lambda: {"x": np.zeros((1 << BITS, K))}, grams, blocks, ("word",))

    def add(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"block": [key[0]], "x": [sum(np.frombuffer(b, np.float32) for b in pdf["x"]).tobytes()]})

    counts = np.zeros((64, (1 << BITS) * K // 64))
    for r in parts.groupBy("block").applyInPandas(add, "block int, x binary").collect():  # 64 blocks, the size of the model
        counts[r.block] = np.frombuffer(r.x, np.float32)
    return model.adapted(counts.reshape(1 << BITS, K))


def label_prior(target_lang: list, source_lang: list, stated: float = 2.5, source: float = 1.0) -> np.ndarray:
    """What labels say beforehand, in nats: the stated language is likelier, and so is the source's."""
    prior = np.zeros((len(target_lang), K))
    for i, (t, s) in enumerate(zip(target_lang, source_lang)):
        if (k := language_of_label(t)) >= 0:
            prior[i, k] += stated
        if (k := language_of_label(s)) >= 0:
            prior[i, k] += source
    return prior


def language_segments(translations: DataFrame, model: LanguageModel, min_words: int = 5, penalty: float = 6.0, background: float = BACKGROUND) -> DataFrame:
    """Every longest stretch of sentences in one language of each target, with confidence; `wrong`: the label names no
    language or another than the text's; `mixed`: the text has several languages."""
    table = translations.sparkSession.sparkContext.broadcast(model.table)

    def run(c: dict[str, list]) -> dict[str, object]:
        texts = [t or "" for t in c["target"]]
        s = Sentences(texts)
        m = LanguageModel(table.value)
        n = len(texts)
        words = m.words(s)
        lang, conf, _ = mixture(m.score(s), s.doc, n, label_prior(c["target_lang"], c["source_lang"]), penalty, background=background * (s.end - s.start))
        if not len(s):
            return {k: [] for k in ("id", "seg_pos", "lang", "confidence", "n_sentences", "n_words", "label", "wrong", "mixed")}
        doc_words = np.bincount(s.doc, weights=words, minlength=n)
        new = np.concatenate([[True], (s.doc[1:] != s.doc[:-1]) | (lang[1:] != lang[:-1])])
        at = np.flatnonzero(new)
        seg_doc, seg_lang = s.doc[at], lang[at]
        seg_words = np.add.reduceat(words, at)
        seg_conf = np.add.reduceat(conf * np.maximum(words, 1), at) / np.add.reduceat(np.maximum(words, 1), at)
        seg_n = np.diff(np.concatenate([at, [len(s)]]))
        n_segs = np.bincount(seg_doc, minlength=n)
        label = np.array([language_of_label(x) for x in c["target_lang"]])
        keep_doc = doc_words >= min_words
        for i in np.flatnonzero(keep_doc):
            t = c["target"][i]
            through = c["chapter"][i] == 0 and c["paragraph"][i] is not None and 0 <= c["paragraph"][i] <= 4 and c["source"][i] is not None and " ".join(t.split()) == " ".join(c["source"][i].split())
            if through or (doc_words[i] < 12 and is_empty(t, c["source"][i])):
                keep_doc[i] = False
        keep = keep_doc[seg_doc]
        seg_doc = seg_doc[keep]
        mixed = n_segs[seg_doc] > 1
        pos = at[keep] - s.first[seg_doc]
        return {
            "id": [c["id"][i] for i in seg_doc],
            "seg_pos": pos.astype(np.int32),
            "lang": [LANGS[k] for k in seg_lang[keep]],
            "confidence": seg_conf[keep],
            "n_sentences": seg_n[keep].astype(np.int32),
            "n_words": seg_words[keep].astype(np.int32),
            "label": [c["target_lang"][i] for i in seg_doc],
            "wrong": mixed | (label[seg_doc] != seg_lang[keep]),
            "mixed": mixed,
        }

    cols = translations.select("id", "chapter", "paragraph", "source_lang", "source", "target_lang", "target").filter("id is not null and target is not null and target <> ''")
    return map_pieces(cols, SEGMENTS, run, ("target",))


def p2_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    translations = spark.read.parquet(f"{sf_dir}/translations.parquet")
    model = adapt_language_model(translations, fit_language_model(spark.read.parquet(f"{sf_dir}/lang_samples.parquet")))
    return language_segments(translations, model)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p2_segments(spark, sf_dir).filter("wrong").select("id", "seg_pos", "lang")


def p2_label_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each label as written: its stretches, how many are wrong, and the mean confidence."""
    return p2_segments(spark, sf_dir).groupBy("label").agg(F.count("*").alias("stretches"), F.sum(F.col("wrong").cast("long")).alias("wrong"), F.round(F.avg("confidence"), 4).alias("confidence"))


QUERIES = {"p2_found": p2_found, "p2_segments": p2_segments, "p2_label_report": p2_label_report}
