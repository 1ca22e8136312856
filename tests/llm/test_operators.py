"""Training-data operators against fixtures, brute force and hostile input."""

import datetime
import random
import re
import unicodedata
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexweave.llm import (p1_alignment, p2_language, p3_truncation, p4_survivor, p5_lookalike, p6_defects, p7_packing, p8_mixing, p9_spam, tokens,
                          vectors)
from lexweave.llm.langid import LanguageModel, mixture
from lexweave.llm.textkit import LANGS, Sentences, is_empty, language_of_label, split_sentences

MEMORY = T.StructType([
    T.StructField("id", T.LongType()), T.StructField("book", T.LongType()), T.StructField("edition", T.IntegerType()), T.StructField("chapter", T.IntegerType()),
    T.StructField("paragraph", T.IntegerType()), T.StructField("source_lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("target_lang", T.StringType()),
    T.StructField("target", T.StringType()), T.StructField("duration", T.IntegerType()), T.StructField("fluency", T.IntegerType()), T.StructField("model", T.StringType()),
    T.StructField("created", T.TimestampNTZType()),
])
DOCS = "doc_id long, text string, source string"
NOW = datetime.datetime(2024, 5, 1)


def row(i, source="The cat sat.", target="Le chat dort.", sl="English", tl="French", model="m", chapter=1, paragraph=1, book=1, fluency=80, created=NOW):
    return (i, book, 1, chapter, paragraph, sl, source, tl, target, 10, fluency, model, created)


def memory(spark, rows):
    return spark.createDataFrame(rows, MEMORY)


#: Rows that must not break any operator: nulls everywhere, empty and blank texts, a very long text, repeated rows.
HOSTILE = [(None,) * 13, (1,) + (None,) * 12, row(2, None, None, None, None, None), row(3, "", ""), row(4, " \n", "​"), row(5, "word " * 30_000, "mot " * 30_000),
           row(6), row(6), row(7, "\x01\x00", "\x01"), row(8, "A. B. C. D. E.", "A. B.", model=None, created=None), row(9, "\U0001f600. \U0001f600!", "<a></a>")]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Tables of hostile rows with extra columns whose names clash with inner ones, and empty ones."""
    out = {}
    books = spark.createDataFrame([(1, "English", "French")], "book long, source_lang string, target_lang string")
    models = spark.createDataFrame([("m", "p", 3, NOW)], "model string, provider string, trust int, released timestamp_ntz")
    samples = spark.createDataFrame([(1, "English", "The cat sat on the mat."), (2, "French", "Le chat dort sur le tapis."), (3, None, None)], "sample_id long, lang string, text string")
    docs = spark.createDataFrame([(1, "a b c", "s"), (2, None, "s"), (3, "", None), (None, "x", "s"), (4, "word " * 30_000, "s"), (5, "a b c", "t"), (5, "a b c", "t")], DOCS)
    boxes = spark.createDataFrame([(1, "k", 64)], "container_id int, kind string, capacity int")
    shares = spark.createDataFrame([("s", 0.5, 2), ("t", 0.5, 2), ("none", 0.1, 1), ("bad", None, 1)], "source string, target_share double, max_repeats int")
    extra = {"word": F.lit("x"), "defect": F.lit("x"), "value": F.lit("x"), "kind": F.lit("x"), "n": F.lit(1), "wanted": F.lit("x"), "tokens": F.lit(1), "p": F.lit(0.0), "_key": F.lit("x"), "group_id": F.lit(0)}
    for name, keep in (("hostile", True), ("empty", False)):
        d = tmp_path_factory.mktemp(name)
        all_tables = {"translations": memory(spark, HOSTILE).withColumns(extra), "books": books, "models": models, "lang_samples": samples, "documents": docs.withColumns(extra), "containers": boxes, "mix_targets": shares}
        for t, df in all_tables.items():
            (df if keep else df.limit(0)).write.parquet(f"{d}/{t}.parquet")
        out[name] = str(d)
    return out


def every_query():
    from lexweave.llm import queries

    return sorted(queries.queries())


@pytest.mark.parametrize("name", every_query())
def test_hostile_rows(spark, tables, name):
    from lexweave.llm import queries

    queries.queries()[name](spark, tables["hostile"]).collect()


@pytest.mark.parametrize("name", every_query())
def test_empty_tables(spark, tables, name):
    from lexweave.llm import queries

    got = queries.queries()[name](spark, tables["empty"])
    assert got.count() == 0


# --- shared rules
@pytest.mark.parametrize(("text", "expected"), [
    ("A. B! C? D", ["A.", "B!", "C?", "D"]), ("> « Oui ? » Non.", ["> « Oui ? »", "Non."]), ("“Go.” He went... off.", ["“Go.”", "He went...", "off."]),
    ("**Bold.** v1.5 is out.", ["**Bold.**", "v1.5 is out."]), ("", []), (" \n ", []), ("a.b", ["a.b"]),
])
def test_sentences(text, expected):
    assert split_sentences(text) == expected


def test_sentences_of_many():
    texts = ["A. B.", "", None, " ", "C! D?", "\x01 E."]
    s = Sentences(texts)
    assert s.n.tolist() == [2, 0, 0, 0, 2, 1] and [s.get(i) for i in range(len(s))] == ["A.", "B.", "C!", "D?", "E."]


@pytest.mark.parametrize(("target", "source", "empty"), [(None, "x", True), ("", "x", True), (" ​", "x", True), ("[no output]", "x", True), ("<fr></fr>", "x", True), ("**  **", "x", True),
    ("***", "* * *", False), ("1871", "1871", False), ("-", "text", True), ("N/A", "x", True), ("Non", "No", False), ("→", "→", False)])
def test_empty_values(spark, target, source, empty):
    assert is_empty(target, source) is empty
    df = spark.createDataFrame([(target, source)], "t string, s string")
    assert df.select(p4_survivor.is_empty_column(F.col("t"), F.col("s")).alias("x")).first().x is empty


def test_labels():
    assert [language_of_label(x) for x in ("EN", "en-GB", "Français", "ron", "Русский", "", None, "und", "?")] == [0, 0, 1, 5, 6, -1, -1, -1, -1]


# --- 1
def test_alignment_kernel():
    rng = np.random.default_rng(1)
    base = rng.standard_normal((6, 40)).astype(np.float32)
    noise = lambda: 0.05 * rng.standard_normal(40).astype(np.float32)
    # 0 left out, 1 and 2 joined, 3 divided in two, 4 and 5 swapped, one added
    parts = base[3] + 0.8 * rng.standard_normal(40).astype(np.float32)
    tgt = np.stack([base[1] + base[2] + noise(), parts, base[3] - (parts - base[3]) + noise(), rng.standard_normal(40).astype(np.float32), base[5] + noise(), base[4] + noise()])
    got = set(vectors.align(base, tgt.astype(np.float32)))
    assert got >= {(1, 0), (2, 0), (3, 1), (3, 2), (4, 5), (5, 4)} and not any(s == 0 or t == 3 for s, t in got - {(0, 3)})
    assert vectors.align(base[:0], tgt) == [] and vectors.align(base, tgt[:0]) == []


def test_alignment_in_pieces(monkeypatch):
    """Long texts are compared piece by piece with the same result."""
    rng = np.random.default_rng(7)
    src = rng.standard_normal((90, 24)).astype(np.float32)
    tgt = np.concatenate([src[rng.permutation(90)[:70]] + 0.4 * rng.standard_normal((70, 24)), src[10:40] + src[11:41]]).astype(np.float32)
    sizes = rng.integers(3, 12, 90), rng.integers(3, 20, 100)
    whole = vectors.align(src, tgt, sizes=sizes)
    monkeypatch.setattr(vectors, "CELLS", 7 * 600)
    assert len(whole) > 60 and vectors.align(src, tgt, sizes=sizes) == whole


def test_cosines_of_windows():
    """Cosines of windows come from the products of their sentences; vectors of sentences of any length are weighted sums."""
    rng = np.random.default_rng(9)
    for n in (1, 2, 9, 70):
        src, tgt = rng.standard_normal((n, 16)).astype(np.float32), rng.standard_normal((5, 16)).astype(np.float32)
        sums = np.stack([src[i:j].sum(0) for i, j in vectors._windows(n, 3)])
        want = sums @ tgt.T / np.linalg.norm(sums, axis=1)[:, None] / np.linalg.norm(tgt, axis=1)
        got = vectors._cosines(src @ tgt.T, vectors._lengths(src, 3), vectors._lengths(tgt, 3)[:5], 3)
        assert np.allclose(got, want, atol=1e-5)
    model = vectors.PairModel(rng.standard_normal((vectors.D, 8)).astype(np.float32), rng.random(vectors.D).astype(np.float32), rng.random(vectors.D).astype(np.float32))
    sizes, identity = np.array([3, 0, 700, 9_000, 1, 40]), vectors.identity_vectors()
    codes = rng.integers(0, vectors.D**2, sizes.sum())
    a, b = codes & (vectors.D - 1), codes >> vectors.BITS
    full = np.concatenate([model.vectors[a] * (model.idf[a] * (1 - model.stays[b]))[:, None], identity[b] * (model.idf[a] * model.stays[b])[:, None]], 1)
    want = np.stack([full[e - k : e].sum(0) for e, k in zip(np.cumsum(sizes), sizes)])
    assert np.allclose(model.sentence_vectors(codes, sizes, identity), want, atol=1e-2)


def test_texts_compared_together(monkeypatch):
    """Short texts of any lengths are compared many at once, with the pairs that each has by itself; longer ones alone."""
    rng = np.random.default_rng(13)
    n, m = rng.integers(0, 14, 300), rng.integers(0, 14, 300)
    n[:3], m[:3] = (90, 1, 60), (80, 5, 60)
    src, tgt, first = rng.standard_normal((n.sum(), 24)).astype(np.float32), [], np.cumsum(n) - n
    for f, a, b in zip(first, n, m):
        x = rng.standard_normal((b, 24))
        for k in range(min(a, b)):
            x[k] = src[f + rng.integers(a)] + src[f + rng.integers(a)] * (k % 3 == 0) + 0.3 * x[k]
        tgt.append(x)
    tgt, t_first = np.concatenate(tgt).astype(np.float32), np.cumsum(m) - m
    sizes, one, calls = (rng.integers(3, 12, len(src)), rng.integers(3, 20, len(tgt))), vectors.align, []
    monkeypatch.setattr(vectors, "align", lambda *a, **k: calls.append(len(a[0])) or one(*a, **k))
    for own in (sizes, None):
        want = []
        for i in range(300):
            s, t = slice(first[i], first[i] + n[i]), slice(t_first[i], t_first[i] + m[i])
            want += [(i, *p) for p in one(src[s], tgt[t], sizes=own and (own[0][s], own[1][t]))]
        got = list(zip(*(v.tolist() for v in vectors.align_all(src, tgt, n, m, sizes=own))))
        assert len(want) > 800 and got == want
    assert calls == [90, 90]
    none = np.zeros(2, np.int64)
    assert [len(v) for v in vectors.align_all(src[:0], tgt[:0], none, none)] == [0, 0, 0]


def test_words_of_many_texts(monkeypatch):
    texts = ["Où vas-tu, l\u00adà?", "", "a\nb_c\x01d\u2028e", "Тис\u0301 42\u200b3 \U0001d400x \U0001f600 \U000e0041z", "\u3164", "ﬁn 東京"]
    want = [["Où", "vas", "tu", "là"], [], ["a", "b", "c", "d", "e"], ["Тис", "423", "\U0001d400x", "z"], [], ["ﬁn", "東京"]]
    assert vectors.words(texts) == want and vectors.words([]) == [] and vectors.words([""]) == [[]]
    monkeypatch.setattr(vectors, "TOGETHER", 10)
    assert vectors.words(texts) == want


def test_sums_in_levels(spark):
    """Two thousand partial sums, at most eight in a task."""
    rng = np.random.default_rng(8)
    rank, n = 2, 2_000
    rows, want = [], np.zeros((vectors.D // p1_alignment.BLOCKS, rank), np.float32)
    for i in range(n):
        used = np.unique(rng.integers(0, 50, 3)).astype(np.int32)
        x = rng.integers(0, 9, (len(used), rank)).astype(np.float32)
        want[used] += x
        rows.append((1, used.tobytes(), x.tobytes(), i))
    parts = spark.createDataFrame(rows, "block int, rows binary, sums binary, part int")
    got = p1_alignment.added(parts, n, rank, fan=8).collect()
    total = np.zeros_like(want)
    assert len(got) == 1
    total[np.frombuffer(got[0].rows, np.int32)] = np.frombuffer(got[0].sums, np.float32).reshape(-1, rank)
    assert np.array_equal(total, want)


def test_gram_product_is_exact():
    rng = np.random.default_rng(2)
    n, t = 300, 3000
    doc, term, side = np.sort(rng.integers(0, n, t)), rng.integers(0, 500, t), rng.integers(0, 2, t)
    key = np.unique(np.stack([doc, side, term], 1), axis=0)
    doc, side, term = key.T
    weight = np.zeros(vectors.D, np.float32)
    weight[:500] = rng.random(500)
    omega = rng.standard_normal((vectors.D, 8)).astype(np.float32)
    out = np.zeros_like(omega)
    vectors.gram_product(term, doc, side, np.ones(n), weight, omega, out)
    x = np.zeros((n, 500))
    for s in (0, 1):
        m = np.zeros((n, 500))
        m[doc[side == s], term[side == s]] = weight[term[side == s]]
        x += m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)
    assert np.allclose(out[:500], x.T @ (x @ omega[:500]), atol=1e-3) and not out[500:].any()


def test_encoded_pairs_are_small(spark, monkeypatch):
    """A row of coded terms belongs to one pair, whatever a piece holds, and its product is that of all pairs together."""
    words = ["".join(chr(97 + k // 26**j % 26) for j in range(4)) for k in range(3_000)]
    rng = random.Random(12)
    texts = [(" ".join(rng.sample(words, n)), " ".join(rng.sample(words, n))) for n in [5] * 300 + [2_000]]
    coded = p1_alignment.encode_pairs(memory(spark, [row(i, *t) for i, t in enumerate(texts)])).filter("kind = 'p'").persist()
    sizes = sorted(len(r.terms) for r in coded.collect())
    assert len(sizes) == 301 and max(sizes[:-1]) <= 2 * 10 and 0 < sizes[-1] <= 2 * 4_000
    term, doc, side, *_ = vectors.paired_terms(vectors.Terms(), *map(list, zip(*texts)))
    weight, omega, want = np.ones(vectors.D, np.float32), vectors.start_matrix(4), np.zeros((vectors.D, 4), np.float32)
    vectors.gram_product(term, doc, side, np.ones(301), weight, omega, want)
    monkeypatch.setattr(p1_alignment, "TERMS", 500)
    got = p1_alignment.summed_product(coded, weight, np.ones((p1_alignment.K_LANGS + 1) ** 2), omega)
    coded.unpersist()
    assert want.any() and np.allclose(got, want, atol=1e-3)


WORDS = {"cat": "chat", "dog": "chien", "tree": "arbre", "house": "maison", "river": "fleuve", "moon": "lune", "bread": "pain", "king": "roi", "book": "livre", "snow": "neige", "door": "porte", "horse": "cheval"}
VERBS = {"sees": "voit", "finds": "trouve", "sells": "vend", "hides": "cache", "loves": "aime", "burns": "brule"}


def clause(rng):
    a, b = rng.sample(sorted(WORDS), 2)
    v = rng.choice(sorted(VERBS))
    return f"The {a} {v} the {b}", f"Le {WORDS[a]} {VERBS[v]} le {WORDS[b]}"


def test_alignment_end_to_end(spark):
    """Held-out accuracy on paragraphs with known pairs: sentences left out, joined and moved."""
    rng = random.Random(3)
    rows, truth = [], set()
    for i in range(400):
        rows.append(row(i, *(x + "." for x in clause(rng))))
    for i in range(400, 460):
        c = [clause(rng) for _ in range(6)]
        order = [1, 0, 3, 4, 5]  # 2 left out, 0 and 1 swapped, 4 and 5 joined
        tgt = [c[k][1] for k in order]
        joined = [*tgt[:3], f"{tgt[3]} et {tgt[4].lower()}"]
        rows.append(row(i, " ".join(x[0] + "." for x in c), " ".join(x + "." for x in joined)))
        truth |= {(i, 1, 0), (i, 0, 1), (i, 3, 2), (i, 4, 3), (i, 5, 3)}
    rows.append(row(999, "One cat. Two dogs. Three books. Four kings.", "One cat. Two dogs. Three books. Four kings."))  # carried over
    t = memory(spark, rows)
    got = {tuple(r) for r in p1_alignment.alignments(t, p1_alignment.fit_pair_model(t), 4).collect()}
    assert not any(g[0] == 999 for g in got)
    assert len(got & truth) / len(truth) > 0.85 and len(got & truth) / len(got) > 0.85


# --- 2
SAMPLES = {0: ["The old man opened the door and saw the river.", "Nobody knew why she was waiting there with the bread."], 1: ["Le vieil homme ouvrit la porte et vit la rivière.", "Personne ne savait pourquoi elle attendait avec le pain."],
           2: ["Der alte Mann öffnete die Tür und sah den Fluss.", "Niemand wusste, warum sie dort mit dem Brot wartete."]}


def test_mixture():
    m = LanguageModel.fit([(t, k) for k, ts in SAMPLES.items() for t in ts])
    s = Sentences(["The old man was waiting there. Personne ne savait pourquoi. Elle attendait avec le vieil homme.", "Der Mann wartete dort.", ""])
    lang, conf, shares = mixture(m.score(s), s.doc, 3)
    assert lang.tolist() == [0, 1, 1, 2] and (conf > 0.9).all() and (shares[0] > 0).sum() == 2 and shares[2].sum() == 0


def test_background_language(spark):
    """Text of a language that the model lacks has little confidence, text of its own nearly all."""
    m = LanguageModel.fit([(t * 3, k) for k, ts in SAMPLES.items() for t in ts])
    rows = [row(1, target="Nobody knew why the old man was waiting with the bread.", tl="?"), row(2, target="Tutkijat julkaisivat eilen uuden tutkimuksen merten lämpenemisestä.", tl="?")]
    conf = {r.id: r.confidence for r in p2_language.language_segments(memory(spark, rows), m).collect()}
    assert conf[1] > 0.95 and conf[2] < 0.1


def test_segments(spark):
    m = LanguageModel.fit([(t, k) for k, ts in SAMPLES.items() for t in ts])
    rows = [row(1, target="Le vieil homme ouvrit la porte. The old man saw the river. Nobody knew why she was there."), row(2, target="Personne ne savait pourquoi elle attendait.", tl="FR"),
            row(3, target="Personne ne savait pourquoi elle attendait.", tl="und"), row(4, target="Niemand wusste, warum sie dort wartete.", tl="fr"), row(5, target="Le vieil", tl=None),
            row(6, "The old man of the river", "The old man of the river", chapter=0, paragraph=1, tl="French")]
    got = {(r.id, r.seg_pos, r.lang) for r in p2_language.language_segments(memory(spark, rows), m).filter("wrong").collect()}
    assert got == {(1, 0, "French"), (1, 1, "English"), (3, 0, "French"), (4, 0, "German")}


def test_adaptation(spark):
    m = LanguageModel.fit([(t, k) for k, ts in SAMPLES.items() for t in ts])
    rows = [row(i, target="Le zéphyr soufflait sur la rivière et la porte.") for i in range(20)]
    a = p2_language.adapt_language_model(memory(spark, rows), m)
    gain = lambda model: (lambda x: x[1] - np.delete(x, 1).max())(model.whole(["zéphyr"])[0])
    assert gain(a) > gain(m)


# --- 3
def test_censored_fit():
    rng = np.random.default_rng(4)
    x = np.exp(rng.normal(5.0, 0.6, 40_000))
    c = 200
    size, n = np.unique(x[x < c].astype(int), return_counts=True)
    mu, sd = p3_truncation.fit_censored(size, n.astype(float), c, float((x >= c).sum()))
    assert abs(mu - 5.0) < 0.05 and abs(sd - 0.6) < 0.05


def test_truncation(spark):
    rng = random.Random(5)
    rows = []
    for i in range(600):
        cs = [clause(rng) for _ in range(rng.randint(1, 6))]
        s, t = " ".join(c[0] + "." for c in cs), " ".join(c[1] + "." for c in cs)
        model = "cutter" if i % 2 else "whole"
        rows.append(row(i, s, t[:60] if model == "cutter" else t, model=f"prov@{model.upper()} "))
    rows += [row(1000, "The cat sees the dog.", "Le chat voit le chi", model="whole"), row(1001, "The cat sees the dog.", "Le chat voit le chien", model="whole"),
             row(1002, "The cat sees the dog", "Le chat voit le chien", model="whole"), row(1003, "The cat sees the dog.", "Le chat voit le...</p>", model="whole")]
    t = memory(spark, rows)
    stats = p3_truncation.corpus_statistics(t)
    lim = {(r.model_key, r.unit, r.limit) for r in p3_truncation.limits(stats).collect()}
    assert ("cutter", "chars", 60) in lim and not any(m == "whole" for m, _, _ in lim)
    found = {r.id for r in p3_truncation.judge(t).filter("cut").collect()}
    want = {r[0] for r in rows if r[0] < 1000 and r[0] % 2 and len(r[8]) == 60 and not r[8].rstrip().endswith(".")}
    assert len(found & want) >= 0.97 * len(want) and found - want <= {1000, 1003} and {1000, 1003} <= found


def test_beginnings_of_long_words(spark):
    """Against a plain count, with listed beginnings of up to five letters."""
    words = {"ab": 4.0, "abcdefgh": 16.0, "abcdexyz": 8.0, "abcdefghijk": 11.0, "z": 3.0}
    wanted = ["a", "abcde", "abcdefg", "abcdefgh", "abcdex", "abcdefghijk", "q", "z"]
    got = {r.word: r.w_part for r in p3_truncation.beginnings(spark.createDataFrame(list(words.items()), "key string, a double"), spark.createDataFrame([(w,) for w in wanted], "word string"), 5).filter(F.col("word").isin(wanted)).collect()}
    want = {w: sum(n / len(k) for k, n in words.items() if k.startswith(w) and len(k) > len(w)) for w in wanted}
    assert got == {w: pytest.approx(x) for w, x in want.items() if x}


def test_long_single_sentences_teach_ratios():
    s, t = "word " * 120 + "end.", "mot " * 130 + "fin."
    st = p3_truncation.new_statistics()
    p3_truncation.add_statistics(st, {"target": [t], "source": [s], "model": ["m"], "source_lang": ["English"], "target_lang": ["French"]})
    assert [x[0] for x in st["r"].values()] == [1]


# --- 4
def test_survivors(spark):
    models = spark.createDataFrame([("a", "p", 1, NOW), ("b", "p", 2, NOW)], "model string, provider string, trust int, released timestamp_ntz")
    later = NOW + datetime.timedelta(days=1)
    rows = [row(1, model=" X@B "), row(2, model="a", created=later), row(3, target="", model="b", created=None), row(4, model=None, fluency=-1), row(5, paragraph=2), row(6, sl="@"), row(7, sl="@", target="null", fluency=None, created=None), row(8, sl=None, paragraph=3, target=None, created=None), row(9, sl=None, paragraph=3, target=None, created=None)]
    got = {(r.group_id, r.field, r.id) for r in p4_survivor.survivors(memory(spark, rows), models).collect()}
    assert got == {(1, "target", 1), (1, "fluency", 2), (1, "created", 2), (6, "target", 6), (6, "fluency", 6), (6, "created", 6)}


# --- 5
@pytest.mark.parametrize(("value", "form"), [
    ("thе cat", "the cat"), ("ｃａｔ", "cat"), ("été", "été"), ("a​b", "ab"), ("a b", "a b"), ("ﬁsh", "fish"), ("hoţ", "hoț"),
    ("Глaва", "Глава"), ("“мост” here", "“мост” here"), ("plain — “text”…", "plain — “text”…"), ("a\nb", "a\nb"),
    ("кольц</p", "кольц</p"), ("Lοng", "Long"), ("λόγoς", "λόγος"),
])
def test_consistent_form(value, form):
    known = {"the", "глава", "long", "λόγος"}
    assert p5_lookalike.consistent_form(value, known) == form
    assert p5_lookalike.consistent_form(form, known) == form
    assert p5_lookalike.consistent_form(value, certain=True) == form
    assert unicodedata.is_normalized("NFC", form)


def test_lookalike_not_normal():
    for value in ("300 \u212a", "5 \u212b", "7 \u2126"):
        assert p5_lookalike.plain_form(value) != value and p5_lookalike.suspect(value)


def test_repairs(spark):
    rows = [row(1, "thе cat", "le chat"), row(2, "they асе it", "x"), row(3, "an ace of it", "y"), row(4, "​", "​1"), row(5, "cаt", "z", chapter=0, paragraph=2), row(6, "they соо it", "x"), row(7, "the ace cat", "a rаre nаme"),
            row(8, "the old cat", "once"), row(9, "оnce", "х")]
    t = memory(spark, rows)
    forms = lambda **kw: {(r.id, r.field): r.form for r in p5_lookalike.repairs(t, **kw).collect()}
    method = {(1, "source"): "the cat", (5, "source"): "cat"}
    assert forms() == method  # 9 would be once, which the corpus has only once
    assert forms(certain=True) == {**method, (7, "target"): "a rare name", (9, "source"): "once"}
    assert forms(whole=True) == {**method, (2, "source"): "they ace it"}  # 6 would be coo, which the corpus lacks
    assert forms(least=1) == {**method, (9, "source"): "once"}


def test_consistent_metadata(spark, tmp_path):
    """Metadata are repaired with the rest, though they are no cases."""
    memory(spark, [row(1, "cаt", "cat", chapter=0, paragraph=2), row(2, "a cat", "cat"), row(3, "cаt", None)]).write.parquet(f"{tmp_path}/translations.parquet")
    assert {(r.id, r.field): r.value for r in p5_lookalike.p5_consistent(spark, str(tmp_path)).collect()} == {(1, "source"): "cat", (1, "target"): "cat", (2, "source"): "a cat", (2, "target"): "cat", (3, "source"): "cat", (3, "target"): None}
    assert [r.id for r in p5_lookalike.p5_found(spark, str(tmp_path)).collect()] == [3]


# --- 6
def test_defects(spark):
    rng = random.Random(6)
    m = LanguageModel.fit([(t, k) for k, ts in SAMPLES.items() for t in ts] + [(" ".join(WORDS), 0), (" ".join(WORDS.values()) + " le la voit trouve vend cache", 1)])
    rows = [row(i, f"On day {i} Mark said so. " + clause(rng)[0] + ".", f"Au jour {i} Mark parla. " + clause(rng)[1] + ".") for i in range(300)]
    refusals = ["I am sorry, but I cannot help with translating this passage today.", "I am sorry, but I cannot help with translating this passage, it is protected."]
    rows += [row(1000 + i, f"On day {i} Mark said so. " + clause(rng)[0] + ".", refusals[i % 2]) for i in range(20)]
    s, t = clause(rng)
    rows += [row(2000, s + ".", None), row(2001, s + ".", f"<fr>{s}.</fr>"), row(2002, s + ".", "Der alte Mann öffnete die Tür und sah den Fluss."), row(2003, s + ".", t.rsplit(" ", 1)[0]), row(2004, "Mark Twain", "Mark Twain"),
             row(2005, f"Mark said: “I am sorry, I cannot help.” {s}.", f"Mark dit : « I am sorry, I cannot help with translating. » {t}."), row(2006, s, "", model="copy"), row(2007, s, "", sl="@"), row(3000, "The cat of the old house", "The cat of the old house", chapter=0, paragraph=2)]
    books = spark.createDataFrame([(1, "French")], "book long, target_lang string")
    t = memory(spark, rows)
    got = {r.id: r.defect for r in p6_defects.defects(t, books, p6_defects.learn(t, m)).collect()}
    assert {i: d for i, d in got.items() if i < 1000} == {}
    assert all(got.get(1000 + i) == "refusal" for i in range(20))
    assert got.get(3000) == "copy"  # metadata are judged as any other row
    assert {i: got.get(i) for i in range(2000, 2008)} == {2000: "empty", 2001: "copy", 2002: "wrong_language", 2003: "truncated", 2004: None, 2005: None, 2006: None, 2007: None}


def test_opening_clusters(spark):
    """Clusters of openings of 6 to 12 words against brute force over all pairs: links found, none between unlike ones."""
    rng = random.Random(7)
    words = ["".join(rng.choice("abcdefghiklmnoprstu") for _ in range(rng.randint(2, 9))) for _ in range(300)]
    base = [[rng.choice(words) for _ in range(rng.randint(6, 12))] for _ in range(60)]
    texts = set()
    for b in base:
        for _ in range(6):
            w = list(b)
            w[rng.randrange(len(w))] = rng.choice(["a", "of", "no", *words[:20]])
            texts.add(" ".join(w))
    hot = " ".join(words[:11])  # a third of all openings are one template with another last word
    texts |= {f"{hot} {w}" for w in words[:180]}
    texts = sorted(texts)
    df = spark.createDataFrame([(t, [i], [i]) for i, t in enumerate(texts)], "opening string, low array<long>, high array<long>")
    df = df.select("opening", *[F.array(*[F.col(c)[0]] * p6_defects.SKETCH).alias(c) for c in ("low", "high")])
    got = {r.opening: r for r in p6_defects.opening_clusters(df).collect()}
    assert set(got) == set(texts)
    sh = {t: {t[i : i + p6_defects.SHINGLE] for i in range(len(t) - p6_defects.SHINGLE + 1)} for t in texts}
    links = [(a, b) for i, a in enumerate(texts) for b in texts[i + 1 :] if len(sh[a] & sh[b]) >= 0.8 * len(sh[a] | sh[b])]
    found = sum(got[a].cluster == got[b].cluster for a, b in links)
    assert len(links) > 1_000 and found >= 0.9 * len(links)
    parent = {t: t for t in texts}

    def root(t):
        while parent[t] != t:
            t = parent[t]
        return t

    for a, b in links:
        parent[root(a)] = root(b)
    assert all(len({root(t) for t in texts if got[t].cluster == c}) == 1 for c in {r.cluster for r in got.values()})  # no cluster joins what no chain of links joins
    number = {t: i for i, t in enumerate(texts)}
    for c in {r.cluster for r in got.values()}:
        mine = [t for t in texts if got[t].cluster == c]
        lows, highs = [min(number[t] for t in mine)] * p6_defects.SKETCH, [max(number[t] for t in mine)] * p6_defects.SKETCH
        assert all(got[t].low == lows and got[t].high == highs for t in mine)


def test_opening_clusters_are_whole(spark):
    """Clusters are exactly what links within buckets join: along chains of any length, and in buckets of many unlike
    openings, of which few are heads."""
    rng = random.Random(21)
    word = lambda k: "".join(rng.choice("abcdefghiklmnoprstu") for _ in range(k))
    texts = set()
    for _ in range(6):  # chains: each opening has one word other than the last
        w = [word(6) for _ in range(12)]
        for i in range(40):
            texts.add(" ".join(w))
            w[i % 12] = word(6)
    same = [word(7) for _ in range(4)]
    for _ in range(250):  # buckets of openings that share half of their words, each with one like it
        other = [word(9) for _ in range(4)]
        texts |= {" ".join(same + other), " ".join([*same, *other, word(3)])}
    texts = sorted(texts)
    signed = p6_defects.signed({k: texts if k == "opening" else [[0]] * len(texts) for k in ("opening", "low", "high")})
    sets, buckets = [set(g) for g in signed["grams"]], {}
    for i, m in enumerate(signed["mins"]):
        for b in range(p6_defects.HASHES // p6_defects.BAND):
            buckets.setdefault((b, *m[b * p6_defects.BAND : (b + 1) * p6_defects.BAND]), []).append(i)
    parent = list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for mine in buckets.values():
        for i in mine:
            for j in mine:
                if i < j and len(sets[i] & sets[j]) * 1.8 >= 0.8 * (len(sets[i]) + len(sets[j])):
                    parent[root(i)] = root(j)
    want = {}
    for i, t in enumerate(texts):
        want.setdefault(root(i), set()).add(t)
    assert max(map(len, buckets.values())) > 4 * p6_defects.HEADS and max(map(len, want.values())) > 12
    df = spark.createDataFrame([(t, [0] * p6_defects.SKETCH, [0] * p6_defects.SKETCH) for t in texts], "opening string, low array<long>, high array<long>")
    got = {}
    for r in p6_defects.opening_clusters(df).collect():
        got.setdefault(r.cluster, set()).add(r.opening)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_prompt_sketch():
    rng = random.Random(8)
    words = [f"w{i}" for i in range(400)]
    near = far = 0
    for _ in range(200):
        a = rng.sample(words, 40)
        b, c = [*a[1:], "other"], rng.sample(words, 40)
        differ = lambda x, y: sum(i != j for i, j in zip(p6_defects.prompt_sketch(" ".join(x)), p6_defects.prompt_sketch(" ".join(y))))
        near += differ(a, b) >= 2
        far += differ(a, c) >= 2
    assert near < 20 and far > 190
    assert len(p6_defects.prompt_sketch("...")) == p6_defects.SKETCH


def test_refusals_of_any_length():
    w = p6_defects.Weights({x: 3.0 for x in "sorry i cannot translate this passage as it may be protected by law and would break our rules please ask another".split()})
    long = "I am sorry, I cannot translate this passage. " + "It may be protected by law and would break our rules. " * 15
    mixed = "Sorry, I cannot translate this passage as it may be protected. Kindly consult qualified colleagues elsewhere. " * 2
    texts = [long, mixed, "Sorry.", "“I cannot translate this,” Mark Berg replied calmly yesterday evening near harbour.", "", None]
    mean, n, high = p6_defects.refusal_scores(texts, w, 0.9)
    source = "On day 17 Mark Berg said that the old clock stood still."
    got = [bool(t) and p6_defects.is_refusal(source, t, mean[i], n[i], high[i], 0.9) for i, t in enumerate(texts)]
    assert n[0] > 150 and got == [True, True, True, False, False, False]


def test_same_beginning_is_not_one_prompt():
    head = "On the first day of the long winter the "
    a, b = (p6_defects.prompt_sketch(head + x) for x in ("miller lost his only horse behind the mill", "countess burned every letter of her brother"))
    assert sum(x != y for x, y in zip(a, b)) >= 2


# --- 7
def brute_bins(plan, sizes, capacity):
    return sum(k for _, k in plan), all(sum(int(sizes[i]) * a for i, a in c.items()) <= capacity for c, _ in plan)


def test_configurations():
    rng = np.random.default_rng(8)
    sizes, counts = np.unique(rng.integers(5, 60, 3000), return_counts=True)
    plan = p7_packing.solve_configurations(sizes, counts, 100, rounds=300)
    packed = Counter()
    for c, k in plan:
        for i, a in c.items():
            packed[i] += a * k
    n, fits = brute_bins(plan, sizes, 100)
    assert fits and [packed[i] for i in range(len(sizes))] == counts.tolist()
    assert n <= 1.02 * -(-int((sizes * counts).sum()) // 100) + 2
    assert p7_packing.solve_configurations(np.zeros(0, int), np.zeros(0, int), 10) == []


def test_knapsack_is_exact():
    rng = np.random.default_rng(9)
    for _ in range(20):
        sizes = np.unique(rng.integers(2, 15, 5))
        prices = rng.random(len(sizes))
        best = {0: 0.0}
        for w in range(1, 31):
            best[w] = max([best[w - 1], *(best[w - s] + p for s, p in zip(sizes, prices) if s <= w)])
        conf = p7_packing.dearest_configuration(sizes, prices, 30)
        assert abs(sum(prices[i] * a for i, a in conf.items()) - best[30]) < 1e-9 and sum(sizes[i] * a for i, a in conf.items()) <= 30


@pytest.mark.parametrize("capacity", [50, 5000, 8192])
def test_pack(spark, capacity):
    rng = random.Random(10)
    items = [(i, rng.choice([1, 7, 20, 33, 49, 50, 51, 120, 333])) for i in range(500)] + [(9999, 0)]
    df = spark.createDataFrame(items, "doc_id long, tokens long").repartition(5)
    rows = p7_packing.pack(df.filter("tokens > 0"), capacity)[0].collect()
    fill, whole = Counter(), Counter()
    for r in rows:
        fill[r.container] += r.tokens
        whole[r.doc_id] += r.tokens
    assert whole == {i: t for i, t in items if t} and max(fill.values()) <= capacity
    assert all(t > capacity for i, t in items if sum(r.doc_id == i for r in rows) > 1)
    assert sorted(fill) == list(range(len(fill)))
    if capacity == 8192:  # exact lengths: no container more than the sum of lengths needs
        assert len(fill) == -(-sum(t for _, t in items) // capacity)


def test_tokens():
    assert tokens.count_tokens(["hello world", "", None]).tolist() == [len(tokens.encoding().encode_ordinary("hello world")), 0, 0]


# --- 8
def test_flight_keeps_totals():
    rng = random.Random(11)
    items = [(i, rng.choice([3, 10, 10, 50, 400]), 0.37) for i in range(500)]
    done, rest = p8_mixing.flight(items, random.Random(1))
    assert len(rest) <= 2 and len(done) + len(rest) == 500
    for f in (lambda t: 1, lambda t: t):
        assert abs(sum(f(t) * d for _, t, d in done) + sum(f(t) * p for _, t, p in rest) - 0.37 * sum(f(t) for _, t, _ in items)) < 1e-4


def test_partitions_draw_apart(spark):
    """Partitions of equal lengths do not choose the same places."""
    df = spark.createDataFrame([(p * 100 + i, "a", 10 + i % 7) for p in range(4) for i in range(100)], "doc_id long, source string, tokens long").repartitionByRange(4, "doc_id")
    shares = {"a": {"uses": 0.5, "wanted": 0.5 * sum(10 + i % 7 for i in range(100)) * 4, "cap": 1}}
    rows = p8_mixing.draw(df, shares).collect()
    places = [{r.doc_id % 100 for r in rows if r.doc_id // 100 == p} for p in range(4)]
    assert len({frozenset(p) for p in places}) == 4 and 190 <= len(rows) <= 210


def test_mixing(spark):
    rng = random.Random(12)
    texts = [(i, " ".join(rng.choice(["red", "blue", "old"]) for _ in range(rng.randint(5, 60))) + f" {i}", "abc"[i % 3]) for i in range(600)]
    texts += [(10_000 + i, texts[i][1], "a") for i in range(30)]  # copies of texts count once
    docs = spark.createDataFrame(texts, DOCS).repartition(4)
    targets = spark.createDataFrame([("a", 0.6, 1), ("b", 0.3, 3), ("c", 0.05, 5), ("none", 0.05, 2)], "source string, target_share double, max_repeats int")
    unique = p8_mixing.texts_of(docs, targets)
    assert unique.count() == 600
    shares = p8_mixing.plan_shares(unique, targets)
    rows = p8_mixing.draw(unique, shares).collect()
    total = sum(r.tokens * r.uses for r in rows)
    for s, v in shares.items():
        got = sum(r.tokens * r.uses for r in rows if r.source == s)
        assert abs(got / total - v["scaled"]) < 0.01 and max([r.uses for r in rows if r.source == s], default=0) <= v["cap"]
    assert shares["none"]["uses"] == 0


# --- 9
PROSE = "The old man opened the door and saw the river. Nobody knew why she was waiting there with the bread. In the evening the horse was at the house."


@pytest.mark.parametrize(("text", "spam"), [
    (PROSE, False), ("#cat #dog #cat #cat #dog #cat", True), ("cheap cat, best dog, cheap cat, best dog, cheap cat, best dog, cheap cat", True),
    ("[cat](https://a.test/x)\n[dog](https://b.test/y)\n[cat](http://c.test/z)", True), ("cat red 12.50 SKU 1234\ndog XL 3.99 -20%\ncat new 7.00 in stock", True),
    ("Chapter 1: In the snow ..... 3\nChapter 2: At noon ..... 12\nChapter 3: At dusk ..... 20", False), ("the cat, 3, 14, 20\nthe dog, 5\nthe river, 7, 9", False),
    ("the cat — le chat\nthe dog — le chien\nthe book — le livre", False), (PROSE + "\n#cat", False), (PROSE + "\n[a page](https://a.test/x)", False),
    ("— Ha, ha, ha!\n— The old man saw the river.\n— Ha, ha, ha!\n— She was waiting there with the bread.", False), ("Anna Berg, the nurse\nOtto Lang, the captain\nEva Horn, the widow", False),
])
def test_pages(spark, text, spam):
    words = frozenset("the and was at with in of a she why there le".split())
    r = p9_spam.judge_pages(spark.createDataFrame([(1, text, "s")], DOCS), words).first()
    assert (r.link + r.tag + r.menu + r.stuffed > 0.5) is spam


def test_verse_is_no_spam(spark):
    """Lines without marks and a refrain, in a language without listed function words."""
    lines = ["Тихий ветер несёт листья к реке", "Старик открыл дверь и долго молчал", "Мальчик смотрел на старый мост", "На холме спала большая собака", "Весной вернулись белые птицы", "Никто не видел её лица"]
    text = "\n".join(f"{x}\nТолько снег падает на пустой двор." for x in lines)
    r = p9_spam.judge_pages(spark.createDataFrame([(1, text, "s")], DOCS), frozenset(["the"])).first()
    assert r.link + r.tag + r.menu + r.stuffed < 0.5


def test_segments_are_linear():
    """A line of many sentences with one spaced dash is cut at all of them, in time proportional to their number."""
    import time

    line = lambda n: "The old man opened the door. " * n + "He went — away."
    assert len(p9_spam.segments_of(line(20))) == 21
    p9_spam.segments_of(line(50))
    took = []
    for n in (500, 8_000):
        began = time.perf_counter()
        assert len(p9_spam.segments_of(line(n))) == n + 1
        took.append(time.perf_counter() - began)
    assert took[1] < 16 * 4 * max(took[0], 1e-3)
    began = time.perf_counter()
    p9_spam.features_of(["1. " * 50_000, "." * 50_000, "1, " * 30_000 + "x", "](" * 20_000, "a-" * 20_000, "<a <a " * 10_000], np.zeros(0, np.uint64))
    assert time.perf_counter() - began < 30


def test_features_of_a_batch():
    """A page's features do not depend on the pages beside it."""
    pages = [PROSE, "", "#cat #dog #cat", "cat, dog, cat, dog, cat\ncat, dog", "[cat](https://a.test/x) b.test/y\ncat 3.50", "the cat, 3, 14", PROSE + "\n" + PROSE]
    known = np.sort(p9_spam.hashes_of(["the", "and", "was"]))
    bits, words, n_of = p9_spam.features_of(pages, known)
    at = np.concatenate([[0], np.cumsum(n_of)])
    for i, p in enumerate(pages):
        b, w, n = p9_spam.features_of([p], known)
        assert n[0] == n_of[i] and b.tolist() == bits[at[i] : at[i + 1]].tolist() and w.tolist() == words[at[i] : at[i + 1]].tolist()


def test_span_hashes():
    from lexweave.llm import hashed

    text = "cat dog cat été"
    codes = hashed.codes_of(text)
    start, end = hashed.spans(hashed.look_up("letter", codes))
    h = hashed.SpanHash(hashed.look_up("fold", codes)).of(start, end)
    assert h[0] == h[2] != h[1] and h.tolist() == hashed.hashes_of(["Cat", "dog", "cat", "ete"], "fold").tolist()
    g, v = np.array([0, 0, 1, 0]), np.array([5, 5, 5, 6])
    assert hashed.counts_within(g, v).tolist() == [2, 2, 1, 1] and hashed.first_of(g, v).tolist() == [True, False, True, True]


def test_posteriors_of_many_pages():
    m = p9_spam.PageModel()
    rng = np.random.default_rng(3)
    n_of = np.array([3, 0, 1, 7, 2])
    bits = rng.integers(0, 1 << len(p9_spam.FEATURES), n_of.sum())
    g, moves, first = m.posteriors(bits, n_of)
    at = np.concatenate([[0], np.cumsum(n_of)])
    alone = [m.posterior(bits[a:b]) for a, b in zip(at[:-1], at[1:]) if b > a]
    assert np.allclose(g, np.concatenate([x[0] for x in alone])) and np.allclose(moves, sum(x[1] for x in alone)) and np.allclose(first, sum(x[0][0] for x in alone))


def test_forward_backward_is_exact():
    """Posteriors against the sum over all state paths."""
    import itertools

    m = p9_spam.PageModel()
    bits = np.array([0b100, 0b1, 0b1100])
    b = m.likelihood(bits)
    k = len(p9_spam.STATES)
    post = np.zeros((3, k))
    for path in itertools.product(range(k), repeat=3):
        p = m.first[path[0]] * b[0, path[0]] * m.move[path[0], path[1]] * b[1, path[1]] * m.move[path[1], path[2]] * b[2, path[2]]
        for t, s in enumerate(path):
            post[t, s] += p
    post /= post.sum(1, keepdims=True)
    assert np.allclose(m.posterior(bits)[0], post)


def test_no_cross_imports():
    """Nothing outside the subpackage imports it."""
    from pathlib import Path

    root = Path(p9_spam.__file__).resolve().parents[1]
    for p in root.rglob("*.py"):
        if "llm" not in p.parts:
            assert not re.search(r"\bllm\b", p.read_text()), p
    assert len(LANGS) == 7
