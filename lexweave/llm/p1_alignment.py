"""Problem 1: sentences of bilingual documents that render each other.

Method: cross-lingual term vectors by singular value decomposition of paired document terms (vectors.py); windows of
merged sentences are matched by margin-scored mutual nearest neighbours, whatever their order. Target sentences that are
source sentences carried over are set aside first.

Nulls: rows with a null or empty source or target, or a null id, give no row. A text of one block without sentence ends
counts as one sentence. Repeated rows each give their own pairs. Extra columns are not read. Long texts are aligned
whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import stage
from .batches import map_pieces, scan_partitions
from .textkit import K_LANGS, SENTENCE_END, Sentences, language_of_label
from .vectors import BITS, D, RANK, PairModel, Terms, align_all, found_in, gram_product, identity_vectors, orthonormal, paired_terms, start_matrix, term_vectors, untag

#: The partial sums of a product are added up in so many blocks of terms, and so many at a time: 13 MB in a group.
BLOCKS, FAN = 64, 32
#: Terms of documents that are multiplied at a time.
TERMS = 1_000_000


def pair_rows(translations: DataFrame) -> DataFrame:
    return translations.filter("id is not null and coalesce(source_lang, '') <> '@' and source is not null and source <> '' and target is not null and target <> ''")


def language_pair(source_lang: str | None, target_lang: str | None) -> int:
    return (language_of_label(source_lang) + 1) * (K_LANGS + 1) + language_of_label(target_lang) + 1


def encode_pairs(rows: DataFrame) -> DataFrame:
    """One scan: for each row its terms (kind 'p', 16 bits a term with its side), and for each partition its counts (kinds
    'c' and 'l'). A row has 128 kB at most and hardly more than its text, so that batches of any number of rows stay small."""

    def start() -> dict:
        return {"terms": Terms(), "df": np.zeros(D, np.int64), "seen": np.zeros(D, np.int64), "kept": np.zeros(D, np.int64), "pairs": {}}

    def step(st: dict, c: dict[str, list]) -> dict[str, object]:
        term, doc, side, every, skeletons, kept = paired_terms(st["terms"], [untag(x) for x in c["source"]], [untag(x) for x in c["target"]])
        st["df"] += np.bincount(every, minlength=D)
        st["seen"] += np.bincount(skeletons, minlength=D)
        st["kept"] += np.bincount(kept, minlength=D)
        pairs = [language_pair(a, b) for a, b in zip(c["source_lang"], c["target_lang"])]
        for p in pairs:
            st["pairs"][p] = st["pairs"].get(p, 0) + 1
        coded = (term << 1 | side).astype("<u2")[np.argsort(doc, kind="stable")].tobytes()
        ends = (2 * np.cumsum(np.bincount(doc, minlength=len(pairs)))).tolist()
        return {"kind": ["p"] * len(pairs), "terms": [coded[a:b] for a, b in zip([0, *ends], ends)], "pair": pairs}

    def end(st: dict) -> dict[str, object]:
        used = np.flatnonzero(st["df"] + st["seen"])
        rows = [("c", int(t), int(st["df"][t]), int(st["seen"][t]), int(st["kept"][t])) for t in used]
        rows += [("l", k, n, 0, 0) for k, n in st["pairs"].items()]
        cols = list(zip(*rows)) if rows else [()] * 5
        return dict(zip(("kind", "key", "a", "b", "c"), map(list, cols)))

    schema = "kind string, terms binary, pair int, key int, a long, b long, c long"
    return scan_partitions(rows.select("source", "target", "source_lang", "target_lang"), schema, start, step, end, ("source", "target"))


def summed_product(encoded: DataFrame, weight: np.ndarray, pair_weight: np.ndarray, omega: np.ndarray) -> np.ndarray:
    """X'(X omega) over all documents. Partial sums leave the partitions in blocks of terms; their total, of a size
    fixed by the model, is gathered on the driver."""
    spark = encoded.sparkSession
    rank = omega.shape[1]
    shared = spark.sparkContext.broadcast((weight, pair_weight, omega))

    def partial(batches: Iterator) -> Iterator:
        w, pw, om = shared.value
        out = np.zeros((D, rank), np.float32)
        for batch in batches:
            # texts of one language pair side by side: a block of them has fewer terms
            order = np.argsort(batch.column(1).to_numpy(), kind="stable")
            coded, weights = batch.column(0).to_pylist(), pw[batch.column(1).to_numpy()[order]]
            coded = [coded[i] for i in order.tolist()]
            sizes = np.fromiter(map(len, coded), np.int64, len(coded)) // 2
            cuts = np.flatnonzero(np.diff(np.cumsum(sizes) // TERMS)) + 1
            for a, b in zip([0, *cuts], [*cuts, len(coded)]):
                x = np.frombuffer(b"".join(coded[a:b]), "<u2").astype(np.int64)
                gram_product(x >> 1, np.repeat(np.arange(b - a), sizes[a:b]), x & 1, weights[a:b], w, om, out)
        at = TaskContext.get().partitionId()
        for b in range(BLOCKS):
            part = out[b::BLOCKS]
            used = np.flatnonzero(np.abs(part).sum(1) > 0).astype(np.int32)
            if len(used):
                yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([used.tobytes()], pa.binary()), pa.array([part[used].tobytes()], pa.binary()), pa.array([at], pa.int32())], ["block", "rows", "sums", "part"])

    coded = encoded.filter("kind = 'p'").select("terms", "pair")
    parts = coded.mapInArrow(partial, "block int, rows binary, sums binary, part int")
    result = np.zeros((D, rank), np.float32)
    for r in added(parts, coded.rdd.getNumPartitions(), rank).collect():  # BLOCKS rows, D x rank numbers in all
        result[np.frombuffer(r.rows, np.int32) * BLOCKS + r.block] = np.frombuffer(r.sums, np.float32).reshape(-1, rank)
    shared.unpersist()
    return result


def added(parts: DataFrame, n: int, rank: int, fan: int = FAN) -> DataFrame:
    """One sum for each block of the partial sums of n partitions, in as many levels as it takes for no task to add up
    more than `fan` of them: block, rows, sums, part."""

    def add(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros((D // BLOCKS, rank), np.float32)
        for r, s in zip(pdf["rows"], pdf["sums"]):
            total[np.frombuffer(r, np.int32)] += np.frombuffer(s, np.float32).reshape(-1, rank)
        used = np.flatnonzero(np.abs(total).sum(1) > 0).astype(np.int32)
        return pd.DataFrame({"block": [key[0]], "rows": [used.tobytes()], "sums": [total[used].tobytes()], "part": [key[1]]})

    while True:
        n = -(-n // fan)
        parts = parts.withColumn("part", F.pmod("part", F.lit(max(n, 1)))).groupBy("block", "part").applyInPandas(add, "block int, rows binary, sums binary, part int")
        if n <= 1:
            return parts


def fit_pair_model(translations: DataFrame, rank: int = RANK) -> PairModel:
    """Vectors from all pairs. Rare language pairs weigh more, by the root of how much rarer they are."""
    encoded = stage(encode_pairs(pair_rows(translations)), "pairs")
    df, seen, kept, langs = np.zeros(D), np.zeros(D), np.zeros(D), np.zeros((K_LANGS + 1) ** 2)
    for r in encoded.filter("kind in ('c', 'l')").groupBy("kind", "key").agg(F.sum("a").alias("a"), F.sum("b").alias("b"), F.sum("c").alias("c")).collect():  # at most D + 64 rows
        if r.kind == "c":
            df[r.key], seen[r.key], kept[r.key] = r.a, r.b, r.c
        else:
            langs[r.key] = r.a
    n = max(langs.sum(), 1)
    idf = np.where(df >= 2, np.log(n / np.maximum(df, 1)), 0).clip(0).astype(np.float32)
    stays = np.where(seen >= 2, kept / np.maximum(seen, 1), 0.5).astype(np.float32)
    known = np.array([i // (K_LANGS + 1) > 0 and i % (K_LANGS + 1) > 0 and i // (K_LANGS + 1) != i % (K_LANGS + 1) for i in range(len(langs))])
    pair_weight = np.where(known & (langs > 0), np.sqrt(langs.max() / np.maximum(langs, 1)).clip(max=40), 1.0)
    weight = np.where(df >= 3, idf, 0).astype(np.float32)
    q = orthonormal(summed_product(encoded, weight, pair_weight, start_matrix(rank)))
    return PairModel(term_vectors(q, summed_product(encoded, weight, pair_weight, q)), idf, stays)


def alignments(translations: DataFrame, model: PairModel, min_source: int = 1, widest: int = 3, least: float = 0.15) -> DataFrame:
    """id, src_pos, tgt_pos of each pair of sentences that render each other, for sources of at least min_source."""
    shared = translations.sparkSession.sparkContext.broadcast((model.vectors, model.idf, model.stays))
    cache: dict = {}

    def run(c: dict[str, list]) -> dict[str, object]:
        if "m" not in cache:
            cache.update(m=PairModel(*shared.value), identity=identity_vectors(), terms=Terms())
        # a text of n sentences has n - 1 marks at least
        some = [i for i, x in enumerate(c["source"]) if x.count(".") + x.count("!") + x.count("?") >= min_source - 1]
        c = {k: [v[i] for i in some] for k, v in c.items()}
        src = Sentences(c["source"])
        keep = [i for i in range(len(c["id"])) if src.n[i] >= min_source]
        out: dict[str, object] = {"id": [], "src_pos": [], "tgt_pos": []}
        if not keep:
            return out
        tgt = Sentences([c["target"][i] for i in keep])
        s_codes, s_sizes = cache["terms"].codes([untag(src.get(j)) for i in keep for j in range(src.first[i], src.first[i] + src.n[i])])
        t_codes, t_sizes = cache["terms"].codes([untag(tgt.get(j)) for j in range(len(tgt))])
        vs = cache["m"].sentence_vectors(s_codes, s_sizes, cache["identity"])
        vt = cache["m"].sentence_vectors(t_codes, t_sizes, cache["identity"])
        s_at, t_at = np.concatenate([[0], np.cumsum(s_sizes)]), np.concatenate([[0], np.cumsum(t_sizes)])
        # a target sentence most of whose words are the source's is perhaps carried over from one of its sentences
        s_doc, t_doc = np.repeat(np.repeat(np.arange(len(keep)), src.n[keep]), s_sizes), np.repeat(tgt.doc, t_sizes)
        same = found_in(t_doc << BITS | t_codes & (D - 1), np.sort(s_doc << BITS | s_codes & (D - 1)))
        likely = 2 * np.bincount(np.repeat(np.arange(len(tgt)), t_sizes), weights=same, minlength=len(tgt)) > t_sizes
        free = t_sizes > 0
        s_n, s_first = src.n[keep], np.cumsum(src.n[keep]) - src.n[keep]
        for y in np.flatnonzero(free & likely).tolist():
            w = set(t_codes[t_at[y] : t_at[y + 1]].tolist())
            first = int(s_first[tgt.doc[y]])
            own = (set(s_codes[s_at[x] : s_at[x + 1]].tolist()) for x in range(first, first + int(s_n[tgt.doc[y]])))
            free[y] = max((len(w & x) / len(w | x) for x in own), default=0) < 0.6
        left = np.flatnonzero(free)
        m = np.bincount(tgt.doc[left], minlength=len(keep))
        doc, xs, ys = align_all(vs, vt[left], s_n, m, widest, least, sizes=(s_sizes, t_sizes[left]))
        ys = left[(np.cumsum(m) - m)[doc] + ys] - tgt.first[doc]
        more = []
        # a beginning of a sentence, too short to tell by itself: it renders what follows the sentence before it, if
        # nothing else does
        ends = tgt.first + tgt.n - 1
        for k in np.flatnonzero((m > 0) & free[ends] & (t_sizes[ends] <= 5)).tolist():
            a, b = np.searchsorted(doc, [k, k + 1])
            last = int(tgt.n[k]) - 1
            if not SENTENCE_END.search(tgt.text[tgt.start[ends[k]] : tgt.end[ends[k]]]) and last not in ys[a:b]:
                before = max(xs[a:b][ys[a:b] == last - 1].tolist(), default=-1)
                if 0 <= before < s_n[k] - 1 and before + 1 not in xs[a:b]:
                    more.append((k, before + 1, last))
        doc, xs, ys = (np.concatenate([v, np.array(z, np.int64)]) for v, z in zip((doc, xs, ys), zip(*more) if more else ((),) * 3))
        order = np.argsort(doc, kind="stable")
        ids = np.array([c["id"][i] for i in keep], np.int64)
        out.update(id=ids[doc[order]], src_pos=xs[order].astype(np.int32), tgt_pos=ys[order].astype(np.int32))
        return out

    rows = pair_rows(translations).select("id", "source", "target")
    return map_pieces(rows, "id long, src_pos int, tgt_pos int", run, ("source", "target"))


def p1_alignments(spark: SparkSession, sf_dir: str, min_source: int = 1) -> DataFrame:
    t = spark.read.parquet(f"{sf_dir}/translations.parquet")
    return alignments(t, fit_pair_model(t), min_source)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p1_alignments(spark, sf_dir, 4)


QUERIES = {"p1_found": p1_found, "p1_alignments": p1_alignments}
