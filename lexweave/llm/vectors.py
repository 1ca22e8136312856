"""Cross-lingual term vectors from paired documents.

Each pair (source, target) is one document whose terms are those of both sides. The leading singular vectors of the
term-document matrix put terms that render each other close together. The matrix is never built: its product with a
narrow matrix is summed over the documents, one partial sum a partition, and a randomised range finder with one power
iteration needs two such products. Terms are hashed, so the model's size is fixed whatever the corpus. Terms that pass
from one side to the other unchanged (names, numbers) are recognised by how often they do and compared by identity.
"""

from __future__ import annotations

import re
import sys
import zlib
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np

from .textkit import _INVISIBLE_RE, fold

BITS = 15
D = 1 << BITS
RANK, IDENTITY = 192, 64
_WORD = re.compile(r"[^\W_]+")
_TAG = re.compile(r"<[^<>]*>")
#: One spelling for names written in Latin or Cyrillic letters.
_SKELETON = str.maketrans({**dict(zip("абвгдеёжзийклмнопрстуфхцчшщыэюя", "abvgdeezziiklmnoprstufhzzzzieua")), **dict(zip("qcwjy", "kkvii")), "ъ": "", "ь": ""})


#: Characters of texts whose words are found all at once.
TOGETHER = 4_000_000


def untag(text: str) -> str:
    return _TAG.sub(" ", text) if "<" in text else text


@lru_cache(maxsize=1)
def _kinds() -> np.ndarray:
    """Of every character: 1 if words have it, 2 if it is drawn as nothing, else 0."""
    every = "".join(map(chr, range(sys.maxunicode + 1)))
    out = np.zeros(len(every), np.uint8)
    for kind, marks in ((1, _WORD), (2, _INVISIBLE_RE)):
        for m in marks.finditer(every):
            out[m.start() : m.end()] = kind
    return out


def words(texts: list[str]) -> list[list[str]]:
    """Words of each text without invisible characters. All texts at once: what is no part of a word becomes a blank."""
    ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
    if not len(ends) or ends[-1] > TOGETHER:
        return [_WORD.findall(t if t.isascii() else _INVISIBLE_RE.sub("", t)) for t in texts]
    codes = np.frombuffer("\n".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), "<u4")
    kind = _kinds()[codes]
    shown = np.where(kind == 1, codes, np.uint32(32))
    shown[ends - 1] = 10
    if (kind == 2).any():
        shown = shown[kind != 2]
    return [t.split() for t in shown.tobytes().decode("utf-32-le", "surrogatepass").split("\n")[:-1]]


class Terms(dict):
    """Code of a word, its skeleton's bucket above its own; words met before are remembered."""

    def __missing__(self, word: str) -> int:
        w = fold(word)
        code = (zlib.crc32(w.translate(_SKELETON).encode(), 7) & (D - 1)) << BITS | zlib.crc32(w.encode()) & (D - 1)
        if len(self) > 300_000:
            self.clear()
        self[word] = code
        return code

    def codes(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Codes of all words of all texts, and how many words each text has."""
        found = words(texts)
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter(map(self.__getitem__, chain.from_iterable(found)), np.int64, int(sizes.sum())), sizes


def uniq(x: np.ndarray) -> np.ndarray:
    """Sorted distinct values; faster than numpy's own on short-ranged keys."""
    s = np.sort(x)
    return s[np.concatenate([[True], s[1:] != s[:-1]])] if len(s) else s


def found_in(x: np.ndarray, among: np.ndarray) -> np.ndarray:
    """Whether each value is in a sorted array."""
    if not len(among):
        return np.zeros(len(x), bool)
    return among[np.minimum(np.searchsorted(among, x), len(among) - 1)] == x


def distinct(codes: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, code) pairs: codes and the text of each."""
    key = uniq(np.repeat(np.arange(len(sizes)), sizes) << (2 * BITS) | codes)
    return key & ((1 << (2 * BITS)) - 1), key >> (2 * BITS)


def paired_terms(terms: Terms, sources: list[str], targets: list[str]) -> tuple[np.ndarray, ...]:
    """Of each pair: the distinct terms of one side that the other lacks, with their pair and side; and for the counts
    all distinct terms of a pair, the skeletons of its source, and those that its target has too."""
    a, da = distinct(*terms.codes(sources))
    b, db = distinct(*terms.codes(targets))
    low = D - 1
    ka, kb = da << BITS | (a & low), db << BITS | (b & low)
    ua, ub = uniq(ka), uniq(kb)
    only_a, only_b = ~found_in(ka, ub), ~found_in(kb, ua)
    sa, sb = uniq(da << BITS | a >> BITS), uniq(db << BITS | b >> BITS)
    term = np.concatenate([a[only_a], b[only_b]]) & low
    doc = np.concatenate([da[only_a], db[only_b]])
    side = np.concatenate([np.zeros(only_a.sum(), np.int64), np.ones(only_b.sum(), np.int64)])
    every = uniq(np.concatenate([ua, ub])) & low
    return term, doc, side, every, sa & low, sa[found_in(sa, sb)] & low


def gram_product(term: np.ndarray, doc: np.ndarray, side: np.ndarray, doc_weight: np.ndarray, weight: np.ndarray, omega: np.ndarray, out: np.ndarray, block: int = 256) -> None:
    """Adds X' (X omega) of these documents to out, X the weighted term-document matrix with each side of unit norm;
    blocks of documents are dense over the terms they have."""
    w = weight[term]
    keep = w > 0
    term, doc, side, w = term[keep], doc[keep], side[keep], w[keep]
    if not len(term):
        return
    unit = doc * 2 + side
    norm = np.sqrt(np.bincount(unit, weights=w * w))
    w = (w / norm[unit] * np.sqrt(doc_weight[doc])).astype(np.float32)
    order = np.argsort(doc, kind="stable")
    term, doc, w = term[order], doc[order], w[order]
    cuts = np.searchsorted(doc, np.arange(0, len(doc_weight) + block, block))
    has, column = np.zeros(len(weight), bool), np.zeros(len(weight), np.int64)
    for a, b in zip(cuts[:-1], cuts[1:]):
        if a < b:
            has[:] = False
            has[term[a:b]] = True
            used = np.flatnonzero(has)
            column[used] = np.arange(len(used))
            x = np.zeros((block, len(used)), np.float32)
            np.add.at(x, (doc[a:b] % block, column[term[a:b]]), w[a:b])
            out[used] += x.T @ (x @ omega[used])


def start_matrix(rank: int = RANK, seed: int = 11) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((D, rank)).astype(np.float32)


def orthonormal(y: np.ndarray) -> np.ndarray:
    """Orthonormal columns; rows of terms that don't occur stay zero."""
    used = np.flatnonzero(np.abs(y).sum(1) > 0)
    out = np.zeros_like(y)
    if len(used):
        q, _ = np.linalg.qr(y[used].astype(np.float64))
        out[used, : q.shape[1]] = q
    return out


def term_vectors(q: np.ndarray, gq: np.ndarray, power: float = 0.25) -> np.ndarray:
    """Unit vectors of terms from Q and (X'X) Q: singular vectors scaled by a power of the singular values, without the
    first, which only tells how common a term is."""
    small = q.T.astype(np.float64) @ gq
    values, vecs = np.linalg.eigh((small + small.T) / 2)
    good = values > max(values[-1], 1e-9) * 1e-7
    v = (gq @ vecs[:, good]) / values[good] ** (1 - power)
    v = v[:, ::-1][:, 1:]
    return (v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)).astype(np.float32)


def identity_vectors(seed: int = 5) -> np.ndarray:
    r = np.random.default_rng(seed).standard_normal((D, IDENTITY)).astype(np.float32)
    return r / np.linalg.norm(r, axis=1, keepdims=True)


#: Words whose vectors are summed at a time; as many rows of weighted vectors, 1 kB each, are held at most.
WORDS = 32_768


@dataclass
class PairModel:
    """vectors: [D, RANK] unit rows; idf: [D]; stays: [D] by skeleton, how often a term passes unchanged."""

    vectors: np.ndarray
    idf: np.ndarray
    stays: np.ndarray

    def sentence_vectors(self, codes: np.ndarray, sizes: np.ndarray, identity: np.ndarray) -> np.ndarray:
        """Weighted sums of the vectors of each sentence's words."""
        rank = self.vectors.shape[1]
        out = np.zeros((len(sizes), rank + IDENTITY), np.float32)
        if not len(codes):
            return out
        full = np.flatnonzero(sizes)
        ends = np.cumsum(sizes[full])
        at = first = 0
        while first < len(full):
            last = max(first + 1, int(np.searchsorted(ends, at + WORDS, side="right")))
            end = int(ends[last - 1])
            if last - first > 1:
                out[full[first:last]] = self._sums_of_words(codes[at:end], sizes[full[first:last]], identity)
            else:
                for i in range(at, end, 4096):  # a sentence of any length
                    out[full[first]] += self._words(codes[i : min(i + 4096, end)], identity).sum(0)
            at, first = end, last
        return out

    def _words(self, codes: np.ndarray, identity: np.ndarray) -> np.ndarray:
        """Weighted vectors of words."""
        a, b = codes & (D - 1), codes >> BITS
        stay, w = self.stays[b], self.idf[a]
        rank = self.vectors.shape[1]
        out = np.empty((len(codes), rank + IDENTITY), np.float32)
        np.multiply(self.vectors[a], (w * (1 - stay))[:, None], out=out[:, :rank])
        np.multiply(identity[b], (w * stay)[:, None], out=out[:, rank:])
        return out

    def _sums_of_words(self, codes: np.ndarray, sizes: np.ndarray, identity: np.ndarray) -> np.ndarray:
        """Vectors of sentences that all have words. Each distinct word is weighted once; sentences are summed in blocks
        that stay in the processor's cache, as products with a matrix of ones."""
        distinct, which = np.unique(codes, return_inverse=True)
        table = self._words(distinct, identity)
        out = np.empty((len(sizes), table.shape[1]), np.float32)
        ends, of = np.cumsum(sizes), np.repeat(np.arange(len(sizes)), sizes)
        at = first = 0
        while first < len(sizes):
            last = max(first + 1, int(np.searchsorted(ends, at + 256, side="right")))
            end = int(ends[last - 1])
            ones = np.zeros((last - first, end - at), np.float32)
            ones[of[at:end] - first, np.arange(end - at)] = 1
            np.matmul(ones, table[which[at:end]], out=out[first:last])
            at, first = end, last
        return out


@lru_cache(maxsize=256)
def _windows(n: int, widest: int) -> np.ndarray:
    return np.array([(i, i + k) for k in range(1, widest + 1) for i in range(n - k + 1)])


def _merits(cos: np.ndarray, size: int, widest: int, windows: np.ndarray, of: np.ndarray | None, facing: np.ndarray | None, whole: float) -> None:
    """Zeroes in place the cosines of windows (rows: single sentences first, then wider ones) with single sentences (columns)
    where a window is not worth more than what it is made of, or the sentence facing it is too short."""
    before, at = cos[:size], size
    for k in range(2, min(widest, size) + 1):
        rows = size - k + 1
        inner = np.maximum(before[:rows], before[1 : rows + 1])
        now = cos[at : at + rows]
        now *= now >= inner
        before, at = np.maximum(inner, now), at + rows
    if of is not None:
        total = np.concatenate([[0], np.cumsum(of)])
        cos[size:] *= facing >= (whole * (total[windows[size:, 1]] - total[windows[size:, 0]]))[:, None]


def _top(best: np.ndarray, cos: np.ndarray) -> np.ndarray:
    """The largest values of each row among those so far and new ones; as many as best has columns."""
    k = best.shape[1]
    both = np.concatenate([best, cos], 1)
    return np.partition(both, both.shape[1] - k, axis=1)[:, both.shape[1] - k :]


def _norms(x: np.ndarray, widest: int) -> list[np.ndarray]:
    """For each width the reciprocal norms of the sums of so many rows, by the first of them."""
    n = len(x)
    near = [np.einsum("ij,ij->i", x[: n - d], x[d:]) for d in range(min(widest, n))]
    square = [near[0]]
    for k in range(2, len(near) + 1):
        square.append(square[-1][:-1] + near[0][k - 1 :] + 2 * sum(near[d][k - 1 - d :] for d in range(1, k)))
    return [1 / np.sqrt(np.maximum(q, 1e-12)) for q in square]


def _lengths(x: np.ndarray, widest: int) -> np.ndarray:
    """Reciprocal norms of the sums of windows, in the order of _windows."""
    return np.concatenate(_norms(x, widest))


def _cosines(dots: np.ndarray, scale: np.ndarray, facing: np.ndarray, widest: int) -> np.ndarray:
    """Cosines of windows (rows) with single sentences (columns): products of sums are sums of products."""
    dots = dots * facing
    rows = [dots]
    for k in range(2, min(widest, len(dots)) + 1):
        rows.append(rows[-1][:-1] + dots[k - 1 :])
    cos = np.concatenate(rows)
    cos *= scale[:, None]
    return cos


def _pieces(src, tgt, a, b, la, lb, widest, least, near, sizes, whole, step) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(source window, target window, score) of all pairs whose cosine is at least `least`, in order of the windows, as
    from one matrix of all windows. Windows of either side meet the single sentences of the other `step` at a time, so that beside the candidates no
    matrix of all windows is held, however long the texts."""
    n, m = len(src), len(tgt)
    ls, lt = sizes if sizes is not None else (None, None)
    kt, ks = min(near, m), min(near, n)
    top_a, top_b = np.full((len(a), kt), -np.inf, np.float32), np.full((len(b), ks), -np.inf, np.float32)
    xs, ys, values = [], [], []
    for j in range(0, m, step):
        cos = _cosines(src @ tgt[j : j + step].T, la, lb[:m][j : j + step], widest)
        _merits(cos, n, widest, a, ls, None if lt is None else lt[j : j + step], whole)
        top_a = _top(top_a, cos)
        top_b[j : j + cos.shape[1]] = _top(top_b[j : j + cos.shape[1]], cos[:n].T)
        x, y = np.nonzero(cos >= least)
        xs.append(x.astype(np.int32)), ys.append((y + j).astype(np.int32)), values.append(cos[x, y])
    for i in range(0, n, step):
        cos = _cosines(tgt @ src[i : i + step].T, lb, la[:n][i : i + step], widest)
        _merits(cos, m, widest, b, lt, None if ls is None else ls[i : i + step], whole)
        top_b[m:] = _top(top_b[m:], cos[m:])
        y, x = np.nonzero(cos[m:] >= least)
        xs.append((x + i).astype(np.int32)), ys.append((y + m).astype(np.int32)), values.append(cos[y + m, x])
    x, y, value = np.concatenate(xs), np.concatenate(ys), np.concatenate(values)
    order = np.argsort(x.astype(np.int64) * len(b) + y)
    x, y, value = x[order], y[order], value[order]
    return x, y, value - 0.25 * (top_a.mean(1)[x] + top_b.mean(1)[y])


#: Cells of a matrix of cosines that are held at a time.
CELLS = 4_000_000


def align(src: np.ndarray, tgt: np.ndarray, widest: int = 3, least: float = 0.15, near: int = 3, sizes: tuple[np.ndarray, np.ndarray] | None = None, whole: float = 0.55) -> list[tuple[int, int]]:
    """Pairs (source sentence, target sentence) of matched windows.

    src, tgt: sentence vectors. Windows of up to `widest` sentences on one side face single sentences on the other;
    each pair of windows scores its cosine less half the mean of the `near` best of either window (margin). The best
    pair of all is a mutual nearest neighbour: it is taken, its sentences leave, and so on; order plays no part. A
    window counts only if its cosine is not below that of the windows inside it and, where sizes (words of the
    sentences of either side) are given, the sentence facing it has at least `whole` of its words."""
    n, m = len(src), len(tgt)
    if not n or not m:
        return []
    a, b = _windows(n, widest), _windows(m, widest)
    la, lb = _lengths(src, widest), _lengths(tgt, widest)
    out = []
    if len(a) * len(b) <= CELLS:  # the usual text: one matrix of all windows
        ls, lt = sizes if sizes is not None else (None, None)
        dots = src @ tgt.T
        cos = np.zeros((len(a), len(b)), np.float32)
        cos[:, :m] = _cosines(dots, la, lb[:m], widest)
        _merits(cos[:, :m], n, widest, a, ls, lt, whole)
        if len(b) > m:
            turned = _cosines(dots.T, lb, la[:n], widest)
            _merits(turned, m, widest, b, lt, ls, whole)
            cos[:n, m:] = turned[m:].T
        kt, ks = min(near, m), min(near, n)
        base_a = np.partition(cos[:, :m], m - kt, axis=1)[:, m - kt :].sum(1) / kt
        base_b = np.partition(cos[:n], n - ks, axis=0)[n - ks :].sum(0) / ks
        x, y = np.nonzero(cos >= least)
        score = cos[x, y] - 0.25 * (base_a[x] + base_b[y])
    else:
        x, y, score = _pieces(src, tgt, a, b, la, lb, widest, least, near, sizes, whole, max(1, CELLS // (len(a) + len(b))))
    order = np.argsort(-score, kind="stable")
    free_s, free_t, left = [True] * n, [True] * m, min(n, m)
    for (i0, i1), (j0, j1) in zip(a[x[order]].tolist(), b[y[order]].tolist()):
        if all(free_s[i0:i1]) and all(free_t[j0:j1]):
            for i in range(i0, i1):
                free_s[i] = False
                for j in range(j0, j1):
                    out.append((i, j))
            for j in range(j0, j1):
                free_t[j] = False
            left = min(left - 1, sum(free_s), sum(free_t))
            if left <= 0:
                break
    return out


#: Sentences of a text that is compared together with others, and cells of single sentences that are held then.
SHORT, SHORT_CELLS = 60, 20_000


def _side(first: np.ndarray, count: np.ndarray, inverse: list[np.ndarray], total: np.ndarray, widest: int) -> tuple[np.ndarray, ...]:
    """Of texts side by side: places of their sentences and whether they are there; and of their windows by width and
    beginning, as many for each text: reciprocal norms (0 of one that is not there), words, and sentences as bits."""
    size = int(count.max())
    here = np.arange(size) < count[:, None]
    at = np.where(here, first[:, None] + np.arange(size), 0)
    scale, words, bits = [], [], []
    for k in range(1, min(widest, size) + 1):
        i, full = at[:, : size - k + 1], here[:, k - 1 :]
        i = np.where(full, i, 0)
        scale.append(np.where(full, inverse[k - 1][i], np.float32(0)))
        words.append(total[i + k] - total[i])
        bits += [((1 << k) - 1) << j for j in range(size - k + 1)]
    return at, here, np.concatenate(scale, 1), np.concatenate(words, 1), np.array(bits, np.int64)


def _faced(dots: np.ndarray, scale: np.ndarray, facing: np.ndarray, widest: int, words: np.ndarray, least_words: np.ndarray, whole: float) -> np.ndarray:
    """_cosines and _merits of many texts: [text, window, single sentence of the other side]."""
    size = dots.shape[1]
    dots = dots * facing[:, None]
    rows = [dots]
    for k in range(2, min(widest, size) + 1):
        rows.append(rows[-1][:, :-1] + dots[:, k - 1 :])
    cos = np.concatenate(rows, 1)
    cos *= scale[:, :, None]
    before, at = cos[:, :size], size
    for k in range(2, min(widest, size) + 1):
        n = size - k + 1
        inner = np.maximum(before[:, :n], before[:, 1 : n + 1])
        now = cos[:, at : at + n]
        now *= now >= inner
        before, at = np.maximum(inner, now), at + n
    cos[:, size:] *= least_words[:, None] >= whole * words[:, size:, None]
    return cos


def _base(cos: np.ndarray, here: np.ndarray, near: int) -> np.ndarray:
    """Means of the `near` largest values along the last axis, of those that are there."""
    x = np.where(here[:, None], cos, -np.inf)
    if x.shape[2] > near:
        x = np.partition(x, x.shape[2] - near, axis=2)[:, :, x.shape[2] - near :]
    return np.where(x == -np.inf, 0, x).sum(2) / np.minimum(near, here.sum(1))[:, None].astype(np.float32)


def align_all(src: np.ndarray, tgt: np.ndarray, n: np.ndarray, m: np.ndarray, widest: int = 3, least: float = 0.15, near: int = 3, sizes: tuple[np.ndarray, np.ndarray] | None = None, whole: float = 0.55) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, source sentence, target sentence) of matched windows, as `align` finds them in each of many texts, of which
    one has n and m sentences and the next ones follow; in order of the texts. Short texts of like length are compared at
    once, padded to the longest."""
    s_first, t_first = np.cumsum(n) - n, np.cumsum(m) - m
    ls, lt = sizes if sizes is not None else (np.ones(len(src), np.int64), np.ones(len(tgt), np.int64))
    short = (n > 0) & (m > 0) & (n <= SHORT) & (m <= SHORT)
    out: list[tuple[np.ndarray, ...]] = [(np.zeros(0, np.int64),) * 3]
    for i in np.flatnonzero((n > 0) & (m > 0) & ~short).tolist():
        s, t = slice(s_first[i], s_first[i] + n[i]), slice(t_first[i], t_first[i] + m[i])
        pairs = np.array(align(src[s], tgt[t], widest, least, near, None if sizes is None else (ls[s], lt[t]), whole), np.int64).reshape(-1, 2)
        out.append((np.full(len(pairs), i), pairs[:, 0], pairs[:, 1]))
    if short.any():
        inverse = _norms(src, widest), _norms(tgt, widest)
        totals = np.concatenate([[0], np.cumsum(ls)]), np.concatenate([[0], np.cumsum(lt)])
        order = np.lexsort((m, n))
        order = order[short[order]]
        at = 0
        while at < len(order):
            longest = np.maximum.accumulate(n[order[at : at + SHORT_CELLS]]) * np.maximum.accumulate(m[order[at : at + SHORT_CELLS]])
            among = order[at : at + max(1, int(np.searchsorted(longest * np.arange(1, len(longest) + 1), SHORT_CELLS, side="right")))]
            at += len(among)
            i, j, a_here, b_here, a_scale, b_scale, a_words, b_words, a_bits, b_bits = chain.from_iterable(zip(_side(s_first[among], n[among], inverse[0], totals[0], widest), _side(t_first[among], m[among], inverse[1], totals[1], widest)))
            size_a, size_b = i.shape[1], j.shape[1]
            dots = src[i] @ tgt[j].transpose(0, 2, 1)
            enough = (0, 0) if sizes is None else (lt[j], ls[i])
            wide_a = _faced(dots, a_scale, b_scale[:, :size_b], widest, a_words, np.broadcast_to(enough[0], j.shape), whole if sizes is not None else 0)
            wide_b = _faced(dots.transpose(0, 2, 1), b_scale, a_scale[:, :size_a], widest, b_words, np.broadcast_to(enough[1], i.shape), whole if sizes is not None else 0)
            base_a, base_b = _base(wide_a, b_here, near), _base(wide_b, a_here, near)
            d1, x1, y1 = np.nonzero(wide_a >= least)
            d2, y2, x2 = np.nonzero(wide_b[:, size_b:] >= least)
            y2 = y2 + size_b
            d, x, y = np.concatenate([d1, d2]), np.concatenate([x1, x2]), np.concatenate([y1, y2])
            score = np.concatenate([wide_a[d1, x1, y1], wide_b[d2, y2, x2]]) - 0.25 * (base_a[d, x] + base_b[d, y])
            by = np.lexsort((y, x, -score, d))
            d, x, y = d[by], x[by], y[by]
            taken, now, used_a, used_b = [], -1, 0, 0
            for k, (text, p, q) in enumerate(zip(d.tolist(), a_bits[x].tolist(), b_bits[y].tolist())):
                if text != now:
                    now, used_a, used_b = text, 0, 0
                if not (p & used_a or q & used_b):
                    used_a |= p
                    used_b |= q
                    taken.append(k)
            d, x, y = d[taken], x[taken], y[taken]
            (x, wx), (y, wy) = _window(x, size_a, widest), _window(y, size_b, widest)
            times = wx * wy  # one of the two is a single sentence
            step = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            out.append((among[np.repeat(d, times)], np.repeat(x, times) + step * (np.repeat(wx, times) > 1), np.repeat(y, times) + step * (np.repeat(wy, times) > 1)))
    text, x, y = (np.concatenate(v) for v in zip(*out))
    order = np.argsort(text, kind="stable")
    return text[order], x[order], y[order]


def _window(x: np.ndarray, size: int, widest: int) -> tuple[np.ndarray, np.ndarray]:
    """First sentence and width of windows by their number."""
    w = _windows(size, widest)[x].reshape(-1, 2)
    return w[:, 0], w[:, 1] - w[:, 0]
