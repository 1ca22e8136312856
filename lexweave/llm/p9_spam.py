"""Problem 9: keyword-stuffed pages and link lists.

Method: a hidden Markov model labels the segments of a page (lines, cut at sentence ends) as prose, link list, tag list,
menu (products, offers), stuffed sentences or reference matter (contents, index, bibliography, cast, word list: a book's own lists). Each
segment is seen as binary features. Emissions and transitions start from a stated table and are re-estimated over all
pages by expectation-maximisation (forward-backward, expected counts summed over partitions, the table as prior, whose
weight is a multiple of the corpus, so that it acts alike at every size). Features and posteriors are worked out in numpy
for a batch of pages at once, in time proportional to the text. A page
is flagged when segments that are most likely link list, tag list, menu or stuffed hold more than half of its words.

Nulls: null, empty and blank texts are not flagged and give no row; a null doc_id gives none. Repeated pages are each
judged. Extra columns are not read. Long pages are read whole.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship_package, stage
from .batches import pieces
from .hashed import SpanHash, codes_of, counts_within, first_of, hashes_of, is_among, look_up, spans
from .textkit import SENTENCE_END, _INVISIBLE_RE

STATES = ("prose", "link", "tag", "menu", "stuffed", "reference")
FEATURES = ("link", "hashtag", "sentence", "function_words", "repeated", "product", "stuffed", "page_reference", "separators", "head_repeated", "short", "running")
#: Start of the emissions: how often each feature (rows as in FEATURES) shows in each state (columns as in STATES).
EMISSIONS = np.array([
    [0.01, 0.97, 0.02, 0.02, 0.02, 0.01],
    [0.005, 0.01, 0.35, 0.01, 0.01, 0.001],
    [0.85, 0.02, 0.10, 0.02, 0.90, 0.15],
    [0.90, 0.10, 0.25, 0.10, 0.70, 0.50],
    [0.005, 0.30, 0.60, 0.25, 0.10, 0.02],
    [0.005, 0.05, 0.03, 0.95, 0.02, 0.03],
    [0.003, 0.10, 0.30, 0.10, 0.80, 0.02],
    [0.01, 0.01, 0.01, 0.03, 0.01, 0.93],
    [0.02, 0.05, 0.55, 0.05, 0.05, 0.10],
    [0.003, 0.30, 0.50, 0.40, 0.35, 0.15],
    [0.10, 0.40, 0.50, 0.30, 0.15, 0.50],
    [0.75, 0.03, 0.05, 0.04, 0.70, 0.15],
])
#: How likely a segment has the state of the one before it; weight of the start table beside the corpus's own counts.
STAY, PRIOR = 0.9, 3.0

# Patterns over segments, one a line; [^\S\n] is a blank inside a line.
_LINK = re.compile(r"(?:https?://|www\.)\S+|\]\([^\S\n]*(?!#)[^()\s]+\)|<a\s[^<>\n]*>", re.I)
_HOSTED = re.compile(r"(?<=[\w-])\.(?:com|org|net|info|example|test|invalid|io|biz|[a-z]{2})/\S*", re.I)
_HASHTAG = re.compile(r"(?<![\w&])#\w[\w-]*")
_PRODUCT = re.compile(r"\b\d+[.,]\d{2}\b|-\d+[^\S\n]?%|\bSKU\b|\bin stock\b|[$€£][^\S\n]?\d", re.I)
_LEADER = r"(?<!\.)(?<!\.[^\S\n])(?:\.[^\S\n]?){3,}+[^\S\n]*+\d+$"
_LISTED = rf"{_LEADER}|,[^\S\n]*\d{{1,4}}$|\b(?:1[5-9]|20)\d\d\.?$|\b\d+[^\S\n]*p\."
_REFERENCE = re.compile(_LISTED, re.M)
_ENTRY = re.compile(r"\S[^\S\n][—–=][^\S\n]\S|\]\(#")
_PAGES = re.compile(rf"{_LISTED}|{_ENTRY.pattern}", re.M)
_CAST = re.compile(r"^[^\w\n]*[^\W\d_]\w+ [^\W\d_]\w+, \S+(?: \S+){0,4}$", re.M)
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
_ENDS = re.compile(r"[.!?…](?:[^\S\n]?»|[\"”“’'*)\]])*$", re.M)
_HEADING = re.compile(r"#+\s")
#: A line of so many words at most with page numbers, a year or pages at its end is one entry of a list, whatever dots it
#: has; with a dash between two words it is one up to the second figure.
ENTRY_WORDS, PAIR_WORDS = 40, 12
_SEPARATORS = tuple(map(ord, ",;|•·/"))


def cut_line(line: str, out: list[str]) -> None:
    """Adds a line's segments to out: cut at sentence ends behind three words at least. Linear in the line."""
    ends = [m.end() for m in SENTENCE_END.finditer(line)]
    if not ends or ends[0] >= len(line):
        out.append(line)
        return
    words, at = [], 0
    for e in [*ends, len(line)]:
        words.append(len(_WORD.findall(line, at, e)))
        at = e
    total = sum(words)
    if total <= ENTRY_WORDS and _REFERENCE.search(line) or total <= PAIR_WORDS and _ENTRY.search(line):
        out.append(line)
        return
    at = n = 0
    for e, w in zip(ends, words):
        n += w
        if n >= 3:
            out.append(line[at:e].strip())
            at, n = e, 0
    if rest := line[at:].strip():
        out.append(rest)


def segments_of(text: str) -> list[str]:
    """Lines, cut further at sentence ends; headings (# Title) and blank lines are left out."""
    out: list[str] = []
    for line in _INVISIBLE_RE.sub("", text).split("\n"):
        line = line.strip()
        if line and not (line[0] == "#" and _HEADING.match(line)):
            cut_line(line, out)
    return out


def _at(pattern: re.Pattern, text: str) -> np.ndarray:
    return np.fromiter((m.start() for m in pattern.finditer(text)), np.int64)


def features_of(texts: list[str], function_words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of many pages at once: feature bits and size (about words) of each segment, and how many segments each page has.
    function_words: their hashes, ascending."""
    per_page = [segments_of(t) for t in texts]
    n_of = np.array([len(p) for p in per_page], np.int64)
    n = int(n_of.sum())
    if not n:
        return np.zeros(0, np.int32), np.zeros(0, np.int32), n_of
    page = np.repeat(np.arange(len(texts)), n_of)
    text = "\n".join([s for p in per_page for s in p]) + "\n"
    codes = codes_of(text)
    low = look_up("lower", codes)
    end = np.flatnonzero(codes == 10)
    start = np.concatenate([[0], end[:-1] + 1])
    segment = lambda at: np.searchsorted(end, at)
    tally = lambda at: np.bincount(segment(at), minlength=n)

    # links, and what is left without them
    found = [m.span() for m in _LINK.finditer(text)]
    taken = np.zeros(len(codes) + 1, np.int8)
    for a, b in found:
        taken[a:b] = 1
    if "/" in text:
        for m in _HOSTED.finditer(text):
            a, b = m.span()
            while a and (text[a - 1].isalnum() or text[a - 1] in "_-."):
                a -= 1
            if not taken[a] and not taken[b - 1]:
                found.append((a, b))
                taken[a:b] = 1
    links = tally(np.array([a for a, _ in found], np.int64))
    taken = taken[:-1].astype(bool)

    # words
    letter = look_up("letter", codes) & ~taken
    mark = np.flatnonzero((codes == 0x27) | (codes == 0x2019))
    mark = mark[(mark > 0) & (mark < len(codes) - 1)]
    letter[mark[letter[mark - 1] & letter[mark + 1]]] = True
    w0, w1 = spans(letter)
    ws = segment(w0)
    words = SpanHash(low)
    w = words.of(w0, w1)
    n_words = np.bincount(ws, minlength=n)
    common = is_among(w, function_words)
    content = ~common & (w1 - w0 > 3)
    first_word = np.searchsorted(ws, np.arange(n))
    blank = look_up("space", codes)
    piece_start = ~blank & np.concatenate([[True], blank[:-1]])
    piece_sum = np.concatenate([[0], np.cumsum(piece_start)])
    n_pieces = piece_sum[end] - piece_sum[start]

    # items between separators
    sep = blank & (codes == 10)
    for c in _SEPARATORS:
        sep |= codes == c
    dash = np.flatnonzero(codes == 45)
    dash = dash[(dash > 0) & (dash < len(codes) - 1)]
    sep[dash[blank[dash - 1] & blank[dash + 1]]] = True
    cut = np.flatnonzero(sep)
    i0, i1 = np.concatenate([[0], cut[:-1] + 1]), cut
    solid = ~(blank | (codes == 46) | (codes == 42) | (codes == 45))
    at = np.arange(len(codes))
    ahead = np.minimum.accumulate(np.where(solid, at, len(codes))[::-1])[::-1]
    back = np.maximum.accumulate(np.where(solid, at, -1))
    a, b = ahead[np.minimum(i0, len(codes) - 1)], back[np.maximum(i1 - 1, 0)] + 1
    real = (a < i1) & (b > a) & (b <= i1)
    i0, i1 = a[real], b[real]
    item_seg = segment(i0)
    item = words.of(i0, i1)
    brief = piece_sum[i1] - piece_sum[i0] + ~piece_start[i0] <= 5
    pages = tally(_at(_PAGES, text)) > 0
    n_items = np.bincount(item_seg, minlength=n)
    n_low = np.bincount(item_seg[brief], minlength=n)
    counted = brief & ~pages[item_seg]
    seen = np.zeros(len(item), np.int64)  # how often the page has it outside reference lines
    if counted.any():
        key = np.concatenate([item[counted], item[brief]])
        group = np.concatenate([page[item_seg[counted]], page[item_seg[brief]]])
        seen[brief] = counts_within(group, key)[int(counted.sum()) :] - counts_within(page[item_seg[brief]], item[brief])
    often = np.bincount(item_seg[brief & (seen >= 3)], minlength=n)

    # pairs of words that the page repeats
    inner = np.flatnonzero(ws[1:] == ws[:-1]) if len(ws) else np.zeros(0, np.int64)
    pair = w[inner] * np.uint64(3) + w[inner + 1]
    same = np.bincount(ws[inner[counts_within(page[ws[inner]], pair) >= 3]], minlength=n)

    # words that many different segments of the page have
    whole = np.zeros(n, np.uint64)
    has = np.flatnonzero(n_words)
    if len(has):
        whole[has] = np.add.reduceat(w * (np.arange(len(w), dtype=np.uint64) - np.repeat(first_word[has], n_words[has]).astype(np.uint64) + np.uint64(1)), first_word[has])
    new = first_of(page, whole)  # a refrain counts once
    mine = content & new[ws]
    k = counts_within(page[ws[mine]], w[mine])
    total = np.bincount(page[ws[mine]], minlength=len(texts))
    top_of = (k >= 5) & (k >= 0.12 * total[page[ws[mine]]])
    top = np.zeros(len(w), bool)
    if top_of.any():
        key = lambda p, x: x + p.astype(np.uint64) * np.uint64(0xA24BAED4963EE407)
        top = is_among(key(page[ws], w), np.unique(key(page[ws[mine][top_of]], w[mine][top_of])))
    n_top = np.bincount(ws[top], minlength=n)
    best = np.zeros(n, np.int64)
    np.maximum.at(best, ws[content], counts_within(ws[content], w[content]))

    # first words of short segments that differ
    some = np.flatnonzero((n_words >= 1) & (n_words <= 7))
    apart = some[new[some]]
    head_n = np.zeros(n, np.int64)
    both = counts_within(np.concatenate([page[apart], page[some]]), np.concatenate([w[first_word[apart]], w[first_word[some]]]))[len(apart) :]
    head_n[some] = both - counts_within(page[some], w[first_word[some]])
    heads = np.bincount(page[apart], minlength=len(texts))[page]
    head_common = np.zeros(n, bool)
    head_common[some] = common[first_word[some]]

    ends = tally(_at(_ENDS, text)) > 0
    tags = tally(_at(_HASHTAG, text))
    product = tally(_at(_PRODUCT, text)) > 0
    pages = pages & (links == 0) | (tally(_at(_CAST, text)) > 0) & (n_items == 2) & ~ends
    n1 = np.maximum(n_words, 1)
    n_common = np.bincount(ws[common], minlength=n)
    small = codes[w0] == low[w0]
    n_small = np.bincount(ws[small], minlength=n)
    capital = np.zeros(n, bool)
    capital[has] = ~small[first_word[has]]
    repeated = (n_low >= 1) & (n_items <= np.maximum(2, 2 * n_low)) & (often >= 0.4 * n_items) & ~(ends & (n_items < 4))
    f = (
        (links > 0) & ((3 * links >= n1) | (links >= 3) | (n1 <= 8)),
        (tags > 0) & (2 * tags >= n_pieces),
        ends & (n_words >= 3),
        n_common >= 0.12 * n1,
        repeated | (n_words >= 8) & ~ends & (same >= 0.3 * (n_words - 1)),
        product & (n1 <= 12) & ~pages,
        (n_words >= 5) & ((best >= 3) & (best >= 0.2 * n1) | (n_top > 0) & (n_top >= 0.2 * n1)),
        pages,
        (n_items >= 4) & (n_low >= 0.8 * n_items),
        (n_words >= 1) & (n_words <= 7) & ~head_common & (head_n >= 4) & (5 * head_n >= heads) & ~pages,
        n_words <= 4,
        (n_words >= 4) & (n_items <= 3) & capital & (n_small >= 0.4 * (n_words - 1)),
    )
    bits = sum(x.astype(np.int32) << i for i, x in enumerate(f))
    size = np.maximum(np.maximum(n_pieces, links), (end - start) // 8)  # an address is long
    return bits.astype(np.int32), size.astype(np.int32), n_of


def function_words_of(samples: DataFrame, share: float = 0.1, long_share: float = 0.25, max_samples: int = 20_000) -> frozenset[str]:
    """Words found in at least `share` of the clean samples of a language, those of four to six letters in `long_share`; from at most
    max_samples of them."""
    rows = samples.select("lang", "text").filter("text is not null").orderBy("sample_id").limit(max_samples).collect()
    docs = Counter(r.lang for r in rows)
    seen = Counter((r.lang, w) for r in rows for w in {w.lower() for w in _WORD.findall(r.text)})
    return frozenset(w for (lang, w), n in seen.items() if len(w) <= 6 and n >= max(3, (share if len(w) < 4 else long_share) * docs[lang]))


class PageModel:
    """Emission, transition and start probabilities."""

    def __init__(self, emit: np.ndarray | None = None, move: np.ndarray | None = None, first: np.ndarray | None = None):
        k = len(STATES)
        self.emit = EMISSIONS.copy() if emit is None else emit
        self.move = np.full((k, k), (1 - STAY) / (k - 1)) + np.eye(k) * (STAY - (1 - STAY) / (k - 1)) if move is None else move
        self.first = np.array([0.6, 0.1, 0.1, 0.05, 0.05, 0.1]) if first is None else first

    def likelihood(self, bits: np.ndarray) -> np.ndarray:
        x = (bits[:, None] >> np.arange(len(FEATURES))) & 1
        logp = x @ np.log(self.emit) + (1 - x) @ np.log(1 - self.emit)
        return np.exp(logp - logp.max(1, keepdims=True))

    def posterior(self, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Posterior of each segment's state of one page and the expected transitions."""
        g, moves, _ = self.posteriors(bits, np.array([len(bits)]))
        return g, moves

    def posteriors(self, bits: np.ndarray, n_of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Scaled forward-backward over many pages at once, whose segments follow each other in bits: posterior of each
        segment, expected transitions of all, and the posterior of the first segments summed up. Pages are taken the longest first, so
        that those which reach a step stand together."""
        k = len(STATES)
        b = self.likelihood(bits)
        order = np.argsort(-n_of, kind="stable")
        first = np.concatenate([[0], np.cumsum(n_of)])[:-1][order]
        size = n_of[order]
        live = len(size) - np.searchsorted(size[::-1], np.arange(1, (size[0] if len(size) else 0) + 1))
        alpha, beta = np.empty((len(bits), k)), np.ones((len(bits), k))
        moves = np.zeros((k, k))
        for t, m in enumerate(live):
            at = first[:m] + t
            a = (self.first if t == 0 else alpha[at - 1] @ self.move) * b[at]
            alpha[at] = a / a.sum(1, keepdims=True)
        for t in range(len(live) - 2, -1, -1):
            at = first[: live[t + 1]] + t
            next_ = b[at + 1] * beta[at + 1]
            v = next_ @ self.move.T
            beta[at] = v / v.sum(1, keepdims=True)
            x = alpha[at]
            # each transition matrix sums to alpha . v
            moves += (x / (x * v).sum(1, keepdims=True)).T @ next_ * self.move
        g = alpha * beta
        g /= g.sum(1, keepdims=True)
        return g, moves, g[first[size > 0]].sum(0)


PAGES = "doc_id long, bits array<int>, words array<int>"


def _list(offsets: np.ndarray, values: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, pa.int32()))


def encode_pages(documents: DataFrame, function_words: frozenset[str]) -> DataFrame:
    ship_package(documents.sparkSession)
    known = np.sort(hashes_of(sorted(function_words)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in pieces({"doc_id": batch.column(0).to_pylist(), "text": batch.column(1).to_pylist()}, ("text",)):
                bits, words, n_of = features_of(c["text"], known)
                offsets = np.concatenate([[0], np.cumsum(n_of)])
                yield pa.RecordBatch.from_arrays([pa.array(c["doc_id"], pa.int64()), _list(offsets, bits), _list(offsets, words)], ["doc_id", "bits", "words"])

    rows = documents.select("doc_id", "text").filter("doc_id is not null and text is not null and trim(text) <> ''")
    return rows.mapInArrow(run, PAGES)


def _flat(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    offsets = column.offsets.to_numpy()
    return column.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]], np.diff(offsets).astype(np.int64)


def fit_page_model(pages: DataFrame, rounds: int = 2, prior: float = PRIOR) -> PageModel:
    """Expectation-maximisation over all pages; the start table counts `prior` times as much as all segments together, a
    state's share of it equal, so that a corpus of any size moves it alike."""
    model, k = PageModel(), len(STATES)
    sc = pages.sparkSession.sparkContext
    start = PageModel()
    for _ in range(rounds):
        shared = sc.broadcast((model.emit, model.move, model.first))

        def expect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            m = PageModel(*shared.value)
            flat = np.zeros(k + k * k + k + len(FEATURES) * k)
            for batch in batches:
                bits, n_of = _flat(batch.column(0))
                if len(bits):
                    g, moves, first = m.posteriors(bits, n_of)
                    on = ((bits[:, None] >> np.arange(len(FEATURES))) & 1).T @ g
                    flat += np.concatenate([g.sum(0), moves.ravel(), first, on.ravel()])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat), dtype=np.int32)), pa.array(flat)], ["i", "x"])

        got = pages.select("bits").mapInArrow(expect, "i int, x double").groupBy("i").agg(F.sum("x").alias("x")).collect()  # about a hundred numbers
        flat = np.zeros(k + k * k + k + len(FEATURES) * k)
        for r in got:
            flat[r.i] = r.x
        seen, moves, first, on = flat[:k], flat[k : k + k * k].reshape(k, k), flat[k + k * k : 2 * k + k * k], flat[2 * k + k * k :].reshape(len(FEATURES), k)
        p = prior * seen.sum() / k + 1e-9
        move = moves + p * start.move
        model = PageModel(((on + p * start.emit) / (seen + p)).clip(1e-3, 1 - 1e-3), move / move.sum(1, keepdims=True), (first + prior * first.sum() * start.first + 1e-9 * start.first) / ((1 + prior) * first.sum() + 1e-9))
        shared.unpersist()
    return model


def judge_pages(documents: DataFrame, function_words: frozenset[str], prior: float = PRIOR) -> DataFrame:
    """doc_id, words, and the share of words in each kind of segment."""
    pages = stage(encode_pages(documents, function_words), "pages")
    shared = pages.sparkSession.sparkContext.broadcast(fit_page_model(pages, prior=prior).__dict__)
    k = len(STATES)

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = PageModel(**shared.value)
        for batch in batches:
            bits, n_of = _flat(batch.column(1))
            words, _ = _flat(batch.column(2))
            state = m.posteriors(bits, n_of)[0].argmax(1) if len(bits) else np.zeros(0, np.int64)
            page = np.repeat(np.arange(len(n_of)), n_of)
            share = np.bincount(page * k + state, weights=words, minlength=len(n_of) * k).reshape(-1, k)
            total = share.sum(1)
            share /= np.maximum(total, 1)[:, None]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(total.astype(np.int64)), *[pa.array(share[:, i]) for i in range(k)]], ["doc_id", "words", *STATES])

    return pages.mapInArrow(label, "doc_id long, words long, " + ", ".join(f"{s} double" for s in STATES))


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = function_words_of(spark.read.parquet(f"{sf_dir}/lang_samples.parquet"))
    return judge_pages(spark.read.parquet(f"{sf_dir}/documents.parquet"), words)


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _judged(spark, sf_dir).filter("link + tag + menu + stuffed > 0.5").select("doc_id")


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _judged(spark, sf_dir)


QUERIES = {"p9_found": p9_found, "p9_shares": p9_shares}
