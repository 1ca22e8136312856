"""Languages of texts and of stretches of texts: a multilingual mixture.

A character n-gram model is fitted on clean samples of known language. Each text is a mixture: expectation-maximisation
estimates the proportions of its languages from the n-gram likelihoods of its sentences, and the set of languages is
grown only while the likelihood rises by more than a penalty. All of it runs on whole batches in numpy.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from .textkit import LANGS, Sentences, space_mask

BITS = 18
K = len(LANGS)
ORDERS = (2, 3, 4)


def normal_codes(codes: np.ndarray) -> np.ndarray:
    """Lower-cased code points; everything that is no letter becomes a blank."""
    out = codes.copy()
    table = _lower_table()
    small = out < len(table)
    out[small] = table[out[small]]
    out[~small] = 32
    return out


_LOWER: np.ndarray | None = None


def _lower_table() -> np.ndarray:
    global _LOWER
    if _LOWER is None:
        t = np.full(0x2000, 32, dtype=np.uint32)
        for i in range(0x2000):
            c = chr(i)
            if c.isalpha():
                low = c.lower()
                t[i] = ord(low[0]) if len(low) == 1 else i
        _LOWER = t
    return _LOWER


def gram_hashes(codes: np.ndarray) -> list[np.ndarray]:
    """For each order the hashes of the n-grams that end at each position."""
    out, h = [], codes.astype(np.uint64)
    for n in range(2, max(ORDERS) + 1):
        shifted = np.empty_like(codes)
        shifted[: n - 1] = 32
        shifted[n - 1 :] = codes[: len(codes) - n + 1]
        h = h * np.uint64(0x100000001B3) + shifted.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        if n in ORDERS:
            x = h ^ (h >> np.uint64(29))
            out.append(((x * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - BITS)).astype(np.int32))
    return out


def gram_counts(text: str, weights: np.ndarray | None = None) -> np.ndarray:
    """Counts of hashed n-grams of a text; weights: of each character."""
    codes = normal_codes(np.frombuffer(text.encode("utf-32-le", "replace"), dtype=np.uint32))
    keep = ~((codes == 32) & (np.concatenate([[32], codes[:-1]]) == 32))
    w = None if weights is None else weights[keep]
    return sum(np.bincount(h, w, minlength=1 << BITS) for h in gram_hashes(codes[keep]))


@dataclass
class LanguageModel:
    """table: log P(gram | language) - mean over languages, float32 [2^BITS, K]; counts: what it was fitted on."""

    table: np.ndarray
    counts: np.ndarray | None = None

    @classmethod
    def of_counts(cls, counts: np.ndarray, alpha: float = 0.3) -> LanguageModel:
        total = counts.sum(0, keepdims=True)
        used = counts.sum(1) > 0
        logp = np.log((counts + alpha) / (total + alpha * max(used.sum(), 1)))
        logp[~used] = 0
        return cls((logp - logp.mean(1, keepdims=True)).astype(np.float32), counts)

    @classmethod
    def fit(cls, samples: list[tuple[str, int]]) -> LanguageModel:
        counts = np.zeros((1 << BITS, K))
        for k in range(K):
            text = "\x01".join(t for t, lang in samples if lang == k)
            counts[:, k] = gram_counts(f" {text} ")
        return cls.of_counts(counts)

    def adapted(self, counts: np.ndarray, weight: float = 20.0) -> LanguageModel:
        """With counts from a corpus besides, whose total in each language counts `weight` times that of the samples."""
        size = max(self.counts.sum(0).mean(), 1.0)
        total = counts.sum(0, keepdims=True)
        own = self.counts * size / np.maximum(self.counts.sum(0, keepdims=True), 1.0)
        return self.of_counts(own + np.where(total > 0, counts * weight * size / np.maximum(total, 1.0), own * weight))

    def score(self, s: Sentences) -> np.ndarray:
        """Log likelihood of each sentence in each language, up to a constant, [sentences, K]; overlapping n-grams
        count as one observation a character."""
        if not len(s):
            return np.zeros((0, K), np.float32)
        codes = normal_codes(s.codes)
        blank = codes == 32
        prev_blank = np.concatenate([[True], blank[:-1]])
        keep = ~(blank & prev_blank)
        pos = np.cumsum(keep) - 1
        codes = codes[keep]
        total = np.zeros((len(codes), K), np.float32)
        for h in gram_hashes(codes):
            total += self.table[h]
        at = np.clip(pos[s.start], 0, len(codes) - 1)
        sums = np.add.reduceat(total, at, axis=0) if len(at) else np.zeros((0, K), np.float32)
        return sums / len(ORDERS)

    def whole(self, texts: list[str]) -> np.ndarray:
        """Log likelihood of whole texts from their longest n-grams but one, [texts, K]; a quick first look."""
        if not texts:
            return np.zeros((0, K), np.float32)
        raw = np.frombuffer(("\x01".join(texts) + "\x01").encode("utf-32-le", "replace"), dtype=np.uint32)
        ends = np.flatnonzero(raw == 1)[-len(texts) :] if raw.size else np.zeros(0, np.int64)
        codes = normal_codes(raw)
        x = codes.astype(np.uint64)
        for n in (2, 3):
            shifted = np.empty_like(codes)
            shifted[: n - 1] = 32
            shifted[n - 1 :] = codes[: len(codes) - n + 1]
            x = x * np.uint64(0x100000001B3) + shifted.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(29)
        h = ((x * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - BITS)).astype(np.int32)
        return np.add.reduceat(self.table[h], np.concatenate([[0], ends[:-1] + 1]), axis=0)

    def words(self, s: Sentences) -> np.ndarray:
        """How many words (white-space pieces with a letter) each sentence has."""
        if not len(s):
            return np.zeros(0, np.int64)
        space = space_mask(s.codes) | (s.codes == 1)
        table = _letters()
        letter = table[np.minimum(s.codes, len(table) - 1)]
        idx = np.arange(len(s.codes))
        last_space = np.maximum.accumulate(np.where(space, idx, -1))
        last_letter = np.maximum.accumulate(np.where(letter, idx, -1))
        before = np.concatenate([[-1], last_letter[:-1]])
        first_in_piece = letter & (before < np.maximum(last_space, 0)) | (letter & (before == -1))
        return np.add.reduceat(first_in_piece.astype(np.int64), s.start)


_LETTERS: np.ndarray | None = None


def _letters() -> np.ndarray:
    global _LETTERS
    if _LETTERS is None:
        _LETTERS = np.array([chr(i).isalpha() for i in range(0x3000)] + [False])
    return _LETTERS


def mixture(scores: np.ndarray, doc: np.ndarray, n_docs: int, prior: np.ndarray | None = None, penalty: float = 6.0, rounds: int = 4, background: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Language of each sentence under each document's own mixture.

    prior: log weights [n_docs, K] of languages expected beforehand. Returns the language of each sentence, its
    posterior, and each document's proportions. A language enters a document's set only while the penalised
    likelihood rises: each further language costs `penalty` nats. background: log likelihood of each sentence in no
    language of the model, which lowers the posterior of text that none fits and decides nothing."""
    if not len(scores):
        return np.zeros(0, np.int64), np.zeros(0), np.zeros((n_docs, K))
    logp = scores.astype(np.float64)
    starts = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
    owner = doc[starts]
    seg = np.cumsum(np.concatenate([[0], (doc[1:] != doc[:-1]).astype(np.int64)]))
    pri = np.zeros((n_docs, K)) if prior is None else prior
    total = np.add.reduceat(logp, starts, axis=0) + pri[owner]
    allowed = np.zeros((len(starts), K), bool)
    best = total.argmax(1)
    allowed[np.arange(len(starts)), best] = True
    current = logp[np.arange(len(logp)), best[seg]]
    single = np.bincount(seg, minlength=len(starts)) == 1
    active = ~single
    for _ in range(K - 1):
        if not active.any():
            break
        rise = np.maximum(logp - current[:, None], 0)
        gain = np.add.reduceat(rise, starts, axis=0) + pri[owner] - pri[owner].max(1, keepdims=True)
        gain[allowed] = -np.inf
        pick = gain.argmax(1)
        grow = active & (gain[np.arange(len(starts)), pick] > penalty)
        if not grow.any():
            break
        allowed[grow, pick[grow]] = True
        inside = grow[seg]
        current[inside] = np.maximum(current[inside], logp[np.flatnonzero(inside), pick[seg][inside]])
        active = grow
    weights = np.where(allowed, 1.0, 0.0) / allowed.sum(1, keepdims=True)
    many = allowed.sum(1) > 1
    post = np.zeros_like(logp)
    for _ in range(rounds):
        with np.errstate(divide="ignore"):
            z = logp + np.log(weights)[seg]
        z -= z.max(1, keepdims=True)
        post = np.exp(z)
        post /= post.sum(1, keepdims=True)
        if not many.any():
            break
        weights = np.add.reduceat(post, starts, axis=0) + 0.1 * allowed
        weights /= weights.sum(1, keepdims=True)
    pick = post.argmax(1)
    # confidence against all languages, not only those of the set
    z = logp + pri[owner][seg]
    if background is not None:
        z = np.concatenate([z, background[:, None]], 1)
    z -= z.max(1, keepdims=True)
    free = np.exp(z)
    conf = free[np.arange(len(pick)), pick] / free.sum(1)
    shares = np.zeros((n_docs, K))
    shares[owner] = weights
    return pick, conf, shares
