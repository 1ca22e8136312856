"""Words of a batch as numbers: spans and 64-bit hashes of all words of one long string, worked out in numpy.

Prefix sums of c[i] * B^i (mod 2^64, B odd) give the hash of any span by one subtraction and one product, so that words,
items and n-grams are compared as integers and no Python object is made for them.
"""

from __future__ import annotations

import unicodedata

import numpy as np

_B = 0x9E3779B97F4A7C15 | 1
_B_INVERSE = pow(_B, -1, 1 << 64)
#: Code points above this are no letters here.
TOP = 0x30000
_TABLES: dict[str, np.ndarray] = {}
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def codes_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "replace"), dtype=np.uint32)


def table(name: str) -> np.ndarray:
    """By code point: `letter`, `digit` (bool), `space` (bool, as str.isspace), `lower` and `fold` (lower case; without accents)."""
    if name not in _TABLES:
        chars = [chr(i) for i in range(TOP)]
        if name == "letter":
            t = np.array([c.isalpha() for c in chars])
        elif name == "digit":
            t = np.array([c.isdigit() for c in chars])
        elif name == "space":
            t = np.array([c.isspace() for c in chars])
        else:
            t = np.arange(TOP, dtype=np.uint32)
            for i, c in enumerate(chars):
                if i >= 65 and c.isalpha():
                    low = c.lower()
                    if name == "fold" and 127 < i < 0x3000:
                        low = unicodedata.normalize("NFKD", low)[:1] or low
                    t[i] = ord(low[0])
        _TABLES[name] = t
    return _TABLES[name]


def look_up(name: str, codes: np.ndarray) -> np.ndarray:
    return table(name)[np.minimum(codes, TOP - 1)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        m = max(n, 2 * len(_POWERS[0]))
        for k, b in enumerate((_B, _B_INVERSE)):
            x = np.full(m, b, np.uint64)
            x[0] = 1
            _POWERS[k] = np.cumprod(x, dtype=np.uint64)
    return _POWERS[0][:n], _POWERS[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


class SpanHash:
    """Hashes of any spans of a string of codes."""

    def __init__(self, codes: np.ndarray):
        up, self.down = _powers(len(codes) + 1)
        self.sums = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * up[: len(codes)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start])


def spans(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true values."""
    edge = np.diff(np.concatenate([[0], inside.view(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def hashes_of(words: list[str], form: str = "lower") -> np.ndarray:
    """Hash of each word, as SpanHash gives it over codes of the same form."""
    ends = np.cumsum([len(w) for w in words], dtype=np.int64)
    starts = np.concatenate([[0], ends[:-1]]) if len(words) else ends
    return SpanHash(look_up(form, codes_of("".join(words)))).of(starts, ends)


def is_among(x: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """Whether each value is in an ascending array."""
    if not len(ordered):
        return np.zeros(len(x), bool)
    return ordered[np.minimum(np.searchsorted(ordered, x), len(ordered) - 1)] == x


def counts_within(group: np.ndarray, value: np.ndarray) -> np.ndarray:
    """How often each element's value occurs in its group (groups are small integers)."""
    if not len(value):
        return np.zeros(0, np.int64)
    order = np.lexsort((value, group))
    g, v = group[order], value[order]
    new = np.concatenate([[True], (g[1:] != g[:-1]) | (v[1:] != v[:-1])])
    run = np.cumsum(new) - 1
    out = np.empty(len(value), np.int64)
    out[order] = np.bincount(run)[run]
    return out


def first_of(group: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Whether an element is the first of its value in its group."""
    out = np.zeros(len(value), bool)
    if len(value):
        order = np.lexsort((np.arange(len(value)), value, group))
        g, v = group[order], value[order]
        out[order] = np.concatenate([[True], (g[1:] != g[:-1]) | (v[1:] != v[:-1])])
    return out
