"""Shared text rules of the training-data operators: language names, empty values, sentences, look-alikes.

Batches are handled as one long string plus offsets, so that Python-level work is per match and the rest is numpy.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import numpy as np

LANGS = ("English", "French", "German", "Spanish", "Italian", "Romanian", "Russian")

#: Names, ISO 639 codes and native names of each language, lower case.
LANGUAGE_NAMES = {
    "English": ("english", "en", "eng"),
    "French": ("french", "fr", "fra", "fre", "français", "francais"),
    "German": ("german", "de", "deu", "ger", "deutsch"),
    "Spanish": ("spanish", "es", "spa", "español", "espanol", "castellano"),
    "Italian": ("italian", "it", "ita", "italiano"),
    "Romanian": ("romanian", "ro", "ron", "rum", "română", "romana", "limba română"),
    "Russian": ("russian", "ru", "rus", "русский", "русский язык"),
}
K_LANGS = len(LANGS)
_BY_NAME = {n: lang for lang, names in LANGUAGE_NAMES.items() for n in names}


@lru_cache(maxsize=4096)
def language_of_label(label: str | None) -> int:
    """Index in LANGS of what a label names, -1 where it names none. Case, blanks and regions (en-GB) are ignored."""
    if not label:
        return -1
    key = unicodedata.normalize("NFC", label).strip().lower()
    lang = _BY_NAME.get(key) or _BY_NAME.get(re.split(r"[-_]", key, maxsplit=1)[0].strip())
    return LANGS.index(lang) if lang else -1


#: Characters that are drawn as nothing.
INVISIBLE = (
    r"\u00ad\u034f\u061c\u115f\u1160\u17b4\u17b5\u180b-\u180f\u200b-\u200f\u202a-\u202e\u2060-\u206f\u3164"
    r"\ufe00-\ufe0f\ufeff\uffa0\ufff9-\ufffb\U000e0000-\U000e0fff"
)
#: Placeholders that say there is nothing, letters only, lower case.
PLACEHOLDERS = (
    "null", "none", "nil", "nan", "na", "n/a", "no output", "no translation", "no text", "no content", "no response",
    "no answer", "no result", "empty", "blank", "missing", "undefined", "untranslated", "not translated", "not available",
    "nothing", "nothing to translate", "empty string", "empty response", "empty output", "translation missing", "no data",
)

#: What is left of a value once markup, punctuation, symbols and blanks are taken out decides whether it is empty.
EMPTY_STRIP = r"<[^<>]*>|&[a-zA-Z]+;|&#\d+;|[^\p{L}\p{N}]"

_INVISIBLE_RE = re.compile(f"[{INVISIBLE}]+")
_MARKUP_RE = re.compile(r"<[^<>]*>|&[a-zA-Z]+;|&#\d+;")
_PLACE = {re.sub(r"[^a-z]", "", p) for p in PLACEHOLDERS}
_FOUR_WORDS = re.compile(r"(?:^|\s)[^\W_]{2,}[,.!?]? [^\W_]{2,}[,.!?]? [^\W_]{2,}[,.!?]? [^\W_]{2,}(?=[\s,.!?:;]|$)")
_BLANKS_RE = re.compile(rf"[\s{INVISIBLE}]+")


def is_empty(target: str | None, source: str | None) -> bool:
    """Null, blank, or only invisible characters, punctuation, empty markup or a placeholder; a value without letters
    passed on unchanged from the source is not empty."""
    if target is None:
        return True
    if _FOUR_WORDS.search(target):  # no placeholder has so many, and markup none in a row
        return False
    if len(target) > 120:
        return not any(c.isalnum() for c in _MARKUP_RE.sub("", target))
    kept = "".join(c for c in _MARKUP_RE.sub(" ", target) if c.isalnum()).lower()
    if kept and kept not in _PLACE:
        return False
    squeezed = _BLANKS_RE.sub("", target)
    return not squeezed or source is None or squeezed != _BLANKS_RE.sub("", source)


#: A sentence ends at a run of . ! ? with closing marks after it, before white space or the end (\x01: end of a text).
SENTENCE_END = re.compile(r"[.!?]+(?:[\s]?»|[\"”“’'‘*›])*(?=[\s\x01]|$)")
SEP = "\x01"


#: The label and number of a heading (# Chapter 3:), which say little about the language of its text.
HEADING = re.compile(r"(?:^|(?<=\x01))#+\s*[^\W\d_]+\s+\d+\s*:")


class Sentences:
    """Sentences of many texts. text: all of them in one string; start, end: offsets; doc: number of the text;
    first: index of each text's first sentence, n: how many it has. Blank pieces are no sentences."""

    def __init__(self, texts: list[str]):
        joined = SEP.join(t.replace(SEP, " ") if t else "" for t in texts) + SEP
        self.text = joined = _INVISIBLE_RE.sub("", joined)
        self.codes = codes = np.frombuffer(joined.encode("utf-32-le", "replace"), dtype=np.uint32)
        doc_end = np.flatnonzero(codes == 1)
        ends = np.fromiter((m.end() for m in SENTENCE_END.finditer(joined)), dtype=np.int64)
        ends = np.unique(np.concatenate([ends, doc_end]))
        starts = np.concatenate([[0], ends[:-1]])
        seen = np.concatenate([[0], np.cumsum(~space_mask(codes))])
        keep = seen[ends] > seen[starts]
        self.start, self.end = starts[keep], ends[keep]
        self.doc = np.searchsorted(doc_end, self.start + 0, side="left")
        at_sep = codes[self.start] == 1  # the piece begins with the separator of the text before
        self.doc = self.doc + at_sep
        self.start = self.start + at_sep
        self.n = np.bincount(self.doc, minlength=len(texts))[: len(texts)]
        self.first = np.concatenate([[0], np.cumsum(self.n)[:-1]]) if len(texts) else np.zeros(0, np.int64)

    def __len__(self) -> int:
        return len(self.start)

    def get(self, i: int) -> str:
        return self.text[self.start[i] : self.end[i]].strip()


def space_mask(codes: np.ndarray) -> np.ndarray:
    return (codes <= 32) | (codes == 0x85) | (codes == 0xA0) | ((codes >= 0x2000) & (codes <= 0x200A)) | (codes == 0x2028) | (codes == 0x2029) | (codes == 0x202F) | (codes == 0x205F) | (codes == 0x3000)


def split_sentences(text: str) -> list[str]:
    s = Sentences([text])
    return [s.get(i) for i in range(len(s))]


WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)*")


def fold(word: str) -> str:
    """Lower case without accents, the form in which words are compared."""
    if word.isascii():
        return word.lower()
    return "".join(c for c in unicodedata.normalize("NFKD", word.lower()) if not unicodedata.combining(c))
