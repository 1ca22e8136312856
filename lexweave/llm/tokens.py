"""Text sizes in tokens of a public tokenizer, whose vocabulary file is read from a folder all executors have."""

from __future__ import annotations

import base64
import importlib.util
import os

import numpy as np
from pyspark.sql import DataFrame

from .batches import map_pieces

#: Where the vocabulary files are, and which is used; both are parameters of every operator that counts tokens.
FOLDER, VOCABULARY = "/opt/tokenizers", "byte_bpe_multi_50k.tiktoken"
_ENCODINGS: dict = {}


def encoding(folder: str = FOLDER, vocabulary: str = VOCABULARY):
    """The tokenizer, loaded once a process."""
    key = (folder, vocabulary)
    if key not in _ENCODINGS:
        import tiktoken

        spec = importlib.util.spec_from_file_location("tokenizer_folder", os.path.join(folder, "__init__.py"))
        module = importlib.util.module_from_spec(spec)
        spec.loader.exec_module(module)
        with open(os.path.join(folder, vocabulary), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _ENCODINGS[key] = tiktoken.Encoding(vocabulary, pat_str=module.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODINGS[key]


def count_tokens(texts: list[str], folder: str = FOLDER, vocabulary: str = VOCABULARY) -> np.ndarray:
    e = encoding(folder, vocabulary)
    return np.array([len(e.encode_ordinary(t)) if t else 0 for t in texts], dtype=np.int64)


def with_tokens(df: DataFrame, keep: dict[str, str], folder: str = FOLDER, vocabulary: str = VOCABULARY) -> DataFrame:
    """The columns keep (name: type) of df and `tokens` of its column `text`; null and empty texts have 0."""

    def run(c: dict[str, list]) -> dict[str, object]:
        return {**{k: c[k] for k in keep}, "tokens": count_tokens(c["text"], folder, vocabulary)}

    return map_pieces(df.select(*keep, "text"), ", ".join(f"{k} {t}" for k, t in keep.items()) + ", tokens long", run, ("text",))
