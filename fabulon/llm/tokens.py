"""Sizes of texts in tokens of a public tokenizer (never trained here)."""

from __future__ import annotations

import base64
import os

from pyspark.sql import DataFrame

from .arrowio import batch_map

#: Folder of the public tokenizers on every executor, and the ranks that size documents.
TOKENIZER_DIR = os.environ.get("TOKENIZER_DIR", "/opt/tokenizers")
TOKENIZER_FILE = "byte_bpe_multi_50k.tiktoken"
# Fixed value: the splitting pattern that belongs to the byte-level vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_ENCODERS: dict = {}


def encoder(path: str):
    """The tokenizer of ``path``, loaded once per Python worker."""
    if path not in _ENCODERS:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _ENCODERS[path] = tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODERS[path]


def count_tokens(df: DataFrame, keys: list[str], text: str, path: str | None = None) -> DataFrame:
    """``keys`` and n_tokens of each row; null and empty texts have 0.  One narrow stage."""
    path = path or f"{TOKENIZER_DIR}/{TOKENIZER_FILE}"
    kept = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys)

    def sizes(*cols):
        enc = encoder(path)
        return [*cols[:-1], [len(enc.encode_ordinary(t)) if t else 0 for t in cols[-1]]]

    return batch_map(df.select(*keys, df[text].alias("t")), sizes, f"{kept}, n_tokens int")
