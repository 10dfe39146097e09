"""Sizes of texts in tokens of a public tokenizer, and their place on a space-filling curve."""

from __future__ import annotations

import base64

import numpy as np
import pandas as pd
import tiktoken
import tiktoken.registry
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Rank file of the tokenizer, the same path on every machine, and its splitting pattern.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A document vector counts hashed tokens; it is projected to so many dimensions of so many bits each.
BUCKETS, DIMENSIONS, BITS = 1024, 3, 10


def encoding(path: str) -> tiktoken.Encoding:
    """The tokenizer of a rank file, loaded once in each process."""
    if path not in tiktoken.registry.ENCODINGS:
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        tiktoken.registry.ENCODINGS[path] = tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return tiktoken.registry.ENCODINGS[path]


def hilbert(points: np.ndarray, bits: int) -> np.ndarray:
    """Hilbert curve positions of integer points (rows) with coordinates below ``2 ** bits``, by Skilling's transform."""
    x = points.T.astype(np.int64).copy()
    dims = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(dims):
            high = (x[i] & q) > 0
            t = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(high, x[0] ^ p, x[0] ^ t)
            x[i] ^= t
        q >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where((x[-1] & q) > 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for i in range(dims):
            key = (key << 1) | ((x[i] >> bit) & 1)
    return key


def token_count(text: str, path: str = TOKENIZER) -> Column:
    """Tokens of the column ``text``; null for null."""

    def run(text: pd.Series) -> pd.Series:
        known = encoding(path)
        return pd.Series([None if t is None else len(known.encode_ordinary(t)) for t in text], dtype="Int32")

    return F.pandas_udf(run, "int")(text)


def token_place(text: str, path: str = TOKENIZER) -> Column:
    """``n_tokens INT`` of the column ``text`` and ``curve BIGINT``, its hashed vector's position on the Hilbert curve."""

    def run(text: pd.Series) -> pd.DataFrame:
        known = encoding(path)
        directions = np.random.default_rng(11).standard_normal((BUCKETS, DIMENSIONS))
        ids = [np.array(known.encode_ordinary(t or ""), np.int64) for t in text]
        vectors = np.array([np.bincount(i * 2654435761 % 4294967296 >> 22, minlength=BUCKETS) for i in ids], float).reshape(-1, BUCKETS)
        vectors = np.log1p(vectors)
        flat = vectors @ directions / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1)
        grid = np.clip((flat + 4) / 8 * (1 << BITS), 0, (1 << BITS) - 1).astype(np.int64)
        return pd.DataFrame({"n_tokens": pd.Series([len(i) for i in ids], dtype="int32"), "curve": hilbert(grid, BITS)})

    return F.pandas_udf(run, "n_tokens INT, curve BIGINT")(text)
