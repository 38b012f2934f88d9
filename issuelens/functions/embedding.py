"""Text -> unit vector (UDF-01) through a pluggable encoder.

An encoder is any picklable object with ``encode(texts: list[str]) -> ndarray``
(rows = texts). It is created on the driver, shipped once per task, and called on
Arrow batches of ``batch_size`` texts by an iterator Pandas UDF, so a real model
is loaded once per task and never per row. Vectors are L2-normalised afterwards
(zero vectors stay zero).

The default ``HashingEncoder`` needs no model files: signed feature hashing of
lower-cased word tokens with a 64-bit hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..constants import ENCODE_BATCH_SIZE


class HashingEncoder:
    """Signed hashing of lower-cased ``\\w+`` tokens into ``dim`` buckets.

    One vectorised pass per batch: tokens of all texts are hashed together
    (``pandas.util.hash_array``, 64-bit), then summed into buckets with one
    ``bincount``. Deterministic across processes (fixed hash key).
    """

    def __init__(self, dim: int = 64, hash_key: str = "0123456789123456"):
        self.dim = dim
        self.hash_key = hash_key

    def encode(self, texts: list[str]) -> np.ndarray:
        import re

        tok = re.compile(r"\w+")
        words, owner = [], []
        for i, t in enumerate(texts):
            if t:
                ws = tok.findall(t.lower())
                words.extend(ws)
                owner.extend([i] * len(ws))
        out = np.zeros(len(texts) * self.dim, dtype=np.float64)
        if words:
            h = pd.util.hash_array(np.asarray(words, dtype=object), hash_key=self.hash_key)
            bucket = (h % np.uint64(self.dim)).astype(np.int64)
            sign = np.where((h >> np.uint64(63)) == 0, 1.0, -1.0)
            idx = np.asarray(owner, dtype=np.int64) * self.dim + bucket
            out += np.bincount(idx, weights=sign, minlength=out.size)
        return out.reshape(len(texts), self.dim)


class DigestEncoder:
    """Signed hashing of lower-cased words, split at ASCII blanks, by MD5.

    The first 32 bits of a word's digest give its bucket (modulo ``dim``) and, by the highest
    of them, its sign; any engine with MD5 gives the same vectors. A digest is taken once
    for each distinct word of a batch.
    """

    def __init__(self, dim: int = 64):
        self.dim = dim

    def encode(self, texts: list[str]) -> np.ndarray:
        from hashlib import md5

        number: dict[bytes, int] = {}
        words = [[number.setdefault(w, len(number)) for w in t.lower().encode().split()] for t in texts]
        digest = np.array([int.from_bytes(md5(w).digest()[:4]) for w in number], dtype=np.int64)
        owner = np.repeat(np.arange(len(texts)), [len(w) for w in words])
        word = np.array([i for w in words for i in w], dtype=np.int64)
        if not len(word):
            return np.zeros((len(texts), self.dim))
        sign = np.where(digest >> 31 == 0, 1.0, -1.0)
        at = owner * self.dim + (digest % self.dim)[word]
        return np.bincount(at, weights=sign[word], minlength=len(texts) * self.dim).reshape(len(texts), self.dim)


def _unit_rows(m: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, n, out=np.zeros_like(m), where=n > 0)


def embed_column(text, encoder=None, batch_size: int = ENCODE_BATCH_SIZE) -> Column:
    """Column expression: unit-norm ``array<float>`` of ``text`` (null text -> '').

    When the encoder raises on a batch, its texts are encoded one by one: only
    texts that fail alone get a null vector; callers filter or count them.
    """
    enc = encoder or HashingEncoder()

    def vectors(texts: list[str]) -> list[np.ndarray]:
        return list(_unit_rows(np.asarray(enc.encode(texts), dtype=np.float64)).astype(np.float32))

    def alone(text: str) -> np.ndarray | None:
        try:
            return vectors([text])[0]
        except Exception:
            return None

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def _embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            texts = s.fillna("").astype(str).tolist()
            parts = []
            for i in range(0, len(texts), batch_size):
                chunk = texts[i:i + batch_size]
                try:
                    parts.extend(vectors(chunk))
                except Exception:
                    parts.extend(alone(text) for text in chunk)
            yield pd.Series(parts, dtype=object)

    col = F.col(text) if isinstance(text, str) else text
    # non-deterministic for the optimizer: a filter on the vector is then never
    # pushed below a repartition, so the encoder runs once per row, after it
    return _embed.asNondeterministic()(col)


def embed(df, text_col: str = "text", out_col: str = "embedding", encoder=None,
          batch_size: int = ENCODE_BATCH_SIZE):
    return df.withColumn(out_col, embed_column(text_col, encoder, batch_size))
