"""Model hooks: a text encoder and a pair scorer that run in batches in the tasks, and deterministic stand-ins.

A hook takes a function without arguments that loads the model, once per worker, and returns a function on batches; ``batch_size`` is the number of texts or pairs
that the model sees at once. The stand-ins give the rows of the column expressions ``vectors.encode_text`` and ``text.overlap_score``.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql.types import ArrayType, DoubleType, FloatType

from ..functions import text as tf


def text_encoder(load: Callable, batch_size: int = 64):
    """A UDF text -> array<float>, for the ``encoder`` of ``encode_text``; ``load()`` gives a function (texts) -> (n, dim) matrix."""
    return predict_batch_udf(load, return_type=ArrayType(FloatType()), batch_size=batch_size)


def pair_scorer(load: Callable, batch_size: int = 32):
    """A UDF (query, document) -> score, for the ``scorer`` of ``rerank``; ``load()`` gives a function (queries, documents) -> n scores."""
    return predict_batch_udf(load, return_type=DoubleType(), batch_size=batch_size)


def sigmoid(logits: np.ndarray) -> np.ndarray:
    """Logits of a cross-encoder to scores; both tails without overflow."""
    small = np.exp(-np.abs(logits))
    return np.where(logits >= 0, 1, small) / (1 + small)


KEPT_WORDS = 1 << 16


def hashed_model(dim: int = 512) -> Callable:
    """Counts of hashed tokens; the places of the words met last are kept."""
    import functools
    import hashlib
    import regex
    token = regex.compile(rf"[{tf.WORD}]+")

    @functools.lru_cache(maxsize=KEPT_WORDS)
    def place(t: str) -> int:
        return int(hashlib.md5(t.encode()).hexdigest()[:8], 16) % dim

    def encode(texts: np.ndarray) -> np.ndarray:
        out = np.zeros((len(texts), dim), np.float32)
        for row, text in zip(out, texts):
            at = np.fromiter(map(place, token.findall((text or "").lower())), np.int64)
            row += np.bincount(at, minlength=dim)
        return out
    return encode


def overlap_model() -> Callable:
    """Share of the query's distinct words that the document has; 0.5 for an empty query."""
    import regex
    space = regex.compile("[" + regex.escape("".join(tf.SPACES)) + "]+")

    def score(queries: np.ndarray, documents: np.ndarray) -> np.ndarray:
        sets = [[set(filter(None, space.split((t or "").lower()))) for t in side] for side in (queries, documents)]
        return np.array([len(q & d) / len(q) if q else 0.5 for q, d in zip(*sets)])
    return score
