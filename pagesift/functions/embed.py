"""Term vectors inside a task (J-04, J-05, E-05, E-06, S-08).

A term's vector is a function of the term: the mean of its n-grams' hash
vectors, or of its characters' trained vectors. So no term has to be joined to
a table. The fitted terms used most are broadcast with their vectors (a bound
on rows and bytes); any other term, unseen or beyond the bound, is embedded
when a worker first meets it and kept in a bounded memo. No key is shuffled,
so neither ``html`` nor the empty class makes a hot task, and a term costs its
embedding once for each worker however often pages repeat it.
"""

from __future__ import annotations

import hashlib
import uuid
from dataclasses import dataclass

import numpy as np

from pagesift import config as C
from pagesift.functions.kept import per_worker

MEMO_TERMS = 100_000  # embedded terms a worker keeps in each of two generations


def hash_vector(term: str) -> np.ndarray:
    """E-05 for one term (same formula as ``vocab.hash_vectors``)."""
    w = f"<{term}>"
    grams = [w[i:i + n] for n in range(C.NGRAM_MIN, C.NGRAM_MAX + 1) for i in range(len(w) - n + 1)]
    if not grams:
        return np.zeros(C.EMBED_DIM)
    raw = [[int(hashlib.md5(f"{g}#{d}".encode()).hexdigest()[:7], 16) for d in range(C.EMBED_DIM)] for g in grams]
    u = np.array(raw, float) / float(0xFFFFFFF) * (2.0 / C.EMBED_DIM) - 1.0 / C.EMBED_DIM
    return u.mean(axis=0)


def step_normalised(v: np.ndarray) -> np.ndarray:
    """S-08: min-max of one step's tag (or class) values."""
    lo, hi, eps = v.min(), v.max(), C.MINMAX_EPS
    return ((v + eps) - (lo + eps)) / ((hi - lo) + eps)


@dataclass
class Embedding:
    """Step-normalised vectors of (kind, term): ``known`` ones, else embedded from the term alone.

    ``chars`` holds the trained character vectors by (kind, character); without
    it the hash embedding is used.
    """

    known: dict
    chars: dict | None = None

    def vector(self, kind: str, term: str) -> np.ndarray:
        v = self.known.get((kind, term))
        if v is not None:
            return v
        if self.chars is None:
            return step_normalised(hash_vector(term) if term else np.zeros(C.EMBED_DIM))
        parts = [self.chars.get((kind, ch)) for ch in term]
        parts = [hash_vector(ch) if p is None else p for p, ch in zip(parts, term)]
        return step_normalised(np.mean(parts, axis=0) if parts else np.zeros(C.EMBED_DIM))


class Memo:
    """``compute(kind, term)`` of the terms met lately, in two generations of bounded size."""

    def __init__(self, compute, limit: int = MEMO_TERMS):
        self.compute, self.limit, self.new, self.old = compute, limit, {}, {}

    def __call__(self, kind: str, term: str):
        key = (kind, term)
        value = self.new.get(key)
        if value is None:
            value = self.old.get(key)
            if value is None:
                value = self.compute(kind, term)
            if len(self.new) >= self.limit:
                self.old, self.new = self.new, {}
            self.new[key] = value
        return value


def share(spark, known: dict, chars: dict | None = None):
    """The broadcast of an embedding's tables, under a name of their own. Broadcasts are plain
    pickles, so no object of this package is in them."""
    return spark.sparkContext.broadcast((uuid.uuid4().hex, known, chars))


def kept_memo(shared, use: str, compute_from):
    """The worker's memo for ``share``'s broadcast; ``compute_from(embedding)`` gives its function."""
    name, known, chars = shared.value
    return per_worker((name, use), lambda: Memo(compute_from(Embedding(known, chars))))
