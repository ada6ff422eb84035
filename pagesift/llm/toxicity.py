"""Toxicity by compression distance: two zstandard dictionaries and the lengths of windows under each.

One dictionary is trained on words of toxic documents, one on words of
ordinary documents. The windows of a text are its words (lower case, outer
punctuation off); a window is compressed with either dictionary, and the bytes
the toxic one saves over the ordinary one are its distance. A toxic word is
one match in the toxic dictionary and several in the other.

zstandard stores short inputs uncompressed, and then both lengths are equal.
So a window is spelled out first: every byte becomes a fixed code of
``CODE_BYTES`` bytes. What was one literal then costs as much as a match, and a
length becomes, up to a constant, the number of pieces that the dictionary
needs for the window.

Which words of toxic documents are toxic is not labelled. The toxic dictionary
is trained on the words that toxic training documents hold ``CONTRAST`` times
as often as ordinary ones, once for each document that holds them; the ordinary one
on the words of ordinary documents, likewise, of which ``SAMPLE_BYTES`` are drawn
where there are more. The share of windows above each of the calibrated
thresholds, and the largest distances, then make one logistic score, fitted on
labelled documents that took no part in training the dictionaries.

The sample of labelled rows is bounded (``PER_CLASS`` of each label); scores
cover every word of every document. Defined cases: a null or empty text has no
window and gets the score of distance 0; if no word of toxic documents stands out, their
dictionary is trained on all of their words; training rows without any word on one side give the
score 0; without toxic or without ordinary
training rows every score is 0 or 1, the one label there is (0 without any).
"""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagesift.llm.common import Recent, labelled_rows, per_worker, slices, text_of

PER_CLASS = 3000
LEVEL, CODE_BYTES = 19, 6
ORDINARY_BYTES, TOXIC_BYTES = 110_000, 16_384
CONTRAST, MIN_DOCS = 20, 4
SAMPLE_BYTES = 24_000_000  # spelled words that a dictionary is trained on; the trainer takes some ten times as much memory
PUNCTUATION = b".,;:!?%$&#*|\"'()[]{}<>-_=+~^/\\`"
CACHED_WORDS = 150_000

CODES = [hashlib.blake2b(bytes([b]), digest_size=CODE_BYTES).digest() for b in range(256)]


class Model(NamedTuple):
    ordinary: bytes
    toxic: bytes
    thresholds: tuple[float, ...]
    weights: tuple[float, ...]
    base: float


def windows(text: str) -> list[bytes]:
    return [w for w in (w.strip(PUNCTUATION) for w in text.lower().encode("utf-8", "replace").split()) if w]


def spelled(window: bytes) -> bytes:
    """The window between two spaces, every byte as its code."""
    return b"".join([CODES[c] for c in b" " + window + b" "])


def dictionary(samples: list[bytes], size: int) -> bytes:
    """A zstandard dictionary trained on the samples; of too few to train on, the samples themselves."""
    try:
        return zstandard.train_dictionary(size, samples, k=CODE_BYTES * 16, d=8, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b"".join(dict.fromkeys(samples))[-size:] or bytes(8)


class _Lengths:
    def __init__(self, data: bytes):
        own = zstandard.ZstdCompressionDict(data)
        params = zstandard.ZstdCompressionParameters.from_level(
            LEVEL, source_size=128, dict_size=len(data), write_content_size=False, write_checksum=False,
            write_dict_id=False, format=zstandard.FORMAT_ZSTD1_MAGICLESS)
        own.precompute_compress(compression_params=params)
        self.compress = zstandard.ZstdCompressor(dict_data=own, compression_params=params).compress

    def __call__(self, data: bytes) -> int:
        return len(self.compress(data))


class _Distances(Recent):
    """Distance of every window seen, measured when it is first asked for."""

    def __init__(self, ordinary: bytes, toxic: bytes):
        super().__init__(self.measure, CACHED_WORDS)
        self.ordinary, self.toxic = _Lengths(ordinary), _Lengths(toxic)

    def measure(self, window: bytes) -> int:
        data = spelled(window)
        return self.ordinary(data) - self.toxic(data)


def _features(distances: np.ndarray, thresholds) -> np.ndarray:
    """Largest distances, and how many windows lie above each threshold, absolutely and as a share."""
    top = np.sort(distances)[-3:] if len(distances) else np.zeros(1)
    above = [np.count_nonzero(distances >= t) for t in thresholds]
    n = max(1, len(distances))
    return np.array([max(0, top[-1]) / 4, max(0, top.mean()) / 4, np.log1p(n) / 4,
                     *[np.log1p(a) for a in above], *[50 * min(a / n, 0.1) for a in above]])


class Scorer:
    def __init__(self, model: Model):
        self.model = model
        self.distances = _Distances(model.ordinary, model.toxic) if model.weights else None
        self.weights = np.array(model.weights)

    def __call__(self, text: str) -> float:
        if self.distances is None:
            return self.model.base
        d = np.array(list(map(self.distances.__getitem__, windows(text))), np.int64)
        z = float(_features(d, self.model.thresholds) @ self.weights) + self.model.base
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _samples(counts: dict[bytes, int], rng: np.random.Generator) -> list[bytes]:
    """Words as often as counted, spelled and mixed (the trainer fills a dictionary stretch by stretch of its
    samples), up to ``SAMPLE_BYTES``."""
    words = sorted(counts)
    each = np.repeat(np.arange(len(words)), [counts[w] for w in words])
    rng.shuffle(each)
    sizes = np.cumsum(np.array([(len(w) + 2) * CODE_BYTES for w in words], np.int64)[each])
    return [spelled(words[i]) for i in each[:np.searchsorted(sizes, SAMPLE_BYTES, "right")].tolist()]


def train(rows: list[tuple], seed: int = 0) -> Model:
    """Fit to ``(text, label, id)`` rows: about three quarters make the dictionaries, the rest the thresholds and score."""
    labels = {r[1] for r in rows}
    if len(labels) < 2:
        return Model(b"", b"", (), (), float(labels == {1}))
    learn = [r for r in rows if zlib.crc32(f"part{r[2]}".encode()) % 4]
    tune = [r for r in rows if not zlib.crc32(f"part{r[2]}".encode()) % 4]
    if len({r[1] for r in tune}) < 2 or len({r[1] for r in learn}) < 2:
        learn = tune = rows
    docs_with = {0: Counter(), 1: Counter()}
    for text, label, *_ in learn:
        docs_with[label].update(set(windows(text)))
    n = Counter(r[1] for r in learn)
    marked = {w: c for w, c in docs_with[1].items()
              if c >= min(MIN_DOCS, n[1]) and c / n[1] >= CONTRAST * (docs_with[0][w] + 0.5) / n[0]}
    rng = np.random.default_rng(seed)
    toxic, ordinary = _samples(marked or docs_with[1], rng), _samples(docs_with[0], rng)
    if not toxic or not ordinary:
        return Model(b"", b"", (), (), 0.0)
    a, b = dictionary(ordinary, ORDINARY_BYTES), dictionary(toxic, TOXIC_BYTES)
    distances = _Distances(a, b)
    measured = [np.array([distances[w] for w in windows(r[0])], np.int64) for r in tune]
    y = np.array([r[1] for r in tune], float)
    # thresholds: what at most 1 %, 0.1 % and 0.01 % of the ordinary windows reach
    plain = np.concatenate([d for d, label in zip(measured, y) if not label] or [np.zeros(1, int)])
    thresholds = tuple(float(max(1, np.quantile(plain, q) + 1)) for q in (0.99, 0.999, 0.9999))
    x = np.stack([_features(d, thresholds) for d in measured])
    weights, base = _logistic(x, y)
    return Model(a, b, thresholds, tuple(weights.tolist()), base)


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.01) -> tuple[np.ndarray, float]:
    """Ridge-penalised logistic regression by Newton's method."""
    x1 = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x1.shape[1])
    penalty = ridge * len(y) / 100 * np.eye(len(w))
    penalty[-1, -1] = 1e-6
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x1 @ w, -30, 30)))
        step = np.linalg.solve((x1 * (p * (1 - p))[:, None]).T @ x1 + penalty, x1.T @ (p - y) + penalty @ w)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w[:-1], float(w[-1])


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", per_class: int = PER_CLASS, seed: int = 0) -> Model:
    """Train on a bounded sample of the labelled rows that are not held out."""
    return train(labelled_rows(docs, labels, label, per_class), seed)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, score`` for every row of ``docs``, over the whole text."""
    def run(batches):
        scorer = per_worker(("toxicity", model), lambda: Scorer(model))
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([float(scorer(t)) for t in text_of(b.column(1))], pa.float64())], names=["id", "score"])
    kept = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return kept.mapInArrow(run, f"id {kept.schema['id'].dataType.simpleString()}, score double")


def reject(docs: DataFrame, model: Model, threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose score lies below the threshold, with all their columns."""
    def run(batches):
        scorer = per_worker(("toxicity", model), lambda: Scorer(model))
        for b in slices(batches):
            texts = text_of(b.column(b.schema.get_field_index(text_col)))
            yield b.filter(pa.array([scorer(t) < threshold for t in texts], pa.bool_()))
    return docs.mapInArrow(run, docs.schema)
