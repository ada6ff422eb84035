"""Quality classifier: a byte-level convolutional network in numpy.

Learned filters of ``WIDTH`` bytes slide over the whole UTF-8 text. Their
activations are max-pooled over overlapping chunks (``CHUNK_BLOCKS`` blocks of
``BLOCK`` bytes, one block shared with the next chunk), the rectified chunk
features are averaged and max-pooled over all chunks of the document, and one
logistic unit makes a probability of them. A filter is a table with one weight
per position and byte value, so a convolution is a sum of table look-ups.

Training runs on the driver over a bounded sample of labelled rows
(``TRAIN_PER_CLASS`` documents of each label), over every chunk of each, in
pieces of about ``PIECE_BYTES``; scoring reads every byte of every document.

Defined cases: a null or empty text is one chunk of padding and gets the score
the network gives that; without labelled rows of both labels the score is the
sample's share of label 1 (0.5 without any).
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagesift.llm.common import labelled_rows, slices, text_of

WIDTH, FILTERS = 6, 16
BLOCK, CHUNK_BLOCKS = 64, 8
TRAIN_PER_CLASS, EPOCHS, BATCH, RATE = 1500, 10, 32, 0.01
PIECE_BYTES = 1 << 19  # of documents whose gradients are taken at once
_PIECE = 1 << 18


class Network(NamedTuple):
    filters: np.ndarray  # (WIDTH, 256, FILTERS)
    bias: np.ndarray  # (FILTERS,)
    out: np.ndarray  # (2 * FILTERS,): weights of averages, then of maxima
    base: float


def _padded(text: str) -> np.ndarray:
    """The text's bytes, zero-padded to whole blocks plus the reach of the last window."""
    data = text.encode("utf-8", "replace")
    blocks = max(1, -(-len(data) // BLOCK))
    return np.frombuffer(data + bytes(blocks * BLOCK + WIDTH - len(data)), np.uint8)


def _pair_tables(filters: np.ndarray) -> list[np.ndarray]:
    """One table per two adjacent filter positions, indexed by a pair of bytes."""
    return [(filters[k][:, None, :] + filters[k + 1][None, :, :]).reshape(65536, -1) for k in range(0, WIDTH, 2)]


def _activations(data: np.ndarray, tables: list[np.ndarray], bias: np.ndarray) -> np.ndarray:
    """Of every window that starts in ``data`` but for its last ``WIDTH`` bytes."""
    pairs = data[:-1].astype(np.uint16) * np.uint16(256) + data[1:]
    n = len(data) - WIDTH
    out = tables[0].take(pairs[:n], axis=0)
    for k, t in enumerate(tables[1:], 1):
        out += t.take(pairs[2 * k:2 * k + n], axis=0)
    return out + bias


def _chunk_bounds(blocks: int) -> np.ndarray:
    """First and past-the-last block of every chunk."""
    first = np.arange(0, max(1, blocks - 1), CHUNK_BLOCKS - 1)
    return np.stack([first, np.minimum(first + CHUNK_BLOCKS, blocks)], 1)


def _pooled(block_max: np.ndarray) -> np.ndarray:
    """Rectified chunk features, averaged and max-pooled over the document."""
    chunks = np.stack([block_max[a:b].max(0) for a, b in _chunk_bounds(len(block_max))])
    np.maximum(chunks, 0, out=chunks)
    return np.concatenate([chunks.mean(0), chunks.max(0)])


class Scorer:
    def __init__(self, net: Network):
        self.net, self.tables = net, _pair_tables(net.filters)

    def __call__(self, text: str) -> float:
        data, maxima = _padded(text), []
        for at in range(0, len(data) - WIDTH, _PIECE):  # whole blocks; windows reach into the next piece
            a = _activations(data[at:at + _PIECE + WIDTH], self.tables, self.net.bias)
            maxima.append(a.reshape(-1, BLOCK, a.shape[1]).max(1))
        z = float(_pooled(np.concatenate(maxima)) @ self.net.out) + self.net.base
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def train(rows: list[tuple], seed: int = 0) -> Network:
    """Fit the network to ``(text, label, ...)`` rows by Adam on the log loss."""
    rng = np.random.default_rng(seed)
    y = np.array([r[1] for r in rows], np.float32)
    params = {"filters": rng.normal(0, 0.15, (WIDTH, 256, FILTERS)).astype(np.float32),
              "bias": np.zeros(FILTERS, np.float32),
              "out": rng.normal(0, 0.3, 2 * FILTERS).astype(np.float32), "base": np.zeros(1, np.float32)}
    share = float(y.mean()) if len(y) else 0.5
    if len(set(y.tolist())) < 2:
        share = min(max(share, 0.001), 0.999)
        return Network(params["filters"], params["bias"], params["out"] * 0, float(np.log(share / (1 - share))))
    params["base"][0] = np.log(share / (1 - share))
    texts = [_padded(text) for text, *_ in rows]
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in params.items()}
    step = 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), BATCH):
            grads = _batch_gradients(params, [texts[i] for i in order[at:at + BATCH]], y[order[at:at + BATCH]])
            step += 1
            for k, g in grads.items():
                m, v = moments[k]
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                params[k] -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Network(params["filters"], params["bias"], params["out"], float(params["base"][0]))


def _chunks(data: np.ndarray) -> list[np.ndarray]:
    """The bytes of every chunk with the reach of its last window."""
    return [data[a * BLOCK:b * BLOCK + WIDTH] for a, b in _chunk_bounds((len(data) - WIDTH) // BLOCK)]


def _batch_gradients(params: dict, texts: list, y: np.ndarray) -> dict:
    """The mean gradients of a batch, summed over pieces of bounded size (one document at least)."""
    tables, out, at = _pair_tables(params["filters"]), None, 0
    while at < len(texts):
        to, size = at + 1, len(texts[at])
        while to < len(texts) and size + len(texts[to]) <= PIECE_BYTES:
            size, to = size + len(texts[to]), to + 1
        part = _gradients(params, tables, [_chunks(t) for t in texts[at:to]], y[at:to], len(texts))
        out = part if out is None else {k: v + part[k] for k, v in out.items()}
        at = to
    return out


def _gradients(params: dict, tables: list, docs: list, y: np.ndarray, total: int) -> dict:
    chunks = [c for d in docs for c in d]
    lengths = [len(c) for c in chunks]
    starts = np.concatenate([[0], np.cumsum(lengths)])
    data = np.concatenate(chunks)
    act = _activations(data, tables, params["bias"])
    best = np.stack([act[s:s + n - WIDTH].argmax(0) + s for s, n in zip(starts, lengths)])  # (chunks, FILTERS)
    top = act[best, np.arange(FILTERS)]
    feature = np.maximum(top, 0)
    firsts = np.concatenate([[0], np.cumsum([len(d) for d in docs])])
    counts = np.diff(firsts)
    mean = np.add.reduceat(feature, firsts[:-1]) / counts[:, None]
    peak = np.stack([feature[a:b].argmax(0) + a for a, b in zip(firsts, firsts[1:])])
    pooled = np.concatenate([mean, feature[peak, np.arange(FILTERS)]], 1)
    p = 1 / (1 + np.exp(-(pooled @ params["out"] + params["base"][0])))
    dz = ((p - y) / total).astype(np.float32)
    d_pooled = dz[:, None] * params["out"]
    d_feature = np.repeat(d_pooled[:, :FILTERS] / counts[:, None], counts, 0)
    np.add.at(d_feature, (peak, np.arange(FILTERS)), d_pooled[:, FILTERS:])
    d_feature *= top > 0
    d_filters = np.zeros_like(params["filters"])
    for k in range(WIDTH):
        np.add.at(d_filters[k], (data[best + k], np.arange(FILTERS)), d_feature)
    return {"filters": d_filters, "bias": d_feature.sum(0), "out": pooled.T @ dz, "base": np.array([dz.sum()], np.float32)}


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", per_class: int = TRAIN_PER_CLASS, seed: int = 0) -> Network:
    """Train on a bounded sample of the labelled rows that are not held out."""
    return train(labelled_rows(docs, labels, label, per_class), seed)


def score(docs: DataFrame, net: Network, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, score`` for every row of ``docs``, over the whole text."""
    def run(batches):
        scorer = Scorer(net)
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([float(scorer(t)) for t in text_of(b.column(1))], pa.float64())], names=["id", "score"])
    kept = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return kept.mapInArrow(run, f"id {kept.schema['id'].dataType.simpleString()}, score double")
