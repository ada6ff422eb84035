"""Periodic runs of words by dyadic square catching.

A run is a stretch of words with smallest period q, words q apart being
identical, of at least ``max(MIN_LENGTH, 2 q)`` words, that no neighbouring word
extends keeping the period.

Texts are read word by word. Whenever a block of ``2^k`` words (aligned to a
multiple of ``2^k``) is complete, a catcher is set on it: while further words
are appended it compares the suffix of ``2^k`` words with its block, and if they
are equal q words later, for a q in its range, it has caught a stretch where
words q apart are identical. The ranges of the sizes cover every period, and a
run of period q has an aligned block of its size in that stretch (``_levels``),
so no run is missed. What neighbouring blocks catch at the same distance is
one stretch (squares that merge into a run); its ends lie less than a block
away and are found by comparing stretches of half, a quarter, ... of a block. Of
stretches with the same bounds the least period is the run's.

All catchers of a size advance together: comparing every block's hash with the
suffix hashes at all distances of its range is one array operation, 2 n
comparisons for each of about log2(n) sizes, and a slice of documents goes
through it at once, a word of its own kind between two documents keeping them
apart. Suffix hashes are differences of one prefix sum modulo 2^64. A hash
decides nothing alone: every run found is compared word by word, and a document
where that fails is searched by plain comparison of all distances.

Defined cases: a null or empty text has no words and no runs; rows are
independent, so repeated rows and null ids change nothing; memory is about 100
bytes a word for the largest of a slice (``SLICE_BYTES``) and a single text.
"""

from __future__ import annotations

from collections import defaultdict
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagesift.llm.common import slices, text_of

MIN_LENGTH = 12
SLICE_BYTES = 1 << 20
_CELLS = 1 << 22  # comparisons of one array operation
_BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so that it has an inverse modulo 2^64


def words(text: str) -> list[bytes]:
    """The runs of bytes other than space and 0x09 to 0x0D."""
    return text.encode("utf-8", "surrogatepass").split()


def _levels(longest: int, least: int):
    """(block size, first period, last period) so that every period q up to longest / 2 is in a range,
    and a run of q, whose words are identical q apart in max(q, least - q) places at least, has an aligned
    block among these: 2 * size - 1 places always hold one."""
    top, q, found = longest // 2, 1, []
    while q <= top:
        size = 1 << ((max(q, least - q) + 1) // 2).bit_length() - 1
        last = q if q <= least else min(top, 4 * size - 2)
        if found and found[-1][0] == size:
            found[-1] = (size, found[-1][1], last)
        else:
            found.append((size, q, last))
        q = last + 1
    return found


class _Hashes:
    """Equality of stretches by differences of a prefix sum of (word's number) * base^position."""

    def __init__(self, ids: np.ndarray):
        n = len(ids)
        x = ids.astype(np.uint64) + np.uint64(1)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(31)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(29)
        self.powers = np.full(n + 1, _BASE)
        self.powers[0] = 1
        np.cumprod(self.powers, out=self.powers)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(x * self.powers[:n], out=self.sums[1:])
        self.inverse = np.full(n + 1, np.uint64(pow(int(_BASE), -1, 1 << 64)))
        self.inverse[0] = 1
        np.cumprod(self.inverse, out=self.inverse)

    def windows(self, size: int) -> np.ndarray:
        """The hash of the ``size`` words from every place on."""
        last = len(self.sums) - size
        return (self.sums[size:] - self.sums[:last]) * self.inverse[:last]

    def same(self, at: np.ndarray, q: np.ndarray, size: int) -> np.ndarray:
        """Whether ``size`` words from ``at`` and from ``at + q`` are equal; not where these leave the words."""
        ok = (at >= 0) & (at + q + size < len(self.sums))
        a = np.where(ok, at, 0)
        b = np.where(ok, a + q, 0)
        s = np.where(ok, size, 0)
        return ok & ((self.sums[a + s] - self.sums[a]) * self.powers[np.where(ok, q, 0)] == self.sums[b + s] - self.sums[b])


def _caught(hashes: _Hashes, size: int, first: int, last: int) -> tuple[np.ndarray, np.ndarray]:
    """(block number, period) of everything the catchers on blocks of ``size`` words catch, by period and block."""
    suffix = hashes.windows(size)
    blocks, periods = [], []
    step = size * max(1, _CELLS // (last - first + 1))
    for low in range(0, len(suffix), step):
        starts = suffix[low:low + step:size]
        # cell (block, q): the suffix that ends when the catcher has seen q more words
        reach = suffix[low + first:low + first + (len(starts) - 1) * size + last - first + 1]
        short = (len(starts) - 1) * size + last - first + 1 - len(reach)
        if short:
            reach = np.concatenate([reach, np.zeros(short, np.uint64)])
        cells = np.lib.stride_tricks.as_strided(reach, (len(starts), last - first + 1), (size * 8, 8))
        m, q = np.nonzero(cells == starts[:, None])
        inside = low + m * size + first + q < len(suffix)  # not the zeros behind the last word
        blocks.append(low // size + m[inside])
        periods.append(q[inside] + first)
    m, q = np.concatenate(blocks), np.concatenate(periods)
    order = np.lexsort((m, q))
    return m[order], q[order]


def _stretches(hashes: _Hashes, size: int, first: int, last: int):
    """(start, end, period) of the stretches around what is caught: ``end`` is behind the last word."""
    if len(hashes.sums) <= size + first:
        return np.zeros((3, 0), np.int64)
    m, q = _caught(hashes, size, first, last)
    head = np.ones(len(m), bool)
    head[1:] = (m[1:] != m[:-1] + 1) | (q[1:] != q[:-1])
    tail = np.append(head[1:], True) if len(m) else head
    q, start, end = q[head], m[head] * size, (m[tail] + 1) * size
    step = size // 2
    while step:
        more = hashes.same(end, q, step)
        end = end + step * more
        more = hashes.same(start - step, q, step)
        start = start - step * more
        step //= 2
    return np.stack([start, end + q, q])


def _plainly(ids: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """The runs by comparing the words of every distance: quadratic, needed where hashes collide."""
    best: dict[tuple[int, int], int] = {}
    for q in range(len(ids) // 2, 0, -1):
        same = np.concatenate([[False], ids[:-q] == ids[q:], [False]])
        edges = np.flatnonzero(same[1:] != same[:-1]).reshape(-1, 2)
        best.update({(int(a), int(b) + q): q for a, b in edges if b + q - a >= max(least, 2 * q)})
    return sorted((a, b - a, q) for (a, b), q in best.items())


def _exact(ids: np.ndarray, start: int, end: int, q: int) -> bool:
    return (np.array_equal(ids[start:end - q], ids[start + q:end]) and (start == 0 or ids[start - 1] != ids[start - 1 + q])
            and (end == len(ids) or ids[end] != ids[end - q]))


def find(documents: list[list[bytes]], least: int = MIN_LENGTH) -> list[list[tuple[int, int, int]]]:
    """For each document, a list of words, its runs ``(start, length, period)`` by start, then period."""
    number: dict = defaultdict(count().__next__)
    sizes = np.array([len(d) for d in documents], np.int64)
    bounds = np.concatenate([[0], np.cumsum(sizes + 1)])
    ids = np.empty(int(bounds[-1]), np.int64)
    for d, at in zip(documents, bounds.tolist()):
        ids[at:at + len(d)] = np.fromiter(map(number.__getitem__, d), np.int64, len(d))
    apart = bounds[1:] - 1
    ids[apart] = len(number) + np.arange(len(documents))
    hashes = _Hashes(ids)
    found = [_stretches(hashes, *level) for level in _levels(int(sizes.max(initial=0)), least)]
    start, end, q = np.concatenate(found, axis=1) if found else np.zeros((3, 0), np.int64)
    long = end - start >= np.maximum(least, 2 * q)
    start, end, q = start[long], end[long], q[long]
    order = np.lexsort((q, end, start))  # the least period of equal bounds comes first
    start, end, q = start[order], end[order], q[order]
    new = np.ones(len(start), bool)
    new[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    start, end, q = start[new], end[new], q[new]
    out: list[list[tuple[int, int, int]]] = [[] for _ in documents]
    failed = set()
    first, last = (np.searchsorted(bounds, x, "right") - 1 for x in (start, end - 1))
    for d, to, a, b, p in zip(first.tolist(), last.tolist(), start.tolist(), end.tolist(), q.tolist()):
        low, high = int(bounds[d]), int(bounds[d + 1]) - 1
        if b > high or not _exact(ids[low:high], a - low, b - low, p):
            failed.update(range(d, to + 1))
        out[d].append((a - low, b - a, p))
    for d in failed:
        out[d] = _plainly(ids[bounds[d]:bounds[d + 1] - 1], least)
    return [sorted(r, key=lambda x: (x[0], x[2])) for r in out]


def collapsed(document: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words without those that a run holds after its first period."""
    if not runs:
        return document
    kept = np.ones(len(document), bool)
    for start, length, q in runs:
        kept[start + q:start + length] = False
    return [w for w, k in zip(document, kept.tolist()) if k]


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = MIN_LENGTH, rewrite=None) -> DataFrame:
    """``id, n_words, runs, text`` of every row: its runs by start and period, and its words, joined by one
    space, without repetitions. ``rewrite(id, words)``, if given, replaces a row's words beforehand."""
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches):
        for b in slices(batches, max_bytes=SLICE_BYTES):
            documents = [words(t) for t in text_of(b.column(1))]
            if rewrite:
                documents = [rewrite(i, d) for i, d in zip(b.column(0).to_pylist(), documents)]
            found = find(documents, least)
            texts = [b" ".join(collapsed(d, r)).decode("utf-8", "surrogatepass") for d, r in zip(documents, found)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([len(d) for d in documents], pa.int64()),
                 pa.array([[{"start": s, "length": n, "period": q} for s, n, q in r] for r in found], kind), pa.array(texts, pa.string())],
                names=["id", "n_words", "runs", "text"])
    kept = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return kept.mapInArrow(run, f"id {kept.schema['id'].dataType.simpleString()}, n_words long, "
                                "runs array<struct<start:long,length:long,period:long>>, text string")
