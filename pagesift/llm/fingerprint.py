"""Document fingerprints: a threshold-scaled sketch.

A text's shingles are the runs of ``WIDTH`` bytes of its UTF-8 form (a shorter
text is one shingle). Every shingle is hashed to 64 bits and every hash below
``2**64 * FRACTION`` is kept, however many there are. Whether a hash is kept
does not depend on the text it stands in, so the sketch of a union is the union
of the sketches, and both resemblance and containment can be estimated between
texts of very unequal length. A text of which no hash lies below the limit
keeps its smallest one, so that no text but the empty one has an empty sketch;
``merge`` drops such a stand-in as soon as a hash below the limit is present.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagesift.llm.common import slices, text_of

WIDTH = 12
FRACTION = 1 / 32
_PIECE = 1 << 20
_LOWEST = -(1 << 63)


def _hashes(data: bytes) -> np.ndarray:
    if len(data) < WIDTH:
        data = data + bytes(WIDTH - len(data) - 1) + bytes([128 + len(data)])
    words = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
    h = words[:-4] * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    h += words[4:] * np.uint64(0xC2B2AE3D27D4EB4F)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(31)
    return h


def sketch(text: str, fraction: float = FRACTION) -> np.ndarray:
    """The kept hashes of a text, ascending; very long texts are hashed piece by piece."""
    data = text.encode("utf-8", "replace")
    if not data:
        return np.zeros(0, np.uint64)
    limit, kept, least = np.uint64(int(2**64 * fraction) - 1), [], None
    for at in range(0, max(1, len(data) - WIDTH + 1), _PIECE):
        h = _hashes(data[at:at + _PIECE + WIDTH - 1])
        kept.append(h[h <= limit])
        least = h.min() if least is None else min(least, h.min())
    out = np.unique(np.concatenate(kept))
    return out if len(out) else np.array([least], np.uint64)


def merge(a: np.ndarray, b: np.ndarray, fraction: float = FRACTION) -> np.ndarray:
    """The sketch of two texts' shingles together."""
    both = np.union1d(a, b)
    low = both[both <= np.uint64(int(2**64 * fraction) - 1)]
    return low if len(low) else both[:1]


def resemblance(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated share of common shingles among all of both; two empty sketches: 1, one: 0."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common / (len(a) + len(b) - common)


def containment(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated share of a's shingles that are also in b; 1 if a is empty."""
    return len(np.intersect1d(a, b, assume_unique=True)) / len(a) if len(a) else 1.0


def as_text(s: np.ndarray) -> str:
    """A sketch as text: 16 hex digits for each kept hash, ascending."""
    return s.astype(">u8").tobytes().hex()


def from_text(s: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(s), ">u8").astype(np.uint64)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 fraction: float = FRACTION) -> DataFrame:
    """``id, n_chars, fingerprint`` for every row; a null text counts as empty (empty fingerprint)."""
    def run(batches):
        for b in slices(batches):
            texts = text_of(b.column(1))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([len(t) for t in texts], pa.int64()),
                 pa.array([as_text(sketch(t, fraction)) for t in texts], pa.string())],
                names=["id", "n_chars", "fingerprint"])
    kept = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return kept.mapInArrow(run, f"id {kept.schema['id'].dataType.simpleString()}, n_chars long, fingerprint string")


def edited(text: str, following: str) -> str:
    """The text with its last half (rounded down, in code points) replaced by the first as many of the other."""
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


def with_following(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents dealt into stretches of ids: ``id, text, stretch, extra``, each stretch in one
    partition and in the documents' order (descending id, null ids last, repeated ids by text).

    After its own rows a stretch holds, marked ``extra``, the row that follows
    its last one, so every document meets the next without a global sort in
    one task. The bounds of the stretches are ids of the table (approximate
    quantiles of the id column alone), so the extra row of a stretch is
    known by its id: the next bound below, or the largest id after the last.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"),
                       F.coalesce(F.col(id_col).cast("long"), F.lit(_LOWEST)).alias("key"))
    n = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    shares = [i / n for i in range(1, n)]
    found = rows.select(F.percentile_approx("key", shares, 100 * n).alias("bounds"), F.max("key").alias("largest")).first()
    largest = found["largest"] if found["largest"] is not None else 0
    bounds = F.array(*[F.lit(b).cast("long") for b in sorted(set(found["bounds"] or []) - {largest})]).cast("array<long>")
    stretch = F.size(F.filter(bounds, lambda b: b < F.col("key")))
    places = F.array_compact(F.array(
        F.struct(stretch.alias("stretch"), F.lit(False).alias("extra")),
        F.when(F.array_contains(bounds, F.col("key")), F.struct((stretch + 1).alias("stretch"), F.lit(True).alias("extra"))),
        F.when(F.col("key") == largest, F.struct(F.lit(0).alias("stretch"), F.lit(True).alias("extra")))))
    return (rows.select("id", "text", "key", F.explode(places).alias("place"))
            .select("id", "text", "key", "place.stretch", "place.extra")
            .repartition(n, "stretch")
            .sortWithinPartitions("stretch", "extra", F.desc("key"), F.col("id").isNull(), F.col("text").asc_nulls_first()))


def edit_likeness(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  fraction: float = FRACTION) -> DataFrame:
    """Every document's fingerprint beside those of its edited text and of the next document:
    ``id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next``.

    Next is by descending id (null ids last, rows that repeat an id by their
    text), and the first after the last; a single document follows itself.
    """
    def run(batches):
        def result(row, following):
            id_, text, own = row
            changed = edited(text, following[1])
            new = sketch(changed, fraction)
            return (id_, len(text), hashlib.sha256(changed.encode("utf-8", "replace")).hexdigest(), as_text(own),
                    as_text(new), resemblance(own, new), resemblance(own, following[2]))

        def packed(rows):
            cols = list(zip(*rows))
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)],
                                              names=["id", "n_chars", "edited_sha256", "fingerprint",
                                                     "edited_fingerprint", "near_edited", "near_next"])
        waiting, at = None, None
        for b in slices(batches):
            out = []
            for id_, text, stretch, extra in zip(b.column(0).to_pylist(), text_of(b.column(1)),
                                                 b.column(2).to_pylist(), b.column(3).to_pylist()):
                if stretch != at:
                    waiting, at = None, stretch
                if extra and waiting is None:
                    continue  # a stretch without own rows, or a further row that repeats the extra id
                row = (id_, text, sketch(text, fraction))
                if waiting is not None:
                    out.append(result(waiting, row))
                waiting = None if extra else row
            if out:
                yield packed(out)
    dealt = with_following(docs, id_col, text_col).select("id", "text", "stretch", "extra")
    return dealt.mapInArrow(run, "id long, n_chars long, edited_sha256 string, fingerprint string, "
                                 "edited_fingerprint string, near_edited double, near_next double")
