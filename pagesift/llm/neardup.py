"""Near-duplicate documents by SuperMinHash, banding, verification and union-find.

A document's set is its distinct 5-word shingles (words between ASCII white
space, A-Z lower-cased; a shorter text is one shingle). Each shingle draws a
random permutation of the signature's slots; at its j-th slot it offers
``j + r`` with a fresh random r, and a slot keeps its smallest offer. Offers of
step j are never below j, so a document is finished as soon as all its slots
lie below the next step: long documents after the first. A batch of documents
steps together, as arrays.

1. Documents with equal sets are one node, their smallest id.
2. Bands of slots (``banding``; 32 of 7 for a threshold of 85 per cent) are hashed to buckets. Every node is
   linked to the smallest node of each of its buckets; the components of these
   unverified links are the candidate groups. A link at the threshold shares a
   bucket with probability 1 - 4e-6, and is then inside one group.
3. The nodes of a group are dealt by hash into blocks of about
   ``BLOCK_SHINGLES`` shingles and ``BLOCK_DOCS`` documents, and every
   pair of blocks is one tile. A tile compares the pairs that its signatures do
   not rule out on their full sets, document by document, and returns a spanning
   forest (union-find) of the true links in it. No pair list of a group or tile
   is ever made, and no group is ever in one task.
4. The components of all forests are those of all true links.

Defined cases: documents without words have an empty set and no links; rows
that repeat an id are one document, linked by any of their texts; rows without
id are never linked and keep a null component.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagesift.llm.common import WORD_SPACE, Recent, ascii_lower, drop_written, per_worker, slices, text_of, written
from pagesift.llm.components import components

SHINGLE, THRESHOLD = 5, 85  # words; per cent
MAX_SLOTS, MISSED = 224, 2e-5  # of a signature; probability that a link at the threshold shares no bucket


def banding(threshold: int = THRESHOLD) -> tuple[int, int]:
    """(bands, rows) of the sharpest banding within ``MAX_SLOTS`` and ``MISSED``: 32 x 7 for 85 per cent, 37 x 6 for 80."""
    for rows in range(20, 1, -1):
        bands = MAX_SLOTS // rows
        if (1 - (threshold / 100)**rows)**bands <= MISSED:
            return bands, rows
    raise ValueError("no banding for a threshold this low")


BANDS, ROWS = banding()
SLOTS = BANDS * ROWS
BLOCK_SHINGLES, BLOCK_DOCS = 1 << 17, 1 << 11
#: Candidate lists up to this many rows (24 bytes each) are broadcast to the scan; longer ones are joined by a shuffle.
BROADCAST_ROWS = 2_000_000
CACHED_WORDS = 150_000
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_U = np.uint64
_PLACES = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], _U)
_STEP_BITS = _U(48)
_UNSET = _U(2**64 - 1)


def _mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, element by element."""
    h = h ^ (h >> _U(30))
    h = h * _U(0xBF58476D1CE4E5B9)
    h ^= h >> _U(27)
    h *= _U(0x94D049BB133111EB)
    h ^= h >> _U(31)
    return h


class Shingler:
    """Full shingle sets of texts, as sorted arrays of 64-bit hashes."""

    def __init__(self):
        self.words = Recent(xxhash.xxh3_64_intdigest, CACHED_WORDS)

    def __call__(self, text: str) -> np.ndarray:
        words = text.encode("utf-8", "replace").translate(_LOWER).split()
        w = np.fromiter(map(self.words.__getitem__, words), _U, len(words))
        if not len(w):
            return w
        if len(w) < SHINGLE:
            return _mix(np.atleast_1d((w * _PLACES[:len(w)]).sum(dtype=_U) + _U(len(w))))
        n = len(w) - SHINGLE + 1
        h = w[:n] * _PLACES[0]
        for k in range(1, SHINGLE):
            h += w[k:k + n] * _PLACES[k]
        return np.unique(_mix(h))


def shingler() -> Shingler:
    return per_worker(("shingler",), Shingler)


def signatures(sets: list[np.ndarray], slots: int = SLOTS) -> np.ndarray:
    """SuperMinHash signatures of sets of 64-bit hashes: one row of as many offers as slots each."""
    sig = np.full(len(sets) * slots, _UNSET)
    sizes = [len(s) for s in sets]
    items = np.concatenate(sets) if sets else np.zeros(0, _U)
    owner = np.repeat(np.arange(len(sets), dtype=np.int64) * slots, sizes)
    order = None  # of each item still in play: its permutation so far
    for step in range(slots):
        if step:
            open_docs = sig.reshape(-1, slots).max(1) >= _U(step) << _STEP_BITS
            go_on = np.flatnonzero(open_docs[owner // slots])
            if not len(go_on):
                break
            if order is None:
                items, owner, first = items[go_on], owner[go_on], slot[go_on]
                order = np.tile(np.arange(slots, dtype=np.uint8 if slots <= 256 else np.uint16), (len(items), 1))
                order[np.arange(len(items)), first] = 0
            elif len(go_on) < len(items):
                items, owner, order = items[go_on], owner[go_on], order[go_on]
        draw = _mix(items + _U(0x9E3779B97F4A7C15 * (step + 1) % 2**64))
        at = step + ((draw >> _U(40)) * _U(slots - step) >> _U(24)).astype(np.int64)
        if order is None:
            slot = at
        else:
            rows = np.arange(len(items))
            slot = order[rows, at].astype(np.int64)
            order[rows, at] = order[:, step]
        offer = (_U(step) << _STEP_BITS) | (_mix(draw) >> _U(64 - 48))
        np.minimum.at(sig, owner + slot, offer)
    return sig.reshape(len(sets), slots)


def band_keys(sig: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """One 64-bit bucket for each band; buckets of different bands never meet but by chance."""
    rows = sig.reshape(len(sig), bands, -1)
    h = np.broadcast_to(np.arange(1, bands + 1, dtype=_U) * _U(0xD6E8FEB86659FD93), rows.shape[:2]).copy()
    for k in range(rows.shape[2]):
        h = _mix(h + rows[:, :, k])
    return h


def linked(a: np.ndarray, b: np.ndarray, threshold: int = THRESHOLD) -> bool:
    """Whether two full sets are alike enough, exactly."""
    small, large = sorted((len(a), len(b)))
    if not small or 100 * small < threshold * large:
        return False
    common = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * common >= threshold * (len(a) + len(b) - common)


def forest(ids: list[int], sets: list[np.ndarray], threshold: int = THRESHOLD) -> list[tuple[int, int]]:
    """A spanning forest of the true links between the given sets, as pairs of ids."""
    n = len(ids)
    root, out = np.arange(n), []  # of each set: the component it is in so far
    if n > 24:
        # pairs that can be links by size and, but for five standard errors, by signature
        share = threshold / 100
        least = (share - 5 * math.sqrt(share * (1 - share) / SLOTS)) * SLOTS
        sig = np.concatenate([signatures(sets[i:i + 64]) for i in range(0, n, 64)]).astype(np.uint16)  # low bits tell slots apart
        size = np.array([len(s) for s in sets])
    for i in range(1, n):
        near = np.arange(i)
        if n > 24:
            near = np.flatnonzero(100 * np.minimum(size[:i], size[i]) >= threshold * np.maximum(size[:i], size[i]))
            equal = np.count_nonzero(sig[near] == sig[i], axis=1)
            near, equal = near[equal >= least], equal[equal >= least]
            near = near[np.argsort(-equal, kind="stable")]  # likeliest first
        while len(near):
            j, near = near[0], near[1:]
            if linked(sets[i], sets[j], threshold):
                if ids[i] != ids[j]:
                    out.append((ids[i], ids[j]))
                root[root == root[j]] = root[i]
                near = near[root[near] != root[i]]
    return out


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = THRESHOLD) -> DataFrame:
    """``id, n_shingles, content, bands`` of every row; ``content`` tells different sets apart and is null for empty ones."""
    bands, rows = banding(threshold)

    def run(batches):
        cut = shingler()
        for b in slices(batches, 64):
            sets = [cut(t) for t in text_of(b.column(1))]
            keys = band_keys(signatures(sets, bands * rows), bands).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([len(s) for s in sets], pa.int64()),
                 pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
                 pa.array([k if len(s) else None for k, s in zip(keys, sets)], pa.list_(pa.int64()))],
                names=["id", "n_shingles", "content", "bands"])
    return _texts(docs, id_col, text_col).mapInArrow(run, "id long, n_shingles long, content binary, bands array<long>")


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))


def _candidate_groups(nodes: DataFrame) -> DataFrame:
    """``node, label`` of all nodes that share a bucket with another."""
    rows = nodes.select("node", F.explode("bands").alias("bucket"))
    hubs = rows.groupBy("bucket").agg(F.min("node").alias("hub"), F.max("node").alias("top")).where("top > hub")
    return components(rows.join(hubs.select("bucket", "hub"), "bucket").where("node <> hub")
                      .select(F.col("node").alias("a"), F.col("hub").alias("b")))


def _tiles(groups: DataFrame) -> DataFrame:
    """``id, label, block, blocks`` of every row of ``groups`` (``node, label, n_shingles``): blocks bounded in shingles and documents."""
    blocks = groups.groupBy("label").agg(F.greatest(F.ceil(F.sum("n_shingles") / BLOCK_SHINGLES),
                                                    F.ceil(F.count("*") / BLOCK_DOCS)).alias("blocks"))
    return groups.join(blocks, "label").select(F.col("node").alias("id"), "label",
                                               F.pmod(F.xxhash64("node"), F.col("blocks")).alias("block"), "blocks")


def _links(docs: DataFrame, tiles: DataFrame, few: bool, threshold: int = THRESHOLD) -> DataFrame:
    """``a, b``: spanning forests of the true links within the tiles of ``tiles`` (``id, label, block, blocks``)."""
    def sets(batches):
        cut = shingler()
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:4], pa.array([cut(t).tobytes() for t in text_of(b.column(4))], pa.binary())],
                names=["id", "label", "block", "blocks", "shingles"])

    def forests(batches):
        def pack(now):
            links = forest([i for i, _ in now], [np.frombuffer(s, _U) for _, s in now], threshold) if len(now) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], names=["a", "b"])
        at, now = None, []
        for b in batches:
            keys = zip(*(b.column(k).to_pylist() for k in range(3)))
            for key, i, s in zip(keys, b.column(3).to_pylist(), b.column(4).to_pylist()):
                if key != at:
                    if len(now) > 1:
                        yield pack(now)
                    at, now = key, []
                now.append((i, s))
        if len(now) > 1:
            yield pack(now)
    cols = ["id", "label", "block", "blocks"]
    found = _texts(docs, "id", "text").join(F.broadcast(tiles) if few else tiles, "id").select(*cols, "text")
    shingled = found.mapInArrow(sets, "id long, label long, block long, blocks long, shingles binary")
    tiled = (shingled.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
             .select("label", F.least("block", "other").alias("row"), F.greatest("block", "other").alias("col"), "id", "shingles"))
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (tiled.repartition(4 * n, "label", "row", "col").sortWithinPartitions("label", "row", "col")
            .mapInArrow(forests, "a long, b long"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = THRESHOLD) -> DataFrame:
    """``id, n_shingles, component, kept`` for every row of ``docs``: the smallest id that links
    of a likeness of ``threshold`` per cent or more reach, and whether that is the row's own (also true without an id)."""
    docs = _texts(docs, id_col, text_col)
    rows = written(features(docs, "id", "text", threshold), "features")
    nodes = written(rows.where("content IS NOT NULL AND id IS NOT NULL").groupBy("content")
                    .agg(F.min("id").alias("node"), F.first("n_shingles").alias("n_shingles"), F.first("bands").alias("bands")), "nodes")
    groups = written(_candidate_groups(nodes).join(nodes.groupBy("node").agg(F.max("n_shingles").alias("n_shingles")), "node"), "groups")
    tiles = _tiles(groups)
    found = components(_links(docs, tiles, groups.count() <= BROADCAST_ROWS, threshold))
    # rows that repeat an id with different texts are one document: a link between their nodes
    repeated = (rows.where("id IS NOT NULL AND content IS NOT NULL").groupBy("id")
                .agg(F.min("content").alias("x"), F.max("content").alias("y")).where("x <> y").select("id"))
    if repeated.limit(1).count():
        same = rows.join(repeated, "id").join(nodes.select("content", "node"), "content").where("id <> node")
        found = components(found.select(F.col("node").alias("a"), F.col("label").alias("b"))
                           .unionByName(same.select(F.col("id").alias("a"), F.col("node").alias("b"))))
    label = nodes.select("content", "node").join(found, "node", "left").select("content", F.coalesce("label", "node").alias("label"))
    out = rows.select("id", "n_shingles", "content").join(written(label, "labels"), "content", "left")
    component = F.when(F.col("id").isNotNull(), F.least("id", "label"))
    return out.select("id", "n_shingles", component.alias("component"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, with all their columns, of one document of each component: the one with
    the smallest id. Of rows that repeat its id those stay whose texts have different words (they
    are one document); of rows equal in that, the one whose columns come first in order.
    Rows without id all stay."""
    found = written(near_duplicates(docs, id_col, text_col, threshold).select("id", "kept"), "kept")
    # columns are named through their tables: the documents may have an "id" of their own
    dropped = found.where("NOT kept").select("id").distinct()
    out = docs.join(dropped, docs[id_col].cast("long") == dropped["id"], "left_anti")
    repeated = found.where("kept AND id IS NOT NULL").groupBy("id").count().where("count > 1").select("id")
    if repeated.limit(1).count():
        same = out[id_col].cast("long") == repeated["id"]
        again = out.join(repeated, same, "left_semi")
        words = F.regexp_replace(ascii_lower(F.coalesce(again[text_col], F.lit(""))), f"[{WORD_SPACE}]+", " ")
        key = F.trim(words)
        order = [F.col(f"`{c}`").asc_nulls_first() for c in docs.columns if docs.schema[c].dataType.simpleString() not in ("variant", "void")
                 and not docs.schema[c].dataType.simpleString().startswith("map")]
        nth = F.row_number().over(Window.partitionBy(again[id_col], key).orderBy(*order))
        once = again.withColumn("_nth of words", nth).where(F.col("`_nth of words`") == 1).drop("_nth of words")
        out = out.join(repeated, same, "left_anti").unionByName(once)
    return out
