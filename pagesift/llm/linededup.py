"""Line dedup: hashes of lines, range partitioned, give a bitmap of kept lines for each document.

A text is split at ``\\n``; a line's key is the line without white space at both
ends, A-Z lower-cased. A key of at least ``least`` code points that stands in two
or more documents loses its lines everywhere but in the document with the
smallest id; there all of them stay.

Only (hash of the key, document, position) rows are shuffled, 128 bits for a
hash: range partitioned by all of these and sorted, so the rows of a key follow
one another, the smallest document first, and one pass over a partition tells
first occurrences from later ones while holding a single row. The range bounds
also cut between the documents of one key, so a line that a third of all
documents hold is spread over many tasks; rows of the key that a partition
begins with are then undecided, until the smallest documents of the keys at the
partitions' ends (two rows for each partition, whatever the data) are known.

The result is a table of compressed bitmaps, one for each text that loses a
line (``bitmaps``); ``kept`` joins them to the texts.

Defined cases: a null or empty text is one empty line, which is kept; rows with
the same id are one document, each with its own bitmap, and equal rows have
equal ones (a text is known by its id and hash); null ids are one document that
comes after all others; an empty table has no bitmaps.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagesift.llm.common import ascii_lower, drop_written, slices, text_of, written

LEAST = 10
_SPACE = " \t\n\x0b\x0c\r"
_DROPPED, _OPEN, _LAST = 0, 1, 2  # a line to drop; a row of a partition's first key; a partition's last key


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(_SPACE)))


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"), F.xxhash64(text).alias("content"))


def _scan(batches):
    """Sorted (h1, h2, no_id, id, content, pos) rows to ``_DROPPED`` lines, ``_OPEN`` rows and one ``_LAST`` row."""
    first = None   # (h1, h2, no_id, id) of the run that the last row belongs to
    opening = True  # still in the partition's first run
    before = None  # the last row, to leave out rows that equal it

    def out(state, cols):
        n = len(cols[0])
        kinds = (pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int32())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)] + [pa.array([state] * n, pa.int8())],
                                          names=["h1", "h2", "no_id", "id", "content", "pos", "state"])
    for b in batches:
        if not b.num_rows:
            continue
        h1, h2, no_id, id_, content, pos = (np.asarray(b.column(i).to_numpy(zero_copy_only=False)) for i in range(6))
        cols = [h1, h2, no_id, id_, content, pos]
        prev = [np.concatenate([c[:1] if before is None else np.array([v], c.dtype), c[:-1]])
                for c, v in zip(cols, before or [None] * 6)]
        new = (h1 != prev[0]) | (h2 != prev[1])
        again = np.logical_and.reduce([c == p for c, p in zip(cols, prev)])
        if before is None:
            again[0] = False
        run = np.maximum.accumulate(np.where(new, np.arange(len(h1)), -1))  # the row that began the run; -1: an earlier batch
        start = first or tuple(c[0] for c in cols[:4])
        first_null = np.where(run < 0, start[2], no_id[run])
        first_id = np.where(run < 0, start[3], id_[run])
        opened = (run < 0) if opening else np.zeros(len(h1), bool)
        drop = ((no_id != first_null) | (id_ != first_id)) & ~opened & ~again
        for state, mask in ((_DROPPED, drop), (_OPEN, opened & ~again)):
            if mask.any():
                yield out(state, [c[mask] for c in cols])
        opening = opening and bool(run[-1] < 0)
        first = (h1[-1], h2[-1], bool(first_null[-1]), first_id[-1])
        before = [c[-1] for c in cols]
    if first is not None:
        yield out(_LAST, [[v] for v in (*first, 0, 0)])


def _bitmap(positions: list[int]) -> bytes:
    kept = np.ones(max(positions) // 8 * 8 + 8, np.uint8)
    kept[positions] = 0
    return zlib.compress(np.packbits(kept).tobytes(), 6)


def lost_lines(bitmap: bytes) -> np.ndarray:
    """Positions of the lines that a bitmap drops."""
    return np.flatnonzero(np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8)) == 0)


def bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST) -> DataFrame:
    """``id, content, bitmap``: one row for each text that loses a line. ``content`` is the text's
    xxhash64; a bitmap (packed, zlib) has a bit for each line, 1 if it stays, and ends with the byte of the
    last lost line; lines after it stay."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    lines = _texts(docs, id_col, text_col).select("id", "content", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    keyed = lines.select("id", "content", "pos", line_key(F.col("line")).alias("key")).where(F.char_length("key") >= least)
    # written, since the range bounds are sampled from all rows before these are dealt
    rows = written(keyed.select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"), F.col("id").isNull().alias("no_id"),
                        F.coalesce("id", F.lit(0)).alias("id"), "content", "pos"), "lines-keyed")
    keys = ["h1", "h2", "no_id", "id", "content", "pos"]
    scanned = written(rows.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).mapInArrow(
        _scan, "h1 long, h2 long, no_id boolean, id long, content long, pos int, state byte"), "lines-scanned")
    drop_written(rows)
    who = F.struct("no_id", "id")
    ends = (scanned.where(F.col("state") != _DROPPED).groupBy("h1", "h2").agg(F.min(who).alias("smallest")))
    later = (scanned.where(F.col("state") == _OPEN)
             # at most two keys for each partition of the scan
             .join(F.broadcast(ends), ["h1", "h2"]).where(who != F.col("smallest")))
    lost = scanned.where(F.col("state") == _DROPPED).select("no_id", "id", "content", "pos").unionByName(
        later.select("no_id", "id", "content", "pos"))
    # a group is one document's lines; a set, since rows that repeat a text repeat its lines
    grouped = lost.groupBy("no_id", "id", "content").agg(F.collect_set("pos").alias("lost"))

    def pack(batches):
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array([_bitmap(p) for p in b.column(2).to_pylist()], pa.binary())],
                names=["id", "content", "bitmap"])
    packed = (grouped.select(F.when(~F.col("no_id"), F.col("id")).alias("id"), "content", "lost")
              .mapInArrow(pack, "id long, content long, bitmap binary"))
    out = written(packed, "lines-bitmaps")
    drop_written(scanned)
    return out


def kept(docs: DataFrame, maps: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, n_lines, n_dropped, text`` of every row, ``text`` being the lines that stay."""
    texts, maps = _texts(docs, id_col, text_col), maps.withColumnsRenamed({"id": "m_id", "content": "m_content"})
    joined = texts.join(maps, (F.col("content") == F.col("m_content")) & F.col("id").eqNullSafe(F.col("m_id")), "left")

    def run(batches):
        for b in slices(batches):
            out = []
            for text, bitmap in zip(text_of(b.column(1)), b.column(2).to_pylist()):
                lines = text.split("\n")
                lost = set() if bitmap is None else set(lost_lines(bitmap).tolist())
                out.append((len(lines), len(lost), "\n".join(x for i, x in enumerate(lines) if i not in lost) if lost else text))
            n, dropped, rest = zip(*out)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(dropped, pa.int64()), pa.array(rest, pa.string())],
                                             names=["id", "n_lines", "n_dropped", "text"])
    return joined.select("id", "text", "bitmap").mapInArrow(run, "id long, n_lines long, n_dropped long, text string")
