"""Token ids in binary files that can be read document by document.

A file is a sequence of independent zstandard frames, one per document, each
holding its ids as little-endian unsigned integers (2 bytes wide if the
vocabulary allows, else 4). Two skippable frames follow, so any zstandard
reader can also decode the file as a stream: the document ids (and which of
them are null), then the seek table of the public seekable format with the
compressed size, size and checksum (low 32 bits of xxHash64) of every frame.
``TokenFile`` reads the trailing tables and then only the frames asked for.

Documents are written in ascending id (null ids first): the table is range
partitioned by id, and every partition writes one file below its final name
only once it is complete, so a repeated task replaces its own file. The
manifest has one row per file with its first and last id, documents and ids;
positions in the whole sequence are prefix sums over the manifest.
"""

from __future__ import annotations

import os
import re
import struct
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import xxhash
import zlib
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagesift.llm.common import Recent, per_worker, slices

#: Fixed values of the zstandard seekable format.
SKIPPABLE, SEEK_TABLE, SEEKABLE = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1
CHECKSUMS = 0x80

LEVEL = 3
CACHED, BATCH_BYTES = 500_000, 16 << 20
_SIGNS = r"!-&(-/:-@\[-`{-~"
MANIFEST = "path string, first_id long, last_id long, documents long, ids long"


def filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system and inner path of a URI (file, hdfs, s3, gs) or a local path."""
    if "://" in path or path.startswith("file:"):
        return pafs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))
    return pafs.LocalFileSystem(), path


class Encoder:
    """Ids of whole texts by the tokenizers library, every distinct chunk encoded once.

    Chunks stand between spaces or line ends, which the vocabulary's word
    pattern never crosses. They are cut further where a word of the pattern
    must end, between a letter or digit and ASCII punctuation other than the
    apostrophe. Distinct pieces are looked up, and the texts' ids are gathered
    from theirs as arrays. New pieces of Latin letters alone are one word each:
    they are encoded in one call, joined by spaces, and told apart by the
    tokens that end a word.
    """

    def __init__(self, path: str, end_id: int | None):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        size = max(self.tokenizer.get_vocab_size(True), (end_id or 0) + 1)
        self.width = 2 if size <= 1 << 16 else 4
        self.kind = f"<u{self.width}"
        self.end = b"" if end_id is None else end_id.to_bytes(self.width, "little")
        ends = [i for token, i in self.tokenizer.get_vocab().items() if token.endswith("</w>")]
        self.ends_word = np.zeros(size, bool)
        self.ends_word[ends] = True
        self.pieces = re.compile(rf"[{_SIGNS}]+|[^{_SIGNS}\n]+|\n").findall
        # a sign beside a character that is neither a sign nor alphanumeric: the pattern may join the two
        self.joined = re.compile(rf"[{_SIGNS}](?=[^{_SIGNS}\n])(?![^\W_İ])|(?<=[^{_SIGNS}\n])(?<![^\W_İ])[{_SIGNS}]").search
        self.latin = re.compile(r"[A-Za-z\xC0-\xD6\xD8-\xF6\xF8-\xFF]{1,100}").fullmatch
        self.of_piece = Recent(self._alone, CACHED)

    def _alone(self, piece: str) -> bytes:
        return b"" if piece == "\n" else np.array(self.tokenizer.encode(piece, add_special_tokens=False).ids, self.kind).tobytes()

    def _learn(self, words: list[str]) -> None:
        """Encode words of Latin letters in one call."""
        ids = np.array(self.tokenizer.encode(" ".join(words), add_special_tokens=False).ids, self.kind)
        ends = np.flatnonzero(self.ends_word[ids]) + 1
        if len(ends) != len(words):
            return  # a vocabulary without word ends: each piece is encoded alone when it is asked for
        data, at = ids.tobytes(), 0
        for word, end in zip(words, (ends * self.width).tolist()):
            self.of_piece.put(word, data[at:end])
            at = end

    def _chunk_ids(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of distinct chunks, one after the other: the ids, where each chunk's start, and how many they are."""
        text = pc.binary_join(pa.array([chunks], pa.list_(pa.string())), "\n")[0].as_py()
        order = np.arange(len(chunks))
        if "<|" in text or self.joined(text):  # chunks that must stay whole go to the end
            every = text.split("\n")
            whole = np.fromiter(("<|" in c or self.joined(c) is not None for c in every), bool, len(every))
            order = np.concatenate([np.flatnonzero(~whole), np.flatnonzero(whole)])
            n = np.count_nonzero(~whole)
            pieces = self.pieces("\n".join([every[i] for i in order[:n]])) if n else []
            for i in order[n:]:
                pieces += [*["\n"] * bool(pieces or n), every[i]]
        else:
            pieces = self.pieces(text)
        coded = pa.array(pieces, pa.string()).dictionary_encode()
        distinct = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        new = set(distinct).difference(self.of_piece).difference(self.of_piece.old)
        words = list(filter(self.latin, new))
        for i in range(0, len(words), 20_000):
            self._learn(words[i:i + 20_000])
        packed = list(map(self.of_piece.__getitem__, distinct))
        sizes = np.fromiter(map(len, packed), np.int64, len(packed)) // self.width
        nth = coded.indices.to_numpy()
        ids, ends = _gather(np.frombuffer(b"".join(packed), self.kind), np.cumsum(sizes) - sizes, sizes, nth)
        breaks = np.flatnonzero(nth == distinct.index("\n")) if "\n" in distinct else np.zeros(0, np.int64)
        starts, lengths = np.zeros(len(chunks), np.int64), np.zeros(len(chunks), np.int64)
        starts[order] = first = np.concatenate([[0], ends[breaks]])
        lengths[order] = np.diff(np.concatenate([first, ends[-1:]]))
        return ids, starts, lengths

    def encode(self, texts: pa.Array) -> list[bytes]:
        """Packed ids of every text of an Arrow string column (null: empty), with the end id."""
        texts = pc.replace_substring(pc.fill_null(texts, ""), "\n", " ")
        lists = pc.split_pattern(texts, " ")
        bounds = lists.offsets.to_numpy()
        coded = lists.flatten().dictionary_encode()
        if not len(coded):
            return []
        ids, starts, lengths = self._chunk_ids(coded.dictionary)
        ids, ends = _gather(ids, starts, lengths, coded.indices.to_numpy())
        data, cuts = ids.tobytes(), (ends[bounds - bounds[0]] * self.width).tolist()
        return [data[a:b] + self.end for a, b in zip(cuts, cuts[1:])]


def _gather(ids: np.ndarray, starts: np.ndarray, lengths: np.ndarray, nth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The stretches ``nth`` of ``ids``, one after the other, and where each begins and the last one ends."""
    size = lengths[nth]
    ends = np.concatenate([[0], np.cumsum(size)])
    return ids[np.repeat(starts[nth] - ends[:-1], size) + np.arange(ends[-1])], ends


def write_frames(out, documents, width: int) -> tuple[int, int, int | None, int | None]:
    """Write ``(doc_id, packed ids)`` pairs to an open binary file; returns documents, ids, first and last id."""
    zstd = zstandard.ZstdCompressor(level=LEVEL, write_checksum=False)
    table, ids, total = [], [], 0
    for doc_id, packed in documents:
        frame = zstd.compress(packed)
        out.write(frame)
        table.append(struct.pack("<III", len(frame), len(packed), xxhash.xxh64_intdigest(packed) & 0xFFFFFFFF))
        ids.append(doc_id)
        total += len(packed) // width
    index = struct.pack("<BQ", width, len(ids)) + zstd.compress(
        np.array([i or 0 for i in ids], "<i8").tobytes() + np.array([i is None for i in ids], "u1").tobytes())
    out.write(struct.pack("<II", SKIPPABLE, len(index)) + index)
    table.append(struct.pack("<III", len(index) + 8, 0, 0))
    body = b"".join(table) + struct.pack("<IBI", len(table), CHECKSUMS, SEEKABLE)
    out.write(struct.pack("<II", SEEK_TABLE, len(body)) + body)
    return len(ids), total, ids[0] if ids else None, ids[-1] if ids else None


class TokenFile:
    """Random access to one file's documents."""

    def __init__(self, path: str):
        fs, inner = filesystem(path)
        self.file = fs.open_input_file(inner)
        end = self.file.size()
        n, flags, magic = struct.unpack("<IBI", self.file.read_at(9, end - 9))
        if magic != SEEKABLE or flags != CHECKSUMS:
            raise ValueError(f"{path} has no seek table")
        table = np.frombuffer(self.file.read_at(12 * n, end - 9 - 12 * n), "<u4").reshape(n, 3)
        self.sizes, self.lengths, self.sums = table[:-1, 0], table[:-1, 1], table[:-1, 2]
        self.offsets = np.concatenate([[0], np.cumsum(table[:, 0], dtype=np.int64)])
        index = self.file.read_at(int(table[-1, 0]) - 8, int(self.offsets[-2]) + 8)
        self.width, documents = struct.unpack("<BQ", index[:9])
        rest = zstandard.ZstdDecompressor().decompress(index[9:])
        numbers = np.frombuffer(rest[:8 * documents], "<i8").tolist()
        self.ids = [None if null else i for i, null in zip(numbers, rest[8 * documents:])]
        self._zstd = zstandard.ZstdDecompressor()

    def __len__(self) -> int:
        return len(self.ids)

    def document(self, nth: int) -> np.ndarray:
        """The ids of the nth document of the file; only its frame is read, and its checksum is verified."""
        data = self._zstd.decompress(self.file.read_at(int(self.sizes[nth]), int(self.offsets[nth])))
        if xxhash.xxh64_intdigest(data) & 0xFFFFFFFF != int(self.sums[nth]):
            raise ValueError(f"checksum of document {nth} does not match")
        return np.frombuffer(data, f"<u{self.width}")

    def close(self) -> None:
        self.file.close()


def write(docs: DataFrame, folder: str, path: str, end_id: int | None = None,
          id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and write all documents in ascending id; returns the manifest (``MANIFEST``), one row
    per file written, which is collected to the driver: a few values for each file.

    A null text counts as empty (its document has the end id only); rows that
    repeat an id stay, next to each other, ordered by text. An empty table
    writes no file.
    """
    def run(batches):
        encoder = per_worker(("word encoder", path, end_id), lambda: Encoder(path, end_id))

        def documents(first):
            for b in (first, *rest):
                for i, ids in zip(b.column(0).to_pylist(), encoder.encode(b.column(1))):
                    yield i, ids
        rest = slices(batches, max_bytes=BATCH_BYTES)
        first = next((b for b in rest if b.num_rows), None)
        if first is None:
            return
        fs, inner = filesystem(folder)
        fs.create_dir(inner, recursive=True)
        from pyspark import TaskContext
        name = f"tokens-{TaskContext.get().partitionId():09d}.zst"
        attempt = f"{inner}/.{name}.{uuid.uuid4().hex}"
        with fs.open_output_stream(attempt) as out:
            n, total, low, high = write_frames(out, documents(first), encoder.width)
        fs.move(attempt, f"{inner}/{name}")
        yield pa.RecordBatch.from_pydict(
            {"path": [f"{folder.rstrip('/')}/{name}"], "first_id": [low], "last_id": [high], "documents": [n], "ids": [total]},
            schema=pa.schema([("path", pa.string()), ("first_id", pa.int64()), ("last_id", pa.int64()),
                              ("documents", pa.int64()), ("ids", pa.int64())]))
    spark = docs.sparkSession
    ordered = (docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
               .repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "id")
               .sortWithinPartitions(F.col("id").asc_nulls_first(), F.col("text").asc_nulls_first()))
    rows = sorted(ordered.mapInArrow(run, MANIFEST).collect(), key=lambda r: r["path"])
    return spark.createDataFrame(rows, MANIFEST)


def with_starts(manifest: DataFrame) -> DataFrame:
    """The manifest with ``start``, the number of ids in all files before. One row per file."""
    rows, at, out = sorted(manifest.collect(), key=lambda r: r["path"]), 0, []
    for r in rows:
        out.append((*r, at))
        at += r["ids"]
    return manifest.sparkSession.createDataFrame(out, MANIFEST + ", start long")


def read(manifest: DataFrame, digest: bool = False) -> DataFrame:
    """All documents of the files: ``id, start, n_tokens`` and the ``ids`` (array of integers), or with
    ``digest`` their ``ids_crc32`` (of the ids as 32-bit integers) instead."""
    last = ("ids_crc32 long", pa.int64()) if digest else ("ids array<int>", pa.list_(pa.int32()))

    def run(batches):
        for b in batches:
            for path, at in zip(b.column("path").to_pylist(), b.column("start").to_pylist()):
                file = TokenFile(path)
                for low in range(0, len(file), 256):
                    rows = []
                    for nth in range(low, min(low + 256, len(file))):
                        ids = file.document(nth)
                        rows.append((file.ids[nth], at, len(ids), zlib.crc32(ids.astype("<u4").tobytes()) if digest else ids.astype(np.int32)))
                        at += len(ids)
                    cols = list(zip(*rows))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.int64(), last[1]))],
                        names=["id", "start", "n_tokens", last[0].split()[0]])
                file.close()
    files = with_starts(manifest)
    n = max(1, files.count())
    return (files.select("path", "start").repartition(n, "path")
            .mapInArrow(run, f"id long, start long, n_tokens long, {last[0]}"))


def lookup(spark: SparkSession, manifest: DataFrame, ids: list[int]) -> DataFrame:
    """``id, ids`` of the requested documents: files whose id range cannot hold one are not
    opened, and of the others only the requested frames are read and decompressed."""
    wanted = sorted(set(ids))

    def run(batches):
        for b in batches:
            for path in b.column(0).to_pylist():
                file = TokenFile(path)
                hits = [nth for nth, i in enumerate(file.ids) if i in set_wanted]
                for nth in hits:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([file.ids[nth]], pa.int64()), pa.array([file.document(nth).astype(np.int32)], pa.list_(pa.int32()))],
                        names=["id", "ids"])
                file.close()
    set_wanted = frozenset(wanted)
    holds = F.exists(F.array(*[F.lit(i).cast("long") for i in wanted]).cast("array<long>"),
                     lambda i: (i >= F.col("first_id")) & (i <= F.col("last_id")))
    return manifest.where(holds).select("path").mapInArrow(run, "id long, ids array<int>")
