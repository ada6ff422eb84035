"""BPE encoding and decoding by a contiguous rank array.

A short word keeps its part ids and the ranks of its adjacent pairs in two
flat lists. The smallest rank is found by a scan, its right-hand boundary is
deleted and the two neighbouring ranks are looked up again, until no pair has
a rank. For words above ``LONG_WORD`` bytes, where a scan per merge would be
quadratic, the same merges run over a heap of pairs.

Byte-level vocabulary files (``tokenizers`` JSON) are read as they are; the
file's path is a parameter. Added tokens in a text become their own id, as the
library does by default. No part of a text is cut off: truncation and padding
of the file are not applied.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagesift.llm.common import Recent, per_worker, slices, text_of

LONG_WORD = 512
CACHED_WORDS, CACHED_CHUNKS = 100_000, 150_000
_NO_RANK = 1 << 62
_ID_BITS = 20

#: Fixed values of byte-level BPE: its word pattern.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_alphabet() -> dict[str, int]:
    """Byte-level BPE's printable character of each byte, by its rule: printable Latin-1
    bytes stand for themselves, the others take the code points from 256 on in order."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    out = {chr(b): b for b in plain}
    rest = [b for b in range(256) if b not in set(plain)]
    out.update({chr(256 + i): b for i, b in enumerate(rest)})
    return out


class BytePairCodec:
    """Encoder and decoder of one byte-level vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        chars = byte_alphabet()
        vocab: dict[str, int] = spec["model"]["vocab"]
        self.pairs: dict[tuple[int, int], int] = {}
        for rank, merge in enumerate(spec["model"]["merges"]):
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            self.pairs[vocab[a], vocab[b]] = rank << _ID_BITS | vocab[a + b]
        self.byte_ids = [0] * 256
        for char, byte in chars.items():
            self.byte_ids[byte] = vocab[char]
        added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        size = max([*vocab.values(), *added.values()]) + 1
        self.token_bytes: list[bytes] = [b""] * size
        for token, i in vocab.items():
            self.token_bytes[i] = bytes(chars[c] for c in token) if all(c in chars for c in token) else token.encode()
        for token, i in added.items():
            self.token_bytes[i] = token.encode()
        self.added = added
        self.added_pattern = re.compile("|".join(sorted(map(re.escape, added), key=len, reverse=True))) if added else None
        self.word_pattern = regex.compile(WORDS)
        # white space other than these four needs the full pattern over the whole text
        self.odd_space = regex.compile(r"[^\S \t\n\r]")
        self.chunks = re.compile(r" ?[^ \t\n\r]+|[ \t\n\r]+(?![^ \t\n\r])|[ \t\n\r]+")
        self.of_word = Recent(self._pack, CACHED_WORDS)
        self.of_chunk = Recent(self._compose, CACHED_CHUNKS)

    def merge_word(self, word: bytes) -> list[int]:
        """Token ids of one word (its bytes): the rank array of the module's text."""
        ids = [self.byte_ids[b] for b in word]
        if len(ids) > LONG_WORD:
            return self._merge_long(ids)
        rank_of = self.pairs.get
        ranks = [rank_of(p, _NO_RANK) for p in zip(ids, ids[1:])]
        while ranks:
            best = min(ranks)
            if best == _NO_RANK:
                break
            i = ranks.index(best)
            ids[i] = best & (1 << _ID_BITS) - 1
            del ids[i + 1], ranks[i]
            if i < len(ranks):
                ranks[i] = rank_of((ids[i], ids[i + 1]), _NO_RANK)
            if i:
                ranks[i - 1] = rank_of((ids[i - 1], ids[i]), _NO_RANK)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        rank_of = self.pairs.get
        heap = [(r, i) for i in range(n - 1) if (r := rank_of((ids[i], ids[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i = heapq.heappop(heap)
            j = after[i]
            if ids[i] < 0 or j >= n or rank_of((ids[i], ids[j])) != rank:
                continue  # one of its parts has been merged meanwhile
            ids[i], ids[j] = rank & (1 << _ID_BITS) - 1, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := rank_of((ids[i], ids[k]))) is not None:
                    heapq.heappush(heap, (r, i))
            if (h := before[i]) >= 0 and (r := rank_of((ids[h], ids[i]))) is not None:
                heapq.heappush(heap, (r, h))
        return [i for i in ids if i >= 0]

    def _plain(self, text: str) -> bytes:
        if self.odd_space.search(text):
            return self._compose(text)
        # a chunk ends where no word of the pattern can go on, so chunks can be cached whole
        return b"".join(map(self.of_chunk.__getitem__, self.chunks.findall(text)))

    def _compose(self, chunk: str) -> bytes:
        return b"".join(map(self.of_word.__getitem__, self.word_pattern.findall(chunk)))

    def _pack(self, word: str) -> bytes:
        return np.array(self.merge_word(word.encode("utf-8", "replace")), "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        """All token ids of a text, as little-endian unsigned 32-bit integers."""
        if self.added_pattern is None or not self.added_pattern.search(text):
            out = self._plain(text)
        else:
            parts, at = [], 0
            for m in self.added_pattern.finditer(text):
                parts += [self._plain(text[at:m.start()]), self.added[m[0]].to_bytes(4, "little")]
                at = m.end()
            out = b"".join([*parts, self._plain(text[at:])])
        return out

    def decode(self, ids: bytes) -> str:
        """The text of packed token ids; bytes that are no UTF-8 become U+FFFD."""
        tokens = np.frombuffer(ids, "<u4").tolist()
        return b"".join(map(self.token_bytes.__getitem__, tokens)).decode("utf-8", "replace")


def codec(path: str) -> BytePairCodec:
    return per_worker(("byte-pair codec", path), lambda: BytePairCodec(path))


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, ids`` for every row: all token ids of the whole text as packed little-endian
    unsigned 32-bit integers. A null or empty text has no ids (an empty binary)."""
    def run(batches):
        bpe = codec(path)
        for b in slices(batches):
            ids = [bpe.encode(t) for t in text_of(b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.binary())], names=["id", "ids"])
    kept = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return kept.mapInArrow(run, f"id {kept.schema['id'].dataType.simpleString()}, ids binary")


def decode(encoded: DataFrame, path: str, id_col: str = "id", ids_col: str = "ids") -> DataFrame:
    """``id, text`` for every row of packed ids; null ids give an empty text."""
    def run(batches):
        bpe = codec(path)
        for b in slices(batches):
            texts = [bpe.decode(i or b"") for i in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=["id", "text"])
    kept = encoded.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids"))
    return kept.mapInArrow(run, f"id {kept.schema['id'].dataType.simpleString()}, text string")


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """``id, n_tokens, ids_sha256, decoded_sha256`` for every row: digests of the ids and of the
    text decoded from them, in one pass; ``with_ids`` adds the ``ids`` themselves (array of integers)."""
    def run(batches):
        bpe = codec(path)
        for b in slices(batches):
            cols = [], [], [], []
            for text in text_of(b.column(1)):
                ids = bpe.encode(text)
                decoded = bpe.decode(ids).encode("utf-8", "replace")
                for col, value in zip(cols, (len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded).hexdigest(), ids)):
                    col.append(value)
            arrays = [b.column(0), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.string())]
            if with_ids:
                arrays.append(pa.array([np.frombuffer(i, "<i4") for i in cols[3]], pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(arrays, names=names)
    names = ["id", "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * with_ids
    kept = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = kept.schema["id"].dataType.simpleString()
    return kept.mapInArrow(run, f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids)
