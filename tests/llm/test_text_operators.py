"""BPE, fingerprints, personal data, token files: against brute force, on edge rows and empty tables."""
import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from pagesift.llm import bpe, fingerprint, pii, queries, tokenfile
from pagesift.llm.common import Recent, shared_path

SMALL = "/root/testdata/sf0.001"
PARTS = [" ", "  ", "\n", "\t", " ", "\x1c", "\x85", "a", "é", "don't", "'s", "<|endoftext|>", "<|startoftext|>", "123", "%%%", "😀",
         "́", "̸", "=", "ß", "漢字", "\x0b", "x" * 150, "²", "_", "İ", "K", "\x00", "word", "The", "THE!!", "ÀÉ"]


def texts(n, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 12))) for _ in range(n)]


@pytest.fixture(scope="module")
def libraries():
    from tokenizers import Tokenizer
    return {n: Tokenizer.from_file(queries.vocabulary(n)) for n in ("byte_bpe_50k.json", "word_bpe_49k.json")}


def test_bpe_equals_the_library(libraries):
    library, codec = libraries["byte_bpe_50k.json"], bpe.BytePairCodec(queries.vocabulary("byte_bpe_50k.json"))
    for t in [*texts(1500), "ab" * 3000, "é" * 2000, "z" * 513]:
        ids = library.encode(t, add_special_tokens=False).ids
        packed = codec.encode(t)
        assert np.frombuffer(packed, "<u4").tolist() == ids, t
        assert codec.decode(packed) == library.decode(ids, skip_special_tokens=False)


def test_bpe_long_words_merge_as_short_ones(monkeypatch):
    codec = bpe.BytePairCodec(queries.vocabulary("byte_bpe_50k.json"))
    words = [w.encode() for w in texts(200, 3)]
    short = [codec.merge_word(w) for w in words]
    monkeypatch.setattr(bpe, "LONG_WORD", 0)
    assert [codec.merge_word(w) for w in words] == short


def test_bpe_decodes_broken_bytes():
    codec = bpe.BytePairCodec(queries.vocabulary("byte_bpe_50k.json"))
    assert codec.decode(np.array([codec.byte_ids[0xC3]], "<u4").tobytes()) == "�" and codec.decode(b"") == ""


def test_op2_is_a_round_trip(spark, docs, edge_docs, no_docs, libraries):
    library = libraries["byte_bpe_50k.json"]
    for table in (docs, edge_docs):
        rows = {}
        for r in table.select("doc_id", "text").collect():
            ids = library.encode(r.text or "", add_special_tokens=False).ids
            rows.setdefault(r.doc_id, []).append((len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
                                                  hashlib.sha256((r.text or "").encode()).hexdigest()))
        out = bpe.round_trip(table, queries.vocabulary("byte_bpe_50k.json")).collect()
        assert sorted((str(r.id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in out) == sorted(
            (str(i), *v) for i, vs in rows.items() for v in vs)
    assert bpe.round_trip(no_docs, queries.vocabulary("byte_bpe_50k.json")).count() == 0
    path = queries.vocabulary("byte_bpe_50k.json")
    back = bpe.decode(bpe.encode(edge_docs, path), path).collect()
    assert sorted((r.text for r in back)) == sorted(r.text or "" for r in edge_docs.select("text").collect())


def test_recent_keeps_its_bound():
    memo = Recent(lambda k: k * 2, 10)
    assert [memo[i % 25] for i in range(500)] == [i % 25 * 2 for i in range(500)] and len(memo) + len(memo.old) <= 20


def test_token_encoder_equals_the_library(libraries):
    library, encoder = libraries["word_bpe_49k.json"], tokenfile.Encoder(queries.vocabulary("word_bpe_49k.json"), 2)
    sample = texts(1500, 5)
    out = encoder.encode(pa.array(["x y", None, *sample, ""], pa.string()))
    for t, packed in zip(["x y", "", *sample, ""], out):
        assert np.frombuffer(packed, "<u2").tolist() == library.encode(t, add_special_tokens=False).ids + [2], t
    assert encoder.encode(pa.array([], pa.string())) == []


def test_op6_files(spark, docs, edge_docs, no_docs, libraries, tmp_path):
    library = libraries["word_bpe_49k.json"]
    for n, table in enumerate((docs, edge_docs)):
        files = tokenfile.write(table, str(tmp_path / str(n)), queries.vocabulary("word_bpe_49k.json"), 2)
        rows = sorted(((r.doc_id is not None, r.doc_id or 0, r.text is not None, r.text or "") for r in table.select("doc_id", "text").collect()))
        want, at = [], 0
        for known, i, _, t in rows:
            ids = np.array(library.encode(t, add_special_tokens=False).ids + [2], "<u4")
            want.append((i if known else None, at, len(ids), zlib.crc32(ids.tobytes())))
            at += len(ids)
        got = sorted(tokenfile.read(files, digest=True).collect(), key=lambda r: r.start)
        assert [tuple(r) for r in got] == want
        whole = sorted(tokenfile.read(files).collect(), key=lambda r: r.start)
        assert [len(r.ids) for r in whole] == [w[2] for w in want]
        some = tokenfile.lookup(spark, files, [7, 9, 123456789]).collect()
        assert {r.id for r in some} <= {7, 9} and len(some) == sum(w[0] in (7, 9) for w in want)
    empty = tokenfile.write(no_docs, str(tmp_path / "none"), queries.vocabulary("word_bpe_49k.json"), 2)
    assert empty.count() == 0 and tokenfile.read(empty, digest=True).count() == 0


def test_token_file_reads_frames_and_checks_them(tmp_path):
    import zstandard
    path = tmp_path / "t.zst"
    with open(path, "wb") as f:
        tokenfile.write_frames(f, [(5, b"\1\0\2\0"), (None, b""), (9, b"\7\0")], 2)
    file = tokenfile.TokenFile(str(path))
    assert file.ids == [5, None, 9] and [file.document(i).tolist() for i in range(3)] == [[1, 2], [], [7]]
    file.close()
    with open(path, "rb") as f:  # any zstandard reader sees the documents in a row
        assert zstandard.ZstdDecompressor().stream_reader(f, read_across_frames=True).read() == b"\1\0\2\0\7\0"
    data = bytearray(path.read_bytes())
    at = data.index(b"\x07\x00")
    data[at] = 8
    path.write_bytes(data)
    with pytest.raises(ValueError, match="checksum"):
        tokenfile.TokenFile(str(path)).document(2)


def brute_spans(t):
    out = []
    for kind, p in (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
                    ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")):
        for m in re.finditer(p, t):
            d = re.sub("[^0-9]", "", m[0])
            if (kind == "ip" and any(int(x) > 255 for x in m[0].split(".")) or kind == "phone" and not 9 <= len(d) <= 15
                    or kind == "card" and not (12 <= len(d) <= 19 and pii.luhn(d))):
                continue
            out.append((kind, *m.span()))
    return sorted(out, key=lambda s: (s[1], pii.KINDS.index(s[0]), s[2]))


def test_base_spans_equal_plain_patterns():
    rng = random.Random(3)
    parts = ["@", "a", "b.c", ".", "-", "+", "1", "22", "192.168.0.1", "4111 1111 1111 1111", "4111111111111111", " ", "+1 (234) 555-1234",
             "x@y.z", "%", "_", "é", "\n", "300.1.1.1", "0001", "5500-0000-0000-0004", "@@", "a@b", "00255", "😀"]
    for _ in range(6000):
        t = "".join(rng.choice(parts) for _ in range(rng.randint(0, 12)))
        assert [(s.kind, s.start, s.end) for s in pii.find(t) if s.kind in pii.BASE] == brute_spans(t), t


def test_added_kinds_context_and_masks():
    t = "IBAN DE89 3704 0044 0532 0130 00 AND 123-45-6789, ssn 123-45-6789; GB82WEST12345698765432 GB83WEST12345698765432"
    found = pii.find(t)
    assert [(s.kind, t[s.start:s.end]) for s in found if s.kind not in pii.BASE] == [
        ("iban", "DE89 3704 0044 0532 0130 00"), ("ssn", "123-45-6789"), ("ssn", "123-45-6789"), ("iban", "GB82WEST12345698765432")]
    assert found[0].score == 1.0 and not [s for s in pii.find("code 123-45-6789 only") if s.kind == "ssn"]
    assert pii.masked("to a@b.c now", pii.find("to a@b.c now")) == "to [EMAIL] now" and pii.masked("", []) == ""


def test_op4_and_mask_on_edge_rows(edge_docs, no_docs):
    out = pii.digests(pii.detect(edge_docs)).collect()
    assert len(out) == edge_docs.count()
    nine = next(r for r in out if r.id == 9)
    assert (nine.n_email, nine.n_ip, nine.n_card, nine.n_phone) == (1, 0, 1, 1)
    t = "mail a.b@c.org, +1 (234) 555-1234, 4111 1111 1111 1111"
    assert nine.base_sha256 == hashlib.sha256(",".join("%s:%d:%d" % s for s in brute_spans(t)).encode()).hexdigest()
    empty = next(r for r in out if r.id == 3)
    assert empty.base_sha256 == hashlib.sha256(b"").hexdigest() and empty.spans == ""
    masked = pii.mask(edge_docs)
    assert masked.columns == edge_docs.columns and masked.count() == edge_docs.count()
    row = masked.where("doc_id = 9").first()
    assert row.text == "mail [EMAIL], [PHONE], [CARD]" and row.n_chars == len(row.text) and masked.where("text IS NULL").count() == 2
    assert pii.digests(pii.detect(no_docs)).count() == 0 and pii.mask(no_docs).count() == 0


def test_pii_is_linear_on_hostile_text():
    assert pii.find("1" * 100_000 + "a" * 100_000 + "@" * 1000 + "A1" * 50_000) is not None


def test_sketch_merges_and_estimates():
    rng = random.Random(2)
    words = ["".join(rng.choice("abcdefghij") for _ in range(7)) for _ in range(6000)]
    a, b = " ".join(words[:4000]), " ".join(words[2000:])
    sa, sb = fingerprint.sketch(a), fingerprint.sketch(b)
    assert abs(fingerprint.resemblance(sa, sb) - 1 / 3) < 0.05
    assert abs(fingerprint.containment(fingerprint.sketch(" ".join(words[100:300])), sa) - 1) < 0.05
    assert (fingerprint.from_text(fingerprint.as_text(sa)) == sa).all() and len(fingerprint.sketch("")) == 0
    for x, y in ((a, b), ("tiny", a), ("tiny", "else"), ("", "x")):
        joined = fingerprint.merge(fingerprint.sketch(x), fingerprint.sketch(y))
        every = np.unique(np.concatenate([fingerprint._hashes(t.encode()) for t in (x, y) if t]))
        low = every[every <= np.uint64(int(2**64 * fingerprint.FRACTION) - 1)]
        assert (joined == (low if len(low) else every[:1])).all()
    assert (fingerprint.sketch(a) == fingerprint.sketch(a)).all()


def test_sketch_of_long_text_is_piecewise_equal(monkeypatch):
    t = " ".join(f"w{i}" for i in range(5000))
    whole = fingerprint.sketch(t)
    monkeypatch.setattr(fingerprint, "_PIECE", 1000)
    assert (fingerprint.sketch(t) == whole).all()


def test_op3_next_documents(spark, docs, edge_docs, no_docs):
    for table in (docs, edge_docs, edge_docs.where("doc_id = 8"), edge_docs.where("doc_id IN (1, 9)")):
        rows = sorted(table.select("doc_id", "text").collect(), key=lambda r: (r.doc_id is None, -(r.doc_id or 0), r.text is not None, r.text or ""))
        want = []
        for r, s in zip(rows, rows[1:] + rows[:1]):
            t, u = r.text or "", s.text or ""
            own, new = fingerprint.sketch(t), fingerprint.sketch(fingerprint.edited(t, u))
            want.append((str(r.doc_id), len(t), hashlib.sha256((t[:len(t) - len(t) // 2] + u[:len(t) // 2]).encode()).hexdigest(),
                         fingerprint.as_text(own), fingerprint.as_text(new), fingerprint.resemblance(own, new),
                         fingerprint.resemblance(own, fingerprint.sketch(u))))
        got = [(str(r[0]), *r[1:]) for r in fingerprint.edit_likeness(table).collect()]
        assert sorted(got) == sorted(want)
    assert fingerprint.edit_likeness(no_docs).count() == 0 and fingerprint.fingerprints(edge_docs).count() == edge_docs.count()


def test_shared_paths_are_new(spark):
    assert shared_path(spark, "x") != shared_path(spark, "x")
