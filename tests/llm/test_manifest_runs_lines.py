"""Merkle manifest, periodic runs, line dedup: plain versions of each, edge rows, hot groups."""
import hashlib
import random
import zlib
from collections import defaultdict

import duckdb
import pytest

from pagesift.llm import linededup, merkle, queries, runs
from pyspark.sql import functions as F

SMALL = "/root/testdata/sf0.001"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def climb(nodes):
    """Levels of a tree over the hashes ``nodes``, the last one holding the root alone."""
    levels = [list(nodes)]
    while len(levels[-1]) > 1:
        below = levels[-1]
        levels.append([sha("".join(below[i:i + 8])) for i in range(0, len(below), 8)])
    return levels


def plain_manifest(rows):
    """{(doc_id, leaf): [(leaf, subroot, root, proof)]} of (doc_id, source, lang, n_chars, text) rows."""
    groups = defaultdict(list)
    for r in rows:
        groups[r[2]].append((r[0], sha("".join(map(field, r)))))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in order:
        groups[g].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        trees[g] = climb([h for _, h in groups[g]])
    crown = climb([trees[g][-1][0] for g in order])

    def beside(levels, at):
        out = []
        for level in levels[:-1]:
            run = level[at // 8 * 8:at // 8 * 8 + 8]
            out += [h for i, h in enumerate(run) if i != at % 8]
            at //= 8
        return "".join(out)
    return sorted((str(i), h, trees[g][-1][0], crown[-1][0], beside(trees[g], at) + beside(crown, k))
                  for k, g in enumerate(order) for at, (i, h) in enumerate(groups[g]))


COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]


def collected(found):
    return sorted((str(r.id), r.leaf, r.subroot, r.root, r.proof) for r in
                  found.select("id", "leaf", "subroot", "root", merkle.proof(F.col("path")).alias("proof")).collect())


@pytest.mark.parametrize("sizes", [(1,), (2,), (8,), (9, 1), (65, 8, 1, 1, 1, 1, 1, 1, 1, 70)])
def test_manifest_equals_plain_trees(spark, sizes):
    rows = [(10 * i + k, None if i % 3 else "s", (None, "", "en", "é")[k] if k < 4 else f"l{k}", i, f"text {i} of {k}")
            for k, n in enumerate(sizes) for i in range(n)]
    random.Random(3).shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    found = merkle.manifest(docs, COLUMNS)
    assert collected(found) == plain_manifest(rows)
    assert found.where(merkle.fold(F.col("leaf"), F.col("path")) == F.col("root")).count() == len(rows)


def test_manifest_edge_rows_and_tampering(spark, edge_docs, no_docs):
    rows = [tuple(r) for r in edge_docs.select(COLUMNS).collect()]
    found = merkle.manifest(edge_docs, COLUMNS, extra={"other": merkle.leaf(F.lit("x"))})
    assert collected(found) == plain_manifest(rows)
    assert found.where(merkle.fold(F.col("other"), F.col("path")) == F.col("root")).count() == 0
    assert merkle.manifest(no_docs, COLUMNS).count() == 0


def test_op11_verifies_what_was_not_changed(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    for r in queries.op11_merkle(spark, SMALL).collect():
        tampered = zlib.crc32(str(r.doc_id).encode()) % 3 == 0 and any("A" <= c <= "Z" for c in texts[r.doc_id] or "")
        assert r.verified == (not tampered) and (r.folded_root == r.root) == r.verified


def plain_runs(words, least=12):
    n, best = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(least, 2 * q):
                best.setdefault((i, j + q), q)
            i = j + 1
    return sorted(((a, e - a, q) for (a, e), q in best.items()), key=lambda r: (r[0], r[2]))


@pytest.mark.parametrize("least", [2, 12, 30])
def test_runs_equal_comparison_of_all_distances(least):
    rng = random.Random(least)
    for _ in range(60):
        documents = []
        for _ in range(rng.randrange(1, 12)):
            n, kinds = rng.randrange(rng.choice([1, 5, 30, 200, 600])), rng.choice([1, 2, 2, 3, 20])
            d = [b"%d" % rng.randrange(kinds) for _ in range(n)]
            for _ in range(rng.randrange(3) if n else 0):
                a = rng.randrange(n)
                p = 1 + rng.randrange(max(1, (n - a) // 2))
                for i in range(a, min(n, a + p * rng.randrange(2, 6) + rng.randrange(p))):
                    d[i] = d[a + (i - a) % p]
            documents.append(d)
        assert runs.find(documents, least) == [plain_runs(d, least) for d in documents]


def test_every_period_has_a_block_size():
    for least in (2, 12, 30):
        covered = [(q, size) for size, first, last in runs._levels(3000, least) for q in range(first, last + 1)]
        assert [q for q, _ in covered] == list(range(1, 1501))
        assert all(2 * size - 1 <= max(q, least - q) for q, size in covered)


def test_runs_survive_equal_hashes(monkeypatch):
    words = [b"%d" % (i % 7 + (i // 40) * 3) for i in range(300)]
    monkeypatch.setattr(runs._Hashes, "windows", lambda self, size: self.sums[size:] * 0)
    monkeypatch.setattr(runs._Hashes, "same", lambda self, at, q, size: (at >= 0) & (at + q + size < len(self.sums)))
    assert runs.find([words, words[:9], words[5:]]) == [plain_runs(words), [], plain_runs(words[5:])]


def test_runs_of_long_texts_are_found_whole():
    for words, q in (([b"a"] * 120_000, 1), ([b"%d" % (i % 4999) for i in range(120_000)], 4999)):
        assert runs.find([words, [b"x"]]) == [[(0, 120_000, q)], []]
    assert runs.collapsed([b"a"] * 20, [(0, 20, 1)]) == [b"a"]


def test_words_split_at_six_bytes_only():
    assert runs.words("a\x0bb\x0cc\rd\te\nf g\x1ch\x85i j k") == [x.encode() for x in ("a", "b", "c", "d", "e", "f", "g\x1ch\x85i j k")]


def plain_op12(doc_id, text):
    words = [w for w in (text or "").translate({c: " " for c in range(9, 14)}).split(" ") if w]
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if doc_id is not None and h % 10 == 0 and n:
        a = h // 10 % n
        p = 1 + (n - a) // (3 + h // 10 % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    found = plain_runs(words)
    gone = {i for s, length, q in found for i in range(s + q, s + length)}
    best = min(((-length, s, q) for s, length, q in found), default=None)
    return (len(found), *((best[1], -best[0], best[2], 1000 * -best[0] // best[2]) if best else (None,) * 4),
            sha("".join(f"{s},{length},{q}\n" for s, length, q in found)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def test_op12_equals_brute_force(spark, tmp_path, edge_docs, no_docs):
    # texts of every length at once, long ones left to the test above: brute force is quadratic
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    rows = [(i, t) for i, t in rows if len(t or "") < 6000]
    spark.createDataFrame(rows, "doc_id long, text string").unionByName(
        edge_docs.where("coalesce(doc_id, 0) <> 4").select("doc_id", "text")).write.parquet(f"{tmp_path}/documents.parquet")
    out = queries.op12_runs(spark, str(tmp_path))
    assert dict(out.dtypes)["exponent_milli"] == "bigint" and [t for _, t in out.dtypes[1:5]] == ["bigint"] * 4
    got = sorted((str(r[0]), str(tuple(r[1:]))) for r in out.collect())
    rows = [tuple(r) for r in spark.read.parquet(f"{tmp_path}/documents.parquet").select("doc_id", "text").collect()]
    assert got == sorted((str(i), str(plain_op12(i, t))) for i, t in rows) and any("None" not in x for _, x in got)
    assert runs.periodic_runs(edge_docs).count() == edge_docs.count() and runs.periodic_runs(no_docs).count() == 0


def plain_lines(rows, least=10):
    """Per row: lines, lost ones, the rest; a null id is one document behind all others."""
    def key(line):
        return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))

    last = 1 << 63
    first = {}
    for i, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= least:
                first[key(line)] = min(first.get(key(line), last), last if i is None else i)
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        rest = [x for x in lines if len(key(x)) < least or first[key(x)] == (last if i is None else i)]
        out.append((str(i), len(lines), len(lines) - len(rest), "\n".join(rest)))
    return sorted(out)


def kept_lines(docs, **more):
    found = linededup.kept(docs, linededup.bitmaps(docs, **more))
    return sorted((str(r.id), r.n_lines, r.n_dropped, r.text) for r in found.collect())


EDGES = [(1, "The same long line\nshort\n\nThe same long line"), (2, "  THE SAME long LINE\t\r\nshort\n\nown line of two"), (3, None), (4, ""),
         (5, "\n"), (6, "É same line \nexactly 10"), (7, "é same line \nEXACTLY 10 \nonly nine"), (8, "only nine"), (None, "the same long line\nof no id, long"),
         (None, "of no id, long"), (9, "of two texts\nfirst text"), (9, "of two texts\nother text"), (9, "of two texts\nfirst text"), (10, "of two texts"),
         (-3, "short of id -3\nexactly 10"), (11, "\n".join(["the same long line"] * 20 + ["x"] * 20))]


def test_line_dedup_edge_rows(spark, edge_docs, no_docs):
    docs = spark.createDataFrame(EDGES, "doc_id long, text string")
    assert kept_lines(docs) == plain_lines(EDGES)
    assert kept_lines(edge_docs) == plain_lines([tuple(r) for r in edge_docs.select("doc_id", "text").collect()])
    assert linededup.bitmaps(no_docs).count() == 0 and kept_lines(no_docs) == []


@pytest.mark.parametrize("parts, batch", [(1, 3), (5, 7), (40, 1000)])
def test_line_dedup_splits_a_hot_line(spark, parts, batch):
    rng = random.Random(parts)
    rows = [(i, "\n".join([f"a line that is everywhere {i % 2}"] + [f"line number {rng.randrange(150)}" for _ in range(rng.randrange(4))]))
            for i in rng.sample(range(10_000), 600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.execution.arrow.maxRecordsPerBatch")}
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    try:
        assert kept_lines(docs) == plain_lines(rows)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_bitmaps_name_the_lost_lines():
    for lost in ([0], [7], [8], [3, 4, 15], [900]):
        assert linededup.lost_lines(linededup._bitmap(lost)).tolist() == lost


@pytest.mark.parametrize("name", ["op11_merkle", "op13_lines"])
def test_sql_of_edge_rows(spark, tmp_path, name):
    rows = [(i, t, ("en", None, "", "fr")[k % 4], None if k % 5 else "s", None if t is None else len(t)) for k, (i, t) in enumerate(EDGES)]
    (spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1)
     .write.parquet(f"{tmp_path}/documents.parquet"))
    got = queries.QUERIES[name](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(queries.ORACLE_SQL[name])
    at = [got.columns.index(c[0]) for c in want.description]
    assert sorted(str(tuple(r[i] for i in at)) for r in got.collect()) == sorted(map(str, want.fetchall()))
