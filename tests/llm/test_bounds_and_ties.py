"""Bounds that cut no text, choices among repeated rows, hubs, and numbers at the edge of their range."""
import numpy as np
import pytest

from pagesift.llm import bytecnn, components, neardup, topk
from pagesift.llm.common import is_held_out, labelled_rows
from pyspark.sql import functions as F


def test_large_components_join_the_tile(spark):
    rows = [(0, [1e307, 1.0]), (20, [1.0, 2.0]), (40, [1e200, -1e200]), (1, [3e150, 1.0]), (2, [-0.5, 4.0]), (3, [2.0**40, 2.0**40]), (4, [float("nan"), 1.0])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {(r.query_id, r["rank"]): (r.id, r.score) for r in topk.search(vectors, F.col("id") % 20 == 0).collect()}
    whole = {i: [int(np.floor(64 * x)) for x in v] for i, v in rows if i not in (0, 4)}  # 64 x is not finite; not a number
    for q in (20, 40):
        clip = lambda n: max(1 - 2**63, min(2**63 - 1, n))
        want = sorted(((-clip(sum(a * b for a, b in zip(whole[q], whole[c]))), c) for c in whole if c != q))
        assert [got[q, k + 1] for k in range(len(want))] == [(c, -s) for s, c in want]
    assert len(got) == 8


def test_products_of_mixed_rows_are_exact():
    rng = np.random.default_rng(0)
    q, c = (rng.integers(-60, 60, (n, 9)).astype(float) for n in (7, 11))
    q[2] *= 2.0**45
    c[5] *= 2.0**50
    want = [[max(1 - 2**63, min(2**63 - 1, sum(int(a) * int(b) for a, b in zip(x, y)))) for y in c] for x in q]
    assert topk._products(q, c).tolist() == want


def test_training_sees_every_chunk(monkeypatch):
    """What tells the labels apart stands in one chunk far inside long texts."""
    filler = "plain words of no meaning " * 900
    rows = [(filler[:k * 97] + ("zzqq!" * 12 if k % 2 else "") + filler[k * 97:], k % 2, k) for k in range(1, 61)]
    score = bytecnn.Scorer(bytecnn.train(rows))
    assert all((score(t) > 0.5) == (y == 1) for t, y, _ in rows)


def test_gradients_do_not_depend_on_the_pieces(monkeypatch):
    rng = np.random.default_rng(2)
    params = {"filters": rng.normal(0, 0.15, (bytecnn.WIDTH, 256, bytecnn.FILTERS)).astype(np.float32), "bias": np.zeros(bytecnn.FILTERS, np.float32),
              "out": rng.normal(0, 0.3, 2 * bytecnn.FILTERS).astype(np.float32), "base": np.zeros(1, np.float32)}
    texts = [bytecnn._padded("word " * n) for n in (1, 40, 3000, 7, 500)]
    y = np.array([0, 1, 1, 0, 1], np.float32)
    whole = bytecnn._batch_gradients(params, texts, y)
    monkeypatch.setattr(bytecnn, "PIECE_BYTES", 100)
    parts = bytecnn._batch_gradients(params, texts, y)
    assert all(np.allclose(whole[k], parts[k], atol=1e-5) for k in whole)


def naive_score(net, text):
    """The network's forward pass written out: every window, every filter, one by one."""
    data = text.encode()
    blocks = max(1, -(-len(data) // bytecnn.BLOCK))
    data += bytes(blocks * bytecnn.BLOCK + bytecnn.WIDTH - len(data))
    chunks, first = [], 0
    while True:
        last = min(first + bytecnn.CHUNK_BLOCKS, blocks)
        chunk = []
        for f in range(bytecnn.FILTERS):
            found = [sum(float(net.filters[k][data[at + k]][f]) for k in range(bytecnn.WIDTH)) + float(net.bias[f])
                     for at in range(first * bytecnn.BLOCK, last * bytecnn.BLOCK)]
            chunk.append(max(0.0, *found))
        chunks.append(chunk)
        first += bytecnn.CHUNK_BLOCKS - 1
        if first >= max(1, blocks - 1):
            break
    n = len(chunks)
    z = net.base + sum(float(net.out[f]) * sum(c[f] for c in chunks) / n + float(net.out[bytecnn.FILTERS + f]) * max(c[f] for c in chunks)
                       for f in range(bytecnn.FILTERS))
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def test_forward_pass_equals_the_written_out_one():
    rows = [(("good text " if y else "bad stuff ") * 20 + str(k), y, k) for k in range(24) for y in (0, 1)]
    net = bytecnn.train(rows)
    score = bytecnn.Scorer(net)
    for text in ("", "x", "good text", "bad stuff é " * 90, "a" * 64, "b" * 65, "mixed good bad " * 120):
        assert abs(score(text) - naive_score(net, text)) < 1e-4


def test_labelled_rows_are_bounded_and_chosen(spark):
    ids = list(range(200))
    docs = spark.createDataFrame([(i, f"text {i} " * 10) for i in ids] + [(7, "a second text"), (8, None), (None, "no id")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in ids] + [(7, 0), (9, None), (None, 1)], "doc_id long, toxic int")
    out = {r.id for r in spark.createDataFrame([(i,) for i in ids], "id long").where(is_held_out(F.col("id"))).collect()}
    rows = labelled_rows(docs, labels, "toxic", 1000)
    assert [r[2] for r in rows] == [i for i in ids if i not in out] and {r[2]: r[1] for r in rows}[7] == 0
    assert {r[2]: r[0] for r in rows}[7] == "a second text"
    few = labelled_rows(docs, labels, "toxic", 30)
    assert [sum(r[1] == y for r in few) for y in (0, 1)] == [30, 30] and few == labelled_rows(docs.repartition(7), labels, "toxic", 30)
    short = labelled_rows(docs, labels, "toxic", 1000, max_chars=2000)
    assert all(0 < sum(len(t) for t, y, _ in short if y == k) <= 1000 for k in (0, 1)) and {r[2] for r in short} < {r[2] for r in rows}


@pytest.mark.parametrize("parts", ["1", "7"])
def test_components_of_a_hub_among_others(spark, parts):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        edges = [(5000, k) for k in range(1000, 3000)] + [(k, k + 1) for k in range(20)] + [(2999, 3)]
        got = {r.node: r.label for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got == {n: 0 for e in edges for n in e}


def test_repeated_ids_keep_what_resembles_nothing(spark):
    rows = [(1, "one two three four five six", 1), (1, "One  TWO three four five six ", 2), (1, "other words entirely, these are", 3),
            (2, "one two three four five six", 4), (3, None, 5), (3, "", 6), (3, "text of three", 7), (None, "x", 8), (None, "x", 9)]
    kept = neardup.keep_first(spark.createDataFrame(rows, "doc_id long, text string, n int").repartition(5)).collect()
    assert sorted(r.n for r in kept) == [2, 3, 5, 7, 8, 9]


def test_banding_is_as_sharp_as_the_bound_allows():
    assert neardup.banding(85) == (32, 7) and neardup.banding(80) == (37, 6)
    for t in (70, 80, 85, 90, 95):
        bands, rows = neardup.banding(t)
        assert bands * rows <= 224 and (1 - (t / 100)**rows)**bands <= 2e-5


def test_threshold_is_a_parameter(spark):
    def text(k):  # 100 words; the last k are replaced, so 96 - k of 96 + k shingles are common
        return " ".join([f"w{i}" for i in range(100 - k)] + [f"other{k}x{i}" for i in range(k)])
    rows = [(k, text(k)) for k in (0, 7, 9, 10, 11, 30)]  # likeness to the first: 86.4, 82.9, 81.1, 79.4, 52.4 per cent
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    at = {t: {r.id: r.component for r in neardup.near_duplicates(docs, threshold=t).collect()} for t in (80, 85)}
    sets = {i: naive_shingles(t) for i, t in rows}
    for t, got in at.items():
        root = {i: i for i in sets}
        for _ in sets:
            for i in sets:
                for j in sets:
                    if 100 * len(sets[i] & sets[j]) >= t * len(sets[i] | sets[j]):
                        root[i] = root[j] = min(root[i], root[j])
        assert got == root
    assert at[80] != at[85]


def test_recall_at_the_threshold():
    """Pairs with a likeness of just 85 per cent share a bucket; fewer than one in a thousand may not."""
    rng = np.random.default_rng(4)
    missed = 0
    for _ in range(2000 // 50):
        sets = []
        for _ in range(50):
            x = rng.integers(0, 2**63, 200).astype(np.uint64)  # 170 common of 200: 85 per cent
            sets += [np.sort(x[:185]), np.sort(np.concatenate([x[:170], x[185:]]))]
        keys = neardup.band_keys(neardup.signatures(sets))
        missed += sum(not (keys[k] == keys[k + 1]).any() for k in range(0, len(keys), 2))
        assert all(neardup.linked(sets[k], sets[k + 1]) for k in range(0, len(sets), 2))
    assert missed <= 2


def naive_shingles(text):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text).translate({c: " " for c in range(9, 14)}).split(" ") if w]
    return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def test_components_equal_plain_sets_of_words(spark):
    """Shingles as tuples of words and likeness in whole numbers, without the operator's hashes."""
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    sets = [(i, naive_shingles(t or "")) for i, t in rows]
    root = {i: i for i, _ in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and 100 * len(a & b) >= 85 * len(a | b):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    got = {r.id: (r.component, r.n_shingles) for r in neardup.near_duplicates(spark.read.parquet("/root/testdata/sf0.001/documents.parquet")).collect()}
    assert got == {i: (find(i), len(s)) for i, s in sets}
