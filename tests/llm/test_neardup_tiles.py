"""Candidate groups of many short texts: tiles are bounded in documents and hold no list of pairs."""
import tracemalloc

from pagesift.llm import neardup

BASE = [f"w{k}" for k in range(40)]


def near_copies(n):
    return [(i, " ".join([*BASE, f"last{i}"])) for i in range(n)]


def test_forest_of_near_copies_holds_no_pair_list():
    cut, n = neardup.Shingler(), 1500
    sets = [cut(t) for _, t in near_copies(n)]
    tracemalloc.start()
    links = neardup.forest(list(range(n)), sets)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(links) == n - 1 and all(neardup.linked(sets[a], sets[b]) for a, b in links)
    assert len({x for link in links for x in link}) == n
    assert peak < 12 * n * n  # half of what one list of all pairs as int64 triples takes


def test_blocks_are_bounded_in_documents(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK_DOCS", 50)
    groups = spark.createDataFrame([(i, 0, 37) for i in range(400)], "node long, label long, n_shingles long")
    sizes = [r["count"] for r in neardup._tiles(groups).groupBy("block").count().collect()]
    assert sum(sizes) == 400 and len(sizes) == 8 and max(sizes) < 100
    out = neardup.near_duplicates(spark.createDataFrame(near_copies(200), "doc_id long, text string")).collect()
    assert len(out) == 200 and {r.component for r in out} == {0}
