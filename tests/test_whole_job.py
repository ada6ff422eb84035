"""Registered queries cover pages without gold and both vocabularies."""
import tempfile

from pagesift.plans import pipeline as P
from pagesift.sources import io

SF = "/root/testdata/sf0.001"


def test_pages_without_gold_are_scored(spark):
    pages, docs = io.read_table(spark, SF, "pages"), io.read_table(spark, SF, "documents")
    text = "<html><body><div class='x'><p>" + "words of a page " * 40 + "</p></div></body></html>"
    odd = spark.createDataFrame([(900_001, "http://x.example/en/99999999", text), (900_002, "http://x.example/no-key", text)],
                                "page_id long, url string, html string")
    d = tempfile.mkdtemp(prefix="pagesift-whole-")
    pages.select("page_id", "url", "html").unionByName(odd).write.parquet(f"{d}/pages.parquet")
    docs.write.parquet(f"{d}/documents.parquet")
    bodies = {r.page_id: r.body for r in P.page_bodies(spark, d).collect()}
    assert len(bodies) == pages.count() + 2 and "wordsofapage" in bodies[900_001] and bodies[900_001] == bodies[900_002]
    unseen = {r.page_id: r.body for r in P.out_of_fold_bodies(spark, d).collect()}
    assert set(unseen) == set(bodies) and unseen[900_001] == bodies[900_001]
    rows = P.scored_nodes(spark, d).collect()
    new = [r for r in rows if r.page_id > 900_000]
    assert {r.page_id for r in new} == {900_001, 900_002} and all(r.label is None and r.fold is None and r.prob is not None for r in new)
    assert all(r.label in (0, 1) and r.fold in range(4) for r in rows if r.page_id < 900_000)
    assert len({(r.page_id, r.pos) for r in rows}) == len(rows)


def test_w2v_vectors_hold_tags_and_classes(spark):
    from pagesift.operators import vocab as V
    got = {(r.kind, r.term): r.vector for r in P.w2v_vectors(spark, SF).collect()}
    want = {tuple(r) for r in V.vocab_terms(io.read_table(spark, SF, "pages")).collect()}
    assert set(got) == want and {k for k, _ in want} == {"tag", "class"} and all(len(v) == 30 for v in got.values())
