"""Fits read sparse vectors, the same numbers as the dense ones, and nodes keep only what they need on the way."""

import pytest
from pyspark.ml.linalg import SparseVector
from pyspark.sql import functions as F

from pagesift.config import Options
from pagesift.operators import features as FE
from pagesift.operators import folds as FO
from pagesift.operators import vocab as V
from pagesift.plans import pipeline as P
from pagesift.plans.extractor import BodyExtractor


def _pages(spark):
    body = "".join(f'<div class="c{i}"><p>some longer words of paragraph {i}, and more.</p><b>x{i}</b></div>' for i in range(4))
    rows = [(k, f"http://x.example/en/{k}", f"<html><body><h1>title number {k}</h1>{body * (1 + k % 3)}</body></html>") for k in range(12)]
    gold = [(k, "en", " ".join(f"some longer words of paragraph {i}, and more." for i in range(4))) for k in range(12)]
    return (spark.createDataFrame(rows, "page_id long, url string, html string"), spark.createDataFrame(gold, "doc_id long, lang string, text string"))


def test_sparse_features_hold_the_dense_numbers(spark):
    pages, gold = _pages(spark)
    ex = BodyExtractor()
    nodes = FE.nonempty_nodes(ex.labelled_rows(pages, gold), with_label=True)
    dense, _ = P.vectors_for(nodes, pages)
    sparse, _ = P.vectors_for(nodes, pages, make=FE.path_features)
    a = {(r.page_id, r.pos): list(r.x) for r in dense.collect()}
    b = {(r.page_id, r.pos): r.features for r in sparse.collect()}
    assert a.keys() == b.keys() and len(a) > 100
    assert all(isinstance(v, SparseVector) and v.toArray().tolist() == a[k] for k, v in b.items())


def test_fits_read_sparse_vectors_and_folds_move_few_columns(spark, monkeypatch):
    pages, gold = _pages(spark)
    written = {}
    real = P.materialize

    def noting(df, tag="stage"):
        written[tag] = out = real(df, tag)
        return out
    for module in (P, FO):
        monkeypatch.setattr(module, "materialize", noting)
    nodes = FE.nonempty_nodes(BodyExtractor().labelled_rows(pages, gold), with_label=True)
    opts = Options(fold_group="page_id", max_iter=3)
    seen, folded = P._fold_predictions(nodes, pages, opts, "content")
    assert isinstance(written["matrix"].first().features, SparseVector)
    assert set(written["grouped"].columns) == {"page_id", "pos", "label", "depth", "text_len", "punct", "step_tag", "step_class", "content"}
    assert folded.filter(F.col("fold").isNull()).count() == 0 and seen.filter("held_out").count() == nodes.count()


def test_nodes_are_not_broadcast_for_the_folds_of_their_pages(spark, monkeypatch):
    plans = {}
    real = FO.materialize

    def noting(df, tag="stage"):
        plans[tag] = df._jdf.queryExecution().executedPlan().toString()
        return real(df, tag)
    monkeypatch.setattr(FO, "materialize", noting)
    # small on disk, large in memory: a page's nodes have the same path
    nodes = spark.range(20_000).selectExpr("id div 200 AS page_id", "cast(id % 200 AS int) AS pos", "cast(id % 2 AS int) AS label",
                                           "array_repeat(repeat('div', 20), 15) AS step_tag")
    folded = FO.stratified_folds(nodes, opts=Options(fold_group="page_id"))
    assert "SortMergeJoin [page_id" in plans["folds"] and "BroadcastHashJoin [page_id" not in plans["folds"]
    assert folded.count() == 20_000 and folded.groupBy("page_id").agg(F.countDistinct("fold").alias("k")).filter("k != 1").count() == 0


def test_pages_with_a_null_gold_text_have_no_fold(spark):
    pages, gold = _pages(spark)
    gold = gold.withColumn("text", F.when(F.col("doc_id") != 5, F.col("text")))
    nodes = FE.nonempty_nodes(BodyExtractor().labelled_rows(pages, gold), with_label=True)
    assert nodes.filter(F.col("label").isNull()).count() > 0
    seen, _ = P._fold_predictions(nodes, pages, Options(fold_group="page_id", max_iter=3))
    held = seen.filter("held_out").select("page_id", "pos")
    assert sorted(held.collect()) == sorted(nodes.filter("page_id != 5").select("page_id", "pos").collect())


@pytest.mark.parametrize("tag, value", [("<p>", ""), ("<p CLASS=A>", "A"), ("<p id='class'>", ""), ("<p class='a  b' class=c>", "a  b")])
def test_class_value(spark, tag, value):
    assert spark.createDataFrame([(tag,)], "t string").select(V.class_value(F.col("t"))).first()[0] == value


def test_characters_go_by_runs():
    import re

    from pagesift import config as C
    assert re.findall(C.PUNCT_KEEP_RE, "some words. More!") == ["some words", " More"]
    assert re.findall(C.CONTENT_STRIP_RE, "a \t b") == [" \t "] and re.findall(C.CONTENT_STRIP_KEEP_LATIN1_RE, "a \x85b") == [" \x85"]
    assert re.sub(C.PUNCT_KEEP_RE, "", "a.b。c？!") == ".。？!"
