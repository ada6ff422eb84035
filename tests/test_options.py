"""Behaviour switches of Options."""
from pyspark.sql import functions as F

from page_rows import pages_df
from pagesift.config import Options
from pagesift.operators import dom as D
from pagesift.operators import features as FE
from pagesift.operators import folds as FO

PAD = "<p>" + "w" * 100 + "</p>"


def contents(spark, html, opts):
    ev = D.page_events(D.clean_pages(pages_df(spark, html)), opts)
    return [r["content"] for r in D.explode_nodes(ev).orderBy("pos").collect() if r["content"]]


def test_keep_whitespace_and_latin1(spark):
    h = "<html><body><p>Café  au\tlait\u0001</p>" + PAD + "</body></html>"
    assert contents(spark, h, Options())[0] == "Cafaulait"
    assert contents(spark, h, Options(strip_latin1=False))[0] == "Caféaulait"
    assert contents(spark, h, Options(keep_whitespace=True))[0] == "Caf au lait"


def test_scope_node(spark):
    h = "<html><body><p>ab.</p><p>cdef!</p>" + PAD + "</body></html>"
    ev = D.page_events(D.clean_pages(pages_df(spark, h)))
    n = FE.nonempty_nodes(ev)
    page = {r["pos"]: (r["text_len"], r["punct"]) for r in FE.apply_scope(n, Options()).collect()}
    node = {r["pos"]: (r["text_len"], r["punct"]) for r in FE.apply_scope(n, Options(scope="node")).collect()}
    assert set(page.values()) == {(108, 2)}
    assert sorted(node.values()) == [(3, 1), (5, 1), (100, 0)]


def test_fold_group_and_ratio_weight(spark):
    rows = [(p, i, int(i == 0)) for p in range(20) for i in range(5)]
    df = spark.createDataFrame(rows, "page_id long, pos int, label int")
    g = FO.stratified_folds(df, opts=Options(fold_group="page_id"))
    per_page = g.groupBy("page_id").agg(F.countDistinct("fold").alias("k"))
    assert per_page.filter("k > 1").count() == 0 and g.select("fold").distinct().count() > 1
    f = FO.stratified_folds(df)
    w = {r["fold"]: r["pos_weight"] for r in FO.fold_weights(f, Options(pos_weight="ratio")).collect()}
    assert all(abs(v - 4.0) < 1e-9 for v in w.values())


def test_max_steps_option(spark):
    from pagesift.plans.extractor import BodyExtractor
    from pagesift.sources import io
    sf = "/root/testdata/sf0.001"
    pages, docs = io.read_table(spark, sf, "pages"), io.read_table(spark, sf, "documents")
    h = "<html><body>" + "<div>" * 25 + "deep text" + "</div>" * 25 + PAD + "</body></html>"
    ev = D.page_events(D.clean_pages(pages_df(spark, h)), Options(max_steps=20))
    deep = FE.nonempty_nodes(ev, max_steps=20).orderBy(F.desc("depth")).first()
    assert deep["depth"] == 27 and len(deep["step_pos"]) == 20 and len(deep["anc_pos"]) == 20
    ex = BodyExtractor(opts=Options(max_steps=20)).fit(pages, docs)
    assert ex.model.numFeatures == 20 * 62
    assert ex.transform(pages).count() == pages.count()
