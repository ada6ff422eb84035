"""Fit/transform extractor, persistence, routing, feature hook, early stopping, label export job, IO."""
import os
import tempfile

from pyspark.sql import functions as F

from pagesift.plans.extractor import (BodyExtractor, extract_bodies, gbt_with_early_stopping,
                                      label_export_job)
from pagesift.sources import io

SF = "/root/testdata/sf0.001"


def tables(spark):
    return io.read_table(spark, SF, "pages"), io.read_table(spark, SF, "documents")


def test_fit_transform_save_load(spark):
    pages, docs = tables(spark)
    ex = BodyExtractor().fit(pages, docs)
    bodies = ex.transform(pages)
    b = {r["page_id"]: r["body"] for r in bodies.collect()}
    assert len(b) == pages.count() and all(isinstance(v, str) for v in b.values())
    assert sum(len(v) > 0 for v in b.values()) > 0
    d = tempfile.mkdtemp(prefix="pagesift-model-")
    ex.save(d)
    ex2 = BodyExtractor.load(spark, d)
    b2 = {r["page_id"]: r["body"] for r in ex2.transform(pages).collect()}
    assert b2 == b


def test_routing_and_quarantine(spark):
    pages, docs = tables(spark)
    ex = BodyExtractor().fit(pages, docs)
    cjk = spark.createDataFrame([(999, "http://x/zh/1", "<html><body><p>" + "中文" * 80 + "</p></body></html>")],
                                "page_id long, url string, html string")
    short = spark.createDataFrame([(998, "http://x/en/2", "<html><body><p>tiny</p></body></html>")],
                                  "page_id long, url string, html string")
    out, quarantine = extract_bodies(pages.unionByName(cjk).unionByName(short), {"la": ex})
    assert out.count() == pages.count()
    q = {r["page_id"]: r["reason"] for r in quarantine.collect()}
    assert set(q) == {998, 999} and "zh" in q[999] and q[998] == "too_short"


def test_feature_hook_and_gbt(spark):
    pages, docs = tables(spark)
    ex = BodyExtractor(classifier=gbt_with_early_stopping(max_iter=5),
                       extra_features=[("node_len", lambda: F.log1p(F.length("content")))])
    ex.fit(pages, docs)
    assert ex.model.numFeatures == 15 * 62 + 1
    assert ex.transform(pages).count() == pages.count()


def test_label_export_job_tsv(spark):
    pages, docs = tables(spark)
    d = os.path.join(tempfile.mkdtemp(prefix="pagesift-lab-"), "labels")
    lab = label_export_job(pages, docs, d)
    n = lab.count()
    back = spark.read.option("sep", "\t").option("header", True).csv(d)
    assert back.count() == n and set(back.columns) == {"index", "text", "label", "page_id"}
    io.write_labels_tsv(lab, d + "_pp", per_page=True)
    pp = spark.read.option("sep", "\t").option("header", True).csv(d + "_pp")
    assert pp.count() == n and pp.select("page_id").distinct().count() == lab.select("page_id").distinct().count()


def test_vectors_csv_and_params_roundtrip(spark):
    d = tempfile.mkdtemp(prefix="pagesift-io-")
    v = spark.createDataFrame([("div", [0.5, 1.0]), ("nan", [0.0, 0.25]), ("null", [1.0, 0.0])],
                              "term string, vector array<double>")
    io.write_vectors_csv(v, f"{d}/v")
    back = {r["term"]: r["vector"] for r in io.read_vectors_csv(spark, f"{d}/v").collect()}
    assert back == {"div": [0.5, 1.0], "nan": [0.0, 0.25], "null": [1.0, 0.0]}
    p = spark.createDataFrame([(1.0, 2.0, 3.0, 4.0)], "a double, b double, c double, d double")
    io.save_params(p, f"{d}/p")
    assert io.load_params(spark, f"{d}/p").first() == p.first()


def test_trained_embedding_option(spark):
    from pagesift.config import Options
    pages, docs = tables(spark)
    ex = BodyExtractor(opts=Options(embedding="w2v")).fit(pages, docs)
    assert ex.char_vectors.count() > 0
    assert ex.transform(pages).count() == pages.count()
    d = tempfile.mkdtemp(prefix="pagesift-w2v-")
    ex.save(d)
    ex2 = BodyExtractor.load(spark, d, opts=Options(embedding="w2v"))
    a = sorted(tuple(r) for r in ex.transform(pages).collect())
    assert a == sorted(tuple(r) for r in ex2.transform(pages).collect())


def test_w2v_term_vector_is_char_mean_with_fallback(spark):
    from pagesift.operators import vocab as V
    cv = spark.createDataFrame([("tag", "a", [1.0] * 30), ("tag", "b", [3.0] * 30)],
                               "kind string, ch string, vector array<double>")
    used = spark.createDataFrame([("tag", "ab"), ("tag", "az"), ("class", "")], "kind string, term string")
    got = {(r["kind"], r["term"]): r["vector"] for r in V.w2v_term_vectors(used, cv).collect()}
    assert got[("tag", "ab")] == [2.0] * 30
    z = {r["term"]: r["vector"] for r in V.wide(V.hash_vectors(spark.createDataFrame([("tag", "z")], "kind string, term string"), ("kind", "term")), ("kind", "term")).collect()}["z"]
    assert all(abs(g - (1.0 + zz) / 2) < 1e-12 for g, zz in zip(got[("tag", "az")], z))
    assert got[("class", "")] == [0.0] * 30


def test_join_path_equals_broadcast_path(spark):
    """Beyond the broadcast bound the vectors come from shuffle joins; same numbers."""
    from pagesift.config import Options
    from pagesift.plans import pipeline as P
    from pagesift.plans import queries as Q
    from pagesift.operators import folds as FO
    nodes = FO.stratified_folds(Q.labelled_nodes(spark, SF))
    pages = io.read_table(spark, SF, "pages")
    a, _ = P.vectors_for(nodes, pages, Options())
    b, _ = P.vectors_for(nodes, pages, Options(vocab_broadcast_max_terms=0))
    key = lambda df: sorted((r["page_id"], r["pos"], tuple(round(v, 12) for v in r["x"])) for r in df.collect())
    ka, kb = key(a), key(b)
    assert len(ka) == nodes.count() and ka == kb
    assert all(len(x) == 15 * 62 for _, _, x in ka)


def test_external_scorer_slot(spark):
    """U-02: any f(float[B, 15, 62]) -> logit[B] runs as a batched UDF over the model vectors."""
    import numpy as np
    from pagesift.operators.model import external_scorer

    def make_predict_fn():
        w = np.zeros((15, 62), dtype=np.float32)
        w[:, 60] = 1.0  # sum of the text-length z-scores over the steps

        def predict(x):
            return (x * w).sum(axis=(1, 2)).astype(np.float32)
        return predict

    x = [float(i % 62 == 60) for i in range(930)]
    df = spark.createDataFrame([(x,), ([0.0] * 930,)], "x array<double>")
    got = [r[0] for r in df.select(external_scorer(make_predict_fn, batch_size=2)("x")).collect()]
    assert got == [15.0, 0.0]


def test_vocabulary_job_exports_csv(spark):
    from pagesift.plans.extractor import vocabulary_job
    pages, _ = tables(spark)
    d = tempfile.mkdtemp(prefix="pagesift-vocab-")
    vec = vocabulary_job(pages, d)
    tags = {r["term"]: r["vector"] for r in io.read_vectors_csv(spark, f"{d}/tag_vectors", key="tag").collect()}
    cls = {r["term"]: r["vector"] for r in io.read_vectors_csv(spark, f"{d}/class_name_vectors", key="classname").collect()}
    assert "div" in tags and len(tags["div"]) == 30 and min(tags["div"]) == 0.0 and max(tags["div"]) == 1.0
    assert cls["0"] == [0.0] * 30 and "ad" in cls
    assert vec.count() == len(tags) + len(cls)


def test_one_pass_scoring_equals_materialized_path(spark):
    """Scoring from the fitted maps with in-place embedding of unseen terms gives the
    same decisions as embedding the used terms of written node rows."""
    from pagesift.config import Options
    pages, docs = tables(spark)
    ex = BodyExtractor().fit(pages, docs)
    odd = spark.createDataFrame(
        [(900, "http://x/en/1", '<html><body><my-widget class="never seen"><p>' + "w " * 200 +
          "</p></my-widget></body></html>")], "page_id long, url string, html string")
    allp = pages.unionByName(odd)
    one = {(r["page_id"], r["pos"]): (round(r["prob"], 9), r["accept"]) for r in ex.score_nodes(allp).collect()}
    ex.term_table = None  # forces the written-nodes path
    two = {(r["page_id"], r["pos"]): (round(r["prob"], 9), r["accept"]) for r in ex.score_nodes(allp).collect()}
    assert one == two and any(k[0] == 900 for k in one)


def test_tune_with_fold_column_and_write_bodies(spark):
    from pagesift.operators import model as MD
    from pagesift.plans import pipeline as P
    m = P.training_matrix(spark, SF).withColumn("w", F.lit(1.0))
    cvm = MD.tune(m)
    assert len(cvm.avgMetrics) == 2 and all(0.0 <= v <= 1.0 for v in cvm.avgMetrics)
    d = tempfile.mkdtemp(prefix="pagesift-bodies-")
    bodies = P.page_bodies(spark, SF)
    io.write_bodies(bodies, f"{d}/b")
    assert spark.read.parquet(f"{d}/b").count() == bodies.count()


def test_extraction_job_and_nested_folder(spark):
    import base64
    from pagesift.plans.extractor import extraction_job
    pages, docs = tables(spark)
    d = tempfile.mkdtemp(prefix="pagesift-job-")
    extraction_job(spark, pages, f"{d}/out", f"{d}/model", docs)
    extraction_job(spark, pages, f"{d}/out2", f"{d}/model")  # load the saved extractor
    a = sorted(tuple(r) for r in spark.read.parquet(f"{d}/out/bodies").collect())
    b = sorted(tuple(r) for r in spark.read.parquet(f"{d}/out2/bodies").collect())
    assert a == b and len(a) == pages.count()
    assert spark.read.parquet(f"{d}/out/quarantine").count() == 0
    nested = os.path.join(d, "site", "sub")
    os.makedirs(nested)
    open(os.path.join(nested, base64.b64encode(b"http://n.example/x").decode() + ".html"), "w").write("<html></html>")
    assert io.read_html_folder(spark, os.path.join(d, "site")).count() == 0
    assert [r["url"] for r in io.read_html_folder(spark, os.path.join(d, "site"), recursive=True).collect()] == ["http://n.example/x"]
