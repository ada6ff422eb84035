"""Spark operators on hand-built micro-fixtures (FIXTURES M5-M14)."""
import base64
import os
import tempfile

from pyspark.sql import functions as F

from page_rows import pages_df
from pagesift.operators import bodies as B
from pagesift.operators import dom as D
from pagesift.operators import features as FE
from pagesift.operators import folds as FO
from pagesift.operators import labels as LB
from pagesift.operators import metrics as M
from pagesift.config import Options


def nodes_of(spark, html):
    ev = D.page_events(D.clean_pages(pages_df(spark, html)))
    return {r["pos"]: r for r in D.explode_nodes(ev).collect()}


def test_m5_gate(spark):
    body = lambda n: "<html><body><p>" + "x" * n + "</p></body></html>"
    df = D.clean_pages(pages_df(spark, body(99), body(100), "<body>" + "y" * 200 + "</body>"))
    st = {r["page_id"]: r["status"] for r in df.collect()}
    assert st == {0: "too_short", 1: "ok", 2: "no_html"}
    assert D.quarantine(df).count() == 2
    nul = D.clean_pages(spark.createDataFrame([(9, "u", None)], "page_id long, url string, html string"))
    assert nul.first()["status"] == "no_html"
    assert D.page_events(nul).count() == 0


def test_m6_cleaning(spark):
    pad = "z" * 100
    h = f"<html><body><p>a\nb é ñ ©  \u0001 € 中 &amp; x\\y</p><p>&lt;b&gt;bold</p><p>{pad}</p></body></html>"
    n = nodes_of(spark, h)
    contents = [r["content"] for r in n.values() if r["content"]]
    assert contents[0] == "ab€中&amp;xy"
    assert len("&amp;") == 5
    assert any(r["name"] == "b" and r["kind"] == "start" and r["content"] == "bold" for r in n.values())


def test_m7_labels(spark):
    gold = "Hello, world! Café"
    rows = [("Hello,world!", 1), ("Hi", 0), ("Caf", 0), ("Cafe", 0), ("----", 1), ("&amp;", 1)]
    df = spark.createDataFrame([(c, gold) for c, _ in rows], "c string, g string")
    df = df.withColumn("gn", F.regexp_replace("g", r"[^\p{L}\p{N}_]", ""))
    got = [r[0] for r in df.select(F.expr(LB.label_sql("c", "gn"))).collect()]
    assert got == [lab for _, lab in rows]


def test_m8_page_features_and_class(spark):
    h = '<html><body><div class="a b">ab.</div><p id="x">c!</p><i data-class="z">。</i>' + "<p>" + "w" * 100 + "</p></body></html>"
    n = nodes_of(spark, h)
    first = next(iter(n.values()))
    assert first["text_len"] == 6 + 100 and first["punct"] == 3
    cls = {r["name"]: r["class_name"] for r in n.values() if r["kind"] == "start"}
    assert cls["div"] == "a b" and cls["p"] == "" and cls["i"] == "z"


def test_m9_normalisation(spark):
    df = spark.createDataFrame([(2, 10, 0), (1, 4, 0)], "depth int, text_len long, punct long")
    p = FE.norm_params(df).first()
    assert abs(p["text_length_mean"] - 6) < 1e-12 and abs(p["text_length_std"] - 18 ** 0.5) < 1e-9
    z = (0 - p["text_length_mean"]) / p["text_length_std"]
    assert abs(z + 1.4142) < 1e-4


def test_m10_length_rules(spark):
    rows = ["abc", "中文字", "abcd", "a" * 300, "中" * 100, "a" * 301, "中" * 101, "中" + "a" * 100]
    want = [0, 0, None, None, None, 1, 1, 1]
    df = spark.createDataFrame([(c,) for c in rows], "content string")
    got = [r[0] for r in df.select(F.expr(B.rule_sql("content", "CAST(NULL AS INT)"))).collect()]
    assert got == want
    # a logit of exactly 0 is probability 0.5, which is not accepted
    assert spark.range(1).select((F.lit(0.5) > 0.5).cast("int")).first()[0] == 0


def test_m11_weights_and_f1(spark):
    df = spark.createDataFrame([(0,)] * 6 + [(1,)] * 2, "label int")
    w = df.agg(FO.pos_weight_expr(F.sum("label"), F.count("*") - F.sum("label")).alias("w")).first()["w"]
    assert w == 0.75
    f = spark.createDataFrame([(1, 1), (0, 1), (1, 0), (0, 0)], "label int, pred int")
    assert f.agg(M.f1_expr(F.col("label"), F.col("pred"))).first()[0] == 0.5
    z = spark.createDataFrame([(0, 0)], "label int, pred int")
    assert z.agg(M.f1_expr(F.col("label"), F.col("pred"))).first()[0] == 0.0


def test_m12_sources(spark):
    from pagesift.sources import io
    d = tempfile.mkdtemp(prefix="pagesift-src-")
    stem = base64.b64encode(b"http://a.b/c").decode()
    assert stem == "aHR0cDovL2EuYi9j"
    open(os.path.join(d, stem + ".html"), "w").write("<html></html>")
    open(os.path.join(d, "skip.txt"), "w").write("x")
    pg = io.read_html_folder(spark, d).collect()
    assert [r["url"] for r in pg] == ["http://a.b/c"]
    g = os.path.join(d, "gold.txt")
    open(g, "w").write("{'Filename': 'YQ==', 'Body text': 'it\\'s ok', 'Website': \"x\"}\njunk\n"
                       "{'Filename': 'YQ==', 'Body text': 'second', 'Website': 'y'}\n")
    lines = io.read_gold_lines(spark, g)
    gold = io.first_gold_per_key(lines).collect()
    assert len(gold) == 1 and gold[0]["body_text"] == "it's ok"
    open(g, "a").write("{not a dict\n")
    bad = io.bad_gold_lines(io.read_gold_lines(spark, g)).collect()
    assert [r["line"] for r in bad] == ["{not a dict"]


def test_m13_folds(spark):
    rows = [(i, 0, 1) for i in range(8)] + [(100 + i, 0, 0) for i in range(40)]
    df = spark.createDataFrame(rows, "page_id long, pos int, label int")
    a = FO.stratified_folds(df, "label", ("page_id", "pos"), Options())
    counts = {(r["fold"], r["label"]): r["count"] for r in a.groupBy("fold", "label").count().collect()}
    assert all(counts[(k, 1)] == 2 and counts[(k, 0)] == 10 for k in range(4))
    b = FO.stratified_folds(df.repartition(5), "label", ("page_id", "pos"), Options())
    key = lambda d: sorted((r["page_id"], r["fold"]) for r in d.collect())
    assert key(a) == key(b)


def test_m14_assembly(spark):
    df = spark.createDataFrame([(0, 5, "b", 1), (0, 2, "a", 1), (0, 9, "<i>c", 1), (0, 7, "no", 0)],
                               "page_id long, pos int, content string, accept int")
    assert B.assemble(df).first()["body"] == "abc"


def test_parent_equals_backward_search(spark):
    h = "<html><body><div><p>a</p><p>b<b>c</b></p></div><ul><li>x</li></ul></body></html>"
    ev = D.page_events(D.clean_pages(pages_df(spark, h + "<p>" + "q" * 100 + "</p>")))
    rows = sorted(D.nodes(ev).collect(), key=lambda r: r["pos"])
    for r in rows:  # nearest earlier start whose path equals the parent's path
        if r["parent_pos"] is None:
            continue
        par = rows[r["parent_pos"]]
        assert par["kind"] == "start" and par["anc_pos"] == r["anc_pos"][:-1]


def test_deep_unclosed_page_stays_compact(spark):
    """3,000 never-closed <b> tags: full paths would be 4.5 M integers; the compact
    form keeps 15 ancestors per event, while depth and parent stay exact."""
    h = "<html><body>" + "<b>x" * 3000 + "</body></html>"
    ev = D.page_events(D.clean_pages(pages_df(spark, h)))
    row = ev.select(F.aggregate("anc", F.lit(0), lambda a, l: a + F.size(l)).alias("n"),
                    F.array_max("depth").alias("d")).first()
    assert row["n"] <= 15 * ev.select(F.size("kind")).first()[0] and row["d"] == 3002
    n = FE.nonempty_nodes(ev)
    deepest = n.orderBy(F.desc("depth")).first()
    assert deepest["depth"] == 3002 and len(deepest["step_pos"]) == 15 and deepest["parent_pos"] == deepest["pos"] - 1
