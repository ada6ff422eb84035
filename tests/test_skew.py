"""Hot keys: a document shared by a third of the pages is salted, results unchanged."""
from pyspark.sql import functions as F

from pagesift.operators import dom as D
from pagesift.operators import labels as LB
from pagesift.operators.skew import hot_keys, salted_join


def test_salted_join_equals_plain_join(spark):
    big = spark.range(0, 3000).select(F.col("id").alias("rid"),
                                      F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id") % 50).alias("k"))
    small = spark.range(0, 50).select(F.col("id").alias("k"), (F.col("id") * 10).alias("v"))
    hot = hot_keys(big, "k", 500)
    assert [r["k"] for r in hot.collect()] == [7]
    a = sorted(tuple(r) for r in big.join(small, "k").select("rid", "k", "v").collect())
    b = sorted(tuple(r) for r in salted_join(big, small, "k", hot, "rid", 8).select("rid", "k", "v").collect())
    assert a == b and len(a) == 3000
    left = salted_join(big, small.filter("k < 10"), "k", hot, "rid", 8, "left")
    assert left.count() == 3000


def test_labels_with_hot_document(spark):
    h = "<html><body><p>alpha beta</p><p>" + "gamma " * 30 + "</p></body></html>"
    rows = [(i, f"http://s.example/en/{0 if i % 3 == 0 else i}", h) for i in range(60)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    docs = spark.createDataFrame([(i, "alpha beta", "en", "s", 10) for i in range(60)],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    ev = D.page_events(D.clean_pages(LB.pages_with_doc(pages).select("page_id", "url", "html", "doc_id")))
    plain = LB.label_page_rows(ev, docs)
    salted = LB.label_page_rows(ev, docs, LB.hot_docs(pages, 10), 4)
    key = lambda df: sorted((r["page_id"], tuple(r["label"])) for r in df.collect())
    assert key(plain) == key(salted) and len(key(plain)) == 60
