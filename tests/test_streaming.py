"""The per-page operators run on a stream and give the batch result."""
import tempfile

from pagesift.streaming.bodies_stream import rule_bodies_stream, stream_pages
from pagesift.plans.queries import q_rule_bodies

SF = "/root/testdata/sf0.001"


def test_stream_equals_batch(spark):
    q = (rule_bodies_stream(stream_pages(spark, SF))
         .writeStream.format("memory").queryName("bodies_stream")
         .option("checkpointLocation", tempfile.mkdtemp(prefix="pagesift-stream-"))
         .outputMode("append").start())
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    got = sorted(tuple(r) for r in spark.sql("SELECT page_id, body FROM bodies_stream").collect())
    want = sorted(tuple(r) for r in q_rule_bodies(spark, SF).collect())
    assert got == want


def test_fitted_extractor_on_a_stream(spark):
    from pagesift.plans.extractor import BodyExtractor
    from pagesift.sources import io
    from pagesift.streaming.bodies_stream import model_bodies_stream
    pages, docs = io.read_table(spark, SF, "pages"), io.read_table(spark, SF, "documents")
    ex = BodyExtractor().fit(pages, docs)
    out = tempfile.mkdtemp(prefix="pagesift-stream-out-")
    q = model_bodies_stream(stream_pages(spark, SF), ex, out, tempfile.mkdtemp(prefix="pagesift-stream-ck-"))
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    got = sorted((r["page_id"], r["body"]) for r in spark.read.parquet(out).collect())
    want = sorted((r["page_id"], r["body"]) for r in ex.transform(pages).collect())
    assert got == want
