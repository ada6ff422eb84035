"""Cleaning keeps page text around odd markup; foreign keys, printed dicts and missing folders are handled."""
import pytest

from pagesift.operators import dom, labels
from pagesift.session import ensure_checkpoint_dir
from pagesift.sources.io import read_gold_lines


@pytest.mark.parametrize("source, cleaned", [
    ('<iframe src="x"/><p>AFTER</p>', "<p>AFTER</p>"),
    ('<div><iframe src="x"></div><p>AFTER</p>', "<div></div><p>AFTER</p>"),
    ('<iframe src="x">inner</iframe><p>AFTER</p>', "<p>AFTER</p>"),
    ("<style-guide>x</style-guide><p>AFTER</p>", "<style-guide>x</style-guide><p>AFTER</p>"),
    ("<img-gallery>x</img-gallery><img src=y>", "<img-gallery>x</img-gallery>"),
    ('<script>var a="<!--";</script><p>KEPT</p><!-- c --><p>tail</p>', "<p>KEPT</p><p>tail</p>"),
    ("<!-- <script> --><p>KEPT</p>", "<p>KEPT</p>"),
    ("<p>a</p><script>x", "<p>a</p>")])
def test_cleaning_keeps_text(spark, source, cleaned):
    pages = spark.createDataFrame([(1, "http://x.example/en/1", source)], "page_id long, url string, html string")
    assert dom.clean_pages(pages).first().html == cleaned


def test_foreign_urls_have_no_key_and_are_reported(spark):
    pages = spark.createDataFrame([(1, "http://a.b/c", ""), (2, "http://x.example/en/7", ""), (3, None, "")],
                                  "page_id long, url string, html string")
    docs = spark.createDataFrame([(7, "gold")], "doc_id long, text string")
    assert [r.doc_id for r in labels.pages_with_doc(pages).orderBy("page_id").collect()] == [None, 7, None]
    assert {r.page_id for r in labels.gold_missing(pages, docs).collect()} == {1, 3}


def test_printed_dicts_keep_their_characters(spark, tmp_path):
    rows = [{"Website": None, "Filename": "a", "Body text": "one\xa0two\x0bthree \\x41 é"},
            {"Website": "w", "Filename": "b", "Body text": "x: None, y"}]
    path = tmp_path / "text.txt"
    path.write_text("\n".join(map(str, rows)), encoding="utf-8")
    got = {r.filename: (r.website, r.body_text) for r in read_gold_lines(spark, str(path)).collect()}
    assert got == {r["Filename"]: (r["Website"], r["Body text"]) for r in rows}


class _Context:
    master = "spark://host:7077"

    def getCheckpointDir(self):
        return None


class _Conf:
    def get(self, key, default=None):
        return default


class _Cluster:
    sparkContext, conf = _Context(), _Conf()


def test_cluster_without_shared_folder_is_an_error():
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        ensure_checkpoint_dir(_Cluster())
