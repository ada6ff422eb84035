"""Gold text, page-gold join and node labels (J-01, S-05..S-07, E-09, C-09).

The gold text is joined once per page (not per node) and each node's label
is computed inside the page row, so the gold string is never replicated
onto node rows. The join is an ordinary equi-join on ``doc_id``: Spark
broadcasts the gold side only when its measured size is under the
broadcast threshold, AQE splits a hot ``doc_id`` (many copies of one page)
into several tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagesift.functions import text as X


def gold_table(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """documents(key, text, [lang], ...) -> gold(doc_id, lang, gold_norm, gold_len); ``lang`` is null where the
    gold has none.

    ``key`` is the table's key. Gold read from line files, where a key can
    repeat, is first reduced to one row per key by ``sources.io.first_gold_per_key``
    (an aggregate, J-01 first match). ``gold_norm`` keeps word characters only.
    """
    lang = F.col("lang") if "lang" in documents.columns else F.lit(None).cast("string")
    return documents.select(
        F.col(key).alias("doc_id"), lang.alias("lang"), X.normalise_gold(F.col(text)).alias("gold_norm"),
        F.length(text).cast("bigint").alias("gold_len"))


def url_key() -> Column:
    """The test tables' key of a page: the document id in its URL."""
    return X.doc_key_from_url(F.col("url"))


def hot_docs(pages: DataFrame, min_rows: int, page_key: Column | None = None) -> DataFrame:
    """Keys referenced by at least ``min_rows`` pages; reads only the key's columns."""
    from pagesift.operators.skew import hot_keys
    key = url_key() if page_key is None else page_key
    return hot_keys(pages.select(key.alias("doc_id")).filter(F.col("doc_id").isNotNull()), "doc_id", min_rows)


def pages_with_doc(pages: DataFrame, page_key: Column | None = None) -> DataFrame:
    """Pages with the key ``doc_id`` of their gold text (``page_key``, else the URL's document id) and the URL's language."""
    return pages.withColumn("doc_id", url_key() if page_key is None else page_key) \
                .withColumn("url_lang", X.lang_from_url(F.col("url")))


def join_gold(pages: DataFrame, documents: DataFrame) -> DataFrame:
    """J-01: pages with their gold text; pages without gold drop out (see ``gold_missing``)."""
    return pages_with_doc(pages).join(gold_table(documents), "doc_id", "inner")


def gold_missing(pages: DataFrame, documents: DataFrame, page_key: Column | None = None,
                 gold_key: str = "doc_id") -> DataFrame:
    """Pages whose key has no gold text (quarantined by training)."""
    return pages_with_doc(pages, page_key).join(documents.select(F.col(gold_key).alias("doc_id")), "doc_id", "left_anti") \
                                          .select("page_id")


def label_sql(content: str, gold: str) -> str:
    """S-07: label 1 when the fragment is longer than 3 and its word characters occur in the gold."""
    norm = (f"regexp_replace(regexp_replace({content}, {X.sql_str('&(amp|lt|gt);')}, ''),"
            f" {X.sql_str('[^\\p{L}\\p{N}_]')}, '')")
    return f"CASE WHEN length({content}) > 3 AND contains({gold}, {norm}) THEN 1 ELSE 0 END"


def label_page_rows(page_rows: DataFrame, documents: DataFrame, hot: DataFrame | None = None,
                    buckets: int = 32, how: str = "inner") -> DataFrame:
    """J-01 + S-07 after the fold: page rows (carrying ``doc_id``) joined to their
    gold text (``documents`` or a ``gold_table``), labels computed in the row. Joining after the narrow clean/fold
    means a shuffle join moves the compact event arrays of usable pages, not
    the raw HTML. ``hot`` (from ``skew.hot_keys`` on the page keys) salts
    documents shared by very many pages so no single task receives them all.
    With ``how='left'`` pages without gold stay, their ``label`` null."""
    gold = documents if "gold_norm" in documents.columns else gold_table(documents)
    if hot is None:
        return with_labels(page_rows.join(gold, "doc_id", how))
    from pagesift.operators.skew import salted_join
    return with_labels(salted_join(page_rows, gold, "doc_id", hot, "page_id", buckets, how))


def with_labels(page_rows: DataFrame) -> DataFrame:
    """Add ``label`` (array, one per event; null without gold) computed inside the page row; drops gold."""
    lab = F.expr(f"CASE WHEN gold_norm IS NOT NULL THEN transform(content, c -> {label_sql('c', 'gold_norm')}) END")
    return page_rows.withColumn("label", lab).drop("gold_norm", "gold_len")
