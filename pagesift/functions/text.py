"""Scalar functions as Spark SQL expressions (JVM-side, whole-stage codegen).

Each helper returns a ``Column``; array helpers are SQL lambdas so a page's
events stay in one row and no shuffle is needed to look at neighbours.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagesift import config as C


def sql_str(s: str) -> str:
    """Quote a Python string as a Spark SQL string literal."""
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def strip_content(col: Column, strip_latin1: bool = True, keep_whitespace: bool = False) -> Column:
    """C-05: delete whitespace and invisible characters from a text run."""
    if keep_whitespace:
        col = F.regexp_replace(col, C.PY_SPACE_RE + "+", " ")
        ctrl = C.CONTROL_RE if strip_latin1 else r"[\x00-\x08\x0b\x0c\x0e-\x1f]"
        return F.regexp_replace(col, ctrl, "")
    pat = C.CONTENT_STRIP_RE if strip_latin1 else C.CONTENT_STRIP_KEEP_LATIN1_RE
    return F.regexp_replace(col, pat, "")


def escape_text(col: Column) -> Column:
    """Serialiser escaping of text: & < > (in that order)."""
    return F.replace(F.replace(F.replace(col, F.lit("&"), F.lit("&amp;")),
                               F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def normalise_gold(col: Column) -> Column:
    """S-05 on the gold text: keep word characters only."""
    return F.regexp_replace(col, C.NON_WORD_RE, "")


def punct_count(col: Column) -> Column:
    """S-04: number of . ! ? 。 ！ ？ characters."""
    return F.length(F.regexp_replace(col, C.PUNCT_KEEP_RE, ""))


def has_cjk(col: Column) -> Column:
    """S-09: contains a CJK unified ideograph U+4E00-U+9FFF."""
    return col.rlike(C.CJK_RE)


def doc_key_from_url(url: Column) -> Column:
    """Test-data page key: /<lang>/<doc_id> in the URL; null for any other URL."""
    return F.regexp_extract(url, r"/[a-z]{2}/([0-9]+)", 1).try_cast("bigint")


def lang_from_url(url: Column) -> Column:
    return F.regexp_extract(url, r"/([a-z]{2})/[0-9]+", 1)
