"""Page cleaning (L-01..L-09), tokens, tag events, paths and node text (C-01..C-09).

Plan shape: every step here is narrow. A page stays one row while its
events are folded and its node texts computed with array lambdas; the only
row multiplication is the final ``inline`` into node rows. Nothing in this
module shuffles, so it scales with the number of scan tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagesift import config as C
from pagesift.config import Options
from pagesift.functions import text as X
from pagesift.functions.udfs import fold_udf, html_unescape
from pagesift.session import bounded_batches

_NAME_END = rf"(?=[{C.BLANK}/>])"  # a name ends here; "style-guide" is another element than "style"
HTML_START_RE = rf"(?i)<html{_NAME_END}{C.ATTRIBUTES}/?>"
# an iframe up to its end tag, other excluded tags alone, any other start tag (kept)
_IFRAME_RE = (rf"<iframe{_NAME_END}{C.ATTRIBUTES}>[^<]*+(?:<(?!/?iframe[{C.BLANK}/>])[^<]*+)*+</iframe[{C.BLANK}]*+>")
_NAMES = "|".join((*C.EXCLUDED_VOID, "iframe"))
EXCLUDED_RE = (rf"(?i){_IFRAME_RE}|<(?:{_NAMES}|{'|'.join(C.EXCLUDED_RAW)}){_NAME_END}{C.ATTRIBUTES}/?>"
               rf"|</(?:{_NAMES}){_NAME_END}[^>]*+>|({C.START_TAG_RE})")


def _strip_excluded(h: Column) -> Column:
    # L-05: raw-text elements lose their whole body, an iframe up to its end tag; one that
    # is closed at once or never loses its tag alone, what follows it is page text
    return F.regexp_replace(F.regexp_replace(h, C.COMMENT_OR_RAW_RE, "$3"), EXCLUDED_RE, "$1")


def clean_pages(pages: DataFrame) -> DataFrame:
    """pages(page_id, url, html) -> cleaned(page_id, url, html, visible_len, status).

    L-01 newlines, L-02 entities (pandas UDF), L-03 doctype, L-04 comments,
    L-05 excluded elements, L-08 gate. Status is 'too_short' below 100
    visible characters, 'no_html' without an html element, else 'ok'.
    """
    bounded_batches(pages.sparkSession)
    h = F.regexp_replace(F.col("html"), "\n", "")
    h = html_unescape(h)
    h = F.regexp_replace(h, C.DOCTYPE_RE, "")
    h = _strip_excluded(h)
    extra = [c for c in pages.columns if c not in ("page_id", "url", "html")]
    out = pages.select("page_id", "url", *extra, h.alias("html"))
    visible = F.length(F.replace(F.regexp_replace("html", C.TAG_OR_DECL_RE, ""), F.lit("\\"), F.lit("")))
    status = (F.when(F.col("html").isNull(), F.lit("no_html"))
              .when(F.col("visible_len") < C.MIN_VISIBLE_CHARS, F.lit("too_short"))
              .when(~F.col("html").rlike(HTML_START_RE), F.lit("no_html"))
              .otherwise(F.lit("ok")))
    return out.withColumn("visible_len", visible.cast("int")).withColumn("status", status)


def quarantine(cleaned: DataFrame) -> DataFrame:
    """L-09: unusable pages with their reason (the re-fetch itself is not built)."""
    return cleaned.filter(F.col("status") != "ok").select(
        "page_id", "url", F.col("status").alias("reason"))


def tokens(cleaned: DataFrame) -> DataFrame:
    """C-01/C-02: tag, declaration and text tokens in document order."""
    return cleaned.withColumn("toks", F.regexp_extract_all("html", F.lit(C.TOKEN_RE), 0))


def page_events(cleaned: DataFrame, opts: Options = Options(), full_paths: bool = False,
                keep_unusable: bool = False) -> DataFrame:
    """L-06/L-07, C-03..C-05 on usable pages; one row per page with event arrays.

    Columns: page_id, url, kind, name, synthetic, raw, tag, class_name, anc,
    parent, depth, content (arrays indexed by event position), text_len,
    punct (page totals over all node texts). ``anc`` holds every ancestor
    with ``full_paths``, else only the root-most ``max_steps`` (all the
    features need), which keeps a page with thousands of unclosed tags at
    O(events) integers instead of O(events x depth). With ``keep_unusable``
    the other pages stay as rows with empty arrays, and ``status`` says why
    (a page whose html element yields no event is 'no_html').

    Only element-wise and shifted-array expressions are used here: a lambda
    that indexes another computed array would be re-evaluated per element
    once Catalyst collapses the projections. Index lookups (``anc``) only
    touch arrays produced by the fold, which are materialised.
    """
    # Unusable pages reach the fold with no tokens and are dropped on its
    # output: a filter on ``status`` here would be pushed through the cleaning
    # projection and evaluate the cleaning regexes a second time.
    ok = cleaned.withColumn("toks", F.when(F.col("status") == "ok",
                                           F.regexp_extract_all("html", F.lit(C.TOKEN_RE), 0)))
    extra = [c for c in cleaned.columns if c not in ("page_id", "url", "html", "visible_len", "status", "toks")]
    fold = fold_udf(None if full_paths else opts.max_steps)
    ev = ok.select("page_id", "url", *extra, *(["status"] if keep_unusable else []), fold("toks").alias("ev"))
    if keep_unusable:
        extra = [*extra, "status"]
        ev = ev.withColumn("status", F.when((F.col("status") == "ok") & (F.size("ev.kind") == 0), "no_html").otherwise(F.col("status")))
    ev = ev.select("page_id", "url", *extra, "ev.*")
    if not keep_unusable:
        ev = ev.filter(F.size("kind") > 0)
    run = F.transform("run", lambda x: X.strip_content(
        X.escape_text(F.replace(x, F.lit("\\"), F.lit(""))), opts.strip_latin1, opts.keep_whitespace))
    ev = ev.select("page_id", "url", *extra, "kind", "name", "synthetic", "tag",
                   F.col("cls").alias("class_name"), "anc", "parent", "depth", "raw", run.alias("r"))
    # C-04: a start owns the text after it plus text left by a preceding end;
    # an end owns only the text left by the preceding end.
    prev = lambda c, pad: F.slice(F.concat(F.array(F.lit(pad)), c), F.lit(1), F.size(c))
    ev = ev.withColumn("pk", prev(F.col("kind"), "")).withColumn("pr", prev(F.col("r"), ""))
    content = F.expr("transform(arrays_zip(kind, pk, pr, r), e -> concat("
                     "CASE WHEN e.pk = 'end' THEN e.pr ELSE '' END,"
                     "CASE WHEN e.kind = 'start' THEN e.r ELSE '' END))")
    ev = ev.withColumn("content", content).drop("pk", "pr", "r")
    ev = ev.withColumn("text_len", F.aggregate("content", F.lit(0), lambda acc, c: acc + F.length(c)))
    ev = ev.withColumn("punct", F.aggregate("content", F.lit(0), lambda acc, c: acc + X.punct_count(c)))
    return ev


NODE_COLS = ("kind", "name", "synthetic", "raw", "tag", "class_name", "anc", "parent", "depth", "content")
_RENAME = {"anc": "anc_pos", "parent": "parent_pos"}


def explode_nodes(events: DataFrame, *keep: str) -> DataFrame:
    """Page rows -> one row per event (narrow ``inline`` of the zipped arrays)."""
    zipped = F.arrays_zip(*[F.col(c) for c in NODE_COLS])
    cols = ["page_id", *keep, "text_len", "punct"]
    out = events.select(*cols, F.posexplode(zipped).alias("pos", "e"))
    return out.select(*cols, F.col("pos").cast("int").alias("pos"),
                      *[F.col("e")[c].alias(_RENAME.get(c, c)) for c in NODE_COLS])


def nodes(events: DataFrame, *keep: str) -> DataFrame:
    """Node rows with parent and path helpers (C-03, J-02 via the path stack)."""
    return explode_nodes(events, *keep)


def path_strings(events: DataFrame) -> DataFrame:
    """Readable root-to-tag path per event: ancestors' path names, then the tag text
    (needs ``page_events(..., full_paths=True)``)."""
    path = F.expr("transform(arrays_zip(anc, raw), e -> "
                  "array_join(concat(transform(e.anc, a -> tag[a]), array(e.raw)), '>'))")
    return events.withColumn("path", path)


def parents_by_search(events: DataFrame) -> DataFrame:
    """J-02 window form: an event's parent is the nearest earlier start event whose
    name is the event's parent name and whose ancestors are the event's
    grandparent path — a backward as-of lookup, written as a union of
    definitions (start events) and probes (all events) and ``last(ignorenulls)``
    over the preceding rows of the same (page, path key). Groups are siblings
    of one page, bounded by the page. Cross-check of ``nodes().parent_pos``;
    needs ``page_events(..., full_paths=True)``."""
    from pyspark.sql import Window
    names = F.expr("transform(anc, l -> transform(l, a -> tag[a]))")
    rows = events.select("page_id", F.posexplode(F.arrays_zip("kind", "tag", names.alias("an"))).alias("pos", "e"))
    rows = rows.select("page_id", "pos", "e.kind", "e.tag", "e.an")
    key = lambda path, last: F.concat_ws("|", F.array_join(path, ">"), last)
    defs = rows.filter(F.col("kind") == "start").select(
        "page_id", key(F.col("an"), F.col("tag")).alias("k"), "pos", F.col("pos").alias("d"), F.lit(0).alias("probe"))
    probes = rows.filter(F.size("an") > 0).select(
        "page_id", key(F.slice("an", 1, F.size("an") - 1), F.element_at("an", -1)).alias("k"), "pos",
        F.lit(None).cast("int").alias("d"), F.lit(1).alias("probe"))
    w = Window.partitionBy("page_id", "k").orderBy("pos", "probe").rowsBetween(Window.unboundedPreceding, -1)
    found = defs.unionByName(probes).withColumn("parent_pos", F.last("d", ignorenulls=True).over(w)) \
                .filter(F.col("probe") == 1).select("page_id", "pos", "parent_pos")
    roots = rows.filter(F.size("an") == 0).select("page_id", "pos", F.lit(None).cast("int").alias("parent_pos"))
    return found.unionByName(roots)
