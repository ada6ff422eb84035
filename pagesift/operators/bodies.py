"""Decisions and page bodies (S-09, S-11, S-13, A-08, T-07, IO-12)."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagesift import config as C
from pagesift.config import Options
from pagesift.functions import text as X


def rule_sql(c: str, model: str) -> str:
    """S-13 as SQL: <=3 rejected; >300 (no CJK) or >100 (CJK) accepted; else the model."""
    cjk = f"{c} RLIKE {X.sql_str(C.CJK_RE)}"
    return (f"CASE WHEN length({c}) <= {C.RULE_MIN_LEN} THEN 0 "
            f"WHEN NOT ({cjk}) AND length({c}) > {C.RULE_MAX_LEN_LATIN} THEN 1 "
            f"WHEN ({cjk}) AND length({c}) > {C.RULE_MAX_LEN_CJK} THEN 1 ELSE {model} END")


def _with_text(page_rows: DataFrame, body: str, any_text: str, *keep: str) -> DataFrame:
    """(keep..., body) of the rows with text. A one-element array is filtered and inlined in place of a
    filter, which the optimiser would push below the texts and so compute these twice."""
    row = ", ".join(f"'{c}', {c}" for c in ("page_id", *keep))
    one = F.expr(f"inline(filter(array(named_struct({row}, 'body', regexp_replace({body}, '<[^>]+>', ''), 'any', {any_text})), s -> s.any))")
    return page_rows.select(one).drop("any")


def rule_bodies(page_rows: DataFrame) -> DataFrame:
    """Length rules alone (model says 0): accepted fragments joined in page order,
    leftover tags stripped. Computed inside the page row — no shuffle."""
    return _with_text(page_rows, "array_join(filter(content, c -> c <> '' AND " + rule_sql("c", "0") + " = 1), '')",
                      "exists(content, c -> c <> '')")


def score_page_rows(page_rows: DataFrame, sums: Callable, weights: np.ndarray, intercept: float,
                    params: tuple[float, float, float, float], opts: Options, *keep: str) -> DataFrame:
    """T-06/S-12/S-13 of a linear model inside the page row: (page_id, keep..., nodes), ``nodes`` holding pos,
    content, prob, pred and accept of the non-empty ones.

    ``sums`` (``features.path_sums``) gives what tags and classes on a node's
    path add up to; length and punctuation are the same on all its steps, so
    they count with the sum of their weights over the kept steps, and the
    padding behind them is a constant for each path length. The result is the
    scalar product with the node's 15 x 62 vector, which is never built.
    """
    ml, sl, mp, sp = params
    wl, wp = weights[:, -2], weights[:, -1]
    upto = lambda w: np.concatenate([[0.0], np.cumsum(w)])
    al, ap = upto(wl), upto(wp)
    pad = (al[-1] - al) * (-ml / sl) + (ap[-1] - ap) * (-mp / sp)
    numbers = lambda v: "array(" + ", ".join(f"{float(x)!r}D" for x in v) + ")"
    length, punct = ("length(e.content)", f"length(regexp_replace(e.content, {X.sql_str(C.PUNCT_KEEP_RE)}, ''))") if opts.scope == "node" \
        else ("text_len", "punct")
    k = f"least(e.depth, {opts.max_steps})"
    margin = (f"{float(intercept)!r}D + e.sum + ({length} - {ml!r}D) / {sl!r}D * {numbers(al)}[{k}]"
              f" + ({punct} - {mp!r}D) / {sp!r}D * {numbers(ap)}[{k}] + {numbers(pad)}[{k}]")
    if "label" in keep:  # zipping with a null array would lose the row; an empty one gives null labels
        page_rows = page_rows.withColumn("label", F.coalesce("label", F.array().cast("array<int>")))
    s = page_rows.select("page_id", *keep, "content", "depth", "text_len", "punct", sums("tag", "class_name", "parent", "depth").alias("sum"),
                         F.sequence(F.lit(0), F.size("kind") - 1).alias("ix"))
    lab = ", label" if "label" in keep else ""
    found = F.expr(f"transform(filter(arrays_zip(ix, content, depth, sum{lab}), e -> e.content <> ''), e -> named_struct("
                   f"'pos', CAST(e.ix AS INT), 'content', e.content, 'prob', 1 / (1 + exp(-({margin})))"
                   f"{', ' + repr('label') + ', e.label' if lab else ''}))")
    s = s.select("page_id", *[c for c in keep if c != "label"], found.alias("n"))
    nodes = F.expr("transform(transform(n, e -> named_struct('e', e, 'pred', CAST(e.prob > 0.5 AS INT))), x -> named_struct("
                   "'pos', x.e.pos, 'content', x.e.content, 'prob', x.e.prob, 'pred', x.pred, 'accept', "
                   f"{rule_sql('x.e.content', 'x.pred')}{', ' + repr('label') + ', x.e.label' if lab else ''}))")
    return s.select("page_id", *[c for c in keep if c != "label"], nodes.alias("nodes"))


_JOINED = "array_join(transform(filter(nodes, n -> n.accept = 1), n -> n.content), '')"


def body_column(nodes: str = "nodes") -> Column:
    """A-08/S-11 of a page's scored nodes: accepted fragments in page order, leftover tags stripped."""
    return F.regexp_replace(F.expr(_JOINED.replace("nodes", nodes)), "<[^>]+>", "")


def bodies_of(scored: DataFrame, *keep: str) -> DataFrame:
    """The body of every page of ``score_page_rows``; pages without text drop out."""
    return _with_text(scored, _JOINED, "size(nodes) > 0", *keep)


def script_family(page_rows: DataFrame) -> DataFrame:
    """IO-12 routing key: 'zh' when any node text holds a CJK ideograph, else 'la'."""
    z = F.exists("content", X.has_cjk)
    return page_rows.select("page_id", F.when(z, "zh").otherwise("la").alias("script"))


def assemble(scored: DataFrame) -> DataFrame:
    """A-08/S-11: accepted fragments of a page concatenated by position (one group per page)."""
    acc = F.when(F.col("accept") == 1, F.struct("pos", "content"))
    g = scored.groupBy("page_id").agg(F.array_sort(F.collect_list(acc)).alias("f"))
    body = F.array_join(F.transform("f", lambda s: s["content"]), "")
    return g.select("page_id", F.regexp_replace(body, "<[^>]+>", "").alias("body"))


def apply_rules(scored: DataFrame) -> DataFrame:
    """S-13 over the model's ``pred``."""
    return scored.withColumn("accept", F.expr(rule_sql("content", "pred")))
