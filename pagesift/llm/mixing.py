"""Mixing sources to target weights by systematic sampling, in DataFrame functions only.

Sizes are words. The sources in code-point order (null last) have the weights
of ``weights``, repeated; together they share ``share`` times all words. A
source's target stops at ``cap`` times its own words and the excess goes to
the other sources by weight until none is above: that is the level ``v`` at
which the sum of ``min(cap * words, v * weight)`` equals the total.

Every document of a source expects ``target / words`` copies. The expected
copies are prefix-summed within the source, one offset per source (a hash of
its name and the seed, below 1) is added, and a document comes once for each
integer boundary its stretch crosses, so it is taken ``floor`` or ``ceil`` of
its expected copies, never more than ``cap`` times.

The prefix sum needs no task that holds a source: a source of n documents is
dealt by hash into about sqrt(n) / 8 runs; positions are counted within a run
(a window over one run) and the runs' counts are summed (a window over the
runs of a source), so both windows grow with sqrt(n). Within a run documents
stand by size, every second run downwards, which keeps neighbours alike and
each source's words near its target.

Defined cases: a null text has no words; rows of a null source form one
source; sources without words have target 0 and are not taken; repeated rows
are separate documents, interchangeable among themselves; reruns agree, since
every choice is a hash of the row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagesift.llm.common import WORD_SPACE, written

WEIGHTS = (5, 2, 1)
SHARE = 1.5
CAP = 2.0
#: Up to this many sources (some 100 bytes each) are broadcast to the documents; more are joined by a shuffle.
BROADCAST_SOURCES = 100_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(f"[^{WORD_SPACE}]+")), F.lit(0)).cast("long")


def _source_key(source: Column) -> Column:
    """Never-null join key of a source: null and the empty name stay apart."""
    return F.when(source.isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), source))


def targets(sources: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """``sources`` (``source, source_size, ...``: one row each) with its ``target`` added.

    Its windows run over one row per source, not over documents.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    whole = Window.partitionBy()
    ranked = sources.withColumn("nth", F.row_number().over(order) - 1)
    ranked = (ranked.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]),
                                                       (F.col("nth") % len(weights) + 1).cast("int")))
              .withColumn("most", F.col("source_size") * F.lit(float(cap)))
              .withColumn("total", F.sum("source_size").over(whole) * F.lit(float(share))))
    # sources by the level at which they reach their cap; before[k]: caps and weights of those reached earlier
    by_level = Window.orderBy(F.col("most") / F.col("weight"), "nth")
    upto = by_level.rowsBetween(Window.unboundedPreceding, -1)
    levels = (ranked.withColumn("full", F.coalesce(F.sum("most").over(upto), F.lit(0.0)))
              .withColumn("open", F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(upto), F.lit(0.0)))
              .withColumn("level", (F.col("total") - F.col("full")) / F.col("open")))
    # the water level: the first whose source is not filled by it; all full: none
    fits = F.when(F.col("level") <= F.col("most") / F.col("weight"), F.struct(F.col("most") / F.col("weight"), "nth", "level"))
    first = F.min(fits).over(whole)["level"]
    return (levels.withColumn("water", first)
            .withColumn("target", F.when(F.col("water").isNull(), F.col("most"))
                        .otherwise(F.least(F.col("most"), F.col("water") * F.col("weight"))))
            .drop("nth", "weight", "most", "total", "full", "open", "level", "water"))


def mix(docs: DataFrame, seed: int = 0, weights=WEIGHTS, share: float = SHARE, cap: float = CAP,
        id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        keep: list[str] | None = None) -> DataFrame:
    """One row per document: ``row`` (a struct of the ``keep`` columns, default the id), ``size``,
    ``source_size``, ``target`` and ``copies`` (how often the mix takes it)."""
    row = F.struct(*[docs[c] for c in (keep if keep is not None else [id_col])])
    sized = docs.select(row.alias("row"), docs[source_col].cast("string").alias("source"),
                        word_count(docs[text_col]).alias("size"),
                        F.xxhash64(F.lit(seed), docs[id_col], docs[text_col]).alias("mark"))
    totals = (sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n")))
    plan = (targets(totals, weights, share, cap)
            .withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
            .withColumn("runs", F.ceil(F.sqrt("n") / 8))
            .withColumn("offset", (F.pmod(F.xxhash64(F.lit(seed), "source"), F.lit(1 << 30)) + 0.5) / F.lit(1 << 30))
            .select(_source_key(F.col("source")).alias("key"), "source_size", "target", "rate", "runs", "offset"))
    plan = written(plan, "mix-plan")  # one row per source
    if plan.count() <= BROADCAST_SOURCES:
        plan = F.broadcast(plan)
    dealt = (sized.withColumn("key", _source_key(F.col("source"))).join(plan, "key")
             .withColumn("run", F.pmod(F.col("mark"), F.col("runs")))
             # one column, so that rows dealt by source for the join are dealt anew by source and run
             .withColumn("stand", F.struct("key", "run")))
    counts = dealt.groupBy("stand").agg(F.count(F.lit(1)).alias("in_run"))
    before = Window.partitionBy("stand.key").orderBy("stand.run").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("stand", F.coalesce(F.sum("in_run").over(before), F.lit(0)).alias("start"))
    # runs alternate between rising and falling sizes
    height = F.when(F.col("run") % 2 == 0, F.col("size")).otherwise(-F.col("size"))
    place = Window.partitionBy("stand").orderBy(height, "mark")
    nth = dealt.withColumn("nth", F.row_number().over(place)).join(starts, "stand")
    upto = F.col("start") + F.col("nth")
    crossed = F.floor(F.col("offset") + upto * F.col("rate")) - F.floor(F.col("offset") + (upto - 1) * F.col("rate"))
    # rounding of long prefix sums must not push a document over its bounds
    copies = F.least(F.greatest(crossed, F.floor("rate")), F.ceil("rate")).cast("long")
    return nth.select("row", "size", "source_size", "target", copies.alias("copies"))


def emit(docs: DataFrame, **options) -> DataFrame:
    """The mixed documents: every row of ``docs``, all its columns, as often as the mix takes it."""
    mixed = mix(docs, keep=docs.columns, **options)
    return mixed.where("copies > 0").select(F.explode(F.array_repeat("row", F.col("copies").cast("int"))).alias("row")).select("row.*")


def oracle_targets() -> str:
    """DuckDB SQL of the sources' targets, by refilling round after round instead of by level."""
    return rf"""
WITH RECURSIVE sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^{WORD_SPACE}]+'))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size,
             [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS w
      FROM sized GROUP BY source),
fill AS (
  SELECT 0 AS i, source, source_size, w, false AS stopped, 0.0::DOUBLE AS target FROM s
  UNION ALL
  SELECT i + 1, source, source_size, w, stopped OR t >= 2.0 * source_size,
         CASE WHEN stopped OR t >= 2.0 * source_size THEN 2.0 * source_size ELSE t END
  FROM (SELECT *, w * (1.5 * sum(source_size) OVER () - coalesce(sum(2.0 * source_size) FILTER (WHERE stopped) OVER (), 0))
                  / nullif(sum(w) FILTER (WHERE NOT stopped) OVER (), 0) AS t FROM fill)
  WHERE i <= (SELECT count(*) FROM s))
SELECT source, source_size, target FROM fill WHERE i = (SELECT max(i) FROM fill)"""
