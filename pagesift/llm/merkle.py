"""Merkle dataset manifest by slot pivot: a hash tree over the rows of every group, and over the groups.

A row's leaf is the sha256 (lower-case hex; digests enter as hex text) of its
columns, each ``-`` if null, else its UTF-8 length, ``:``, its value. Within a
group the leaves stand by id; while more than one node remains, every
``FANOUT`` consecutive nodes become the hash of their concatenation. The last
node is the group's subroot, and the subroots, by group, make a tree of the
same kind up to the root.

A level is one aggregation by (group, position div fanout): conditional
aggregates spread a parent's children into one column for each slot, the
concatenated columns hash to the parent, and leaving out a slot's own column
gives what stands to its left and right. No group, however large, is a window
or a task of its own: rows get their position from a range partitioning by
(group, id) with the counts of a group's earlier partitions added, and a
parent has at most ``FANOUT`` children. Levels are written to the shared
folder, so a lost executor repeats a level at most.

Defined cases: a null group is a group and stands first; null ids stand
first in their group; rows that repeat an id stand by leaf, and equal rows have
equal leaves, so their order does not matter; an empty table has no rows and no
root; a group of one row has its leaf as subroot, a table of one row has it as
root and an empty proof.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagesift.llm.common import drop_written, written

FANOUT = 8
_SLOTS = [f"s{i}" for i in range(FANOUT)]
_PATH = "array<struct<before:string,after:string>>"
_ROW = (1 << 33) - 1  # monotonically_increasing_id: the partition above, the row's number in it below


def field(column: Column) -> Column:
    """A value as the leaf hashes it."""
    value = column.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaf(*columns: Column) -> Column:
    return F.sha2(F.concat(*[field(c) for c in columns]).cast("binary"), 256)


def deal(rows: DataFrame, group: str, order: list[Column]) -> tuple[DataFrame, DataFrame]:
    """``rows`` range partitioned by ``group`` (not null) and ``order``, sorted inside a partition and
    numbered there (``part, at``); and for each (group, partition) the ``shift`` that makes ``at``
    the row's place in its group, with the group's size ``n``.

    The second table has at most (partitions + groups) rows; its window runs
    over a group's partitions, not over its rows.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col(group), *order]
    numbered = (rows.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
                .withColumn("row", F.monotonically_increasing_id()))
    dealt = written(numbered.withColumns({"part": F.shiftright("row", 33), "at": F.col("row").bitwiseAND(F.lit(_ROW))}).drop("row"),
                    "merkle-dealt")
    counts = dealt.groupBy(group, "part").agg(F.count("*").alias("rows"), F.min("at").alias("first"))
    whole = Window.partitionBy(group)
    earlier = whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return dealt, written(counts.select(
        group, "part", F.sum("rows").over(whole).alias("n"),
        (F.coalesce(F.sum("rows").over(earlier), F.lit(0)) - F.col("first")).alias("shift")), "merkle-starts")


def place(dealt: DataFrame, starts: DataFrame, group: str) -> DataFrame:
    """The dealt rows with their place ``pos``; joined by (group, partition), so no group meets in one task."""
    return dealt.join(starts, [group, "part"]).withColumn("pos", F.col("at") + F.col("shift")).drop("at", "part", "shift")


def _pivot(nodes: DataFrame, value: Column) -> DataFrame:
    """One row for each parent: ``g, pos, n`` (its own place and its level's size) and its children in slots."""
    slot = F.col("pos") % FANOUT
    return (nodes.groupBy("g", F.expr(f"pos div {FANOUT}").alias("up"), F.expr(f"(n + {FANOUT - 1}) div {FANOUT}").alias("of"))
            .agg(*[F.max(F.when(slot == i, value)).alias(s) for i, s in enumerate(_SLOTS)])
            .select("g", F.col("up").alias("pos"), F.col("of").alias("n"), *_SLOTS))


def _hashes(slots: list[str]) -> Column:
    """The slots' hashes joined; ``concat_ws`` leaves out empty slots."""
    return F.concat_ws("", *[F.col(s)["hash"] for s in slots]) if slots else F.lit("")


def _parents(pivoted: DataFrame) -> DataFrame:
    return pivoted.select("g", "pos", "n", F.sha2(_hashes(_SLOTS).cast("binary"), 256).alias("hash"))


def _children(pivoted: DataFrame) -> DataFrame:
    """The pivoted nodes as rows again, with the step of their path that the slots beside them are."""
    entries = [F.when(F.col(s).isNotNull(), F.struct(
        F.lit(i).alias("slot"), F.col(s).alias("value"),
        F.struct(_hashes(_SLOTS[:i]).alias("before"), _hashes(_SLOTS[i + 1:]).alias("after")).alias("step")))
        for i, s in enumerate(_SLOTS)]
    out = pivoted.select("g", "pos", "subroot", "path", F.explode(F.array_compact(F.array(*entries))).alias("e"))
    return out.select("g", (F.col("pos") * FANOUT + F.col("e.slot")).alias("pos"), F.col("e.value").alias("value"), "subroot",
                      F.concat(F.array(F.col("e.step")), F.col("path")).alias("path"))


class Forest:
    """Trees over ``g, pos, n, value`` (tree, place, size, a struct with the node's ``hash``), built level
    by level; ``largest`` is the size of the largest."""

    def __init__(self, leaves: DataFrame, largest: int):
        self.lone = written(leaves.where(F.col("n") == 1), "merkle-lone")
        self.levels, self._tops = [], [self.lone.select("g", F.col("value.hash").alias("hash"), F.lit(0).alias("height"))]
        nodes, value, height = leaves, F.col("value"), 0
        while largest > 1:
            height, largest = height + 1, -(-largest // FANOUT)
            pivoted = written(_pivot(nodes.where(F.col("n") > 1), value), "merkle-level")
            self.levels.append(pivoted)
            nodes, value = _parents(pivoted), F.struct("hash")
            self._tops.append(nodes.where(F.col("n") == 1).select("g", "hash", F.lit(height).alias("height")))

    def roots(self) -> DataFrame:
        """``g, hash, height`` of every tree; the height is the number of levels above the leaves."""
        return reduce(DataFrame.unionByName, self._tops)

    def paths(self, above: DataFrame) -> DataFrame:
        """``g, pos, value, subroot, path`` of every leaf. ``above``: ``g, height, subroot, path`` of every
        tree, the path being that of its root in the tree above."""
        nodes = None
        for height in range(len(self.levels), 0, -1):
            start = above.where(F.col("height") == height).select("g", F.lit(0).cast("long").alias("pos"), "subroot", "path")
            known = start if nodes is None else nodes.drop("value").unionByName(start)
            nodes = _children(self.levels[height - 1].drop("n").join(known, ["g", "pos"]))
        lone = (self.lone.join(above.where(F.col("height") == 0).select("g", "subroot", "path"), "g")
                .select("g", "pos", "value", "subroot", "path"))
        return lone if nodes is None else nodes.unionByName(lone)


def fold(start: Column, path: Column) -> Column:
    """The root to which a leaf and the nodes beside its way up lead."""
    return F.aggregate(path, start, lambda h, s: F.sha2(F.concat(s["before"], h, s["after"]).cast("binary"), 256))


def proof(path: Column) -> Column:
    """The hashes beside a leaf's way up, level by level, as one text."""
    return F.array_join(F.transform(path, lambda s: F.concat(s["before"], s["after"])), "")


def manifest(rows: DataFrame, columns: list[str], group_col: str = "lang", id_col: str = "doc_id",
             extra: dict[str, Column] | None = None) -> DataFrame:
    """``id, leaf, subroot, root, path`` and the named ``extra`` columns (over ``rows``) of every row.

    ``path`` holds the hashes before and after the row's own node, level by
    level up to the root; ``fold`` leads from a leaf along it.
    """
    extra = extra or {}
    group = F.when(F.col(group_col).isNull(), F.lit("")).otherwise(F.concat(F.lit("+"), F.col(group_col).cast("string")))
    leaves = written(rows.select(group.alias("group"), F.col(id_col).alias("id"), leaf(*[F.col(c) for c in columns]).alias("hash"),
                                 *[c.alias(f"x_{k}") for k, c in extra.items()]), "merkle-leaves")
    dealt, starts = deal(leaves, "group", [F.col("id").asc_nulls_first(), F.col("hash")])
    drop_written(leaves)
    # the groups in order; all of them are one group of the tree above
    groups = starts.groupBy("group").agg(F.max("n").alias("size")).withColumn("all", F.lit(0))
    groups = place(*deal(groups, "all", [F.col("group")]), "all").select("group", "size", F.col("pos").alias("g"), F.col("n").alias("groups"))
    groups = written(groups, "merkle-groups")
    size, count = groups.agg(F.coalesce(F.max("size"), F.lit(0)), F.coalesce(F.max("groups"), F.lit(0))).first()
    value = F.struct("hash", "id", *[f"x_{k}" for k in extra])
    numbered = written(starts.join(groups.select("group", "g"), "group"), "merkle-starts")
    trees = Forest(place(dealt, numbered, "group").select("g", "pos", "n", value.alias("value")), size)
    drop_written(dealt)
    heads = written(trees.roots().join(groups.select("g", "groups"), "g"), "merkle-subroots")
    crown = Forest(heads.select(F.lit(0).cast("long").alias("g"), F.col("g").alias("pos"), F.col("groups").alias("n"),
                                F.struct("hash", "height").alias("value")), count)
    root = crown.roots().first()
    root = F.lit(root["hash"] if root else None).cast("string")
    above = crown.paths(crown.roots().select("g", "height", F.lit("").alias("subroot"), F.array().cast(_PATH).alias("path")))
    above = written(above.select(F.col("pos").alias("g"), "value.height", F.col("value.hash").alias("subroot"), "path"), "merkle-above")
    return trees.paths(above).select(F.col("value.id").alias("id"), F.col("value.hash").alias("leaf"), "subroot", root.alias("root"), "path",
                                     *[F.col("value")[f"x_{k}"].alias(k) for k in extra])
