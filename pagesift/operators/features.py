"""Node features, path sequences and normalisation (E-01..E-03, E-10, A-03..A-06, A-10, W-04, S-08, S-10, S-14, S-15).

A node's sequence is the encoding of every event on its root-to-node path,
root first, cut to 15 steps. Ancestors are looked up by position inside the
page row (``anc`` comes from the fold), so the closure needs no self-join;
rows multiply only when the page row is exploded into its non-empty nodes.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagesift import config as C
from pagesift.config import Options
from pagesift.functions.embed import kept_memo, share
from pagesift.functions.udfs import by_slices

TERM_BYTES = 256  # longer terms are not broadcast
MAX_CHARS = 100_000  # characters of a trained embedding
BATCH_NODES = 512  # nodes whose vectors (7.4 KB each) leave a task at once


def nonempty_nodes(page_rows: DataFrame, *keep: str, with_label: bool = False,
                   max_steps: int = C.MAX_STEPS) -> DataFrame:
    """C-06/C-09/J-03/W-04: one row per non-empty node.

    Columns: page_id, keep..., text_len, punct, pos, idx (position among the
    page's non-empty nodes), kind, name, raw, tag, class_name, anc_pos,
    content, depth, [label], step_pos / step_tag / step_class (path cut to ``max_steps``).
    """
    if with_label:  # null without gold; zipping with a null array would lose the row
        page_rows = page_rows.withColumn("label", F.coalesce("label", F.array().cast("array<int>")))
    lab = ", label" if with_label else ""
    lab_e = ", 'label', e.label" if with_label else ""
    steps = f"slice(concat(e.anc, array(e.ix)), 1, {max_steps})"
    sel = F.expr(
        f"transform(filter(arrays_zip(ix, kind, name, raw, tag, class_name,"
        f" anc, parent, depth, content{lab}), e -> e.content <> ''), e -> named_struct("
        f"'pos', e.ix, 'kind', e.kind, 'name', e.name, 'raw', e.raw, 'tag', e.tag,"
        f" 'class_name', e.class_name, 'anc_pos', e.anc, 'parent_pos', e.parent, 'depth', e.depth,"
        f" 'content', e.content{lab_e},"
        f" 'step_pos', {steps},"
        f" 'step_tag', transform({steps}, a -> tag[a]),"
        f" 'step_class', transform({steps}, a -> class_name[a])))")
    cols = ["page_id", *keep, "text_len", "punct"]
    out = page_rows.withColumn("ix", F.sequence(F.lit(0), F.size("kind") - 1)) \
                   .select(*cols, F.posexplode(sel).alias("idx", "e"))
    return out.select(*cols, F.col("idx").cast("int").alias("idx"), "e.*") \
        .withColumn("pos", F.col("pos").cast("int"))


def apply_scope(nodes: DataFrame, opts: Options = Options()) -> DataFrame:
    """With ``scope='node'`` the length and punctuation features are the node's
    own (repeated on each of its path steps) instead of the page totals."""
    if opts.scope != "node":
        return nodes
    from pagesift.functions.text import punct_count
    return nodes.withColumn("text_len", F.length("content")).withColumn("punct", punct_count(F.col("content")))


def node_features(nodes: DataFrame, opts: Options = Options()) -> DataFrame:
    """E-01: tag name, class, text length and punctuation of a node.

    With ``scope='page'`` (reference semantics) length and punctuation are
    page totals; with ``scope='node'`` they are the node's own.
    """
    if opts.scope == "node":
        from pagesift.functions.text import punct_count
        return nodes.select("page_id", "pos", "tag", "class_name",
                            F.length("content").cast("bigint").alias("text_len"),
                            punct_count(F.col("content")).cast("bigint").alias("punct"))
    return nodes.select("page_id", "pos", "tag", "class_name",
                        F.col("text_len").cast("bigint"), F.col("punct").cast("bigint"))


def _sums(k, length, punct) -> list:
    """Sums of k, k x and k x x for both features: whole numbers, so exact in any order of merging."""
    out = []
    for name, x in (("l", length), ("p", punct)):
        kx = (k * x).cast("decimal(18,0)")
        out += [F.sum(kx.cast("decimal(28,0)")).alias(f"s{name}"), F.sum(kx * x.cast("decimal(10,0)")).alias(f"s{name}2")]
    return out


def _params(agg: DataFrame) -> DataFrame:
    """Mean and population std over n x t cells from exact sums. The deviations are taken from the
    whole part q of the mean, still in whole numbers: sum k (x - q)^2 = s2 - 2 q s + q^2 cells, the
    padding zeros among the cells. Nothing cancels, however far the values lie from zero."""
    out = agg.withColumn("cells", F.expr("CAST(n AS DECIMAL(19,0)) * CAST(t AS DECIMAL(10,0))").cast("decimal(20,0)"))
    cols = {}
    for name, feature in (("l", "text_length"), ("p", "punctuation_nb")):
        out = out.withColumn(f"q{name}", F.expr(f"s{name} div cells").cast("decimal(10,0)"))
        rest = f"CAST(s{name} - q{name} * cells AS DOUBLE) / CAST(cells AS DOUBLE)"
        square = f"CAST(s{name}2 - 2 * q{name} * s{name} + q{name} * q{name} * cells AS DOUBLE) / CAST(cells AS DOUBLE)"
        cols[f"{feature}_mean"] = F.expr(f"CAST(q{name} AS DOUBLE) + {rest}")
        cols[f"{feature}_std"] = F.expr(f"sqrt(greatest({square} - ({rest}) * ({rest}), 0.0D))")
    return out.select(*[c.alias(k) for k, c in cols.items()], F.col("n").alias("n_nodes"), F.col("t").cast("int").alias("t_steps"))


def norm_params(nodes: DataFrame, max_steps: int = C.MAX_STEPS) -> DataFrame:
    """A-05/A-06: mean and population std of text length and punctuation over
    all N x T cells of the padded tensor (padding zeros included).

    One global aggregate with partial aggregation; T = longest kept path.
    Returns one row: text_length_mean, text_length_std, punctuation_nb_mean,
    punctuation_nb_std, n_nodes, t_steps.
    """
    kept = F.least(F.col("depth"), F.lit(max_steps)).cast("bigint")
    return _params(nodes.agg(F.count("*").alias("n"), F.max(kept).alias("t"),
                             *_sums(kept, F.col("text_len").cast("bigint"), F.col("punct").cast("bigint"))))


def norm_params_rows(page_rows: DataFrame, opts: Options = Options()) -> DataFrame:
    """``norm_params`` from page rows, without a row for each node: a page's part of every sum is
    computed in its row."""
    from pagesift.functions.text import punct_count
    steps = F.expr(f"transform(filter(arrays_zip(depth, content), e -> e.content <> ''),"
                   f" e -> named_struct('k', CAST(least(e.depth, {opts.max_steps}) AS BIGINT), 'content', e.content))")
    cut = page_rows.select("text_len", "punct", steps.alias("steps"))
    if opts.scope == "node":
        one = cut.select(F.inline("steps"))
        k, length, punct = F.col("k"), F.length("content").cast("bigint"), punct_count(F.col("content")).cast("bigint")
        return _params(one.agg(F.count("*").alias("n"), F.max("k").alias("t"), *_sums(k, length, punct)))
    whole = cut.select(F.size("steps").alias("m"), F.expr("aggregate(steps, 0L, (a, s) -> a + s.k)").alias("k"),
                       F.expr("array_max(transform(steps, s -> s.k))").alias("t"), F.col("text_len").cast("bigint").alias("l"),
                       F.col("punct").cast("bigint").alias("p"))
    # as count(*) over nodes: 0 for an empty table
    return _params(whole.agg(F.coalesce(F.sum("m"), F.lit(0)).alias("n"), F.max("t").alias("t"), *_sums(F.col("k"), F.col("l"), F.col("p"))))


def zscore(x, mean, std):
    """S-10 with a guard: a zero std leaves the centred value."""
    return (x - mean) / F.when(std > 0, std).otherwise(F.lit(1.0))


def term_uses(nodes: DataFrame) -> DataFrame:
    """(kind, term, uses) of the terms on the nodes' path steps (map-side combined)."""
    st = nodes.select(F.explode(F.arrays_zip(F.col("step_tag").alias("t"), F.col("step_class").alias("c"))).alias("s"))
    both = st.select(F.explode(F.array(F.struct(F.lit("tag").alias("kind"), F.col("s.t").alias("term")),
                                       F.struct(F.lit("class").alias("kind"), F.col("s.c").alias("term")))).alias("k"))
    return both.select("k.*").groupBy("kind", "term").agg(F.count("*").alias("uses"))


def step_normalised(vectors: DataFrame) -> DataFrame:
    """S-08 moved to the term table: a step's 30 tag (or class) values are one
    term's vector, so their per-step min-max (with the +eps shift) is a
    property of the term and is computed once per term, not per node."""
    eps = C.MINMAX_EPS
    lo, hi = F.array_min("vector"), F.array_max("vector")
    mm = F.transform("vector", lambda x: ((x + eps) - (lo + eps)) / ((hi - lo) + eps))
    keys = [c for c in vectors.columns if c != "vector"]
    return vectors.select(*keys, mm.alias("vector"))


def embedded(terms: DataFrame, chars=None) -> DataFrame:
    """``terms`` (kind, term, ...) with their step-normalised ``vector``, each embedded once by the very function
    that embeds unseen terms in a task; ``chars`` as for ``share``, of a trained embedding."""
    shared = share(terms.sparkSession, {}, chars)
    names = terms.columns

    def run(batches):
        memo = kept_memo(shared, "vectors", lambda e: e.vector)
        for b in batches:
            kinds, words = (b.column(names.index(c)).to_pylist() for c in ("kind", "term"))
            vectors = pa.array([memo(k, t).tolist() for k, t in zip(kinds, words)], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*b.columns, vectors], names=[*names, "vector"])
    return terms.mapInArrow(run, T.StructType([*terms.schema, T.StructField("vector", T.ArrayType(T.DoubleType()))]))


def trained_characters(chars: DataFrame | None) -> dict | None:
    """The character table of a trained embedding (one row for each kind and character), ``MAX_CHARS`` at most."""
    if chars is None:
        return None
    rows = chars.limit(MAX_CHARS + 1).collect()
    if len(rows) > MAX_CHARS:
        raise ValueError(f"more than {MAX_CHARS} trained characters")
    return {(r["kind"], r["ch"]): np.array(r["vector"]) for r in rows}


def embedding(spark: SparkSession, table: DataFrame | None, chars: dict | None = None, opts: Options = Options()):
    """The broadcast of an ``embed.Embedding``: of ``table`` (kind, term, vector, uses) the terms used
    most, ``vocab_broadcast_max_terms`` at most and none above ``TERM_BYTES``, which bounds the bytes
    as well; all others are embedded where they occur."""
    known = {}
    if table is not None and opts.vocab_broadcast_max_terms:
        top = (table.filter(F.octet_length("term") <= TERM_BYTES).orderBy(F.desc("uses"), "kind", "term")
               .limit(opts.vocab_broadcast_max_terms))
        known = {(r["kind"], r["term"]): np.array(r["vector"]) for r in top.collect()}
    return share(spark, known, chars)


def normalisation(params: DataFrame) -> tuple[float, float, float, float]:
    """The four numbers of the one-row parameter table; a zero std counts as one (S-10's guard)."""
    r = params.first()
    guard = lambda s: s if s and s > 0 else 1.0
    return (r["text_length_mean"] or 0.0, guard(r["text_length_std"]), r["punctuation_nb_mean"] or 0.0, guard(r["punctuation_nb_std"]))


def distinct_inputs(nodes: DataFrame, *keys: str) -> DataFrame:
    """One row for the nodes of a page that agree in label, ``keys``, numbers and path, and so in their model
    vector: the first of their positions as ``pos``, all of them as ``at``, their number as ``copies``.

    A weighted loss over these rows is that over the nodes (a standardised penalty differs a little: Spark ML's
    variance of weighted rows depends on how many they are). With page totals for numbers, the paragraphs of one parent are one row. Combined before
    the shuffle; a group never exceeds a page.
    """
    same = ["page_id", "label", *keys, "text_len", "punct", "step_tag", "step_class"]
    return nodes.groupBy(*same).agg(F.sort_array(F.collect_list("pos")).alias("at")).withColumns(
        {"pos": F.col("at")[0], "copies": F.size("at")})


def path_vectors(nodes: DataFrame, shared, params: DataFrame, max_steps: int = C.MAX_STEPS) -> DataFrame:
    """E-02/E-03/E-10/S-14/S-15: the normalised 15 x 62 input ``x`` of every node, flattened.

    ``shared`` is ``embedding``'s broadcast, ``params`` the one row of
    ``norm_params``. Narrow: a batch's distinct terms are embedded once and
    its steps gathered from them. Steps past the path are padding: zero
    vectors and the z-score of zero, as in a zero-padded tensor. The step
    columns are replaced by ``x``.
    """
    def dense(x):
        n, width = x.shape
        return pa.ListArray.from_arrays(np.arange(n + 1, dtype=np.int32) * width, x.reshape(-1))
    return _path_inputs(nodes, shared, params, max_steps, T.StructField("x", T.ArrayType(T.DoubleType())), dense)


def path_features(nodes: DataFrame, shared, params: DataFrame, max_steps: int = C.MAX_STEPS) -> DataFrame:
    """``path_vectors`` as the sparse Spark ML vector ``features``, for fits: padding, missing classes and the
    smallest place of each term are zeros, most of the places on ordinary paths."""
    def sparse(x):
        n, width = x.shape
        flat, counts = x.reshape(-1), np.count_nonzero(x, axis=1)
        at = np.flatnonzero(flat)
        place = (at - np.repeat(np.arange(n) * width, counts)).astype(np.int32)
        ends = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
        lists = [pa.ListArray.from_arrays(ends, v) for v in (place, flat[at])]
        return pa.StructArray.from_arrays([pa.array(np.zeros(n, np.int8)), pa.array(np.full(n, width, np.int32)), *lists],
                                          names=["type", "size", "indices", "values"])
    return _path_inputs(nodes, shared, params, max_steps, T.StructField("features", VectorUDT()), sparse)


def _path_inputs(nodes: DataFrame, shared, params: DataFrame, max_steps: int, out: T.StructField, emit) -> DataFrame:
    """``nodes`` with ``out``, which ``emit`` makes of a batch's rows x (steps * 62) numbers, in place of the step columns."""
    ml, sl, mp, sp = normalisation(params)
    keep = [c for c in nodes.columns if c not in ("step_tag", "step_class", "step_pos")]
    d, width = C.EMBED_DIM, C.STEP_WIDTH

    def run(batches):
        memo = kept_memo(shared, "vectors", lambda e: e.vector)
        for b in (whole.slice(at, BATCH_NODES) for whole in batches for at in range(0, whole.num_rows, BATCH_NODES)):
            n = b.num_rows
            x = np.zeros((n, max_steps, width))
            x[:, :, 2 * d], x[:, :, 2 * d + 1] = -ml / sl, -mp / sp
            for at, kind, name in ((0, "tag", "step_tag"), (d, "class", "step_class")):
                steps = b.column(b.schema.get_field_index(name))
                lens = pc.list_value_length(steps).to_numpy(zero_copy_only=False).astype(np.int64)
                codes = pc.list_flatten(steps).dictionary_encode()
                if not len(codes):
                    continue
                table = np.array([memo(kind, t) for t in codes.dictionary.to_pylist()])
                row = np.repeat(np.arange(n), lens)
                step = np.arange(len(row)) - np.repeat(np.cumsum(lens) - lens, lens)
                x[row, step, at:at + d] = table[codes.indices.to_numpy()]
                if at == 0:
                    for col, m, s, slot in (("text_len", ml, sl, 2 * d), ("punct", mp, sp, 2 * d + 1)):
                        z = (b.column(b.schema.get_field_index(col)).to_numpy(zero_copy_only=False).astype(float) - m) / s
                        x[row, step, slot] = z[row]
            made = emit(x.reshape(n, max_steps * width))
            yield pa.RecordBatch.from_arrays([*[b.column(b.schema.get_field_index(c)) for c in keep], made], names=[*keep, out.name])
    return nodes.mapInArrow(run, T.StructType([*[nodes.schema[c] for c in keep], out]))


def path_sums(shared, weights: np.ndarray):
    """A UDF ``(tag, class_name, parent, depth) -> array<double>``: for each event of a page row the
    weighted tag and class values along its kept path.

    ``weights`` (steps x 62) are a linear model's. A term's 30 values at step k
    then count as one number, so a term is a row of ``steps`` numbers, and an
    event's sum is its parent's plus its own number at its depth: one addition
    for each event, no vector.
    """
    d, steps = C.EMBED_DIM, len(weights)
    parts = {"tag": np.ascontiguousarray(weights[:, :d]), "class": np.ascontiguousarray(weights[:, d:2 * d])}
    use = "sums" + hashlib.md5(weights.tobytes()).hexdigest()

    def run(tag: pa.Array, class_name: pa.Array, parent: pa.Array, depth: pa.Array) -> pa.Array:
        memo = kept_memo(shared, use, lambda e: lambda kind, term: (parts[kind] @ e.vector(kind, term)).tolist())

        def page(tags, classes, parents, depths):
            sums = []
            for t, c, p, k in zip(tags, classes, parents, depths):
                s = 0.0 if p is None else sums[p]
                sums.append(s + memo("tag", t)[k - 1] + memo("class", c)[k - 1] if k <= steps else s)
            return sums
        return by_slices(lambda *rows: [page(*r) for r in zip(*rows)], pa.list_(pa.float64()), tag, class_name, parent, depth)
    # not deterministic for the optimiser, as the fold: evaluated once for each page
    return F.arrow_udf(run, T.ArrayType(T.DoubleType())).asNondeterministic()
