"""Registered queries: name -> f(spark, sf_dir) -> DataFrame.

Every query reads the given parquet tables and runs over all rows. Integer
outputs are BIGINT and reals are rounded to 6 decimals so the DuckDB
oracle (``oracle_queries``) can compare values exactly.
"""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagesift import config as C
from pagesift.config import Options
from pagesift.functions import text as X
from pagesift.operators import bodies as B
from pagesift.operators import dom as D
from pagesift.operators import features as FE
from pagesift.operators import folds as FO
from pagesift.operators import labels as LB
from pagesift.operators import metrics as M
from pagesift.operators import vocab as V
from pagesift.session import materialize
from pagesift.sources.io import read_table

OPTS = Options()


def _pages(spark, sf):
    return read_table(spark, sf, "pages")


def _docs(spark, sf):
    return read_table(spark, sf, "documents")


def _events(spark, sf, full_paths: bool = False) -> DataFrame:
    return D.page_events(D.clean_pages(_pages(spark, sf)), OPTS, full_paths)


def r6(c):
    return F.round(c.cast("double"), 6)


def big(c):
    return c.cast("bigint")


# --------------------------------------------------------------------------- queries
def q_page_clean_len(spark, sf):
    c = D.clean_pages(_pages(spark, sf))
    return c.select(big(F.col("page_id")).alias("page_id"), big(F.length("html")).alias("n"))


def q_page_gate(spark, sf):
    c = D.clean_pages(_pages(spark, sf))
    return c.select("page_id", big(F.col("visible_len")).alias("visible_len"), "status")


def q_quarantine(spark, sf):
    return D.quarantine(D.clean_pages(_pages(spark, sf)))


def q_tag_vocab(spark, sf):
    return V.tag_vocab(_pages(spark, sf)).select("term", big(F.col("pages")).alias("pages"), big(F.col("uses")).alias("uses"))


def q_class_vocab(spark, sf):
    return V.class_vocab(_pages(spark, sf)).select("term", big(F.col("uses")).alias("uses"))


def q_raw_tokens(spark, sf):
    t = D.tokens(D.clean_pages(_pages(spark, sf)))
    tag = rf"^(?:{C.START_TAG_RE}|{C.END_TAG_RE})\z"
    tags = F.size(F.filter("toks", lambda x: x.rlike(tag)))
    text = F.size(F.filter("toks", lambda x: ~x.rlike(rf"^(?:{C.TAG_OR_DECL_RE})\z")))
    return t.select("page_id", big(tags).alias("n_tags"), big(text).alias("n_text"))


def q_events(spark, sf):
    ev = D.path_strings(_events(spark, sf, full_paths=True))
    z = F.arrays_zip("kind", "name", "path")
    return ev.select("page_id", F.posexplode(z).alias("pos", "e")).select(
        "page_id", big(F.col("pos")).alias("pos"), "e.kind", "e.name", "e.path")


def q_parents(spark, sf):
    n = D.nodes(_events(spark, sf))
    return n.select("page_id", big(F.col("pos")).alias("pos"), big(F.col("parent_pos")).alias("parent_pos"))


def q_parents_search(spark, sf):
    """J-02 by backward search (window form); must equal ``parents``."""
    p = D.parents_by_search(_events(spark, sf, full_paths=True))
    return p.select("page_id", big(F.col("pos")).alias("pos"), big(F.col("parent_pos")).alias("parent_pos"))


def q_node_content(spark, sf):
    n = D.explode_nodes(_events(spark, sf))
    return n.select("page_id", big(F.col("pos")).alias("pos"), "content")


def _nonempty(spark, sf, with_label=False, rows=None):
    return FE.nonempty_nodes(rows if rows is not None else _events(spark, sf), with_label=with_label,
                             max_steps=OPTS.max_steps)


def q_nonempty_nodes(spark, sf):
    n = _nonempty(spark, sf)
    return n.select("page_id", big(F.col("pos")).alias("pos"), big(F.col("idx")).alias("idx"),
                    big(F.length("content")).alias("n"))


def q_closure(spark, sf):
    n = _nonempty(spark, sf, rows=_events(spark, sf, full_paths=True))
    return n.select("page_id", "pos", F.posexplode(F.concat("anc_pos", F.array("pos"))).alias("step", "anc")) \
            .select("page_id", big(F.col("pos")).alias("pos"), big(F.col("step")).alias("step"),
                    big(F.col("anc")).alias("anc_pos"))


def q_truncated_paths(spark, sf):
    n = _nonempty(spark, sf)
    return n.select("page_id", big(F.col("pos")).alias("pos"), big(F.col("depth")).alias("depth"),
                    big(F.size("step_pos")).alias("kept"))


def q_max_depth(spark, sf):
    ev = _events(spark, sf)
    kept = F.expr(f"array_max(transform(filter(arrays_zip(depth, content), e -> e.content <> ''),"
                  f" e -> least(e.depth, {OPTS.max_steps})))")
    return ev.select("page_id", big(kept).alias("d")).filter(F.col("d").isNotNull())


def q_page_features(spark, sf):
    ev = _events(spark, sf)
    return ev.select("page_id", big(F.col("text_len")).alias("text_len"), big(F.col("punct")).alias("punct"))


def q_node_features(spark, sf):
    n = D.explode_nodes(_events(spark, sf))
    f = FE.node_features(n, OPTS)
    return f.select("page_id", big(F.col("pos")).alias("pos"), "tag", "class_name", "text_len", "punct")


def q_page_gold(spark, sf):
    j = LB.join_gold(_pages(spark, sf), _docs(spark, sf))
    return j.select("page_id", "doc_id", "lang", "gold_len")


def q_gold_missing(spark, sf):
    return LB.gold_missing(_pages(spark, sf), _docs(spark, sf))


def labelled_rows(spark, sf) -> DataFrame:
    """Usable pages with gold: event arrays + ``label`` array + ``lang``; the gold
    join comes after the narrow clean/fold."""
    raw = _pages(spark, sf)
    pages = LB.pages_with_doc(raw).select("page_id", "url", "html", "doc_id")
    ev = D.page_events(D.clean_pages(pages), OPTS)
    hot = LB.hot_docs(raw, OPTS.hot_key_rows)
    return LB.label_page_rows(ev, _docs(spark, sf), hot, OPTS.hot_key_buckets)


def labelled_nodes(spark, sf) -> DataFrame:
    return FE.nonempty_nodes(labelled_rows(spark, sf), "lang", with_label=True, max_steps=OPTS.max_steps)


def q_labels(spark, sf):
    n = labelled_nodes(spark, sf)
    return n.select("page_id", big(F.col("pos")).alias("pos"), big(F.col("label")).alias("label"))


def q_label_rate_by_lang(spark, sf):
    n = labelled_nodes(spark, sf)
    return n.groupBy("lang").agg(big(F.count("*")).alias("n"), big(F.sum("label")).alias("pos"))


def folded_nodes(spark, sf) -> DataFrame:
    n = labelled_nodes(spark, sf)
    return FO.stratified_folds(n, "label", ("page_id", "pos"), OPTS)


def q_folds(spark, sf):
    f = folded_nodes(spark, sf)
    return f.select("page_id", big(F.col("pos")).alias("pos"), big(F.col("label")).alias("label"),
                    big(F.col("fold")).alias("fold"))


def q_fold_weights(spark, sf):
    w = FO.fold_weights(folded_nodes(spark, sf), OPTS)
    return w.select(big(F.col("fold")).alias("fold"), big(F.col("n_pos")).alias("n_pos"),
                    big(F.col("n_neg")).alias("n_neg"), r6(F.col("pos_weight")).alias("pos_weight"))


def _vocab_terms(spark, sf) -> DataFrame:
    return V.vocab_terms(_pages(spark, sf))


def q_hash_vectors(spark, sf):
    hv = V.hash_vectors(_vocab_terms(spark, sf), ("kind", "term"))
    return hv.select("kind", "term", big(F.col("dim")).alias("dim"), r6(F.col("value")).alias("value"))


def q_minmax_vectors(spark, sf):
    mm = V.minmax_vectors(V.hash_vectors(_vocab_terms(spark, sf), ("kind", "term")), ("kind", "term"))
    return mm.select("kind", "term", big(F.col("dim")).alias("dim"), r6(F.col("value")).alias("value"))


def q_vocab_misses(spark, sf):
    """J-06 in one pass over the node rows: (kind, term) pairs absent from the vocabularies."""
    n = D.explode_nodes(_events(spark, sf))
    used = n.select(F.explode(F.array(F.struct(F.lit("tag").alias("kind"), F.col("tag").alias("term")),
                                      F.struct(F.lit("class").alias("kind"), F.col("class_name").alias("term")))).alias("k"))
    used = used.select("k.*").filter(F.col("term") != "").distinct()
    return used.join(_vocab_terms(spark, sf), ["kind", "term"], "left_anti")


def q_norm_params(spark, sf):
    p = FE.norm_params_rows(_events(spark, sf), OPTS)
    return p.select(*[r6(F.col(c)).alias(c) for c in ("text_length_mean", "text_length_std",
                                                       "punctuation_nb_mean", "punctuation_nb_std")],
                    big(F.col("n_nodes")).alias("n_nodes"), big(F.col("t_steps")).alias("t_steps"))


def q_zscores(spark, sf):
    # two passes (global statistics, then per node): the nodes are written once
    n = materialize(_nonempty(spark, sf), "zscore-nodes")
    p = FE.norm_params(n, OPTS.max_steps)
    j = n.crossJoin(F.broadcast(p))  # one row
    zl = FE.zscore(F.col("text_len").cast("double"), F.col("text_length_mean"), F.col("text_length_std"))
    zp = FE.zscore(F.col("punct").cast("double"), F.col("punctuation_nb_mean"), F.col("punctuation_nb_std"))
    return j.select("page_id", "pos", F.posexplode("step_pos").alias("step", "a"), zl.alias("zl"), zp.alias("zp")) \
            .select("page_id", big(F.col("pos")).alias("pos"), big(F.col("step")).alias("step"),
                    r6(F.col("zl")).alias("zl"), r6(F.col("zp")).alias("zp"))


def q_length_rules(spark, sf):
    n = _nonempty(spark, sf)
    d = F.expr(B.rule_sql("content", "CAST(NULL AS INT)"))
    return n.select("page_id", big(F.col("pos")).alias("pos"), big(d).alias("decision"))


def q_script_family(spark, sf):
    return B.script_family(_events(spark, sf))


def q_rule_f1(spark, sf):
    n = labelled_nodes(spark, sf)
    pred = F.expr(B.rule_sql("content", "0"))
    n = n.withColumn("pred", pred)
    return n.rollup("lang").agg(r6(M.f1_expr(F.col("label"), F.col("pred"))).alias("f1"))


def q_rule_loss(spark, sf):
    f = folded_nodes(spark, sf)
    w = FO.fold_weights(f, OPTS)
    d = F.expr(B.rule_sql("content", "CAST(NULL AS INT)"))
    prob = F.when(d == 1, 0.99).when(d == 0, 0.01).otherwise(0.5)
    j = f.join(F.broadcast(w.select("fold", "pos_weight")), "fold")  # n_folds rows
    return j.groupBy("fold").agg(r6(M.bce_expr(F.col("label"), prob, F.col("pos_weight"))).alias("loss")) \
            .select(big(F.col("fold")).alias("fold"), "loss")


def q_rule_bodies(spark, sf):
    return B.rule_bodies(_events(spark, sf))


def q_term_vectors(spark, sf):
    """J-04/J-05/E-05/S-16: the vectors of all terms on the nodes' paths, vocabulary terms min-max normalised."""
    used = materialize(FE.term_uses(_nonempty(spark, sf)).select("kind", "term"), "used-terms")
    v = V.kind_term_vectors(used, _vocab_terms(spark, sf))
    return v.select("kind", "term", F.posexplode("vector").alias("dim", "value")).select(
        "kind", "term", big(F.col("dim")).alias("dim"), r6(F.col("value")).alias("value"))


def q_step_vectors(spark, sf):
    """S-08: the terms' vectors as a path step holds them."""
    used = materialize(FE.term_uses(_nonempty(spark, sf)).select("kind", "term"), "used-terms")
    v = FE.step_normalised(V.kind_term_vectors(used, _vocab_terms(spark, sf)))
    return v.select("kind", "term", F.posexplode("vector").alias("dim", "value")).select(
        "kind", "term", big(F.col("dim")).alias("dim"), r6(F.col("value")).alias("value"))


#: Weights that tell all 15 x 62 places of a model vector apart; the oracle states the same rule.
CHECK_WEIGHTS = (np.arange(C.MAX_STEPS * C.STEP_WIDTH) * 7 % 11 - 5).reshape(C.MAX_STEPS, C.STEP_WIDTH) / 10
CHECK_INTERCEPT = 0.25


def _vector_inputs(spark, sf):
    """Page rows, their nodes and parameters, and the terms' broadcast; page rows are written once."""
    rows = materialize(_events(spark, sf), "page-rows")
    nodes = FE.nonempty_nodes(rows, max_steps=OPTS.max_steps)
    table = materialize(FE.embedded(FE.term_uses(nodes)), "term-vectors")
    return rows, nodes, materialize(FE.norm_params_rows(rows, OPTS), "params"), FE.embedding(spark, table, None, OPTS)


def q_path_vectors(spark, sf):
    """E-02/E-03/E-10/S-08/S-14/S-15: the model vector of every node, as scalar products of its tag, class and
    number places with fixed weights."""
    _, nodes, params, shared = _vector_inputs(spark, sf)
    x = FE.path_vectors(nodes, shared, params, OPTS.max_steps)
    d = C.EMBED_DIM

    def part(places):
        w = np.zeros_like(CHECK_WEIGHTS)
        w[:, places] = CHECK_WEIGHTS[:, places]
        weights = F.lit(w.reshape(-1).tolist())
        return r6(F.aggregate(F.zip_with("x", weights, lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b))
    return x.select("page_id", big(F.col("pos")).alias("pos"), part(slice(0, d)).alias("tags"), part(slice(d, 2 * d)).alias("classes"),
                    part(slice(2 * d, None)).alias("numbers"))


def q_path_scores(spark, sf):
    """T-06/S-12/S-13 in the page row: scores of a linear model with fixed weights, decisions and all."""
    rows, _, params, shared = _vector_inputs(spark, sf)
    scored = B.score_page_rows(rows, FE.path_sums(shared, CHECK_WEIGHTS), CHECK_WEIGHTS, CHECK_INTERCEPT, FE.normalisation(params), OPTS)
    return scored.select("page_id", F.inline("nodes")).select(
        "page_id", big(F.col("pos")).alias("pos"), r6(F.col("prob")).alias("prob"), big(F.col("pred")).alias("pred"),
        big(F.col("accept")).alias("accept"))


def q_fold_report(spark, sf):
    """A-13/T-04 on the length rules' score: every fold's losses, F1 and weight, and their means."""
    f = folded_nodes(spark, sf)
    w = FO.fold_weights(f, OPTS).withColumnRenamed("fold", "other")  # n_folds rows
    d = F.expr(B.rule_sql("content", "CAST(NULL AS INT)"))
    seen = f.select("label", F.col("fold").alias("own"), F.when(d == 1, 0.99).when(d == 0, 0.01).otherwise(0.5).alias("prob"),
                    F.explode(F.sequence(F.lit(0), F.lit(OPTS.n_folds - 1))).alias("other"))
    seen = seen.join(F.broadcast(w.select("other", "pos_weight")), "other").select(
        F.col("other").alias("fold"), (F.col("own") == F.col("other")).alias("held_out"), "label", "prob",
        (F.col("prob") > 0.5).cast("int").alias("pred"), "pos_weight")
    r = M.fold_report(seen)
    return r.select(big(F.col("fold")).alias("fold"), *[r6(F.col(c)).alias(c) for c in ("train_loss", "val_loss", "f1", "pos_weight")],
                    big(F.col("n_val")).alias("n_val"))


def q_page_folds(spark, sf):
    """W-03 with whole pages: pages dealt to folds by their label counts."""
    g = FO.group_folds(labelled_nodes(spark, sf).select("page_id", "label"), opts=Options(fold_group="page_id"))
    return g.select("page_id", big(F.col("n_pos")).alias("n_pos"), big(F.col("n_rows")).alias("n_rows"), big(F.col("fold")).alias("fold"))


def q_gold_lines(spark, sf):
    """IO-04/IO-05/W-05: the documents printed as gold lines, twice, read again; the first source's lines win."""
    from pagesift.session import ensure_checkpoint_dir
    from pagesift.sources import io
    paths = [f"{ensure_checkpoint_dir(spark).rstrip('/')}/pagesift-gold-{uuid.uuid4().hex}" for _ in range(2)]
    for path, name in zip(paths, ("first", "second")):
        io.write_gold_lines(_docs(spark, sf), path, website=name)
    return io.first_gold_per_key(io.read_gold_lines(spark, *paths))


def q_vectors_csv(spark, sf):
    """IO-06/IO-07: the vocabulary job's CSV tables, read again."""
    from pagesift.plans.extractor import vocabulary_job
    from pagesift.session import ensure_checkpoint_dir
    from pagesift.sources import io
    out = f"{ensure_checkpoint_dir(spark).rstrip('/')}/pagesift-csv-{uuid.uuid4().hex}"
    vocabulary_job(_pages(spark, sf), out)
    both = [io.read_vectors_csv(spark, f"{out}/{name}", key).withColumn("kind", F.lit(kind))
            for kind, name, key in (("tag", "tag_vectors", "tag"), ("class", "class_name_vectors", "classname"))]
    v = both[0].unionByName(both[1]).select("kind", "term", F.posexplode("vector").alias("dim", "value"))
    return v.select("kind", "term", big(F.col("dim")).alias("dim"), r6(F.col("value")).alias("value"))


# --------------------------------------------------------------------------- pages with what the tables lack
def _edge_pages(spark, sf) -> DataFrame:
    """Every page, changed by its id: cut short, without html element, with CJK text, with classes and quoted
    '>', with a foreign key, or null."""
    h, kind = F.col("html"), F.col("page_id") % 6
    html = (F.when(kind == 0, F.substring(h, 1, 80)).when(kind == 1, F.replace(h, F.lit("<html"), F.lit("<div")))
            .when(kind == 2, F.replace(h, F.lit("the"), F.lit("中文")))
            .when(kind == 3, F.replace(h, F.lit("<p>"), F.concat(F.lit("<p title=\"x > y\" class='k"), (F.col("page_id") % 5).cast("string"), F.lit("  b'>"))))
            .when(kind == 4, h))
    url = F.when(kind == 4, F.concat(F.lit("http://x.example/en/9"), F.col("page_id") + 1_000_000)).otherwise(F.col("url"))
    return _pages(spark, sf).select("page_id", url.alias("url"), html.alias("html"))


def _edge_events(spark, sf):
    return D.page_events(D.clean_pages(_edge_pages(spark, sf)), OPTS)


def q_edge_quarantine(spark, sf):
    """L-08/L-09 on pages of which a third are unusable."""
    return D.quarantine(D.clean_pages(_edge_pages(spark, sf)))


def q_edge_gold_missing(spark, sf):
    return LB.gold_missing(_edge_pages(spark, sf), _docs(spark, sf))


def q_edge_class_vocab(spark, sf):
    return V.class_vocab(_edge_pages(spark, sf)).select("term", big(F.col("uses")).alias("uses"))


def q_edge_script_family(spark, sf):
    return B.script_family(_edge_events(spark, sf))


def q_edge_length_rules(spark, sf):
    """S-09/S-13 with both branches of the rules."""
    n = FE.nonempty_nodes(_edge_events(spark, sf), max_steps=OPTS.max_steps)
    d = F.expr(B.rule_sql("content", "CAST(NULL AS INT)"))
    return n.select("page_id", big(F.col("pos")).alias("pos"), big(d).alias("decision"))


QUERIES = {name[2:]: fn for name, fn in dict(globals()).items() if name.startswith("q_")}
