"""End-to-end jobs on the test tables: training set, cross-validation, scoring
and page bodies (E-08, T-02, T-06, T-07).

Plan: narrow clean/fold -> gold join per page (hot documents salted) ->
labels in the page row -> non-empty node rows -> stratified folds (bucket
repartition, one written table) -> term vectors written once, the most used
broadcast -> written training matrix, equal rows of a page as one with their
number -> Spark ML fits -> scores and bodies in the page row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagesift.config import Options
from pagesift.operators import bodies as B
from pagesift.operators import features as FE
from pagesift.operators import folds as FO
from pagesift.operators import metrics as M
from pagesift.operators import model as MD
from pagesift.operators import vocab as V
from pagesift.plans import queries as Q
from pagesift.session import ensure_checkpoint_dir, materialize
from pagesift.sources.io import spread

OPTS = Options()


def vectors_for(nodes: DataFrame, pages: DataFrame, opts: Options = OPTS, of: DataFrame | None = None,
                make=FE.path_vectors) -> tuple[DataFrame, DataFrame]:
    """Model vectors of ``nodes`` (needs step_tag/step_class), or of the rows ``of`` made from them, and the
    norm parameters of ``nodes``. ``make``: ``path_vectors`` (``x``) or ``path_features`` (sparse ``features``).

    The used terms, embedded once, are written with their uses; those used most
    are broadcast, and the vectors are a narrow projection over the nodes.
    """
    chars = None
    if opts.embedding == "w2v":
        chars = FE.trained_characters(V.w2v_char_vectors(materialize(V.vocab_terms(pages), "vocab"), opts.seed))
    table = materialize(FE.embedded(FE.term_uses(nodes), chars), "term-vectors")
    params = materialize(FE.norm_params(nodes, opts.max_steps), "params")
    return make(nodes if of is None else of, FE.embedding(nodes.sparkSession, table, chars, opts), params, opts.max_steps), params


def training_matrix(spark: SparkSession, sf: str, opts: Options = OPTS) -> DataFrame:
    """E-08: labelled non-empty nodes with folds and ``features``, sparse and written once."""
    folded = _folded(spark, sf, opts)
    vec, _ = vectors_for(folded, Q._pages(spark, sf), opts, make=FE.path_features)
    return materialize(vec, "matrix")


def _folded(spark: SparkSession, sf: str, opts: Options) -> DataFrame:
    return _with_folds(Q.labelled_nodes(spark, sf), opts)


def _with_folds(nodes: DataFrame, opts: Options, *columns: str) -> DataFrame:
    """``nodes`` with their folds; of their columns only ``columns``, if any are named."""
    ensure_checkpoint_dir(nodes.sparkSession)
    nodes = FE.apply_scope(nodes, opts)
    if columns:
        nodes = nodes.select(*columns)
    return spread(FO.stratified_folds(nodes, "label", ("page_id", "pos"), opts))  # written once inside


def _fold_predictions(nodes: DataFrame, pages: DataFrame, opts: Options, *keep: str) -> tuple[DataFrame, DataFrame]:
    """Every labelled node as each fold's model sees it, and the nodes with their folds and ``keep``: fitted and
    scored on the distinct rows of ``training_matrix``, about half as many as nodes. Nodes go through the shuffle
    of their folds with what the vectors are made of, not with every column."""
    folded = _with_folds(nodes, opts, "page_id", "pos", "label", "depth", "text_len", "punct", "step_tag", "step_class", *keep)
    vec, _ = vectors_for(folded, pages, opts, FE.distinct_inputs(folded, "fold"), FE.path_features)
    return MD.fold_predictions(materialize(vec, "matrix"), opts), folded


def _cross_validated(spark: SparkSession, sf: str, opts: Options) -> DataFrame:
    return M.fold_report(_fold_predictions(Q.labelled_nodes(spark, sf), Q._pages(spark, sf), opts)[0])


def cv_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """T-02/A-13: 4-fold cross-validation report."""
    return _cross_validated(spark, sf, OPTS)


def cv_metrics_grouped(spark: SparkSession, sf: str) -> DataFrame:
    """T-02/A-13 with whole pages in a fold, dealt by their label counts; beside ``cv_metrics`` it shows how
    much of that score comes from nodes of one page on both sides."""
    return _cross_validated(spark, sf, Options(fold_group="page_id"))


def _fitted(spark: SparkSession, sf: str):
    """``BodyExtractor`` fitted on the pages with gold, and all usable page rows (label null without gold): the
    pages are cleaned and folded once, for the fit and for what is scored."""
    from pagesift.plans.extractor import BodyExtractor
    pages, ex = Q._pages(spark, sf), BodyExtractor()
    rows = materialize(ex.labelled_rows(pages, Q._docs(spark, sf), how="left"), "labelled-rows")
    return ex.fit_rows(rows.filter(F.col("label").isNotNull()), pages), rows


def scored_nodes(spark: SparkSession, sf: str) -> DataFrame:
    """T-06 + S-13: every non-empty node of every usable page with probability, model decision and
    final decision (fit on all labelled nodes); label and fold are null on pages without gold."""
    ex, rows = _fitted(spark, sf)
    scored = ex.score_rows(rows, "label")
    folded = FO.stratified_folds(scored.filter(F.col("label").isNotNull()), "label", ("page_id", "pos"), OPTS)
    rest = scored.filter(F.col("label").isNull()).withColumn("fold", F.lit(None).cast("int"))
    return folded.unionByName(rest).select(
        "page_id", "pos", "label", "fold", F.round("prob", 6).alias("prob"), "pred", "accept", "content")


def out_of_fold(spark: SparkSession, sf: str) -> DataFrame:
    """T-06: every labelled node with the probability and decisions of the model that has not seen its page."""
    return _out_of_fold(Q.labelled_nodes(spark, sf), Q._pages(spark, sf))


def _out_of_fold(nodes: DataFrame, pages: DataFrame) -> DataFrame:
    seen, nodes = _fold_predictions(nodes, pages, Options(fold_group="page_id"), "content")
    seen = seen.filter("held_out").join(nodes.select("page_id", "pos", "content"), ["page_id", "pos"])
    return B.apply_rules(seen).select("page_id", "pos", "label", "fold", F.round("prob", 6).alias("prob"), "pred", "accept", "content")


def extracted_bodies(spark: SparkSession, sf: str) -> DataFrame:
    """T-07/T-08: the main body of every usable page: fitted on the pages with gold, then one pass over the
    page rows, which ends in the body without a shuffle."""
    ex, rows = _fitted(spark, sf)
    return ex.bodies_of_rows(rows)


def page_bodies(spark: SparkSession, sf: str) -> DataFrame:
    """T-07/T-08: ``extracted_bodies`` under the name that earlier benches have."""
    return extracted_bodies(spark, sf)


def out_of_fold_bodies(spark: SparkSession, sf: str) -> DataFrame:
    """T-07 out of fold: the body of every usable page from a model that has not seen it, i.e. for a page with
    gold that of its fold, for any other the one fitted on all pages with gold."""
    ex, rows = _fitted(spark, sf)
    nodes = FE.nonempty_nodes(rows.filter(F.col("label").isNotNull()), with_label=True, max_steps=OPTS.max_steps)  # folded once for both
    seen = _out_of_fold(nodes, Q._pages(spark, sf))
    return B.assemble(seen).unionByName(ex.bodies_of_rows(rows.filter(F.col("label").isNull())))


def w2v_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """E-06: trained character Word2Vec term vectors (kind, term, vector) of the tag and class vocabularies."""
    voc = materialize(V.vocab_terms(Q._pages(spark, sf)), "vocab")
    return V.w2v_term_vectors(voc, materialize(V.w2v_char_vectors(voc), "char-vectors"))


ROWS_ONLY = {
    "w2v_vectors": w2v_vectors,
    "cv_metrics": cv_metrics,
    "cv_metrics_grouped": cv_metrics_grouped,
    "scored_nodes": scored_nodes,
    "out_of_fold": out_of_fold,
    "out_of_fold_bodies": out_of_fold_bodies,
    "page_bodies": page_bodies,
    "extracted_bodies": extracted_bodies,
}
