"""Fit once, extract bodies from any pages (E-04, E-07, E-09, T-07, T-08, IO-09, IO-10, IO-12).

``BodyExtractor.fit(pages, documents)`` learns from pages with a known body
text; ``transform(pages)`` needs only the pages. The fitted state is small:
the two vocabularies, the fitted term vectors, the one-row normalisation parameters and the
Spark ML model; ``save``/``load`` write them as parquet and ML folders.

``extract_bodies(pages, registry)`` routes every page to the extractor of
its script family ('zh' when a node text holds a CJK ideograph, else 'la');
pages whose family has no extractor go to a quarantine table.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagesift.config import Options
from pagesift.operators import bodies as B
from pagesift.operators import dom as D
from pagesift.operators import features as FE
from pagesift.operators import folds as FO
from pagesift.operators import labels as LB
from pagesift.operators import model as MD
from pagesift.operators import vocab as V
from pagesift.functions import text as X
from pagesift.session import materialize

ExtraFeature = tuple[str, Callable[[], Column]]


def page_rows(pages: DataFrame, opts: Options = Options()) -> DataFrame:
    """E-04: usable pages as event-array rows (other input columns are carried)."""
    return D.page_events(D.clean_pages(pages), opts)


def with_validation_split(df: DataFrame, share: float = 0.1, seed: int = 42,
                          col: str = "is_val") -> DataFrame:
    """T-05 helper: a deterministic per-page hold-out flag for early stopping."""
    h = F.conv(F.substring(FO.fold_hash(seed + 1, "page_id"), 1, 7), 16, 10).cast("double")
    return df.withColumn(col, h / float(0xFFFFFFF) < share)


def gbt_with_early_stopping(max_iter: int = 30, tol: float = 0.01):
    """T-05: gradient-boosted trees that stop when the hold-out loss stops improving."""
    from pyspark.ml.classification import GBTClassifier
    return GBTClassifier(featuresCol="features", labelCol="label", weightCol="w", maxIter=max_iter,
                         validationIndicatorCol="is_val", validationTol=tol, seed=42)


@dataclass
class BodyExtractor:
    """Main-body extractor: path-sequence features, Spark ML classifier, length rules.

    ``extra_features`` (E-07/U-01) are ``(name, make_column)`` pairs evaluated on
    node rows (columns: content, tag, class_name, depth, text_len, punct, ...)
    and appended to the 15 x 62 path features; the vector width follows.
    """

    opts: Options = field(default_factory=Options)
    classifier: object | None = None
    extra_features: Sequence[ExtraFeature] = ()
    vocab: DataFrame | None = None
    char_vectors: DataFrame | None = None
    term_table: DataFrame | None = None
    params: DataFrame | None = None
    model: object | None = None
    pos_weight: float = 1.0
    _embedding: tuple | None = field(default=None, repr=False)

    # -- features ---------------------------------------------------------
    def _spark(self):
        return self.params.sparkSession

    def _shared(self):
        """The broadcast term vectors; made once for a fitted table."""
        table, chars = self.term_table, self.char_vectors
        if self._embedding is None or self._embedding[0] is not table:
            self._embedding = (table, FE.embedding(self._spark(), table, FE.trained_characters(chars), self.opts))
        return self._embedding[1]

    def _vectors(self, nodes: DataFrame) -> DataFrame:
        if not self.extra_features:
            return FE.path_features(nodes, self._shared(), self.params, self.opts.max_steps)
        vec = FE.path_vectors(nodes, self._shared(), self.params, self.opts.max_steps)
        extra = F.array(*[make().cast("double").alias(name) for name, make in self.extra_features])
        return MD.with_features(vec.withColumn("x", F.concat("x", extra)))

    def _fitted_terms(self, nodes: DataFrame) -> DataFrame:
        """Step-normalised vectors of the fitted vocabulary, end-tag terms, the empty class and
        all other terms of the labelled nodes, each embedded once, with their uses on these nodes."""
        voc = self.vocab
        ends = voc.filter(F.col("kind") == "tag").select("kind", F.concat(F.lit("/"), "term").alias("term"))
        terms = voc.select("kind", "term").unionByName(ends).withColumn("uses", F.lit(0).cast("bigint")).unionByName(FE.term_uses(nodes))
        terms = terms.groupBy("kind", "term").agg(F.sum("uses").alias("uses"))
        return FE.embedded(terms, FE.trained_characters(self.char_vectors))

    # -- fit / transform --------------------------------------------------
    def labelled_rows(self, pages: DataFrame, gold: DataFrame, page_key: Column | None = None, gold_key: str = "doc_id",
                      gold_text: str = "text", how: str = "inner") -> DataFrame:
        """E-08: usable pages as event rows with their labels by ``gold``; ``page_key`` (a column over
        ``pages``) meets ``gold_key``."""
        keyed = LB.pages_with_doc(pages, page_key).select("page_id", "url", "html", "doc_id")
        return LB.label_page_rows(page_rows(keyed, self.opts), LB.gold_table(gold, gold_key, gold_text),
                                  LB.hot_docs(pages, self.opts.hot_key_rows, page_key), self.opts.hot_key_buckets, how)

    def fit(self, pages: DataFrame, documents: DataFrame, page_key: Column | None = None, gold_key: str = "doc_id",
            gold_text: str = "text") -> "BodyExtractor":
        """E-08 + T-01: label the pages against their gold text and fit the classifier."""
        return self.fit_rows(self.labelled_rows(pages, documents, page_key, gold_key, gold_text), pages)

    def fit_rows(self, rows: DataFrame, pages: DataFrame) -> "BodyExtractor":
        """Fit on labelled page rows; the vocabulary is that of ``pages``."""
        nodes = FE.apply_scope(FE.nonempty_nodes(rows, with_label=True, max_steps=self.opts.max_steps), self.opts)
        if not self.extra_features:  # a feature hook may ask for any column
            nodes = nodes.select("page_id", "pos", "label", "depth", "text_len", "punct", "step_tag", "step_class")
        nodes = materialize(nodes, "fit-nodes")
        self.vocab = materialize(V.vocab_terms(pages), "vocab")
        if self.opts.embedding == "w2v":
            self.char_vectors = materialize(V.w2v_char_vectors(self.vocab, self.opts.seed), "char-vectors")
        self.params = materialize(FE.norm_params(nodes, self.opts.max_steps), "params")
        self.term_table = materialize(self._fitted_terms(nodes), "fitted-terms")
        if isinstance(self.classifier, MD.ExternalModel):
            self.model, self.pos_weight = MD.fit(nodes, self.opts, self.classifier)
            return self
        alike = not self.extra_features and MD.weighs_rows(self.classifier)
        vectors = self._vectors(FE.distinct_inputs(nodes).drop("at") if alike else nodes)
        # written, not cached: the classifier caches blocks of its own
        train = materialize(vectors.select("page_id", "pos", "label", *(["copies"] if alike else []), "features"), "fit-vectors")
        if self.classifier is not None and self.classifier.hasParam("validationIndicatorCol") \
                and self.classifier.isSet("validationIndicatorCol"):
            train = with_validation_split(train)
        self.model, self.pos_weight = MD.fit(train, self.opts, self.classifier)
        return self

    def scored_rows(self, rows: DataFrame, *keep: str) -> DataFrame | None:
        """Page rows with their scored nodes, (page_id, keep..., nodes), in one narrow pass; None if the
        model is not a linear one over the path features."""
        linear = None if self.extra_features else MD.linear_weights(self.model, self.opts)
        if linear is None:
            return None
        intercept, weights = linear
        return B.score_page_rows(rows, FE.path_sums(self._shared(), weights), weights, intercept, FE.normalisation(self.params), self.opts, *keep)

    def score_nodes(self, pages: DataFrame) -> DataFrame:
        """T-06 + S-13 on pages without gold: (page_id, pos, content, prob, pred, accept).

        One narrow pass from pages to scores: of a linear model inside the page
        row, of any other from the nodes' vectors."""
        return self.score_rows(page_rows(pages.select("page_id", "url", "html"), self.opts))

    def score_rows(self, rows: DataFrame, *keep: str) -> DataFrame:
        """``score_nodes`` from already folded page rows (``page_rows`` output); ``keep`` may name ``label``,
        which then comes with each node."""
        scored = self.scored_rows(rows, *keep)
        if scored is not None:
            return scored.select("page_id", *[c for c in keep if c != "label"], F.inline("nodes"))
        return self.score_vectors(rows, *keep)

    def score_vectors(self, rows: DataFrame, *keep: str) -> DataFrame:
        """``score_rows`` through the nodes' vectors, for any classifier."""
        labelled = "label" in keep
        others = [c for c in keep if c != "label"]
        nodes = FE.apply_scope(FE.nonempty_nodes(rows, *others, with_label=labelled, max_steps=self.opts.max_steps), self.opts)
        out = self.model.transform(self._vectors(nodes))
        out = out.withColumn("prob", vector_to_array("probability")[1]).withColumn("pred", (F.col("prob") > 0.5).cast("int"))
        return B.apply_rules(out).select("page_id", *others, "pos", "content", "prob", "pred", "accept", *(["label"] if labelled else []))

    def bodies_of_rows(self, rows: DataFrame) -> DataFrame:
        """T-07 from folded page rows: inside the row for a linear model, else from one group per page."""
        scored = self.scored_rows(rows)
        return B.bodies_of(scored) if scored is not None else B.assemble(self.score_vectors(rows))

    def transform(self, pages: DataFrame) -> DataFrame:
        """T-07: (page_id, body) for every usable page with text."""
        return self.bodies_of_rows(page_rows(pages.select("page_id", "url", "html"), self.opts))

    # -- persistence (IO-09, IO-10) ----------------------------------------
    def save(self, path: str) -> None:
        self.vocab.write.mode("overwrite").parquet(f"{path}/vocab")
        self.params.write.mode("overwrite").parquet(f"{path}/params")
        self.model.write().overwrite().save(f"{path}/model")
        if self.char_vectors is not None:
            self.char_vectors.write.mode("overwrite").parquet(f"{path}/char_vectors")
        self.term_table.write.mode("overwrite").parquet(f"{path}/term_table")
        spark = self.params.sparkSession
        kind = type(self.model)
        spark.createDataFrame([(float(self.pos_weight), f"{kind.__module__}.{kind.__qualname__}")], "pos_weight double, model_class string") \
             .write.mode("overwrite").parquet(f"{path}/meta")

    @classmethod
    def load(cls, spark, path: str, opts: Options = Options(), model_cls=None) -> "BodyExtractor":
        ex = cls(opts=opts)
        ex.vocab = spark.read.parquet(f"{path}/vocab")
        ex.params = spark.read.parquet(f"{path}/params")
        meta = spark.read.parquet(f"{path}/meta").first()
        ex.model = model_cls.load(f"{path}/model") if model_cls else MD.load_model(f"{path}/model", meta["model_class"])
        ex.pos_weight = meta["pos_weight"]
        if opts.embedding == "w2v":
            ex.char_vectors = spark.read.parquet(f"{path}/char_vectors")
        ex.term_table = spark.read.parquet(f"{path}/term_table")
        return ex


def page_scripts(pages: DataFrame, opts: Options = Options()) -> DataFrame:
    """(page_id, script) for usable pages (IO-12 routing key)."""
    return B.script_family(page_rows(pages.select("page_id", "url", "html"), opts))


def _row_options(opts: Options) -> tuple:
    """Options that shape the page rows (node text and ancestors)."""
    return (opts.strip_latin1, opts.keep_whitespace, opts.max_steps)


def _with_status(pages: DataFrame, opts: Options) -> DataFrame:
    """All pages as event rows, the unusable ones with empty arrays and their ``status``."""
    return D.page_events(D.clean_pages(pages.select("page_id", "url", "html")), opts, keep_unusable=True)


def extract_bodies(pages: DataFrame, registry: dict[str, BodyExtractor]) -> tuple[DataFrame, DataFrame]:
    """T-08/IO-12: bodies from the extractor of each page's script family, plus a
    quarantine table (page_id, reason) of unusable pages (too short, no html) and
    of pages whose script family has no extractor.

    Pages are cleaned and folded once per distinct set of text options (normally once),
    tagged with their script family and status inside the row and written once; each
    extractor then scores its own subset of those rows, and the quarantine is read from them. The
    registry is a handful of fitted extractors, so the loop over it
    is a few Spark jobs, not a loop over data.
    """
    script = F.when(F.exists("content", X.has_cjk), F.lit("zh")).otherwise(F.lit("la"))
    rows_by_opts: dict[tuple, DataFrame] = {}
    out = None
    for name, ex in registry.items():
        key = _row_options(ex.opts)
        if key not in rows_by_opts:
            rows_by_opts[key] = materialize(_with_status(pages, ex.opts).withColumn("script", script), "routed-rows")
        mine = rows_by_opts[key].filter((F.col("script") == name) & (F.col("status") == "ok"))
        part = ex.bodies_of_rows(mine.drop("script", "status"))
        out = part if out is None else out.unionByName(part)
    first = next(iter(rows_by_opts.values()))
    reason = F.when(F.col("status") != "ok", F.col("status")) \
              .when(~F.col("script").isin(list(registry)), F.concat(F.lit("no model for script "), F.col("script")))
    return out, first.select("page_id", reason.alias("reason")).filter(F.col("reason").isNotNull())


def label_export_job(pages: DataFrame, documents: DataFrame, out_path: str | None = None, opts: Options = Options(),
                     page_key: Column | None = None, gold_key: str = "doc_id", gold_text: str = "text") -> DataFrame:
    """E-09: (page_id, idx, content, label) of non-empty nodes; optional TSV export (IO-08)."""
    rows = BodyExtractor(opts=opts).labelled_rows(pages, documents, page_key, gold_key, gold_text)
    lab = FE.nonempty_nodes(rows, with_label=True, max_steps=opts.max_steps).select(
        "page_id", "idx", "content", "label")
    if out_path:
        from pagesift.sources.io import write_labels_tsv
        write_labels_tsv(lab, out_path)
    return lab


def vocabulary_job(pages: DataFrame, out_dir: str | None = None, opts: Options = Options()) -> DataFrame:
    """SURVEY §3-D: corpus vocabularies -> term vectors (min-max normalised) ->
    optional CSV export as ``tag_vectors`` and ``class_name_vectors`` (IO-06),
    the latter with key '0' for "no class" (zeros). Returns (kind, term, vector)."""
    voc = materialize(V.vocab_terms(pages), "vocab")
    chars = materialize(V.w2v_char_vectors(voc, opts.seed), "char-vectors") if opts.embedding == "w2v" else None
    vec = V.kind_term_vectors(voc, voc, chars)
    spark = pages.sparkSession
    none = spark.createDataFrame([("class", "0", [0.0] * 30)], "kind string, term string, vector array<double>")
    vec = materialize(vec.unionByName(none), "vocab-vectors")
    if out_dir:
        from pagesift.sources.io import write_vectors_csv
        write_vectors_csv(vec.filter(F.col("kind") == "tag"), f"{out_dir}/tag_vectors", key="tag")
        write_vectors_csv(vec.filter(F.col("kind") == "class"), f"{out_dir}/class_name_vectors", key="classname")
    return vec


def extraction_job(spark, pages: DataFrame, out_path: str, model_path: str | None = None,
                   documents: DataFrame | None = None, opts: Options = Options(), page_key: Column | None = None,
                   gold_key: str = "doc_id", gold_text: str = "text") -> BodyExtractor:
    """T-08 bulk job: fit on ``documents`` (and save to ``model_path``) or load a saved
    extractor, score every page in one pass, write ``bodies`` and ``quarantine`` under
    ``out_path`` (parquet). Returns the extractor.

    Pages are cleaned once for the scoring: one table with status and body is
    written, and both outputs are read from it."""
    if documents is not None:
        ex = BodyExtractor(opts=opts).fit(pages, documents, page_key, gold_key, gold_text)
        if model_path:
            ex.save(model_path)
    else:
        ex = BodyExtractor.load(spark, model_path, opts)
    rows = _with_status(pages, ex.opts)
    scored = ex.scored_rows(rows, "url", "status")
    if scored is None:  # a model over vectors groups by page, so the rows are written in between
        rows = materialize(rows, "rows-with-status")
        bodies = ex.bodies_of_rows(rows.filter(F.col("status") == "ok").drop("status"))
        unusable = rows.filter(F.col("status") != "ok").select("page_id", "url", F.col("status").alias("reason"))
    else:
        body = B.body_column("nodes")
        done = materialize(scored.select("page_id", "url", "status", F.size("nodes").alias("n"), body.alias("body")), "bodies-with-status")
        bodies = done.filter((F.col("status") == "ok") & (F.col("n") > 0)).select("page_id", "body")
        unusable = done.filter(F.col("status") != "ok").select("page_id", "url", F.col("status").alias("reason"))
    bodies.write.mode("overwrite").parquet(f"{out_path}/bodies")
    unusable.write.mode("overwrite").parquet(f"{out_path}/quarantine")
    return ex


def files_job(spark, html_folder: str, gold_files: Sequence[str], out_path: str, model_path: str | None = None,
              opts: Options = Options()) -> BodyExtractor:
    """Files in, bodies out: pages from ``*.html`` (IO-01..03), gold from line files (IO-04, IO-05), joined on the file's
    stem (J-01, W-05: the first line of a key wins), labels (E-09), fit, and bodies of all pages.

    Writes ``labels`` (TSV), ``bodies``, ``quarantine``, ``gold_missing`` (pages without a gold line)
    and ``bad_gold`` (lines that do not parse) under ``out_path``."""
    from pagesift.sources import io
    pages = materialize(io.read_html_folder(spark, html_folder), "html-files")
    lines = materialize(io.read_gold_lines(spark, *gold_files), "gold-lines")
    gold = io.first_gold_per_key(lines)
    on = {"page_key": F.col("key"), "gold_key": "filename"}
    label_export_job(pages, gold, f"{out_path}/labels", opts, gold_text="body_text", **on)
    LB.gold_missing(pages, gold, **on).write.mode("overwrite").parquet(f"{out_path}/gold_missing")
    io.bad_gold_lines(lines).write.mode("overwrite").parquet(f"{out_path}/bad_gold")
    return extraction_job(spark, pages, out_path, model_path, gold, opts, gold_text="body_text", **on)
