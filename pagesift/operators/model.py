"""Training, cross-validation and scoring on Spark ML (T-01..T-06, S-12, IO-10).

The recurrent network of the original is replaced by a weighted logistic
regression over the same flattened 15 x 62 path features (Spark ML,
distributed L-BFGS). Any other Spark ML classifier with ``weightCol`` can
be passed in; an external sequence scorer plugs in through
``pyspark.ml.functions.predict_batch_udf`` (``external_scorer``).
"""

from __future__ import annotations

import importlib

from pyspark import cloudpickle
from pyspark.ml import Transformer
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.functions import array_to_vector, predict_batch_udf, vector_to_array
from pyspark.ml.util import MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from pagesift import config as C
from pagesift.config import Options
from pagesift.operators import folds as FO
from pagesift.operators import metrics as M


def default_classifier(opts: Options = Options()):
    return LogisticRegression(featuresCol="features", labelCol="label", weightCol="w",
                              maxIter=opts.max_iter, regParam=opts.reg_param, tol=opts.tol)


def with_features(vectors: DataFrame) -> DataFrame:
    return vectors.withColumn("features", array_to_vector("x")).drop("x")


def weighs_rows(classifier=None) -> bool:
    """Whether a fit of ``classifier`` heeds the weight column, so that equal rows may come as one."""
    return classifier is None or bool(classifier.hasParam("weightCol") and classifier.isSet("weightCol")
                                      and classifier.getOrDefault("weightCol") == "w")


def fit(train: DataFrame, opts: Options = Options(), classifier=None):
    """T-01/T-03: fit on rows with ``features`` and ``label``; returns (model, pos_weight). A row counts
    ``copies`` times where it has that column.

    ``train`` should be a written table, not a cached one: the classifier keeps its own blocks of it."""
    if isinstance(classifier, ExternalModel):
        return classifier.fit(train), 1.0
    copies = F.col("copies") if "copies" in train.columns else F.lit(1)
    c = train.agg(F.sum(F.col("label") * copies).alias("p"), F.coalesce(F.sum(copies), F.lit(0)).alias("n")).first()
    pos, neg = int(c["p"] or 0), int(c["n"] - (c["p"] or 0))
    den = pos if opts.pos_weight == "ratio" else pos + neg
    pw_val = (neg / den) if den else 1.0
    clf = classifier or default_classifier(opts)
    if opts.max_train_rows and c["n"] > opts.max_train_rows:
        # the same rows each time: those with the smallest hash; equal ones go or stay together
        share = opts.max_train_rows / c["n"]
        train = train.filter(F.conv(F.substring(FO.fold_hash(opts.seed + 2, "page_id", "pos"), 1, 7), 16, 10).cast("double") < share * 0x10000000)
    model = clf.fit(train.withColumn("w", copies * FO.weight_col(F.col("label"), F.lit(pw_val))))
    return model, pw_val


def score(model, rows: DataFrame, pos_weight: float = 1.0) -> DataFrame:
    """T-06/S-12: probability of class 1 and the strict ``> 0.5`` decision."""
    out = model.transform(rows)
    p = vector_to_array("probability")[1]
    return (out.withColumn("prob", p).withColumn("pred", (F.col("prob") > 0.5).cast("int"))
               .withColumn("w", FO.weight_col(F.col("label"), F.lit(pos_weight)))
               .drop("rawPrediction", "probability", "prediction", "features"))


def fold_predictions(folded: DataFrame, opts: Options = Options(), classifier=None) -> DataFrame:
    """T-02: every row as each fold's model sees it: (page_id, pos, label, own_fold, fold, held_out, prob, pred,
    pos_weight), ``fold`` being the fold that the model was not fitted on.

    The loop is over the folds' fits; nothing of the rows comes to the driver.
    ``folded`` (``features``, ``label``, ``fold``) should be a written table,
    since every fit reads it several times. Its rows may be those of
    ``features.distinct_inputs``: each is scored once for all its positions.
    """
    pos = F.explode("at").alias("pos") if "at" in folded.columns else F.col("pos")
    out = None
    for k in range(opts.n_folds):
        model, pw = fit(folded.filter(F.col("fold") != k), opts, classifier)
        part = score(model, folded.withColumnRenamed("fold", "own_fold"), pw).select(
            "page_id", pos, "label", "own_fold", F.lit(k).alias("fold"), (F.col("own_fold") == k).alias("held_out"),
            "prob", "pred", F.lit(float(pw)).alias("pos_weight"))
        out = part if out is None else out.unionByName(part)
    return out


def cross_validate(folded: DataFrame, opts: Options = Options(), classifier=None) -> DataFrame:
    """T-02/T-04/A-13: per fold (train_loss, val_loss, f1), the models are not kept; the row with a null fold holds
    the means (``metrics.fold_report`` over ``fold_predictions``)."""
    return M.fold_report(fold_predictions(folded, opts, classifier))


def tune(folded: DataFrame, grid=None, opts: Options = Options(), classifier=None):
    """T-02/T-09 alternative: Spark ML ``CrossValidator`` over the same folds
    (``foldCol``), scored by F1 of class 1; returns the fitted CrossValidatorModel.
    ``folded`` needs ``features``, ``label``, ``fold`` and the weight column ``w``."""
    from pyspark.ml.evaluation import MulticlassClassificationEvaluator
    from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
    clf = classifier or default_classifier(opts)
    if grid is None:
        grid = ParamGridBuilder().addGrid(clf.regParam, [opts.reg_param, 1e-2]).build()
    ev = MulticlassClassificationEvaluator(labelCol="label", predictionCol="prediction",
                                           metricName="fMeasureByLabel", metricLabel=1.0)
    cv = CrossValidator(estimator=clf, estimatorParamMaps=grid, evaluator=ev, foldCol="fold",
                        numFolds=opts.n_folds, seed=opts.seed)
    return cv.fit(folded)


def linear_weights(model, opts: Options = Options()):
    """(intercept, steps x 62 weights) of a binary logistic regression over the path features alone, else None."""
    if not isinstance(model, LogisticRegressionModel) or model.numFeatures != opts.max_steps * C.STEP_WIDTH:
        return None
    if model.getThreshold() != 0.5:
        return None
    return float(model.intercept), model.coefficients.toArray().reshape(opts.max_steps, C.STEP_WIDTH)


def save_model(model, path: str) -> None:
    """IO-10."""
    model.write().overwrite().save(path)


def load_model(path: str, model_class: str | None = None):
    """A model saved by ``save_model``; ``model_class`` is its class's full name (a logistic regression if not given)."""
    if model_class is None:
        return LogisticRegressionModel.load(path)
    module, _, name = model_class.rpartition(".")
    return getattr(importlib.import_module(module), name).load(path)


def external_scorer(make_predict_fn, batch_size: int = 64, steps: int = C.MAX_STEPS):
    """U-02: wrap any ``f(float[B, 15, 62]) -> logit[B]`` as a batched UDF over ``x``."""
    return predict_batch_udf(make_predict_fn, return_type=FloatType(), batch_size=batch_size,
                             input_tensor_shapes=[[steps, C.STEP_WIDTH]])


class ExternalModel(Transformer, MLWritable, MLReadable):
    """U-02: a model trained elsewhere, as a Spark ML transformer that can be saved and loaded.

    ``make_predict_fn()`` runs once in a worker and returns ``f(float[B, steps, 62]) -> logit[B]``;
    ``transform`` adds ``probability`` as a Spark ML classifier does. ``fit`` returns
    the model itself, so it can stand where a classifier is asked for
    (``BodyExtractor(classifier=ExternalModel(...))``): vocabularies and normalisation are
    then fitted to the pages, the model is not. The saved form is a parquet table with the
    pickled function; load only what you trust.
    """

    def __init__(self, make_predict_fn, batch_size: int = 64, steps: int = C.MAX_STEPS):
        super().__init__()
        self.make_predict_fn, self.batch_size, self.steps = make_predict_fn, batch_size, steps

    def fit(self, dataset) -> "ExternalModel":
        return self

    def _transform(self, dataset: DataFrame) -> DataFrame:
        logit = external_scorer(self.make_predict_fn, self.batch_size, self.steps)(vector_to_array("features")).cast("double")
        scored = dataset.withColumn("_logit", logit)
        p = 1 / (1 + F.exp(-F.col("_logit")))
        return scored.withColumn("probability", array_to_vector(F.array(1 - p, p))).drop("_logit")

    def write(self) -> MLWriter:
        return _ExternalWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _ExternalReader()


class _ExternalWriter(MLWriter):
    def __init__(self, model: ExternalModel):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        row = (cloudpickle.dumps(self.model.make_predict_fn), self.model.batch_size, self.model.steps)
        self.sparkSession.createDataFrame([row], "make_predict_fn binary, batch_size int, steps int").write.parquet(path)


class _ExternalReader(MLReader):
    def load(self, path: str) -> ExternalModel:
        r = self.sparkSession.read.parquet(path).first()
        return ExternalModel(cloudpickle.loads(bytes(r["make_predict_fn"])), r["batch_size"], r["steps"])
