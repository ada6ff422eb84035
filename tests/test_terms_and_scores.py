"""Term vectors in tasks, scores and bodies in the page row, exact moments, group folds, out-of-fold report,
external models, keys as arguments, files in and bodies out."""
import base64
import math
import os
import re
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from page_rows import pages_df
from pagesift.config import Options
from pagesift.functions import embed
from pagesift.operators import bodies as B
from pagesift.operators import dom as D
from pagesift.operators import features as FE
from pagesift.operators import folds as FO
from pagesift.operators import metrics as M
from pagesift.operators import model as MD
from pagesift.operators import vocab as V
from pagesift.plans import pipeline as P
from pagesift.plans import queries as Q
from pagesift.plans.extractor import BodyExtractor, extract_bodies, extraction_job, files_job, gbt_with_early_stopping, page_rows
from pagesift.sources import io

SF = "/root/testdata/sf0.001"
PAD = "<p>" + "w" * 100 + ".</p>"


@pytest.fixture(scope="module")
def fitted(spark):
    return BodyExtractor().fit(io.read_table(spark, SF, "pages"), io.read_table(spark, SF, "documents"))


@pytest.fixture(scope="module")
def odd_pages(spark):
    deep = "<div class='d'>" * 40 + "deep text" + "</div>" * 40
    return pages_df(spark, f"<html><body><my-tag class='never seen'>{'some words ' * 30}</my-tag>{PAD}</body></html>",
                    f"<html><body>{deep}{PAD}<input>after void<wbr/>more</body></html>", f"<html><body>{PAD}tail<p></p></body></html>",
                    "<html><body><p>too short</p></body></html>", "<div>" + PAD + "</div>", None)


def test_task_embedding_equals_the_sql_embedding(spark):
    terms = ["", "a", "ab", "div", "/div", "x-very-long-custom-element", "klass zwei  drei", "Ünïcode 中文", "wbr/", "a" * 300]
    df = spark.createDataFrame([("tag", t) for t in terms], "kind string, term string")
    want = {r.term: r.vector for r in V.wide(V.hash_vectors(df, ("kind", "term")), ("kind", "term")).collect()}
    assert all(np.allclose(embed.hash_vector(t), want[t], rtol=0, atol=1e-12) for t in terms)
    got = {r.term: r.vector for r in FE.embedded(df).collect()}
    step = {r.term: r.vector for r in FE.step_normalised(V.wide(V.hash_vectors(df, ("kind", "term")), ("kind", "term"))).collect()}
    assert all(np.allclose(got[t], step[t], rtol=0, atol=1e-9) for t in terms)


def test_memo_keeps_two_bounded_generations():
    asked = []
    memo = embed.Memo(lambda kind, term: asked.append(term) or term, limit=3)
    for t in "aaabbbabcdeabc":
        assert memo("tag", t) == t and len(memo.new) <= 3 and len(memo.old) <= 3
    assert asked.count("a") < "aaabbbabcdeabc".count("a")


@pytest.mark.parametrize("opts", [Options(), Options(scope="node"), Options(max_steps=4)])
def test_scores_in_the_page_row_equal_the_vector_path(spark, odd_pages, opts):
    pages = io.read_table(spark, SF, "pages").select("page_id", "url", "html")
    ex = BodyExtractor(opts=opts).fit(pages, io.read_table(spark, SF, "documents"))
    rows = page_rows(pages.unionByName(odd_pages.withColumn("page_id", F.col("page_id") + 5000)), opts)
    one, two = ({(r.page_id, r.pos): r for r in df.collect()} for df in (ex.score_rows(rows), ex.score_vectors(rows)))
    assert set(one) == set(two) and {5000, 5001, 5002} <= {k[0] for k in one}
    assert all(abs(one[k].prob - two[k].prob) < 1e-9 and one[k][2:3] + one[k][4:] == two[k][2:3] + two[k][4:] for k in one)
    assert sorted(map(tuple, ex.bodies_of_rows(rows).collect())) == sorted(map(tuple, B.assemble(ex.score_vectors(rows)).collect()))


def test_no_exchange_between_pages_and_bodies(spark, fitted):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    plan = fitted.transform(pages)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan and plan.count("regexp_extract_all") == 1


@pytest.mark.parametrize("scope", ["page", "node"])
def test_moments_of_page_rows_equal_those_of_nodes(spark, odd_pages, scope):
    opts = Options(scope=scope)
    rows = page_rows(odd_pages, opts)
    a = FE.norm_params_rows(rows, opts).first()
    b = FE.norm_params(FE.apply_scope(FE.nonempty_nodes(rows), opts)).first()
    assert a == b and a.n_nodes > 5 and a.t_steps == 15


def test_moments_are_exact_far_from_zero(spark):
    """Σx²/n - mean² in doubles loses every digit here."""
    base = 2_000_000_000
    rows = [(base + i % 3, base - i % 5, 2) for i in range(3000)]
    p = FE.norm_params(spark.createDataFrame(rows, "text_len long, punct long, depth int"), max_steps=15).first()
    for got_mean, got_std, values in ((p.text_length_mean, p.text_length_std, [r[0] for r in rows]),
                                      (p.punctuation_nb_mean, p.punctuation_nb_std, [r[1] for r in rows])):
        assert math.isclose(got_mean, statistics.fmean(values), rel_tol=1e-15)
        assert math.isclose(got_std, math.sqrt(float(statistics.pvariance(values))), rel_tol=1e-12)
    empty = FE.norm_params(spark.createDataFrame([], "text_len long, punct long, depth int")).first()
    assert empty.n_nodes == 0 and empty.text_length_mean is None


@pytest.mark.parametrize("parts", ["1", "7"])
def test_group_folds_share_positives(spark, parts):
    rng = np.random.default_rng(3)
    rows = [(p, i, int(rng.random() < (p % 10) / 12)) for p in range(157) for i in range(int(rng.integers(1, 60)))]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        folded = FO.stratified_folds(spark.createDataFrame(rows, "page_id long, pos int, label int"), opts=Options(fold_group="page_id")).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert len(folded) == len(rows) and len({(r.page_id, r.fold) for r in folded}) == 157
    pos, size = ([sum(r.label if by else 1 for r in folded if r.fold == k) for k in range(4)] for by in (True, False))
    most = max(sum(r[2] for r in rows if r[0] == p) for p in range(157))
    assert max(pos) - min(pos) <= most
    groups = sorted((sum(r[2] for r in rows if r[0] == p), sum(r[0] == p for r in rows)) for p in range(157))
    way = [n for p in sorted({p for p, _ in groups}) for n in sorted((n for q, n in groups if q == p), reverse=p % 2 == 1)]
    assert max(size) - min(size) <= sum(abs(a - b) for a, b in zip(way, way[1:]))
    assert max(p / n for p, n in zip(pos, size)) - min(p / n for p, n in zip(pos, size)) < 0.05


def test_fold_report_equals_plain_computation(spark):
    rng = np.random.default_rng(1)
    folds = [(int(k), float(w)) for k, w in enumerate((0.5, 0.6, 0.7))]
    rows = [(k, bool(own == k), int(y), float(p), int(p > 0.5), w)
            for own, y, p in zip(rng.integers(0, 3, 400), rng.integers(0, 2, 400), rng.random(400)) for k, w in folds]
    got = {r.fold: r for r in M.fold_report(spark.createDataFrame(rows, "fold int, held_out boolean, label int, prob double, pred int, pos_weight double")).collect()}

    def loss(part):
        return statistics.fmean(-(w * y * math.log(p) + (1 - y) * math.log(1 - p)) for _, _, y, p, _, w in part)
    for k, w in folds:
        held, seen = ([r for r in rows if r[0] == k and r[1] == h] for h in (True, False))
        tp, wrong = sum(r[2] and r[4] for r in held), sum(r[2] != r[4] for r in held)
        assert math.isclose(got[k].train_loss, loss(seen)) and math.isclose(got[k].val_loss, loss(held))
        assert math.isclose(got[k].f1, 2 * tp / (2 * tp + wrong)) and got[k].n_val == len(held) and math.isclose(got[k].pos_weight, w)
    assert math.isclose(got[None].f1, statistics.fmean(got[k].f1 for k, _ in folds)) and got[None].n_val == 400


def test_cross_validation_report_is_that_of_the_predictions(spark):
    matrix = P.training_matrix(spark, SF)
    seen = MD.fold_predictions(matrix).cache()
    assert seen.count() == 4 * matrix.count() and seen.filter("held_out").count() == matrix.count()
    own = {r.fold: r.n_val for r in MD.cross_validate(matrix).collect()}
    assert own[None] == matrix.count() and set(own) == {None, 0, 1, 2, 3}
    matrix.unpersist()
    out = P.out_of_fold(spark, SF).collect()
    assert len(out) == own[None] and len({(r.page_id, r.fold) for r in out}) == len({r.page_id for r in out})


def test_train_rows_can_be_bounded(spark):
    pages, docs = io.read_table(spark, SF, "pages"), io.read_table(spark, SF, "documents")
    few = BodyExtractor(opts=Options(max_train_rows=200)).fit(pages, docs)
    again = BodyExtractor(opts=Options(max_train_rows=200)).fit(pages, docs)
    assert np.allclose(few.model.coefficients.toArray(), again.model.coefficients.toArray())
    assert few.transform(pages).count() == pages.count()


def test_external_model_fits_saves_loads_and_scores(spark, tmp_path):
    def make_length_model():
        w = np.zeros((15, 62), np.float32)
        w[:, 60] = 1.0

        def predict(x):
            return (x * w).sum(axis=(1, 2)).astype(np.float32)
        return predict

    pages, docs = io.read_table(spark, SF, "pages"), io.read_table(spark, SF, "documents")
    ex = BodyExtractor(classifier=MD.ExternalModel(make_length_model, batch_size=16)).fit(pages, docs)
    ex.save(str(tmp_path / "m"))
    back = BodyExtractor.load(spark, str(tmp_path / "m"))
    assert isinstance(back.model, MD.ExternalModel) and back.model.batch_size == 16
    scores = {(r.page_id, r.pos): (round(r.prob, 6), r.accept) for r in back.score_nodes(pages).collect()}
    assert scores == {(r.page_id, r.pos): (round(r.prob, 6), r.accept) for r in ex.score_nodes(pages).collect()}
    # the logit is the sum of the length z-scores over the 15 steps, so probabilities follow the page's length
    nodes = FE.nonempty_nodes(page_rows(pages.select("page_id", "url", "html")))
    ml, sl, *_ = FE.normalisation(ex.params)
    for r in nodes.collect():
        kept = min(r.depth, 15)
        logit = kept * (r.text_len - ml) / sl + (15 - kept) * -ml / sl
        assert abs(scores[r.page_id, r.pos][0] - 1 / (1 + math.exp(-logit))) < 1e-4
    assert sorted(map(tuple, back.transform(pages).collect())) == sorted(map(tuple, ex.transform(pages).collect()))


def test_trees_are_saved_with_their_class(spark, tmp_path):
    pages, docs = io.read_table(spark, SF, "pages"), io.read_table(spark, SF, "documents")
    ex = BodyExtractor(classifier=gbt_with_early_stopping(max_iter=3)).fit(pages, docs)
    ex.save(str(tmp_path / "m"))
    back = BodyExtractor.load(spark, str(tmp_path / "m"))
    assert type(back.model).__name__ == "GBTClassificationModel"
    assert sorted(map(tuple, back.transform(pages).collect())) == sorted(map(tuple, ex.transform(pages).collect()))


def test_unusable_pages_keep_their_status(spark, odd_pages, fitted, tmp_path):
    rows = D.page_events(D.clean_pages(odd_pages), keep_unusable=True).collect()
    assert [r.status for r in sorted(rows, key=lambda r: r.page_id)] == ["ok", "ok", "ok", "too_short", "no_html", "no_html"]
    assert all(r.kind == [] and r.content == [] for r in rows if r.status != "ok")
    fitted.save(str(tmp_path / "m"))
    extraction_job(spark, odd_pages, str(tmp_path / "out"), str(tmp_path / "m"))
    bad = {r.page_id: r.reason for r in spark.read.parquet(str(tmp_path / "out/quarantine")).collect()}
    assert bad == {3: "too_short", 4: "no_html", 5: "no_html"}
    done = {r.page_id: r.body for r in spark.read.parquet(str(tmp_path / "out/bodies")).collect()}
    bodies, quarantine = extract_bodies(odd_pages, {"la": fitted})
    assert done == {r.page_id: r.body for r in bodies.collect()} and set(done) == {0, 1, 2}
    assert {r.page_id: r.reason for r in quarantine.collect()} == bad


def test_first_gold_line_wins_over_several_files_and_splits(spark, tmp_path):
    long = "x" * 300
    for name, who in (("a.txt", "A"), ("b.txt", "B")):
        lines = [f"# {name}"] + [str({"Website": f"{who}{i}", "Filename": f"k{i % 40}", "Body text": f"{who}{i} {long}"}) for i in range(200)] + ["{broken"]
        (tmp_path / name).write_text("\n".join(lines), encoding="utf-8")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "5000")
    try:
        lines = io.read_gold_lines(spark, str(tmp_path / "b.txt"), str(tmp_path / "a.txt"))
        assert lines.select("file", "block").distinct().count() > 10
        got = {r.filename: r.website for r in io.first_gold_per_key(lines).collect()}
        assert got == {f"k{i}": f"B{i}" for i in range(40)} and io.bad_gold_lines(lines).count() == 2
        folder = {r.filename: r.website for r in io.first_gold_per_key(io.read_gold_lines(spark, str(tmp_path / "*.txt"))).collect()}
        assert folder == {f"k{i}": f"A{i}" for i in range(40)}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_files_in_bodies_out(spark, tmp_path):
    """The original inputs: *.html named by base64 URL, and text files of printed dicts; duplicate and missing keys."""
    pages = spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url", "html").collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    (tmp_path / "html").mkdir()
    key = {r.page_id: base64.b64encode(r.url.encode()).decode().replace("/", "_") for r in pages}
    lines = []
    for r in pages:
        (tmp_path / "html" / f"{key[r.page_id]}.html").write_text(r.html, encoding="utf-8")
        if r.page_id % 7:
            text = texts[int(re.search(r"/[a-z]{2}/([0-9]+)", r.url)[1])]
            lines.append(str({"Website": r.url, "Filename": key[r.page_id], "Body text": text}))
    late = str({"Website": "w", "Filename": key[pages[1].page_id], "Body text": "a later line of a known key"})
    (tmp_path / "train.txt").write_text("\n".join(["header", *lines[::2]]), encoding="utf-8")
    (tmp_path / "test.txt").write_text("\n".join([*lines[1::2], "{not a dict", late]), encoding="utf-8")
    out = str(tmp_path / "out")
    ex = files_job(spark, str(tmp_path / "html"), [str(tmp_path / "train.txt"), str(tmp_path / "test.txt")], out, str(tmp_path / "model"))
    by_url = BodyExtractor().labelled_rows(spark.read.parquet(f"{SF}/pages.parquet").filter("page_id % 7 <> 0"), spark.read.parquet(f"{SF}/documents.parquet"))
    want = FE.nonempty_nodes(by_url, with_label=True).groupBy("label").count().collect()
    got = spark.read.option("sep", "\t").option("header", True).csv(f"{out}/labels").groupBy("label").count().collect()
    assert {int(r["label"]): r["count"] for r in got} == {r["label"]: r["count"] for r in want}
    assert spark.read.parquet(f"{out}/gold_missing").count() == sum(r.page_id % 7 == 0 for r in pages)
    assert spark.read.parquet(f"{out}/bad_gold").count() == 1 and spark.read.parquet(f"{out}/bodies").count() == len(pages)
    assert BodyExtractor.load(spark, str(tmp_path / "model")).pos_weight == ex.pos_weight and os.path.isdir(f"{out}/quarantine")


def test_null_keys_do_not_meet_one_task(spark):
    from pagesift.operators.skew import hot_keys, salted_join
    big = spark.createDataFrame([(i, None if i % 3 else i % 5) for i in range(300)], "id long, k long")
    small = spark.createDataFrame([(k, f"v{k}") for k in range(4)], "k long, v string")
    rows = salted_join(big, small, "k", hot_keys(big, "k", 10**9), "id", how="left").collect()
    assert len(rows) == 300 and all((r.v is None) == (r.k is None or r.k == 4) for r in rows)


def test_equal_rows_of_a_page_fit_as_one(spark):
    folded = P._folded(spark, SF, P.OPTS)
    alike = FE.distinct_inputs(folded, "fold")
    assert alike.count() < folded.count() == alike.agg(F.sum("copies")).first()[0]
    assert alike.select("page_id", F.explode("at").alias("pos")).exceptAll(folded.select("page_id", "pos")).count() == 0
    each, _ = P.vectors_for(folded, Q._pages(spark, SF))
    one, _ = P.vectors_for(folded, Q._pages(spark, SF), P.OPTS, alike)
    # every node's own vector, label and fold are those of the row that stands for it
    x = {(r.page_id, r.pos): (r.label, r.fold, r.x) for r in each.collect()}
    rows = one.collect()
    assert {(r.page_id, p): (r.label, r.fold, r.x) for r in rows for p in r.at} == x and all(r.copies == len(r.at) for r in rows)
    (a, wa), (b, wb) = (MD.fit(MD.with_features(v)) for v in (each, one))
    probs = [{(r.page_id, r.pos): r.prob for r in MD.score(m, MD.with_features(each)).collect()} for m in (a, b)]
    assert wa == wb and statistics.fmean(abs(probs[0][k] - probs[1][k]) for k in x) < 0.01


def test_classifiers_without_the_weight_column_get_every_row(spark):
    from pyspark.ml.classification import LogisticRegression, MultilayerPerceptronClassifier
    assert MD.weighs_rows() and MD.weighs_rows(LogisticRegression(weightCol="w"))
    assert not MD.weighs_rows(LogisticRegression()) and not MD.weighs_rows(MultilayerPerceptronClassifier())
