"""Model fitting on small learnable data."""

import random
import statistics

import pytest
from flowlens.errors import FlowLensError
from flowlens.operators import evaluate as EV
from flowlens.operators import train as TR
from flowlens.operators.score import align_to_model, with_prediction
from flowlens.plans.training import run_experiment
from flowlens.streaming.flow_stream import model_scorer
from pyspark.sql import functions as F


def table(spark, n=400, seed=0):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        x = [rng.gauss(0, 1) for _ in range(5)]
        rows.append((i, *x, None if i % 10 else x[0], str(int(x[0] + x[1] > 0))))
    return spark.createDataFrame(rows, "sample_id long, `x.0` double, x1 double, `x/2` double, x3 double, x4 double, "
                                       "thin double, is_attack string")


FEATURES = ["x.0", "x1", "x/2", "x3", "x4", "thin"]


@pytest.fixture(scope="module")
def run(spark):
    return run_experiment(table(spark), trees=20, depth=5)


def test_learnable_label(run):
    assert run.features == FEATURES and run.classes == ["0", "1"]
    rows = {r["model"]: r for r in run.comparison().collect()}
    assert set(rows) == set(TR.MODEL_NAMES)
    assert all(r["roc_auc"] > 0.9 and r["inference_rows"] == 80 for r in rows.values())
    assert all(r["fit_seconds"] > 0 and r["inference_seconds"] > 0 for r in rows.values())


def test_tables_hold_together(run):
    cells = EV.confusion(run.predictions, run.classes)
    assert cells.agg(F.sum("n")).first()[0] == 240
    assert run.reliability().groupBy("model").agg(F.sum("rows").alias("n")).filter("n <> 80").count() == 0
    assert run.train.count() + run.test.count() == 400


def test_same_seed_same_predictions(spark, run):
    train, test = run.train, run.test
    again = TR.fit("random_forest", train, FEATURES, "is_attack", 20, 5)
    labels = with_prediction(TR.score(again, test), again.classes, truth=None).select("sample_id", "predicted_label")
    first = run.predictions.filter("model = 'random_forest'").select("sample_id", "predicted_label")
    assert labels.exceptAll(first).count() == 0


def test_importance(run):
    forest = TR.feature_importance(run.models["random_forest"], 3)
    assert {f for f, _ in forest[:2]} == {"x.0", "x1"} and len(forest) == 3
    linear = TR.feature_importance(run.models["logistic_regression"])
    assert linear == [(f, 0.0) for f in FEATURES]


def test_experiment_rows(spark, run, tmp_path):
    run.save(str(tmp_path / "e"))
    run.save(str(tmp_path / "e"))
    rows = spark.read.json(str(tmp_path / "e")).collect()
    assert len(rows) == 2 and rows[0]["random_seed"] == 42 and "roc_auc" in rows[0]["metrics"]
    assert rows[0]["model"] == "primary" and "GBT" in rows[0]["implementation"]


def test_several_classes(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice([0.0, 5.0, 10.0]) + rng.random()) for i in range(150)]
    df = spark.createDataFrame(rows, "sample_id long, v double").withColumn(
        "Label", F.when(F.col("v") < 2, "BENIGN").when(F.col("v") < 7, "Bot").otherwise("DoS"))
    run = run_experiment(df, models=("primary", "logistic_regression"), trees=5, depth=3)
    rows = run.comparison().collect()
    assert all(r["accuracy"] > 0.9 and r["roc_auc"] is None for r in rows)


def test_exact_medians(spark):
    rng = random.Random(4)
    rows = [(rng.choice([0.0, rng.random() * 1e6]), None if rng.random() < 0.5 else float(i), None) for i in range(999)]
    df = spark.createDataFrame(rows, "a double, b double, c double")
    got = TR.exact_medians(df, ["a", "b", "c"])
    assert got["a"] == statistics.median(r[0] for r in rows)
    assert got["b"] == statistics.median(r[1] for r in rows if r[1] is not None)
    assert got["c"] is None
    # one value makes up nearly all rows
    same = TR.exact_medians(spark.range(1000).select(F.when(F.col("id") < 3, 1.0).otherwise(7.0).alias("v")), ["v"])
    assert same == {"v": 7.0}


def test_weights():
    assert TR.class_weights({"0": 90, "1": 10}) == {"0": 100 / 180, "1": 100 / 20}


def test_saved_model(spark, run, tmp_path):
    model = run.models["logistic_regression"]
    model.save(str(tmp_path / "m"))
    again = TR.FittedModel.load(spark, str(tmp_path / "m"))
    assert again.describe() == model.describe() and again.features == model.features
    first, second = (TR.score(m, run.test).select("sample_id", "probability") for m in (model, again))
    assert first.exceptAll(second).count() == 0


def test_partitioning_does_not_depend_on_cores(spark, run):
    """Rows that arrive in other partitions and order fit the same forest."""
    train = run.train
    models = [TR.fit("random_forest", train.repartition(n, "x1"), FEATURES, "is_attack", 10, 4) for n in (2, 7)]
    first, second = (TR.score(m, run.test).select("sample_id", "probability") for m in models)
    assert first.exceptAll(second).count() == 0


def test_only_fitting_is_bounded(spark):
    """The cap on fitted rows leaves every held-out row in its place."""
    run = run_experiment(table(spark), models=("logistic_regression",), max_fit_rows=50)
    assert run.train.count() == 320 and run.predictions.count() == run.test.count() == 80


def test_unreadable_rows_fail_alone(spark, run):
    rows = spark.createDataFrame([(1, "2.5"), (2, "no number")], "sample_id int, `x.0` string")
    every = rows.withColumns({f: F.lit(0.5) for f in FEATURES[1:]})
    got = {r["sample_id"]: r for r in model_scorer(run.models["logistic_regression"])(every).collect()}
    assert got[1]["prediction"] is not None and got[1]["error"] is None
    assert got[2]["prediction"] is None and got[2]["error"] == "The flow could not be scored."


def test_unknown_model(spark):
    with pytest.raises(FlowLensError):
        TR.fit("hosted", table(spark, 20), FEATURES, "is_attack")


def test_scorer_on_records(spark, run):
    records = spark.createDataFrame([(1, "2.5", "oops"), (2, "-3", "Infinity")], "sample_id int, `x.0` string, x1 string")
    aligned = align_to_model(records, FEATURES, ["sample_id"])
    assert aligned.filter("x1 IS NOT NULL").count() == 0
    forest = run.models["random_forest"]
    rows = model_scorer(run.models["logistic_regression"], {"random_forest": forest})(aligned).orderBy("sample_id").collect()
    assert [r["prediction"]["prediction"] for r in rows] == ["1", "0"]
    assert rows[0]["prediction"]["is_attack"] and not rows[1]["prediction"]["is_attack"]
    assert set(rows[0]["prediction"]["model_agreement"]) == {"random_forest"}
    assert rows[0]["prediction"]["evidence"][0] == "5 feature values were missing and median-imputed."
    assert sum(rows[0]["prediction"]["probabilities"].values()) == pytest.approx(1.0)


def test_experiment_computes_its_rows_once(spark, monkeypatch):
    """The split reads stored rows, and the fits read stored training rows, whatever the input costs."""
    from flowlens.plans import training as TN

    seen, split = {}, TN.SM.with_split

    class Stop(Exception):
        pass

    def watched(df, *rest):
        seen["labelled"] = df.inputFiles()
        return split(df, *rest)

    def stop(df, features):
        seen["fitted"] = df.inputFiles()
        raise Stop

    monkeypatch.setattr(TN.SM, "with_split", watched)
    monkeypatch.setattr(TN.TR, "exact_medians", stop)
    rows = spark.createDataFrame([(i, float(i % 7), i % 2) for i in range(200)], "sample_id long, x double, is_attack int")
    try:
        TN.run_experiment(rows, "is_attack", max_fit_rows=100)
    except Stop:
        pass
    for name in ("labelled", "fitted"):
        assert seen[name] and all(f"/{name}-" in f for f in seen[name])


def test_flow_model_is_fitted_and_asked_with_the_gap(spark, monkeypatch):
    """One reset is as far from none as three are, in the training rows and in scoring; records keep their counts."""
    from flowlens.operators import flows as FL
    from flowlens.plans import ml_queries as M

    packets = [(10 * f + i, (10 * f + i) * 1_000_000, "TCP", f"10.0.0.{f}", 1000, "9.0.0.1", 443, 40, "RA" if i < f else "S") for f in range(4) for i in range(3)]
    rows = FL.flow_table(spark.createDataFrame(packets, M.FS.PACKET_SCHEMA), 5_000_000, 3).withColumn("flow_id", F.col("first_seq"))
    monkeypatch.setattr(M, "run_experiment", lambda rows, *_, **__: rows)
    monkeypatch.setattr(M.FS, "model_scorer", lambda model: lambda r: r.withColumn("seen", F.col(f"`{M.RESETS}`")))
    want = {0: (0, 0), 10: (1, 1), 20: (1, 2), 30: (1, 3)}
    fitted = M.flow_experiment(rows).collect()
    assert {r["flow_id"]: (r["is_attack"], r[M.RESETS] - M.GAP * r["is_attack"]) for r in fitted} == want
    asked = M.flow_scorer(None)(FL.flow_records(rows)).collect()
    assert {r["flow_id"]: (int(r["seen"] > M.GAP), r[M.RESETS]) for r in asked} == want


def test_every_training_row_is_fitted(spark, monkeypatch):
    """Without a caller's own bound the models see all training rows, however many."""
    from flowlens.plans import training as TN

    class Stop(Exception):
        pass

    def stop(df, features):
        raise Stop(df.count())

    monkeypatch.setattr(TN.TR, "exact_medians", stop)
    rows = spark.range(150_000).select(F.col("id").alias("sample_id"), (F.col("id") % 7).alias("x"), (F.col("id") % 2).alias("is_attack"))
    with pytest.raises(Stop) as seen:
        run_experiment(rows, "is_attack")
    assert seen.value.args == (120_000,)


def test_trees_split_where_all_rows_say(spark):
    """The label's gap is a split of every tree, though some 10,000 drawn rows would put it a value beside; rare values count."""
    x = F.pmod(F.xxhash64("id"), F.lit(400))
    rows = spark.range(60_000).select(
        (x + F.when(x > 260, 1000).otherwise(0)).alias("x"), F.when(F.col("id") < 3, F.col("id")).otherwise(5).alias("rare"), F.lit(None).cast("int").alias("none"),
        F.lit(2.5).alias("same"), (x > 260).cast("int").alias("is_attack"))
    points = TR.split_points(rows, "is_attack", {"x": 0.0, "rare": 5.0, "same": 2.5})
    assert len(points["x"]) == TR.BINS - 1 and (260 + 1261) / 2 in points["x"]
    assert points["rare"] == [0.5, 1.5, 3.5] and points["same"] == []
    for seed in (1, 2):
        model = TR.fit("random_forest", rows.withColumn("x", F.col("x") + seed), ["x", "none", "same"], "is_attack", 1, 2)
        scored = TR.score(model, rows.withColumn("x", F.col("x") + seed))
        assert scored.columns == [*rows.columns, "probability"]
        assert scored.filter((F.col("probability")[1] > 0.5) != (F.col("is_attack") == 1)).count() == 0


def test_split_points_are_quantiles_of_the_balanced_weight(spark):
    rng = random.Random(7)
    values = [(rng.choice([rng.random(), float(rng.randrange(5))]), int(rng.random() < 0.1)) for _ in range(3000)]
    points = TR.split_points(spark.createDataFrame(values, "v double, is_attack int"), "is_attack", {"v": 0.0})["v"]
    counts = {c: sum(1 for _, a in values if a == c) for c in (0, 1)}
    distinct = sorted({v for v, _ in values})
    before = {}
    total = 0
    for v in distinct:
        before[v] = total
        total += sum(1 / counts[a] for x, a in values if x == v)
    cuts = {min(distinct[1:], key=lambda v: abs(before[v] - k * total / TR.BINS)) for k in range(1, TR.BINS)}
    want = sorted((v + distinct[distinct.index(v) - 1]) / 2 for v in cuts)
    assert points == pytest.approx(want)
