"""Metrics on hand-made predictions and on confusion matrices with known results."""

from flowlens.errors import FlowLensError
from flowlens.operators import investigate as IN
from flowlens.operators import live as LV
import random

import pytest
from flowlens.functions import columns as C
from flowlens.operators import evaluate as EV
from flowlens.operators.score import with_prediction
from pyspark.sql import functions as F


def binary(spark, rows, model="m"):
    """rows: (true label, probability of class 1)"""
    df = spark.createDataFrame(
        [(model, i, t, [1 - p, p]) for i, (t, p) in enumerate(rows)],
        "model string, sample_id long, true_label string, probability array<double>")
    return with_prediction(df, ["0", "1"])


def from_matrix(spark, matrix):
    rows, sid = [], 0
    for i, line in enumerate(matrix):
        for j, n in enumerate(line):
            for _ in range(n):
                rows.append((str(i), 0.9 if j else 0.1))
                sid += 1
    return binary(spark, rows)


# Recorded results of three classifiers on one 200-row split: matrix and metrics.
RECORDED = [
    ([[198, 0], [2, 0]], dict(accuracy=0.99, macro_precision=0.495, macro_recall=0.5, macro_f1=0.49748743718592964,
                              weighted_f1=0.9850251256281406, attack_recall=0.0, false_positive_rate=0.0)),
    ([[184, 14], [0, 2]], dict(accuracy=0.93, macro_precision=0.5625, macro_recall=0.9646464646464646,
                               macro_f1=0.5927865037812682, weighted_f1=0.9559394997091333, attack_recall=1.0,
                               false_positive_rate=0.0707070707070707)),
]


@pytest.mark.parametrize("matrix,want", RECORDED)
def test_recorded_metrics(spark, matrix, want):
    row = EV.comparison(from_matrix(spark, matrix), ["0", "1"], "is_attack").first()
    for name, value in want.items():
        assert row[name] == pytest.approx(value, abs=1e-12), name


def test_recorded_calibration_error(spark):
    bins = spark.createDataFrame(
        [("m", 7, 1, 0.21672219038009644), ("m", 8, 4, 0.3523746132850647), ("m", 9, 195, 0.005618274211883545)],
        "model string, bin int, rows long, gap double")
    assert EV.calibration_error(bins).first()["ece"] == pytest.approx(0.013608920574188232, abs=1e-12)


def test_ties(spark):
    rows = [("1", 0.9), ("0", 0.8), ("1", 0.7), ("0", 0.7), ("0", 0.1)]
    row = EV.ranking(binary(spark, rows), "1").first()
    assert row["roc_auc"] == pytest.approx(0.75) and row["pr_auc"] == pytest.approx(0.75)


def test_ranking_against_brute_force(spark):
    rng = random.Random(3)
    rows = [(str(int(rng.random() < 0.3)), rng.choice([0.0, 0.001, 0.5, 0.9, 0.99999, 1.0, rng.random()])) for _ in range(700)]
    # a third of all rows share one score
    rows += [(str(i % 2), 0.25) for i in range(350)]
    pos = [p for t, p in rows if t == "1"]
    neg = [p for t, p in rows if t == "0"]
    auc = sum((a > b) + (a == b) / 2 for a in pos for b in neg) / (len(pos) * len(neg))
    ap = 0.0
    for s in sorted({p for _, p in rows}):
        tp, flagged = sum(p >= s for p in pos), sum(p >= s for _, p in rows)
        ap += sum(p == s for p in pos) * tp / flagged
    row = EV.ranking(binary(spark, rows), "1").first()
    assert row["roc_auc"] == pytest.approx(auc, abs=1e-12)
    assert row["pr_auc"] == pytest.approx(ap / len(pos), abs=1e-12)


def test_one_class_only(spark):
    row = EV.ranking(binary(spark, [("0", 0.4), ("0", 0.6)]), "1").first()
    assert row["roc_auc"] is None and row["pr_auc"] is None


def test_reliability_edges(spark):
    confidences = [0.0, 0.3, 0.30000000000000004, 0.9, 1.0]
    df = spark.createDataFrame([("m", c, True) for c in confidences], "model string, confidence double, correct boolean")
    got = {r["bin"]: r for r in EV.reliability_bins(df).collect()}
    assert {b: r["rows"] for b, r in got.items()} == {0: 1, 1: 0, 2: 1, 3: 1, 4: 0, 5: 0, 6: 0, 7: 0, 8: 0, 9: 2}
    assert got[1]["gap"] is None and got[9]["mean_confidence"] == pytest.approx(0.95)
    assert sum(r["rows"] for r in got.values()) == len(confidences)


def test_entropy(spark):
    df = spark.createDataFrame([([1.0, 0.0],), ([0.5, 0.5],)], "p array<double>")
    got = [r[0] for r in df.select(C.normalised_entropy(F.col("p"), 2)).collect()]
    assert got == pytest.approx([0.0, 1.0])
    three = spark.createDataFrame([([1 / 3] * 3,)], "p array<double>")
    assert three.select(C.normalised_entropy(F.col("p"), 3)).first()[0] == pytest.approx(1.0)


def test_first_class_wins_ties(spark):
    assert binary(spark, [("0", 0.5)]).first()["predicted_label"] == "0"


def test_unseen_class_is_left_out_of_macro(spark):
    df = spark.createDataFrame([("m", "a", "a"), ("m", "b", "a")], "model string, true_label string, predicted_label string")
    row = EV.averages(EV.per_class(EV.confusion(df, ["a", "b", "c"]))).first()
    assert row["macro_recall"] == pytest.approx(0.5) and row["macro_precision"] == pytest.approx(0.25)


def test_positive_class():
    assert EV.positive_class(["BENIGN", "DoS"]) == "DoS"
    assert EV.positive_class(["AAA", "BENIGN"]) == "AAA"
    assert EV.positive_class(["0", "1"], "is_attack") == "1"
    assert EV.positive_class(["a", "b"]) == "b"


def test_confusion_adds_up(spark):
    preds = binary(spark, [("0", 0.2), ("1", 0.7), ("1", 0.1)])
    cells = EV.confusion(preds, ["0", "1"]).collect()
    assert len(cells) == 4 and sum(r["n"] for r in cells) == 3


def test_evidence_sentences(spark):
    df = spark.createDataFrame([(1.0, -7.0, None, 0.95), (None, None, None, 0.5), (3.0, -3.0, 0.0, 0.8)],
                               "`a.b` double, c double, d double, p double")
    got = [r[0] for r in df.select(C.evidence(["a.b", "c", "d"], F.col("p"))).collect()]
    assert got[0] == ["1 feature values were missing and median-imputed.", "Highest-magnitude observed feature: c.", "High confidence"]
    assert got[1] == ["3 feature values were missing and median-imputed.", "Review manually: model confidence is below 0.8."]
    assert got[2] == ["Highest-magnitude observed feature: a.b.", "High confidence"]


def test_many_classes(spark):
    """The plan does not grow with the square of the classes."""
    names = [f"c{i:03d}" for i in range(200)]
    rows = spark.range(2000).select(F.lit("m").alias("model"), F.concat(F.lit("c"), F.lpad((F.col("id") % 200).cast("string"), 3, "0")).alias("true_label"),
                                    F.concat(F.lit("c"), F.lpad((F.col("id") % 199).cast("string"), 3, "0")).alias("predicted_label"))
    cells = EV.confusion(rows, names)
    assert cells.count() == 40_000 and cells.agg(F.sum("n")).first()[0] == 2000
    assert EV.per_class(EV.pair_counts(rows, names), names).count() == 200


def test_lookups_that_find_nothing(spark):
    rows = spark.createDataFrame([(1, True)], "sample_id long, active boolean").withColumn("flow_id", F.col("sample_id"))
    assert IN.sample(rows, 1).count() == 1
    with pytest.raises(FlowLensError):
        IN.sample(rows, 2)
    with pytest.raises(FlowLensError):
        LV.flow_by_id(rows, 1)
