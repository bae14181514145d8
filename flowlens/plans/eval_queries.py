"""Scoring, evaluation and investigation queries over deterministic predictions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema as S
from ..functions import columns as C
from ..operators import evaluate as EV
from ..operators import investigate as IN
from ..operators import profile as PR
from ..operators import score as SC
from .views import BINARY, CLASSES, FEATURES, MODELS, labelled_flows, scored, with_views

BASELINES = [m for m in MODELS if m != "primary"]
LOOKUP = 101


def predictions(spark: SparkSession, sf_dir: str, binary: bool = False) -> DataFrame:
    return SC.with_prediction(scored(spark, sf_dir, binary), BINARY if binary else CLASSES)


def primary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predictions(spark, sf_dir).filter("model = 'primary'")


def joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Primary predictions with all models' labels; the predictions are one table read once per side."""
    rows = predictions(spark, sf_dir)
    return IN.with_baselines(rows.filter("model = 'primary'"), IN.side_by_side(rows, list(MODELS)))


# Values with missing cells and ties, for the evidence sentences.
_EVIDENCE_FEATURES = ["line_count", "qty_sum", "qty_min", "qty_max", "discount_pct"]


def _with_holes(rows: DataFrame) -> DataFrame:
    sid = F.col("sample_id")
    return rows.withColumn("qty_sum", F.when(sid % 3 != 0, F.col("qty_sum"))).withColumn(
        "qty_max", F.when(sid % 13 != 0, F.col("qty_max")))


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _with_holes(primary(spark, sf_dir))
    return rows.select("sample_id", F.concat_ws("|", C.evidence(_EVIDENCE_FEATURES, F.col("confidence"))).alias("evidence"))


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = predictions(spark, sf_dir)
    base = IN.side_by_side(rows.filter("model <> 'primary'"), BASELINES)
    scored_rows = IN.with_baselines(rows.filter("model = 'primary'").drop("predicted_label", "confidence", "correct"), base)
    return SC.scored_records(scored_rows, CLASSES, FEATURES, BASELINES).select(
        "sample_id", "prediction", "is_attack", "confidence", F.round("uncertainty", 9).alias("uncertainty"),
        F.element_at("model_agreement", F.lit("random_forest")).alias("random_forest"),
        F.element_at("model_agreement", F.lit("logistic_regression")).alias("logistic_regression"),
        "models_agree", "should_investigate",
        *[F.element_at("probabilities", F.lit(c)).alias(f"p_{c}") for c in CLASSES],
    )


def lone_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without baselines every record counts as agreed."""
    rows = primary(spark, sf_dir)
    return SC.scored_records(rows, CLASSES, FEATURES).select("sample_id", "models_agree", "should_investigate")


def _round(df: DataFrame, digits: int, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, digits) for n in names})


def confusion(spark: SparkSession, sf_dir: str, binary: bool = False) -> DataFrame:
    return EV.confusion(predictions(spark, sf_dir, binary), BINARY if binary else CLASSES)


def pairs(spark: SparkSession, sf_dir: str, binary: bool = False) -> DataFrame:
    return EV.pair_counts(predictions(spark, sf_dir, binary), BINARY if binary else CLASSES)


def comparison(spark: SparkSession, sf_dir: str, binary: bool) -> DataFrame:
    return EV.comparison(predictions(spark, sf_dir, binary), BINARY if binary else CLASSES,
                         "is_attack" if binary else "Label")


_METRICS = ["accuracy", "macro_precision", "macro_recall", "macro_f1", "weighted_f1", "roc_auc", "pr_auc",
            "false_positive_rate", "false_negative_rate", "attack_recall"]


def cohort(kind):
    def build(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = _with_holes(primary(spark, sf_dir))
        return IN.cohort_rows(kind(rows), CLASSES, _EVIDENCE_FEATURES).select(
            "sample_id", "true_label", "predicted_label", "confidence", "uncertainty", "correct",
            *[F.element_at("probabilities", F.lit(c)).alias(f"p_{c}") for c in CLASSES],
            *[F.element_at("feature_values", F.lit(f)).alias(f) for f in _EVIDENCE_FEATURES],
            F.concat_ws("|", "evidence").alias("evidence"))

    return build


def wide_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One sample with all of its 78 feature values."""
    names = [f"f{i}" for i in range(1, 79)]
    rows = primary(spark, sf_dir).withColumns({f: (F.col("sample_id") * i % 1009).cast("double") for i, f in enumerate(names, 1)})
    found = IN.cohort_rows(IN.sample(rows, LOOKUP), CLASSES, names, n_features=None)
    return found.select("sample_id", *[F.element_at("feature_values", F.lit(f)).alias(f) for f in names])


# --- SQL twins -----------------------------------------------------------------------


def _sized(f: str) -> str:
    return f"coalesce(abs({f}), -1)"


_TOP = "greatest(" + ", ".join(_sized(f) for f in _EVIDENCE_FEATURES) + ")"
_EVIDENCE = (
    "concat_ws('|', CASE WHEN miss > 0 THEN miss || ' feature values were missing and median-imputed.' END, "
    "'Highest-magnitude observed feature: ' || CASE "
    + " ".join(f"WHEN {_sized(f)} = {_TOP} THEN '{f}'" for f in _EVIDENCE_FEATURES)
    + " END || '.', CASE WHEN confidence >= 0.8::DOUBLE THEN 'High confidence' ELSE 'Review manually: model confidence is below 0.8.' END)"
)


def _classes_cte(names: list[str], source: str) -> dict[str, tuple[tuple[str, ...], str]]:
    values = ", ".join(f"('{c}')" for c in names)
    return {
        "classes": ((), f"SELECT * FROM (VALUES {values}) AS t(class)"),
        "pc": ((source, "classes"), f"""
            SELECT model, class, CASE WHEN predicted > 0 THEN tp::DOUBLE / predicted ELSE 0.0::DOUBLE END AS precision,
              CASE WHEN support > 0 THEN tp::DOUBLE / support ELSE 0.0::DOUBLE END AS recall,
              CASE WHEN tp > 0 THEN 2.0::DOUBLE * (tp::DOUBLE / predicted) * (tp::DOUBLE / support)
                / (tp::DOUBLE / predicted + tp::DOUBLE / support) ELSE 0.0::DOUBLE END AS f1, support, predicted, tp
            FROM (SELECT model, class, count(*) FILTER (true_label = class AND predicted_label = class) AS tp,
              count(*) FILTER (true_label = class) AS support, count(*) FILTER (predicted_label = class) AS predicted
              FROM {source}, classes GROUP BY model, class)"""),
        "avgs": (("pc",), """
            SELECT model, avg(precision) FILTER (support + predicted > 0) AS macro_precision,
              avg(recall) FILTER (support + predicted > 0) AS macro_recall, avg(f1) FILTER (support + predicted > 0) AS macro_f1,
              sum(f1 * support) / sum(support) AS weighted_f1, sum(precision * support) / sum(support) AS weighted_precision,
              sum(recall * support) / sum(support) AS weighted_recall, CAST(sum(support) AS BIGINT) AS rows FROM pc GROUP BY model"""),
        "acc": ((source,), f"SELECT model, avg(CASE WHEN correct THEN 1 ELSE 0 END) AS accuracy, count(*) AS rows FROM {source} GROUP BY model"),
        "bin": ((source,), f"""
            SELECT *, fp::DOUBLE / greatest(fp + tn, 1) AS false_positive_rate, fn::DOUBLE / greatest(fn + tp, 1) AS false_negative_rate,
              tp::DOUBLE / greatest(tp + fn, 1) AS attack_recall
            FROM (SELECT model, count(*) FILTER (true_label <> '1' AND predicted_label <> '1') AS tn,
              count(*) FILTER (true_label <> '1' AND predicted_label = '1') AS fp,
              count(*) FILTER (true_label = '1' AND predicted_label <> '1') AS fn,
              count(*) FILTER (true_label = '1' AND predicted_label = '1') AS tp FROM {source} GROUP BY model)"""),
        "ranked": ((source,), f"""
            SELECT *, coalesce(sum(neg) OVER (PARTITION BY model ORDER BY p1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS neg_below,
              sum(pos) OVER (PARTITION BY model ORDER BY p1 DESC) AS tps, sum(pos + neg) OVER (PARTITION BY model ORDER BY p1 DESC) AS flagged
            FROM (SELECT model, p1, count(*) FILTER (true_label = '1') AS pos, count(*) FILTER (true_label <> '1') AS neg
              FROM {source} GROUP BY model, p1)"""),
        "auc": (("ranked",), """
            SELECT model, sum(pos * (neg_below + neg / 2.0::DOUBLE)) / (sum(pos)::DOUBLE * sum(neg)::DOUBLE) AS roc_auc,
              sum(pos::DOUBLE * (tps::DOUBLE / flagged::DOUBLE)) / sum(pos)::DOUBLE AS pr_auc FROM ranked GROUP BY model"""),
        "edges": ((), "SELECT * FROM (VALUES " + ", ".join(
            f"({i}, '{EV.bin_edges()[i]!r}'::DOUBLE, '{EV.bin_edges()[i + 1]!r}'::DOUBLE)" for i in range(10)) + ") AS e(bin, lower, upper)"),
        "bins": ((source, "edges"), f"""
            SELECT m.model, bin, lower, upper, count(s.confidence) AS rows, avg(s.confidence) AS mean_confidence,
              avg(CASE WHEN s.correct THEN 1.0::DOUBLE WHEN NOT s.correct THEN 0.0::DOUBLE END) AS accuracy,
              abs(avg(s.confidence) - avg(CASE WHEN s.correct THEN 1.0::DOUBLE WHEN NOT s.correct THEN 0.0::DOUBLE END)) AS gap
            FROM (SELECT DISTINCT model FROM {source}) m CROSS JOIN edges LEFT JOIN {source} s
              ON s.model = m.model AND s.confidence >= lower AND (s.confidence < upper OR (bin = 9 AND s.confidence <= 1.0::DOUBLE))
            GROUP BY m.model, bin, lower, upper"""),
        "wide": (("scored",), """
            SELECT sample_id, max(predicted_label) FILTER (model = 'primary') AS "primary",
              max(predicted_label) FILTER (model = 'random_forest') AS random_forest,
              max(predicted_label) FILTER (model = 'logistic_regression') AS logistic_regression FROM scored GROUP BY sample_id"""),
        "joined": (("scored", "wide"), "SELECT s.*, w.\"primary\", w.random_forest, w.logistic_regression FROM scored s JOIN wide w USING (sample_id) WHERE model = 'primary'"),
        "risk": (("joined",), """
            SELECT *, confidence + CASE WHEN NOT correct THEN 0.25::DOUBLE ELSE 0.0::DOUBLE END
              + CASE WHEN predicted_label <> 'BENIGN' THEN 0.15::DOUBLE ELSE 0.0::DOUBLE END AS risk_score,
              random_forest = predicted_label AND logistic_regression = predicted_label AS models_agree FROM joined"""),
        "cohort": (("scored",), f"""
            SELECT sample_id, true_label, predicted_label, confidence, 1 - confidence AS uncertainty, correct,
              p0 AS p_BENIGN, p1 AS "p_DoS", p2 AS "p_PortScan",
              {", ".join(f"{f}::DOUBLE AS {f}" for f in _EVIDENCE_FEATURES)}, {_EVIDENCE} AS evidence
            FROM (SELECT *, CASE WHEN qty_sum IS NULL THEN 1 ELSE 0 END + CASE WHEN qty_max IS NULL THEN 1 ELSE 0 END AS miss
              FROM (SELECT * REPLACE (CASE WHEN sample_id % 3 <> 0 THEN qty_sum END AS qty_sum,
                CASE WHEN sample_id % 13 <> 0 THEN qty_max END AS qty_max) FROM scored WHERE model = 'primary'))"""),
    }


_MULTI = _classes_cte(CLASSES, "scored")
_BIN = _classes_cte(BINARY, "scored_binary")


def _m(body: str, *views: str) -> str:
    return with_views(body, views, _MULTI)


def _b(body: str, *views: str) -> str:
    return with_views(body, views, _BIN)


def _confusion_sql(source: str) -> str:
    return f"""SELECT m.model, t.class AS true_label, p.class AS predicted_label, count(s.sample_id) AS n
      FROM (SELECT DISTINCT model FROM {source}) m CROSS JOIN classes t CROSS JOIN classes p LEFT JOIN {source} s
        ON s.model = m.model AND s.true_label = t.class AND s.predicted_label = p.class GROUP BY m.model, t.class, p.class"""


def _r(*names: str) -> str:
    return ", ".join(f"round({n}, 9) AS {n}" for n in names)


# one sample with as many features as a capture has: 78 values from its key
_WIDE_SAMPLE = f"""SELECT sample_id, {", ".join(f'CAST(sample_id * {i} % 1009 AS DOUBLE) AS f{i}' for i in range(1, 79))}
    FROM labelled_flows WHERE sample_id = {LOOKUP}"""
_BINS_OUT = ["mean_confidence", "accuracy", "gap"]
_COHORT = "SELECT * FROM cohort"
_P = [f"p_{c}" for c in CLASSES]

Q: dict[str, tuple] = {
    "m7_m8_prediction": (
        lambda s, d: predictions(s, d).select("model", "sample_id", "predicted_label", "confidence", "correct"),
        _m("SELECT model, sample_id, predicted_label, confidence, correct FROM scored", "scored")),
    "m9_m10_uncertainty": (
        lambda s, d: predictions(s, d).select(
            "model", "sample_id", F.round(C.normalised_entropy(F.col("probability"), 3), 9).alias("entropy"),
            (1 - F.col("confidence")).alias("uncertainty")),
        _m("""SELECT model, sample_id, round(-(p0 * ln(p0) + p1 * ln(p1) + p2 * ln(p2)) / ln(3.0::DOUBLE), 9) AS entropy,
          1 - confidence AS uncertainty FROM scored""", "scored")),
    "m11_m14_records": (records, _m("""
        SELECT sample_id, predicted_label AS prediction, predicted_label <> 'BENIGN' AS is_attack, confidence,
          round(-(p0 * ln(p0) + p1 * ln(p1) + p2 * ln(p2)) / ln(3.0::DOUBLE), 9) AS uncertainty, random_forest, logistic_regression,
          random_forest = predicted_label AND logistic_regression = predicted_label AS models_agree,
          confidence < 0.9::DOUBLE OR NOT (random_forest = predicted_label AND logistic_regression = predicted_label) AS should_investigate,
          p0 AS "p_BENIGN", p1 AS "p_DoS", p2 AS "p_PortScan" FROM joined""", "joined")),
    "m11_without_baselines": (lone_records, _m("""
        SELECT sample_id, true AS models_agree, confidence < 0.9::DOUBLE AS should_investigate FROM scored WHERE model = 'primary'""", "scored")),
    "m15_evidence": (evidence, _m("SELECT sample_id, evidence FROM cohort", "cohort")),
    "m16_file_summary": (
        lambda s, d: _round(SC.file_summary(primary(s, d), "Label", ~C.is_benign(F.col("predicted_label"))), 9, "accuracy"),
        _m("""SELECT count(*) AS rows, count(*) FILTER (predicted_label <> 'BENIGN') AS attack_predictions,
          count(*) FILTER (predicted_label = 'BENIGN') AS benign_predictions,
          round(sum(CASE WHEN trim(Label) = predicted_label THEN 1 ELSE 0 END)::DOUBLE / greatest(count(*), 1), 9) AS accuracy
          FROM scored WHERE model = 'primary'""", "scored")),
    "m20_prediction_check": (
        lambda s, d: SC.prediction_check(primary(s, d), "Label", ["sample_id"]),
        _m("SELECT sample_id, Label AS expected_label, predicted_label, Label = predicted_label AS is_correct FROM scored WHERE model = 'primary'",
           "scored")),
    "e1_accuracy": (lambda s, d: _round(EV.accuracy(predictions(s, d)), 9, "accuracy"),
                    _m(f"SELECT model, {_r('accuracy')} FROM acc", "acc")),
    "e2_confusion": (confusion, _m(_confusion_sql("scored"), "scored", "classes")),
    "e2_confusion_binary": (lambda s, d: confusion(s, d, True), _b(_confusion_sql("scored_binary"), "scored_binary", "classes")),
    "e3_per_class": (lambda s, d: EV.per_class(pairs(s, d), CLASSES), _m("SELECT * FROM pc", "pc")),
    "e4_e5_averages": (
        lambda s, d: _round(EV.averages(EV.per_class(pairs(s, d))).drop("accuracy"), 9, "macro_precision", "macro_recall", "macro_f1",
                            "weighted_f1", "weighted_precision", "weighted_recall"),
        _m("SELECT model, rows, " + _r("macro_precision", "macro_recall", "macro_f1", "weighted_f1", "weighted_precision",
                                       "weighted_recall") + " FROM avgs", "avgs")),
    "e6_binary_rates": (lambda s, d: EV.binary_counts(pairs(s, d, True), "1"), _b("SELECT * FROM bin", "bin")),
    "e7_e8_ranking": (
        lambda s, d: _round(EV.ranking(predictions(s, d, True), "1"), 9, "roc_auc", "pr_auc"),
        _b(f"SELECT model, {_r('roc_auc', 'pr_auc')} FROM auc", "auc")),
    "e9_attack_recall": (lambda s, d: EV.attack_recall(pairs(s, d)), _m("""
        SELECT model, count(*) FILTER (true_label <> 'BENIGN' AND predicted_label <> 'BENIGN')::DOUBLE
          / greatest(count(*) FILTER (true_label <> 'BENIGN'), 1) AS attack_recall FROM scored GROUP BY model""", "scored")),
    "e10_reliability_bins": (
        lambda s, d: _round(EV.reliability_bins(predictions(s, d)), 9, *_BINS_OUT),
        _m(f"SELECT model, bin, lower, upper, rows, {_r(*_BINS_OUT)} FROM bins", "bins")),
    "e11_calibration_error": (
        lambda s, d: _round(EV.calibration_error(EV.reliability_bins(predictions(s, d))), 9, "ece"),
        _m("SELECT model, round(sum(gap * rows) / sum(rows), 9) AS ece FROM bins GROUP BY model", "bins")),
    "e12_brier_binary": (
        lambda s, d: _round(EV.brier(predictions(s, d, True), BINARY), 9, "brier_score"),
        _b("SELECT model, round(avg(pow(p1 - CASE WHEN true_label = '1' THEN 1 ELSE 0 END, 2)), 9) AS brier_score "
           "FROM scored_binary GROUP BY model", "scored_binary")),
    "e13_brier_multiclass": (
        lambda s, d: _round(EV.brier(predictions(s, d), CLASSES), 9, "brier_score"),
        _m("SELECT model, round(avg(" + " + ".join(f"pow(p{i} - CASE WHEN true_label = '{c}' THEN 1 ELSE 0 END, 2)" for i, c in enumerate(CLASSES))
           + "), 9) AS brier_score FROM scored GROUP BY model", "scored")),
    "e14_confidence_accuracy": (
        lambda s, d: _round(EV.confidence_accuracy(predictions(s, d)), 9, "mean_confidence", "accuracy"),
        _m("SELECT model, round(avg(confidence), 9) AS mean_confidence, round(avg(CASE WHEN correct THEN 1 ELSE 0 END), 9) AS accuracy, "
           "count(*) AS samples FROM scored GROUP BY model", "scored")),
    "e15_comparison_binary": (
        lambda s, d: _round(comparison(s, d, True), 9, *_METRICS),
        _b(f"SELECT model, avgs.rows AS inference_rows, {_r(*_METRICS)} FROM acc JOIN avgs USING (model) JOIN bin USING (model) JOIN auc USING (model)",
           "acc", "avgs", "bin", "auc")),
    "e15_comparison_multiclass": (
        lambda s, d: _round(comparison(s, d, False), 9, *_METRICS),
        _m("""SELECT model, avgs.rows AS inference_rows, round(accuracy, 9) AS accuracy, round(macro_precision, 9) AS macro_precision,
          round(macro_recall, 9) AS macro_recall, round(macro_f1, 9) AS macro_f1, round(weighted_f1, 9) AS weighted_f1,
          NULL::DOUBLE AS roc_auc, NULL::DOUBLE AS pr_auc, NULL::DOUBLE AS false_positive_rate, NULL::DOUBLE AS false_negative_rate,
          round(attack_recall, 9) AS attack_recall FROM acc JOIN avgs USING (model) JOIN (
            SELECT model, count(*) FILTER (true_label <> 'BENIGN' AND predicted_label <> 'BENIGN')::DOUBLE
              / greatest(count(*) FILTER (true_label <> 'BENIGN'), 1) AS attack_recall FROM scored GROUP BY model) USING (model)""",
           "acc", "avgs", "scored")),
    "e16_better_than": (
        lambda s, d: _round(EV.better_than(comparison(s, d, False), "primary", "random_forest"), 9, "primary_value", "baseline_value"),
        _m("""SELECT 'macro_f1' AS metric, round(a, 9) AS primary_value, round(b, 9) AS baseline_value,
          CASE WHEN a > b THEN 'better' ELSE 'worse or equal' END AS outcome
          FROM (SELECT max(macro_f1) FILTER (model = 'primary') AS a, max(macro_f1) FILTER (model = 'random_forest') AS b FROM avgs)""", "avgs")),
    "i12_metric_listing": (
        lambda s, d: EV.metrics_long(comparison(s, d, True)).withColumn("value", F.round("value", 9)),
        _b(f"""SELECT model, metric, value FROM (SELECT model, {_r(*_METRICS)}, avgs.rows::DOUBLE AS inference_rows
          FROM acc JOIN avgs USING (model) JOIN bin USING (model) JOIN auc USING (model))
          UNPIVOT INCLUDE NULLS (value FOR metric IN ({', '.join(_METRICS)}, inference_rows))""", "acc", "avgs", "bin", "auc")),
    "a11_class_coverage": (
        lambda s, d: PR.class_coverage(labelled_flows(s, d).filter("is_attack = 1"), "Label", CLASSES),
        _m("""SELECT count(DISTINCT Label) AS observed_classes, 3 AS expected_classes, count(DISTINCT Label) < 3 AS incomplete
          FROM labelled_flows WHERE is_attack = 1""", "labelled_flows")),
    "j1_j2_joined_predictions": (
        lambda s, d: joined(s, d).select("sample_id", "true_label", "confidence", *[C.quoted(m) for m in MODELS]),
        _m('SELECT sample_id, true_label, confidence, "primary", random_forest, logistic_regression FROM joined', "joined")),
    "i1_disagreement": (lambda s, d: IN.disagreement(joined(s, d), list(MODELS)), _m("""
        SELECT sample_id, "primary", random_forest, logistic_regression, true AS disagreement, true_label, confidence AS primary_confidence
        FROM joined WHERE NOT ("primary" = random_forest AND "primary" = logistic_regression) ORDER BY sample_id LIMIT 25""", "joined")),
    "i2_high_risk": (lambda s, d: IN.high_risk(joined(s, d), list(MODELS), S.clamp_limit(500)), _m("""
        SELECT sample_id, predicted_label, true_label, risk_score, confidence, 1 - confidence AS uncertainty, models_agree,
          "primary", random_forest, logistic_regression, NOT correct AS historically_error_prone,
          NOT correct OR NOT models_agree AS should_investigate FROM risk ORDER BY risk_score DESC, confidence DESC, sample_id LIMIT 100""", "risk")),
    "i3_alert_columns": (
        lambda s, d: IN.risk_columns(joined(s, d), list(MODELS)).select(
            "sample_id", "risk_score", "uncertainty", "models_agree", "historically_error_prone", "should_investigate"),
        _m("""SELECT sample_id, risk_score, 1 - confidence AS uncertainty, models_agree, NOT correct AS historically_error_prone,
          NOT correct OR NOT models_agree AS should_investigate FROM risk""", "risk")),
    "i3_without_baselines": (
        lambda s, d: IN.risk_columns(primary(s, d), []).groupBy("models_agree", "should_investigate").agg(F.count("*").alias("rows")),
        _m("SELECT NULL::BOOLEAN AS models_agree, true AS should_investigate, count(*) AS rows FROM scored WHERE model = 'primary'", "scored")),
    "i4_i8_false_positives": (cohort(lambda r: IN.first_rows(IN.false_positives(r), S.clamp_limit(25))), _m(
        _COHORT + " WHERE true_label = 'BENIGN' AND NOT correct ORDER BY sample_id LIMIT 25", "cohort")),
    "i5_false_negatives": (cohort(lambda r: IN.first_rows(IN.false_negatives(r), S.clamp_limit(25))), _m(
        _COHORT + " WHERE true_label <> 'BENIGN' AND NOT correct ORDER BY sample_id LIMIT 25", "cohort")),
    "i6_high_confidence_errors": (cohort(lambda r: IN.high_confidence_errors(r, 25)), _m(
        _COHORT + " WHERE NOT correct ORDER BY confidence DESC, sample_id LIMIT 25", "cohort")),
    "i7_uncertain": (cohort(lambda r: IN.uncertain(r, 25)), _m(_COHORT + " ORDER BY confidence, sample_id LIMIT 25", "cohort")),
    "i8_cohort_rows": (cohort(lambda r: r), _m(_COHORT, "cohort")),
    "i9_sample": (wide_sample, _m(_WIDE_SAMPLE, "labelled_flows")),
    "i10_attack_summary": (lambda s, d: IN.attack_summary(EV.per_class(pairs(s, d), CLASSES)), _m("""
        SELECT model, class, precision, recall, f1, support, support AS class_rows,
          CAST(sum(support) OVER (PARTITION BY model) AS BIGINT) AS attack_rows, row_number() OVER (PARTITION BY model ORDER BY recall, class) = 1 AS is_hardest
        FROM pc WHERE class <> 'BENIGN'""", "pc")),
}
