"""Investigation queries over held-out predictions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from ..errors import FlowLensError
from ..functions import columns as C


def side_by_side(predictions: DataFrame, models: Sequence[str]) -> DataFrame:
    """One row per sample with each model's label in a column of its name."""
    return predictions.groupBy("sample_id").agg(*[
        F.max(F.when(F.col("model") == m, F.col("predicted_label"))).alias(m) for m in models
    ])


def with_baselines(primary: DataFrame, baselines: DataFrame) -> DataFrame:
    """Primary predictions with the baselines' labels (1:1 by sample, null where a baseline has none)."""
    return primary.join(baselines, "sample_id", "left")


def disagreement(joined: DataFrame, models: Sequence[str], limit: int = 25) -> DataFrame:
    """Samples on which the models give more than one label."""
    labels = F.array_compact(F.array(*[C.quoted(m) for m in models]))
    return (
        joined.filter(F.size(F.array_distinct(labels)) > 1)
        .select("sample_id", *models, F.lit(True).alias("disagreement"), "true_label",
                F.col("confidence").alias("primary_confidence"))
        .orderBy("sample_id").limit(limit)
    )


def risk_score(label_column: str = "Label") -> Column:
    wrong = F.when(~F.col("correct"), S.ERROR_RISK).otherwise(0.0)
    attack = F.when(~C.is_benign(F.col("predicted_label"), label_column), S.ATTACK_RISK).otherwise(0.0)
    return F.col("confidence") + wrong + attack


def risk_columns(joined: DataFrame, models: Sequence[str], label_column: str = "Label") -> DataFrame:
    """Risk, uncertainty, agreement and review flag of every prediction.

    Without baselines ``models_agree`` is null and every row is to be investigated.
    """
    if models:
        labels = F.array_compact(F.array(*[C.quoted(m) for m in models]))
        agree = F.size(F.array_distinct(labels)) <= 1
    else:
        agree = F.lit(None).cast("boolean")
    return joined.select(
        "sample_id", "predicted_label", "true_label",
        risk_score(label_column).alias("risk_score"),
        "confidence",
        (1 - F.col("confidence")).alias("uncertainty"),
        agree.alias("models_agree"),
        *models,
        (~F.col("correct")).alias("historically_error_prone"),
        (~F.col("correct") | ~F.coalesce(agree, F.lit(False))).alias("should_investigate"),
    )


def high_risk(joined: DataFrame, models: Sequence[str], limit: int = 25, label_column: str = "Label") -> DataFrame:
    return risk_columns(joined, models, label_column).orderBy(
        F.desc("risk_score"), F.desc("confidence"), "sample_id"
    ).limit(limit)


def cohort_rows(rows: DataFrame, classes: Sequence[str], features: Sequence[str], n_features: int | None = 10) -> DataFrame:
    """Cohort shape: labels, confidence, probabilities, leading feature values, evidence."""
    shown = list(features) if n_features is None else list(features)[:n_features]
    return rows.select(
        "sample_id", "true_label", "predicted_label", "confidence",
        (1 - F.col("confidence")).alias("uncertainty"),
        "correct",
        C.probability_map(classes, F.col("probability")).alias("probabilities"),
        C.feature_map(shown).alias("feature_values"),
        C.evidence(features, F.col("confidence")).alias("evidence"),
    )


def false_positives(rows: DataFrame, label_column: str = "Label") -> DataFrame:
    """Benign rows predicted as something else."""
    return rows.filter(C.is_benign(F.col("true_label"), label_column) & ~F.col("correct"))


def false_negatives(rows: DataFrame, label_column: str = "Label") -> DataFrame:
    """Attack rows predicted wrongly, as benign or as another attack."""
    return rows.filter(~C.is_benign(F.col("true_label"), label_column) & ~F.col("correct"))


def high_confidence_errors(rows: DataFrame, limit: int = 25) -> DataFrame:
    return rows.filter(~F.col("correct")).orderBy(F.desc("confidence"), "sample_id").limit(limit)


def uncertain(rows: DataFrame, limit: int = 25) -> DataFrame:
    return rows.orderBy("confidence", "sample_id").limit(limit)


def first_rows(rows: DataFrame, limit: int = 25) -> DataFrame:
    return rows.orderBy("sample_id").limit(limit)


def sample(rows: DataFrame, sample_id: int) -> DataFrame:
    """The row of one sample; an id that is not among the held-out rows is an error."""
    found = rows.filter(F.col("sample_id") == sample_id)
    if found.isEmpty():
        raise FlowLensError(f"There is no held-out sample {sample_id}.")
    return found


def attack_summary(classes_table: DataFrame, label_column: str = "Label") -> DataFrame:
    """Per attack class its rows, precision, recall, F1; the hardest has the lowest recall, first in class order.

    ``class_rows`` and ``attack_rows`` count the true rows of the class and of all attack classes.
    """
    attacks = classes_table.filter(~C.is_benign(F.col("class"), label_column))
    hardest = attacks.groupBy("model").agg(
        F.min_by("class", F.struct("recall", "class")).alias("hardest_attack")
    )
    every = attacks.groupBy("model").agg(F.sum("support").alias("attack_rows"))
    return attacks.join(hardest, "model").join(every, "model").select(
        "model", "class", "precision", "recall", "f1", "support", F.col("support").alias("class_rows"), "attack_rows",
        (F.col("class") == F.col("hardest_attack")).alias("is_hardest"),
    )
