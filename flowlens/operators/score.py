"""From class probabilities to predictions, agreement, records and file summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from ..functions import columns as C


def with_prediction(
    df: DataFrame, classes: Sequence[str], probability: str = "probability", truth: str | None = "true_label"
) -> DataFrame:
    """Add ``predicted_label``, ``confidence`` and, when the truth is known, ``correct``."""
    p = F.col(probability)
    out = df.withColumn("confidence", F.array_max(p))
    out = out.withColumn("predicted_label", C.arg_max(classes, p, F.col("confidence")))
    if truth is not None:
        out = out.withColumn("correct", F.col("predicted_label") == F.col(truth))
    return out


def agreement(prediction: Column, baselines: Sequence[str]) -> tuple[Column, Column]:
    """The baselines' labels as a map, and whether all equal the prediction (true without any)."""
    if not baselines:
        return F.create_map().cast("map<string,string>"), F.lit(True)
    labels = F.create_map(*[x for b in baselines for x in (F.lit(b), C.quoted(b).cast("string"))])
    same = F.lit(True)
    for b in baselines:
        same = same & (C.quoted(b).cast("string") == prediction)
    return labels, same


def scored_records(
    df: DataFrame,
    classes: Sequence[str],
    features: Sequence[str],
    baselines: Sequence[str] = (),
    label_column: str = "Label",
    keep: Sequence[str] = ("sample_id",),
) -> DataFrame:
    """One analyst record per scored row; needs ``probability`` and one column per baseline."""
    df = with_prediction(df, classes, truth=None)
    labels, same = agreement(F.col("predicted_label"), baselines)
    return df.select(
        *keep,
        F.col("predicted_label").alias("prediction"),
        (~C.is_benign(F.col("predicted_label"), label_column)).alias("is_attack"),
        "confidence",
        C.normalised_entropy(F.col("probability"), len(classes)).alias("uncertainty"),
        labels.alias("model_agreement"),
        same.alias("models_agree"),
        ((F.col("confidence") < S.REVIEW_CONFIDENCE) | ~same).alias("should_investigate"),
        C.probability_map(classes, F.col("probability")).alias("probabilities"),
        C.evidence(features, F.col("confidence")).alias("evidence"),
    )


def align_to_model(records: DataFrame, features: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Records on the model's columns: absent ones null, others dropped, cells coerced to numbers."""
    types = dict(records.dtypes)

    def cell(name: str) -> Column:
        if name not in types:
            return F.lit(None).cast("double")
        if types[name] == "string":
            return C.numeric_cell(C.quoted(name))
        return C.finite(C.quoted(name).cast("double"))

    return records.select(*keep, *[cell(f).alias(f) for f in features])


def null_filled(df: DataFrame, features: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Feature values as doubles with 0 for a missing one."""
    return df.select(
        *keep, *[F.coalesce(C.finite(C.quoted(f).cast("double")), F.lit(0.0)).alias(f) for f in features]
    )


def file_summary(predictions: DataFrame, label: str | None = None, is_attack: Column | None = None) -> DataFrame:
    """Rows, attack and benign predictions, and text-equality accuracy when labels came along."""
    attack = is_attack if is_attack is not None else F.col("is_attack")
    aggs = [
        F.count("*").alias("rows"),
        F.count_if(attack).alias("attack_predictions"),
        F.count_if(~attack).alias("benign_predictions"),
    ]
    if label is not None:
        hit = F.coalesce((F.trim(C.quoted(label).cast("string")) == F.col("predicted_label")).cast("int"), F.lit(0))
        aggs.append((F.sum(hit) / F.greatest(F.count("*"), F.lit(1))).alias("accuracy"))
    return predictions.agg(*aggs)


def prediction_check(df: DataFrame, expected: str, keep: Sequence[str]) -> DataFrame:
    """Expected against predicted label of supplied rows."""
    return df.select(
        *keep,
        C.quoted(expected).cast("string").alias("expected_label"),
        "predicted_label",
        (C.quoted(expected).cast("string") == F.col("predicted_label")).alias("is_correct"),
    )
