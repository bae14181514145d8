"""Evaluation of predictions, every metric grouped by model.

Input rows: ``model, sample_id, true_label, predicted_label, confidence, correct`` and the
``probability`` array in class order. Everything but the ranking metrics comes from counts
that are combined on the map side, so a class with nearly all rows costs nothing extra.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from ..functions.columns import is_benign, safe_ratio
from ..functions.prefix import ordered_prefix
from ..workspace import staged

WIDE = "decimal(38,0)"


def positive_class(classes: Sequence[str], label_column: str = "Label") -> str:
    """The attack class of a binary model; the second class when none or both are benign."""
    benign = {S.BENIGN} | ({"0"} if label_column.lower() == "is_attack" else set())
    attacks = [c for c in classes if c.strip().upper() not in benign]
    return attacks[0] if len(attacks) == 1 else classes[1]


def accuracy(predictions: DataFrame) -> DataFrame:
    return predictions.groupBy("model").agg(F.avg(F.col("correct").cast("int")).alias("accuracy"))


def pair_counts(predictions: DataFrame, classes: Sequence[str]) -> DataFrame:
    """Count of the (true, predicted) pairs of known classes that occur; enough for every metric."""
    known = [F.col(c).isin(list(classes)) for c in ("true_label", "predicted_label")]
    return predictions.filter(known[0] & known[1]).groupBy("model", "true_label", "predicted_label").agg(F.count("*").alias("n"))


def confusion(predictions: DataFrame, classes: Sequence[str]) -> DataFrame:
    """Count of every (true, predicted) class pair, zeros included, from one pass."""
    names = F.array(*[F.lit(c) for c in classes])
    zero = F.lit(0).cast("bigint").alias("n")
    zeros = F.flatten(F.transform(names, lambda t: F.transform(names, lambda p: F.struct(
        t.alias("true_label"), p.alias("predicted_label"), zero))))
    cell = F.struct("true_label", "predicted_label", "n")
    # per model one array of the pairs seen and one of zeros, from the class list alone
    seen = pair_counts(predictions, classes).groupBy("model").agg(F.collect_list(cell).alias("cells"))
    every = seen.select("model", F.inline(F.concat("cells", zeros)))
    return every.groupBy("model", "true_label", "predicted_label").agg(F.sum("n").alias("n"))


def _f1(precision: Column, recall: Column) -> Column:
    return safe_ratio(2 * precision * recall, precision + recall)


def per_class(cells: DataFrame, classes: Sequence[str] | None = None) -> DataFrame:
    """Precision, recall, F1 and support per class from pair counts; 0 when undefined.

    With ``classes`` every class has a row, also one that no pair of ``cells`` names.
    """
    hit = F.when(F.col("true_label") == F.col("predicted_label"), F.col("n")).otherwise(0)
    zero = F.lit(0).cast("bigint")
    sides = F.array(
        F.struct(F.col("true_label").alias("class"), F.col("n").alias("support"), zero.alias("predicted"), hit.alias("tp")),
        F.struct(F.col("predicted_label").alias("class"), zero.alias("support"), F.col("n").alias("predicted"), zero.alias("tp")),
    )
    rows = cells.select("model", F.inline(sides))
    if classes is not None:
        named = cells.select("model").distinct().select("model", F.explode(F.array(*[F.lit(c) for c in classes])).alias("class"))
        rows = rows.unionByName(named.select("model", "class", *[zero.alias(c) for c in ("support", "predicted", "tp")]))
    sums = rows.groupBy("model", "class").agg(
        F.sum("support").alias("support"), F.sum("predicted").alias("predicted"), F.sum("tp").alias("tp")
    )
    precision, recall = safe_ratio(F.col("tp"), F.col("predicted")), safe_ratio(F.col("tp"), F.col("support"))
    return sums.select(
        "model", "class", precision.alias("precision"), recall.alias("recall"),
        _f1(precision, recall).alias("f1"), "support", "predicted", "tp",
    )


def averages(classes_table: DataFrame) -> DataFrame:
    """Macro averages over classes seen in truth or prediction, and support-weighted ones."""
    seen = F.col("support") + F.col("predicted") > 0
    out = []
    for metric in ("precision", "recall", "f1"):
        value = F.when(seen, F.col(metric))
        out.append(F.avg(value).alias(f"macro_{metric}"))
        out.append((F.sum(value * F.col("support")) / F.sum("support")).alias(f"weighted_{metric}"))
    out.append((F.sum("tp") / F.sum("support")).alias("accuracy"))
    return classes_table.groupBy("model").agg(*out, F.sum("support").alias("rows"))


def binary_counts(cells: DataFrame, positive: str) -> DataFrame:
    """tn, fp, fn, tp and their rates with denominators of at least 1."""
    true, pred = F.col("true_label") == positive, F.col("predicted_label") == positive

    def total(cond: Column) -> Column:
        return F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0))

    counts = cells.groupBy("model").agg(
        total(~true & ~pred).alias("tn"), total(~true & pred).alias("fp"),
        total(true & ~pred).alias("fn"), total(true & pred).alias("tp"),
    )

    def rate(part: str, other: str) -> Column:
        return F.col(part) / F.greatest(F.col(part) + F.col(other), F.lit(1))

    return counts.select(
        "*",
        rate("fp", "tn").alias("false_positive_rate"),
        rate("fn", "tp").alias("false_negative_rate"),
        rate("tp", "fn").alias("attack_recall"),
    )


def attack_recall(cells: DataFrame, label_column: str = "Label") -> DataFrame:
    """Share of attack rows predicted as any attack class."""
    true = ~is_benign(F.col("true_label"), label_column)
    pred = ~is_benign(F.col("predicted_label"), label_column)
    hits = F.coalesce(F.sum(F.when(true & pred, F.col("n"))), F.lit(0))
    attacks = F.coalesce(F.sum(F.when(true, F.col("n"))), F.lit(0))
    return cells.groupBy("model").agg((hits / F.greatest(attacks, F.lit(1))).alias("attack_recall"))


def ranking(predictions: DataFrame, positive: str, positive_index: int = 1) -> DataFrame:
    """ROC-AUC (ties averaged) and average precision (step-wise) of a binary score.

    Rows are first combined per score, so tied scores are one row; cumulative counts then
    come from the bucketed prefix sum and no task sorts the whole table.
    """
    hit = (F.col("true_label") == positive).cast("bigint")
    by_score = (
        predictions.groupBy("model", F.element_at("probability", positive_index + 1).alias("score"))
        .agg(F.sum(hit).alias("pos"), F.sum(1 - hit).alias("neg"))
    )
    ranked = ordered_prefix(staged(by_score, "scores"), ["model"], "score", {"pos_below": "pos", "neg_below": "neg"})
    pos, neg = F.col("pos"), F.col("neg")
    total_pos, total_neg = F.col("pos_below_all"), F.col("neg_below_all")
    # twice the number of (positive, negative) pairs in the right order, ties counting one half
    pairs = (pos.cast(WIDE) * (2 * F.col("neg_below") + neg)).cast(WIDE)
    above_pos = total_pos - F.col("pos_below")
    above_all = above_pos + total_neg - F.col("neg_below")
    return ranked.groupBy("model").agg(
        F.when(
            (F.max(total_pos) > 0) & (F.max(total_neg) > 0),
            F.sum(pairs).cast("double")
            / (F.lit(2.0) * F.max(total_pos).cast("double") * F.max(total_neg).cast("double")),
        ).alias("roc_auc"),
        F.when(
            F.max(total_pos) > 0,
            F.sum(pos * above_pos / F.greatest(above_all, F.lit(1))) / F.max(total_pos),
        ).alias("pr_auc"),
    )


def bin_edges(bins: int = 10) -> list[float]:
    """Equal edges over 0..1, each computed as i * width, the last exactly 1."""
    return [i * (1.0 / bins) for i in range(bins)] + [1.0]


def reliability_bins(predictions: DataFrame, bins: int = 10) -> DataFrame:
    """Half-open confidence bins (the last closed): count, mean confidence, accuracy, gap."""
    edges = bin_edges(bins)
    confidence = F.col("confidence")
    place = sum([(confidence >= e).cast("int") for e in edges[2:-1]], (confidence >= edges[1]).cast("int"))
    filled = predictions.groupBy("model", place.alias("bin")).agg(
        F.count("*").alias("rows"),
        F.avg("confidence").alias("mean_confidence"),
        F.avg(F.col("correct").cast("int")).alias("accuracy"),
    )
    stats = F.struct("rows", "mean_confidence", "accuracy")
    # at most one entry per bin
    by_bin = filled.groupBy("model").agg(F.map_from_entries(F.collect_list(F.struct("bin", stats))).alias("bins"))
    frame = by_bin.select(
        "model",
        F.inline(F.array(*[
            F.struct(
                F.lit(i).alias("bin"), F.lit(edges[i]).alias("lower"), F.lit(edges[i + 1]).alias("upper"),
                F.try_element_at("bins", F.lit(i)).alias("found"),
            )
            for i in range(bins)
        ])),
    )
    return frame.select(
        "model", "bin", "lower", "upper", F.coalesce("found.rows", F.lit(0)).alias("rows"),
        "found.mean_confidence", "found.accuracy",
        F.abs(F.col("found.mean_confidence") - F.col("found.accuracy")).alias("gap"),
    )


def calibration_error(bins_table: DataFrame) -> DataFrame:
    return bins_table.groupBy("model").agg((F.sum(F.col("gap") * F.col("rows")) / F.sum("rows")).alias("ece"))


def brier(predictions: DataFrame, classes: Sequence[str], positive_index: int = 1) -> DataFrame:
    """Mean squared error of the positive probability, or of all classes when more than two."""
    p, true = F.col("probability"), F.col("true_label")
    if len(classes) == 2:
        hit = (true == classes[positive_index]).cast("double")
        loss = F.pow(F.element_at(p, positive_index + 1) - hit, 2)
    else:
        loss = sum(
            [F.pow(F.element_at(p, i + 1) - (true == c).cast("double"), 2) for i, c in enumerate(classes)][1:],
            F.pow(F.element_at(p, 1) - (true == classes[0]).cast("double"), 2),
        )
    return predictions.groupBy("model").agg(F.avg(loss).alias("brier_score"))


def confidence_accuracy(predictions: DataFrame) -> DataFrame:
    return predictions.groupBy("model").agg(
        F.avg("confidence").alias("mean_confidence"),
        F.avg(F.col("correct").cast("int")).alias("accuracy"),
        F.count("*").alias("samples"),
    )


def comparison(predictions: DataFrame, classes: Sequence[str], label_column: str = "Label") -> DataFrame:
    """One row of metrics per model on the same split."""
    cells = pair_counts(predictions, classes)
    table = averages(per_class(cells))
    if len(classes) == 2:
        positive = positive_class(classes, label_column)
        table = table.join(binary_counts(cells, positive), "model").join(
            ranking(predictions, positive, list(classes).index(positive)), "model"
        )
    else:
        none = F.lit(None).cast("double")
        table = table.join(attack_recall(cells, label_column), "model").withColumns({
            "roc_auc": none, "pr_auc": none, "false_positive_rate": none, "false_negative_rate": none,
        })
    return table.select(
        "model", "accuracy", "macro_precision", "macro_recall", "macro_f1", "weighted_f1", "roc_auc", "pr_auc",
        "false_positive_rate", "false_negative_rate", "attack_recall", F.col("rows").alias("inference_rows"),
    )


def metrics_long(table: DataFrame) -> DataFrame:
    """(model, metric, value) rows of a comparison table."""
    names = [c for c in table.columns if c != "model"]
    return table.select("model", *[F.col(c).cast("double").alias(c) for c in names]).unpivot(
        "model", names, "metric", "value"
    )


def better_than(table: DataFrame, primary: str, baseline: str, metric: str = "macro_f1") -> DataFrame:
    """Whether the primary model is strictly better than the baseline on one metric."""
    def value(name: str) -> Column:
        return F.coalesce(F.max(F.when(F.col("model") == name, F.col(metric))), F.lit(0.0))

    return table.agg(value(primary).alias("primary_value"), value(baseline).alias("baseline_value")).select(
        F.lit(metric).alias("metric"), "primary_value", "baseline_value",
        F.when(F.col("primary_value") > F.col("baseline_value"), S.BETTER).otherwise(S.NOT_BETTER).alias("outcome"),
    )
