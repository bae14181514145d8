"""The offline run: sample, split, fit, score, evaluate, keep.

What a long-lived process would hold in memory is written as tables: the split rows, the
held-out predictions of every model and one experiment row. Every later question is a
query over those tables.
"""

from __future__ import annotations

import time
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from ..errors import FlowLensError
from ..functions.columns import quoted, valid_label
from ..operators import evaluate as EV
from ..operators import profile as PR
from ..operators import sample as SM
from ..operators import train as TR
from ..operators.score import with_prediction
from ..sources.sinks import append_experiment
from ..workspace import run_folder, staged


@dataclass
class Experiment:
    """Tables and models of one run."""

    label: str
    features: list[str]
    classes: list[str]
    rows: DataFrame
    predictions: DataFrame
    models: dict[str, TR.FittedModel]
    score_seconds: dict[str, float] = field(default_factory=dict)

    @property
    def train(self) -> DataFrame:
        return self.rows.filter("split = 'train'")

    @property
    def test(self) -> DataFrame:
        return self.rows.filter("split = 'test'")

    def comparison(self) -> DataFrame:
        """Metrics per model on the held-out rows, with fit and scoring seconds apart."""
        table = EV.comparison(self.predictions, self.classes, self.label)

        def seconds(values: dict[str, float]):
            return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])[F.col("model")]

        return table.withColumn("fit_seconds", seconds({n: m.fit_seconds for n, m in self.models.items()})).withColumn(
            "inference_seconds", seconds(self.score_seconds))

    def reliability(self) -> DataFrame:
        bins = EV.reliability_bins(self.predictions)
        scores = EV.calibration_error(bins).join(EV.brier(self.predictions, self.classes), "model").join(
            EV.confidence_accuracy(self.predictions).withColumnRenamed("accuracy", "sample_accuracy")
            .withColumnRenamed("mean_confidence", "sample_confidence"), "model")
        return bins.join(scores, "model")

    def save(self, path: str) -> None:
        primary = next(iter(self.models.values()))
        append_experiment(
            self.rows.sparkSession, path, EV.metrics_long(self.comparison()), self.reliability(),
            PR.column_profile(self.rows), primary.describe(),
        )


def usable_rows(rows: DataFrame, label: str) -> DataFrame:
    """Rows with a label, the label as trimmed text."""
    return rows.filter(valid_label(quoted(label))).withColumn(label, F.trim(quoted(label).cast("string")))


def run_experiment(
    rows: DataFrame,
    label: str | None = None,
    sample_id: str = "sample_id",
    models: Sequence[str] = TR.MODEL_NAMES,
    max_fit_rows: int | None = None,
    test_size: float = S.TEST_SIZE,
    trees: int = 200,
    depth: int = 10,
) -> Experiment:
    """Fit the models on one fixed split and keep their held-out predictions.

    All labelled rows are split, the models are fitted on all training rows, and all held-out rows
    are scored. Only a caller that passes ``max_fit_rows`` fits on fewer rows, the classes cut to equal caps.
    ``trees`` and ``depth`` are those of the forests; a primary model of several classes is a
    forest two levels deeper.
    """
    label = S.detect_label(rows.columns, label)
    features = [f for f in S.numeric_features(rows.schema, label) if f != sample_id]
    if not features:
        raise FlowLensError("The table has no numeric column left to train on.")
    # the split and the caps read the rows several times, and every fit the training rows: each is computed once
    labelled = staged(usable_rows(rows.select(sample_id, *[quoted(f) for f in features], quoted(label)), label), "labelled")
    split = staged(SM.with_split(labelled, label, sample_id, test_size), "split")
    path = run_folder(rows.sparkSession, "predictions")
    train = split.filter("split = 'train'")
    if max_fit_rows is not None:
        train = staged(SM.capped_by_class(train, label, sample_id, max_fit_rows), "fitted")
    medians = TR.exact_medians(train, features)
    known = {f: m for f, m in medians.items() if m is not None}
    points = TR.split_points(train, label, known) if set(models) & set(TR.TREE_NAMES) else None
    fitted: dict[str, TR.FittedModel] = {}
    seconds: dict[str, float] = {}
    for name in models:
        model = TR.fit(name, train, features, label, trees, depth, medians, points)
        start = time.perf_counter()
        scored = TR.score(model, split.filter("split = 'test'")).withColumn("true_label", quoted(label))
        with_prediction(scored, model.classes).write.parquet(f"{path}/model={name}")
        seconds[name] = time.perf_counter() - start
        fitted[name] = model
    predictions = rows.sparkSession.read.option("basePath", path).parquet(path)
    classes = list(next(iter(fitted.values())).classes)
    return Experiment(label, features, classes, split, predictions, fitted, seconds)
