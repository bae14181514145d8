"""Model fitting and scoring with Spark ML."""

from __future__ import annotations

import math
import time
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import Bucketizer, IndexToString, SQLTransformer, StringIndexerModel, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema as S
from ..errors import FlowLensError
from ..functions.columns import finite, quoted
from ..functions.prefix import class_counts, ordered_prefix
from ..workspace import staged

_ABOUT = "name string, features array<string>, used array<string>, classes array<string>, label_column string, fit_seconds double"
SKETCH_GROUPS = 64  # groups of partitions whose quantile sketches are merged first
SKETCH_SIZE = 4096  # entries of a sketch: ranks are within about 0.13 %
MODEL_NAMES = ("primary", "random_forest", "logistic_regression")
TREE_NAMES = ("primary", "random_forest")
BINS = 32  # of a feature, at most: a tree splits between them
MOST_BINS = 46_340  # its square is the largest that Spark ML counts rows with


def _values(df: DataFrame, features: Sequence[str]) -> DataFrame:
    return df.select(*[finite(quoted(f).cast("double")).alias(f"c{i}") for i, f in enumerate(features)])


def sketched(values: DataFrame, columns: Sequence[int], low: float, high: float) -> DataFrame:
    """One row: per column c<i> the number of its values (n<i>) and the values at two shares (q<i>), approximately."""
    k = F.lit(SKETCH_SIZE)
    groups = values.withColumn("_group", F.pmod(F.spark_partition_id(), F.lit(SKETCH_GROUPS))).groupBy("_group").agg(*[
        x for i in columns for x in (F.count(f"c{i}").alias(f"n{i}"), F.kll_sketch_agg_double(f"c{i}", k).alias(f"s{i}"))])
    merged = groups.agg(*[
        x for i in columns for x in (F.sum(f"n{i}").alias(f"n{i}"), F.kll_merge_agg_double(F.when(F.col(f"n{i}") > 0, F.col(f"s{i}"))).alias(f"s{i}"))])
    return merged.select(*[f"n{i}" for i in columns], *[
        F.when(F.col(f"n{i}") > 0, F.array(*[F.kll_sketch_get_quantile_double(f"s{i}", F.lit(r)) for r in (low, high)])).alias(f"q{i}") for i in columns])


def exact_medians(df: DataFrame, features: Sequence[str]) -> dict[str, float | None]:
    """Exact median of every column; None for a column without values.

    A pass of quantile sketches brackets each median, one pass counts what lies below the bracket,
    and only the values inside it are grouped and ranked. The ranks are checked, and the
    bracket is widened where they fall outside, up to the whole column. Sketches are merged in two
    levels, ``SKETCH_GROUPS`` groups of partitions first, so no task merges those of all partitions.
    """
    values = _values(df, features)
    out: dict[str, float | None] = {}
    todo, reach = list(range(len(features))), 0.002
    while todo:
        first = sketched(values, todo, max(0.0, 0.5 - reach), min(1.0, 0.5 + reach)).first()
        for i in [i for i in todo if first[f"n{i}"] == 0]:
            out[features[i]] = None
            todo.remove(i)
        if not todo:
            break
        low = {i: first[f"q{i}"][0] for i in todo}
        high = {i: first[f"q{i}"][1] for i in todo}
        below = values.agg(*[F.count_if(F.col(f"c{i}") < low[i]).alias(f"b{i}") for i in todo]).first()
        inside = values.select(F.explode(F.array(*[
            F.when(F.col(f"c{i}").between(low[i], high[i]), F.struct(F.lit(i).alias("col"), F.col(f"c{i}").alias("value")))
            for i in todo
        ])).alias("cell")).filter("cell IS NOT NULL").groupBy("cell.col", "cell.value").agg(F.count("*").alias("n"))
        # few rows by now, and ranking reads them three times
        ranked = ordered_prefix(staged(inside, "medians"), ["col"], "value", {"before": "n"})
        marks = {i: sorted({(first[f"n{i}"] + 1) // 2, first[f"n{i}"] // 2 + 1}) for i in todo}
        wanted = F.create_map(*[x for i in todo for x in (
            F.lit(i), F.array(F.lit(marks[i][0] - below[f"b{i}"]), F.lit(marks[i][-1] - below[f"b{i}"])))])
        place = wanted[F.col("col")]
        lies = [(place[k] > F.col("before")) & (place[k] <= F.col("before") + F.col("n")) for k in (0, 1)]
        found: dict[int, list[float]] = {}
        # at most two rows per column
        for r in ranked.select("col", "value", lies[0].alias("first"), lies[1].alias("second")).filter(
            F.col("first") | F.col("second")
        ).collect():
            found.setdefault(r["col"], []).extend([r["value"]] * (r["first"] + r["second"]))
        for i in list(todo):
            if len(found.get(i, [])) == 2:
                out[features[i]] = (found[i][0] + found[i][1]) / 2
                todo.remove(i)
        reach = min(0.5, reach * 10)
    return {f: out[f] for f in features}


def moments(df: DataFrame, features: Sequence[str], medians: Mapping[str, float]) -> dict[str, tuple[float, float]]:
    """Mean and population deviation of each imputed column, summed as one vector column."""
    filled = _values(df, features).fillna({f"c{i}": float(medians[f]) for i, f in enumerate(features)})
    vector = VectorAssembler(inputCols=filled.columns, outputCol="v").transform(filled)
    row = vector.select(Summarizer.metrics("mean", "variance", "count").summary(F.col("v")).alias("s")).select("s.*").first()
    n = row["count"]
    # the summarizer's variance is over n - 1
    spread = [math.sqrt(v * (n - 1) / n) for v in row["variance"]]
    return {f: (float(row["mean"][i]), spread[i]) for i, f in enumerate(features)}


def class_weights(counts: Mapping[str, int]) -> dict[str, float]:
    """Balanced weights: rows / (classes * rows of the class)."""
    total = sum(counts.values())
    return {c: total / (len(counts) * n) for c, n in counts.items()}


def split_points(df: DataFrame, label: str, medians: Mapping[str, float]) -> dict[str, list[float]]:
    """Per feature of ``medians`` (which impute it) where its bins but the first begin: what trees may split at.

    Spark ML draws some 10,000 rows for this; here every row counts, by its class's balanced weight. The bins are
    as even as the values allow, at most ``BINS``; a feature with no more values has a bin for each. A bin begins halfway
    between its least value and the value before.
    """
    features = list(medians)
    counts = class_counts(df, label)
    # whole numbers, so that sums do not depend on their order; BINS times the sum of two of them is a long
    unit = 1 << max(0, 56 - sum(counts.values()).bit_length())
    weights = F.create_map(*[x for c, w in class_weights(counts).items() for x in (F.lit(c), F.lit(round(w * unit)).cast("long"))])
    filled = df.select(weights[quoted(label).cast("string")].alias("n"), *[
        F.coalesce(finite(quoted(f).cast("double")), F.lit(float(medians[f]))).alias(f"c{i}") for i, f in enumerate(features)])
    cells = filled.select("n", F.inline(F.array(*[F.struct(F.lit(i).alias("col"), F.col(f"c{i}").alias("value")) for i in range(len(features))])))
    cells = staged(cells.groupBy("col", "value").agg(F.sum("n").alias("n"), F.lit(1).alias("one")), "values")
    ranked = ordered_prefix(cells, ["col"], "value", {"before": "n", "place": "one"})
    # the cuts wanted lie at multiples of 1 / BINS of the weight; each is moved to the nearer end of the value it falls into
    ranked = ranked.withColumn("upto", F.col("before") + F.col("n")).withColumns({
        "first": F.expr(f"before * {BINS} div before_all + 1"), "last": F.least(F.expr(f"upto * {BINS} div before_all"), F.lit(BINS - 1))})
    few, inside, ends = F.col("place_all") <= BINS, F.col("first") <= F.col("last"), (F.col("before") + F.col("upto")) * BINS
    start = (F.col("place") > 0) & (few | (inside & (2 * F.col("first") * F.col("before_all") < ends)))
    after = ~few & (F.col("upto") < F.col("before_all")) & inside & (2 * F.col("last") * F.col("before_all") >= ends)
    starts: dict[int, set[float]] = {i: set() for i in range(len(features))}
    # at most two rows per cut
    for r in ranked.select("col", "value", start.alias("start"), after.alias("after")).filter("start OR after").collect():
        starts[r["col"]] |= {x for x, there in ((r["value"], r["start"]), (math.nextafter(r["value"], math.inf), r["after"])) if there}
    begins = F.create_map(*[x for i, cuts in starts.items() for x in (F.lit(i), F.array(*[F.lit(c) for c in sorted(cuts)]).cast("array<double>"))])
    bins = cells.withColumn("bin", F.size(F.filter(begins[F.col("col")], lambda c: c <= F.col("value")))).groupBy("col", "bin").agg(
        F.min("value").alias("low"), F.max("value").alias("high"))
    out: dict[str, list[float]] = {f: [] for f in features}
    # a row per bin
    found = sorted((r["col"], r["low"], r["high"]) for r in bins.collect())
    for (i, _, high), (j, low, _) in zip(found[:-1], found[1:], strict=True):
        if i == j:
            middle = high / 2 + low / 2
            out[features[i]].append(middle if high < middle <= low else low)
    return out


@dataclass(frozen=True)
class FittedModel:
    """A fitted pipeline with what is needed to score and describe it."""

    name: str
    pipeline: PipelineModel
    features: tuple[str, ...]
    used: tuple[str, ...]
    classes: tuple[str, ...]
    label_column: str
    fit_seconds: float

    def describe(self) -> dict[str, str]:
        stage = self.pipeline.stages[-2]
        return {
            "model": self.name,
            "implementation": f"{type(stage).__module__}.{type(stage).__name__}",
            "label_column": self.label_column,
            "features": str(len(self.features)),
            "classes": ",".join(self.classes),
        }

    def save(self, path: str) -> None:
        """Keep the pipeline and its description in a folder, for another session or a restarted stream."""
        spark = SparkSession.active()
        self.pipeline.write().overwrite().save(f"{path}/pipeline")
        about = [(self.name, list(self.features), list(self.used), list(self.classes), self.label_column, self.fit_seconds)]
        spark.createDataFrame(about, _ABOUT).coalesce(1).write.mode("overwrite").parquet(f"{path}/about")

    @staticmethod
    def load(spark: SparkSession, path: str) -> FittedModel:
        about = spark.read.schema(_ABOUT).parquet(f"{path}/about").first()
        return FittedModel(about["name"], PipelineModel.load(f"{path}/pipeline"), tuple(about["features"]), tuple(about["used"]),
                           tuple(about["classes"]), about["label_column"], about["fit_seconds"])


def _spread(rows: DataFrame, cells: int) -> DataFrame:
    """Training rows in partitions of about 250,000 cells, dealt and ordered by their values.

    Forests draw rows per partition, so neither the number of cores nor the order in which
    rows arrive may decide where a row goes: the same rows give the same model everywhere.
    """
    key = F.xxhash64(*[quoted(c) for c in rows.columns])
    return rows.repartition(max(1, cells // 250_000), key).sortWithinPartitions(key, *[quoted(c) for c in rows.columns])


def _prepare_sql(medians: Mapping[str, float], scale: Mapping[str, tuple[float, float]] | None) -> str:
    cells = []
    for i, (name, median) in enumerate(medians.items()):
        cell = f"try_cast(`{name}` AS DOUBLE)"
        value = f"coalesce(CASE WHEN NOT isnan({cell}) AND abs({cell}) != double('Infinity') THEN {cell} END, double('{median!r}'))"
        if scale is not None:
            mean, std = scale[name]
            value = f"({value} - double('{mean!r}')) / double('{(std or 1.0)!r}')"
        cells.append(f"{value} AS _x{i}")
    return "SELECT *, " + ", ".join(cells) + " FROM __THIS__"


def _classifier(name: str, n_classes: int, rows: int, trees: int, depth: int):
    # trees see bin numbers, and look for them among as many rows as the square of maxBins: all
    bins = {"maxBins": min(MOST_BINS, max(BINS, math.isqrt(rows) + 1))}
    common = dict(featuresCol="_vector", labelCol="_index", weightCol="_weight", predictionCol="_prediction")
    if name == "logistic_regression":
        # balanced weights add up to the row count, which makes 1/rows the usual unit penalty
        return LogisticRegression(maxIter=500, regParam=1.0 / rows, standardization=False, **common)
    if name == "random_forest":
        return RandomForestClassifier(
            numTrees=trees, maxDepth=depth, seed=S.SEED, featureSubsetStrategy="sqrt", maxMemoryInMB=1024, **bins, **common
        )
    if name == "primary":
        if n_classes == 2:
            return GBTClassifier(maxIter=20, maxDepth=5, seed=S.SEED, **bins, **common)
        # boosted trees are binary only in Spark ML; several classes take a deeper forest
        return RandomForestClassifier(
            numTrees=trees, maxDepth=min(30, depth + 2), seed=S.SEED, maxMemoryInMB=1024, **bins, **common
        )
    raise FlowLensError(f"model_name must be one of {', '.join(MODEL_NAMES)}.")


def fit(
    name: str,
    train: DataFrame,
    features: Sequence[str],
    label: str,
    trees: int = 200,
    depth: int = 10,
    medians: Mapping[str, float | None] | None = None,
    points: Mapping[str, Sequence[float]] | None = None,
) -> FittedModel:
    """Median imputation, scaling for the linear model, bins for trees, balanced weights, classifier.

    ``medians`` and ``split_points`` of the training rows may be passed in when several models share them.
    """
    if name not in MODEL_NAMES:
        raise FlowLensError(f"model_name must be one of {', '.join(MODEL_NAMES)}.")
    start = time.perf_counter()
    counts = class_counts(train, label)
    if len(counts) < 2:
        raise FlowLensError("Training needs a label with at least two classes.")
    found = exact_medians(train, features) if medians is None else medians
    known = {f: m for f, m in found.items() if m is not None}
    scale = None
    if name == "logistic_regression":
        scale = moments(train, list(known), known)
    weights = F.create_map(*[F.lit(x) for pair in class_weights(counts).items() for x in pair])
    classes = sorted(counts)
    indexer = StringIndexerModel.from_labels(classes, inputCol="_label", outputCol="_index", handleInvalid="error")
    rows = train.select(
        *[quoted(f) for f in features], quoted(label).cast("string").alias("_label")
    ).withColumn("_weight", weights[F.col("_label")])
    columns = [f"_x{i}" for i in range(len(known))]
    prepare = [SQLTransformer(statement=_prepare_sql(known, scale))]
    if name in TREE_NAMES:
        points = split_points(train, label, known) if points is None else points
        binned = [f"_b{i}" for i in range(len(known))]
        prepare.append(Bucketizer(splitsArray=[[-math.inf, *(points[f] or [0.0]), math.inf] for f in known], inputCols=columns, outputCols=binned))
        columns = binned
    prepare.append(VectorAssembler(inputCols=columns, outputCol="_vector"))
    # the passes of the fit run over kept, evenly spread rows; a lost block is recomputed
    per_row = len(known) if name == "logistic_regression" else trees
    spread = _spread(indexer.transform(rows), sum(counts.values()) * per_row).persist()
    pipeline = Pipeline(stages=[
        *prepare,
        _classifier(name, len(counts), sum(counts.values()), trees, depth)
        .setProbabilityCol("_probability").setRawPredictionCol("_raw"),
        IndexToString(inputCol="_prediction", outputCol="_predicted", labels=classes),
    ]).fit(spread)
    spread.unpersist()
    return FittedModel(
        name, pipeline, tuple(features), tuple(known), tuple(classes), label, time.perf_counter() - start
    )


def score(model: FittedModel, rows: DataFrame) -> DataFrame:
    """Add the ``probability`` array in class order; stateless, so it also runs on streams."""
    scored = model.pipeline.transform(rows).withColumn("probability", vector_to_array("_probability"))
    return scored.drop("_vector", "_raw", "_prediction", "_probability", "_predicted",
                       *[f"_{x}{i}" for x in "xb" for i in range(len(model.used))])


def timed_score(model: FittedModel, rows: DataFrame) -> float:
    """Seconds to score all rows without keeping the result."""
    start = time.perf_counter()
    score(model, rows).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def feature_importance(model: FittedModel, limit: int = 20) -> list[tuple[str, float]]:
    """The largest importances, ties in column order; zeros for a model without any."""
    stage = model.pipeline.stages[-2]
    values = stage.featureImportances.toArray() if hasattr(stage, "featureImportances") else [0.0] * len(model.used)
    by_name = dict(zip(model.used, (float(v) for v in values)))
    place = {f: i for i, f in enumerate(model.features)}
    ranked = sorted(model.features, key=lambda f: (-by_name.get(f, 0.0), place[f]))
    return [(f, by_name.get(f, 0.0)) for f in ranked[:limit]]
