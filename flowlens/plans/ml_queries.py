"""Queries that fit models, and streaming runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schema as S
from ..functions import columns as C
from ..operators import flows as FL
from ..operators import live as LV
from ..operators import score as SC
from ..operators import train as TR
from ..sources import flow_files as FF
from ..sources import sinks as SK
from ..streaming import flow_stream as FS
from ..streaming import keyed_flows as KF
from ..workspace import configure, run_folder, staged
from . import clean_queries as CQ
from . import flow_queries as FQ
from .training import Experiment, run_experiment
from .views import CAP, FEATURES, IDLE_US, labelled_flows, raw_packets_from, table, with_views

_HOLES = ["line_count", "qty_sum", "qty_min", "qty_max", "price_cents", "half"]
STREAM_PARTS = 5
ROWS_A_FILE = 100_000  # of the smallest part, at least: a batch is read by as many tasks as it has files
DELAY_US = 0
RESET_DELAY_US = 60_000_000  # packets wait at the reset
LARGE = 120  # a summed quantity above this is an attack
GAP = 10_000  # what the feature of attacks is raised by, so that the label is separable
RESETS = "RST Flag Count"

_RUNS: dict[tuple, Experiment] = {}  # runs of this session: several queries read one of them


def learnable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows, with a label that follows from one column: a large summed quantity, raised by a gap, is an attack."""
    rows, attack = labelled_flows(configure(spark), sf_dir), F.col("qty_sum") > LARGE
    return rows.withColumn("is_attack", attack.cast("int")).withColumn("qty_sum", F.col("qty_sum") + F.when(attack, GAP).otherwise(0))


def experiment(spark: SparkSession, sf_dir: str, models: tuple[str, ...] = TR.MODEL_NAMES) -> Experiment:
    """The run with the library's own settings; its tables and models are kept for the session's other queries."""
    key = (spark.sparkContext.applicationId, sf_dir, models)
    if key not in _RUNS:
        _RUNS[key] = run_experiment(learnable(spark, sf_dir), "is_attack", models=models)
    return _RUNS[key]


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every model's held-out predictions; whether confidence is the larger probability, of two that sum to one."""
    p, confidence = F.col("probability"), F.col("confidence")
    sums = (F.size(p) == 2) & (F.abs(p[0] + p[1] - 1) < 1e-9) & (confidence == F.array_max(p)) & confidence.between(0.5, 1)
    return experiment(spark, sf_dir).predictions.select("model", "sample_id", "true_label", "predicted_label", sums.alias("confidence_is_share"))


def raised(rows: DataFrame, by: int = GAP) -> DataFrame:
    """Flow features with the label's own column raised by a gap for attacks, as in ``learnable``; ``-GAP`` takes it back."""
    count = C.quoted(RESETS)
    return rows.withColumn(RESETS, count + F.when(count > 0, by).otherwise(0))


def flow_experiment(rows: DataFrame) -> Experiment:
    """A model on the 78 flow features of a stored flow table; flows with a reset count as attacks.

    Without the gap a rare flow with one reset among replies unlike the training rows' is taken for a normal one: the
    weights follow the usual number of resets, and the other features, far out, outweigh one.
    """
    labelled = FL.flow_features(rows.withColumn("is_attack", (F.col("rst") > 0).cast("int")), ["flow_id", "is_attack"])
    return run_experiment(raised(labelled), "is_attack", "flow_id", models=("logistic_regression",))


def flow_scorer(model: TR.FittedModel) -> FS.Scorer:
    """Scores flow records by a model of ``flow_experiment``; the records keep their features."""
    score = FS.model_scorer(model)
    return lambda records: raised(score(raised(records)), -GAP)


def medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = TR.exact_medians(CQ.holes(spark, sf_dir), [*_HOLES, "absent"])
    return spark.createDataFrame(list(found.items()), "feature string, median double")


def standardised(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = CQ.holes(spark, sf_dir)
    found = TR.exact_medians(rows, _HOLES)
    out = [(f, *values) for f, values in TR.moments(rows, _HOLES, found).items()]
    return spark.createDataFrame(out, "feature string, mean double, std double").select(
        "feature", F.round("mean", 2).alias("mean"), F.round("std", 2).alias("std"))


def class_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = labelled_flows(spark, sf_dir).groupBy("Label").agg(F.count("*").alias("n"))
    every = counts.agg(F.sum("n").alias("rows"), F.count("*").alias("classes"))
    # one row per class, and one row of totals
    totals = every.select(F.struct("rows", "classes")).scalar()
    return counts.select("Label", (totals["rows"] / (totals["classes"] * F.col("n"))).alias("weight"))


def importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The forest's whole ranking: per feature whether it is first, and whether place and importance are in order.

    Importances are the forest's own numbers, so the checks are made here, against the row before.
    """
    ranked = TR.feature_importance(experiment(spark, sf_dir).models["random_forest"])
    rows = spark.createDataFrame([(i, *r) for i, r in enumerate(ranked, 1)], "place int, feature string, importance double")
    one = F.abs(F.sum("importance").over(Window.partitionBy()) - 1) < 1e-9  # at most 20 rows
    falls = F.coalesce(F.lag("importance").over(Window.orderBy("place")) >= F.col("importance"), F.lit(True))
    return rows.select("feature", (F.col("place") == 1).alias("first"), (falls & F.col("importance").between(0, 1)).alias("in_order"), one.alias("sums_to_one"))


def saved_experiment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stored experiment row: what it says of the run, its metrics and profile, and whether its times were taken."""
    path = run_folder(spark, "experiments")
    experiment(spark, sf_dir).save(path)
    row = spark.read.json(path).withColumns({
        "metrics": F.from_json("metrics", "array<struct<model: string, metric: string, value: double>>"),
        "reliability": F.from_json("reliability", "array<struct<model: string, rows: bigint>>"),
        "dataset": F.from_json("dataset", "array<struct<column_name: string>>")})

    def every(name: str, test) -> Column:
        found = F.filter("metrics", lambda m: m["metric"] == name)
        return (F.size(found) == len(TR.MODEL_NAMES)) & F.forall(found, lambda m: test(m["value"]))

    return row.select(
        "random_seed", "model", "label_column", "features", "classes", "infinite_values", "numeric_coercion",
        F.concat_ws(",", "metadata_excluded").alias("metadata_excluded"),
        every("accuracy", lambda v: v == 1.0).alias("all_right"),
        (every("fit_seconds", lambda v: v > 0) & every("inference_seconds", lambda v: v > 0)).alias("times_taken"),
        F.aggregate(F.filter("reliability", lambda b: b["model"] == "primary"), F.lit(0).cast("bigint"), lambda n, b: n + b["rows"]).alias("reliability_rows"),
        F.size("dataset").alias("profiled_columns"))


def file_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows of an uploaded Parquet file scored by the linear model, its labels checked."""
    path = run_folder(spark, "upload") + ".parquet"
    learnable(spark, sf_dir).write.parquet(path)
    labelled, rows = FF.read_upload(spark, path, "is_attack")
    model = experiment(spark, sf_dir).models["logistic_regression"]
    aligned = SC.align_to_model(rows, model.features, ["sample_id"])
    scored = SC.with_prediction(TR.score(model, aligned), model.classes, truth=None)
    checked = scored.join(labelled.select("sample_id", "is_attack"), "sample_id")
    return SC.file_summary(checked, "is_attack", ~C.is_benign(F.col("predicted_label"), "is_attack"))


def scored_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every completed flow scored by the model trained on flow features."""
    rows = staged(FQ.flows(spark, sf_dir), "numbered")
    scorer = flow_scorer(flow_experiment(rows).models["logistic_regression"])
    return FS.live_records(rows.filter(~F.col("active")), scorer).select(
        "flow_id", "source", "destination", "packet_count", "prediction.prediction", "error")


def _stored_events(events: DataFrame, path: str, parts: int) -> tuple[str, int]:
    """The events by time in several parts of files written one after the other, and the number of files of each part.

    A stream that takes as many files at a time has a batch of each part. No part ends inside a millisecond.
    """
    ms = F.ceil(_at() / 1000)
    first, last = events.agg(F.min(ms), F.max(ms)).first()
    part = F.least(F.floor((ms - first) * parts / (last - first + 1)), F.lit(parts - 1))
    rows = {r["part"]: r["count"] for r in events.groupBy(part.alias("part")).count().collect()}
    files = max(1, min(rows.values()) // ROWS_A_FILE)
    for i in sorted(rows):
        # dealt round robin, so that no file is missing
        events.filter(part == i).repartition(files).write.mode("append").parquet(path)
    return path, files


def _at() -> Column:
    return F.unix_micros(F.col("ts").cast("timestamp"))


def _packet_stream(spark: SparkSession, sf_dir: str, path: str, files_per_batch: int | None) -> DataFrame:
    reader = spark.readStream.schema(table(spark, sf_dir, "events").schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return FL.normalise_packets(raw_packets_from(reader.parquet(path)))


def _event_stream(spark: SparkSession, sf_dir: str, in_parts: bool = False) -> DataFrame:
    path, files = _stored_events(table(spark, sf_dir, "events"), run_folder(spark, "events"), STREAM_PARTS)
    return _packet_stream(spark, sf_dir, path, files if in_parts else None)


def stream_after_reset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flows of a stream whose window is reset between two batches, with flows open and packets waiting at the reset."""
    events, folder, path = table(configure(spark), sf_dir, "events"), run_folder(spark, "stream"), run_folder(spark, "events")
    for part, parts in ((_at() < FQ.EARLY_US, 1), (_at() >= FQ.EARLY_US, 2)):
        _, files = _stored_events(events.filter(part), path, parts)
        FS.stream_flows(_packet_stream(spark, sf_dir, path, files), folder, RESET_DELAY_US, IDLE_US, CAP).awaitTermination()
        if parts == 1:
            FS.reset_window(spark, folder, FQ.EARLY_US)
    return FS.live_state(spark, folder, IDLE_US, CAP).select(F.col("flow_id").alias("first_seq"), "protocol", "packet_count", "bytes")


def streamed(spark: SparkSession, sf_dir: str, scorer=None) -> str:
    """The folder of a run over several batches; files may come in any order within the delay."""
    folder = run_folder(spark, "stream")
    FS.stream_flows(_event_stream(spark, sf_dir, True), folder, DELAY_US, IDLE_US, CAP, scorer=scorer).awaitTermination()
    return folder


def streamed_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flows of a streaming run that are closed by its last watermark, with some of their features."""
    rows = FS.closed_flows(spark, streamed(configure(spark), sf_dir))
    return rows.select(
        F.col("flow_id").alias("first_seq"), "source", "destination", "protocol", "packet_count", "bytes", "duration_seconds",
        *[F.element_at("features", F.lit(f)).alias(f) for f in ("Total Fwd Packets", "Flow IAT Max", "SYN Flag Count")])


def streamed_open(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = FS.open_flows(spark, streamed(configure(spark), sf_dir), IDLE_US, CAP)
    return rows.select("first_seq", "protocol", "packet_count", "bytes", "active")


def streamed_scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Streaming run with a trained model in the loop, then the live state's counters."""
    model = flow_experiment(staged(FQ.flows(configure(spark), sf_dir), "numbered")).models["logistic_regression"]
    path = run_folder(spark, "model")
    model.save(path)  # the stream scores with the stored model
    scorer = flow_scorer(TR.FittedModel.load(spark, path))
    return LV.counters(FS.live_state(spark, streamed(spark, sf_dir, scorer), IDLE_US, CAP))


def keyed_run(spark: SparkSession, sf_dir: str, redelivered: bool = False) -> str:
    """The folder of a run with keyed state over several batches; ``redelivered``: every tenth packet comes again."""
    folder, packets = run_folder(configure(spark), "keyed"), _event_stream(spark, sf_dir, True)
    if redelivered:
        packets = packets.withColumn("_times", F.explode(F.sequence(F.lit(1), F.when(F.col("seq") % 10 == 0, 2).otherwise(1)))).drop("_times")
    KF.write_flows(KF.keyed_flows(packets, "0 seconds", IDLE_US, CAP, redelivered), folder).awaitTermination()
    return folder


def keyed_stream_flows(spark: SparkSession, sf_dir: str, redelivered: bool = False) -> DataFrame:
    """The flows that keyed state and timers have closed, with some of their features."""
    rows = spark.read.schema(S.LIVE_FLOW_SCHEMA).parquet(f"{keyed_run(spark, sf_dir, redelivered)}/flows")
    return rows.select(
        F.col("flow_id").alias("first_seq"), "source", "destination", "protocol", "packet_count", "bytes", "duration_seconds",
        *[F.element_at("features", F.lit(f)).alias(f) for f in ("Total Fwd Packets", "Flow IAT Max", "SYN Flag Count")])


def keyed_open_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flows still open, read from the stream's state."""
    return KF.open_flows(spark, keyed_run(spark, sf_dir)).select("first_seq", "protocol", "packet_count", "bytes", "active")


def native_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Session-window flows written by an append stream and read back."""
    folder = run_folder(configure(spark), "sessions")
    flows = FS.session_flows(_event_stream(spark, sf_dir), IDLE_US)
    flows.writeStream.format("parquet").option("path", f"{folder}/flows").option(
        "checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).outputMode("append").start().awaitTermination()
    return spark.read.schema(flows.schema).parquet(f"{folder}/flows")


def batch_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same session windows as a batch aggregation, open sessions included."""
    return FS.session_flows(FQ.packets(spark, sf_dir), IDLE_US)


def live_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Completed flows written in the register's layout and read back with its schema."""
    path = run_folder(spark, "state")
    FS.live_records(FQ.flows(spark, sf_dir).filter(~F.col("active"))).write.parquet(path)
    return SK.read_live_state(spark, path).select(
        "flow_id", "source", "source_port", "started_at", "packet_count", "error",
        F.element_at("features", F.lit("Flow Duration")).alias("flow_duration"))


_HOLES_NUM = {c: f"CASE WHEN isnan({c}::DOUBLE) THEN NULL ELSE {c}::DOUBLE END" for c in [*_HOLES, "absent"]}
_SESSION_CTES = {
    **FQ.STRICT,
    "idle_flows": (("sessions",), f"""
        SELECT protocol, session, arg_min(seq, position) AS first_seq, arg_min(src_ip, position) AS source_ip,
          arg_min(src_port, position) AS source_port, arg_min(dst_ip, position) AS destination_ip,
          arg_min(dst_port, position) AS destination_port, count(*) AS packet_count, CAST(sum(length) AS BIGINT) AS bytes,
          count(*) FILTER (src_ip = o_ip AND src_port = o_port) AS fwd_n, count(*) FILTER (NOT (src_ip = o_ip AND src_port = o_port)) AS bwd_n,
          min(ts_us) AS started_us, max(ts_us) AS last_seen_us
        FROM (SELECT *, first_value(src_ip) OVER f AS o_ip, first_value(src_port) OVER f AS o_port FROM sessions
          WINDOW f AS (PARTITION BY {FQ.KEYS}, session ORDER BY ts_us, seq)) GROUP BY {FQ.KEYS}, session"""),
}
_SESSION_COLS = ("first_seq, protocol, source_ip, source_port, destination_ip, destination_port, packet_count, bytes, "
                 "fwd_n, bwd_n, started_us, last_seen_us")

_LEARNT = {
    "learnable": (("labelled_flows",), f"""SELECT sample_id, CASE WHEN qty_sum > {LARGE} THEN '1' ELSE '0' END AS Label,
        line_count, qty_sum + CASE WHEN qty_sum > {LARGE} THEN {GAP} ELSE 0 END AS qty_sum, qty_min, qty_max, price_cents, discount_pct FROM labelled_flows"""),
    "learnable_split": (("learnable",), """
        SELECT r.*, CASE WHEN rn <= quota THEN 'test' ELSE 'train' END AS split
        FROM (SELECT *, row_number() OVER (PARTITION BY Label ORDER BY md5(CAST(sample_id AS VARCHAR) || ':42')) AS rn FROM learnable) r
        JOIN (SELECT Label, floor_q + CASE WHEN row_number() OVER (ORDER BY rest DESC, Label) <= wanted - sum(floor_q) OVER () THEN 1 ELSE 0 END AS quota
          FROM (SELECT Label, n * wanted // total AS floor_q, n * wanted % total AS rest, wanted FROM (
            SELECT Label, n, CAST(sum(n) OVER () AS BIGINT) AS total, CAST(ceil(0.2::DOUBLE * sum(n) OVER ()) AS BIGINT) AS wanted
            FROM (SELECT Label, count(*) AS n FROM learnable GROUP BY Label)))) USING (Label)"""),
}
_MARK = "(SELECT (max(ts_us) + 999) // 1000 * 1000 FROM packets)"  # the last watermark, in whole milliseconds
_KEYED_CLOSED = f"(packet_count >= {CAP} OR (last_seen_us + {IDLE_US} + 999) // 1000 * 1000 <= {_MARK})"
_KEYED = with_views(f"""
        SELECT first_seq, source_ip || ':' || source_port AS source, destination_ip || ':' || destination_port AS destination, protocol,
          packet_count, bytes, round((last_seen_us - started_us)::DOUBLE / 1000000.0::DOUBLE, 6) AS duration_seconds,
          "Total Fwd Packets", "Flow IAT Max", "SYN Flag Count" FROM flow_features WHERE {_KEYED_CLOSED}""", ["flow_features", "packets"], FQ.STRICT)
_ONES = ("accuracy", "macro_precision", "macro_recall", "macro_f1", "weighted_f1", "roc_auc", "pr_auc", "attack_recall")


def _learnt(body: str, *views: str) -> str:
    return with_views(body, views, _LEARNT)


Q: dict[str, tuple] = {
    "m1_medians": (medians, with_views(" UNION ALL ".join(
        f"SELECT '{c}' AS feature, median({x}) AS median FROM holes" for c, x in _HOLES_NUM.items()), ["holes"], CQ._CTES)),
    "m2_standardise": (standardised, with_views(" UNION ALL ".join(
        f"SELECT '{c}' AS feature, round(avg(v), 2) AS mean, round(stddev_pop(v), 2) AS std FROM "
        f"(SELECT coalesce({_HOLES_NUM[c]}, (SELECT median({_HOLES_NUM[c]}) FROM holes)) AS v FROM holes)" for c in _HOLES), ["holes"], CQ._CTES)),
    "m3_class_weights": (class_weights, with_views("""
        SELECT Label, sum(n) OVER ()::DOUBLE / (count(*) OVER () * n)::DOUBLE AS weight
        FROM (SELECT Label, count(*) AS n FROM labelled_flows GROUP BY Label)""", ["labelled_flows"])),
    "m3_m4_m5_trained_comparison": (
        lambda s, d: experiment(s, d).comparison().drop("fit_seconds", "inference_seconds"), _learnt(f"""
        SELECT model, {", ".join(f"1.0::DOUBLE AS {m}" for m in _ONES)}, 0.0::DOUBLE AS false_positive_rate, 0.0::DOUBLE AS false_negative_rate,
          (SELECT count(*) FROM learnable_split WHERE split = 'test') AS inference_rows
        FROM (VALUES ('primary'), ('random_forest'), ('logistic_regression')) AS m(model)""", "learnable_split")),
    "m6_m7_trained_predictions": (
        predictions, _learnt("""
        SELECT model, sample_id, Label AS true_label, Label AS predicted_label, true AS confidence_is_share FROM learnable_split,
          (VALUES ('primary'), ('random_forest'), ('logistic_regression')) AS m(model) WHERE split = 'test'""", "learnable_split")),
    "m17_feature_importance": (importance, _learnt("""
        SELECT feature, max(v) FILTER (Label = '0') < min(v) FILTER (Label = '1') AS first, true AS in_order, true AS sums_to_one
        FROM (UNPIVOT learnable ON line_count, qty_sum, qty_min, qty_max, price_cents, discount_pct INTO NAME feature VALUE v) GROUP BY feature""", "learnable")),
    "m18_m19_s8_experiment_row": (saved_experiment, _learnt(f"""
        SELECT CAST({S.SEED} AS BIGINT) AS random_seed, 'primary' AS model, 'is_attack' AS label_column, '{len(FEATURES)}' AS features,
          string_agg(DISTINCT Label, ',' ORDER BY Label) AS classes, 'NaN' AS infinite_values, true AS numeric_coercion,
          '{",".join(S.METADATA_COLUMNS)}' AS metadata_excluded, true AS all_right, true AS times_taken,
          count(*) FILTER (split = 'test') AS reliability_rows, {len(FEATURES) + 3} AS profiled_columns FROM learnable_split""", "learnable_split")),
    "s11_file_scoring": (file_scoring, _learnt("""
        SELECT count(*) AS rows, count(*) FILTER (Label = '1') AS attack_predictions, count(*) FILTER (Label = '0') AS benign_predictions,
          1.0::DOUBLE AS accuracy FROM learnable""", "learnable")),
    "f18_model_scored_flows": (scored_flows, with_views("""
        SELECT flow_id, source_ip || ':' || source_port AS source, destination_ip || ':' || destination_port AS destination, packet_count,
          CASE WHEN rst > 0 THEN '1' ELSE '0' END AS prediction, NULL::VARCHAR AS error FROM flow_rows WHERE NOT active""", ["flow_rows"], FQ.STRICT)),
    "s12_s13_stream_flows": (streamed_flows, with_views("""
        SELECT first_seq, source_ip || ':' || source_port AS source, destination_ip || ':' || destination_port AS destination, protocol,
          packet_count, bytes, round((last_seen_us - started_us)::DOUBLE / 1000000.0::DOUBLE, 6) AS duration_seconds,
          "Total Fwd Packets", "Flow IAT Max", "SYN Flag Count" FROM flow_features WHERE NOT active""", ["flow_features"], FQ.STRICT)),
    "f6_f8_keyed_stream": (keyed_stream_flows, _KEYED),
    "s12_redelivered_packets": (lambda s, d: keyed_stream_flows(s, d, True), _KEYED),
    "f17_state_snapshot": (keyed_open_flows, with_views(
        f"SELECT first_seq, protocol, packet_count, bytes, true AS active FROM flow_rows WHERE NOT {_KEYED_CLOSED}", ["flow_rows", "packets"], FQ.STRICT)),
    "f17_stream_open_flows": (streamed_open, with_views(
        "SELECT first_seq, protocol, packet_count, bytes, active FROM flow_rows WHERE active", ["flow_rows"], FQ.STRICT)),
    "f32_stream_reset": (stream_after_reset, with_views(
        "SELECT first_seq, protocol, packet_count, bytes FROM flow_rows", ["flow_rows"], FQ.since_start())),
    "f18_f19_stream_scored": (streamed_scored, with_views("""
        SELECT CAST(sum(packet_count) AS BIGINT) AS packets_captured, count(*) AS flows_detected, count(*) FILTER (NOT active) AS flows_analyzed,
          count(*) FILTER (NOT active AND rst > 0) AS suspicious_flows, count(*) FILTER (NOT active) AS predictions_used
        FROM flow_rows""", ["flow_rows"], FQ.STRICT)),
    "s14_live_state": (live_state, with_views(f"""
        SELECT flow_id, source_ip || ':' || source_port AS source, source_port, {FQ._ISO.format(c='started_us')} AS started_at, packet_count,
          'Flow was not analyzed.' AS error, "Flow Duration" AS flow_duration FROM flow_features WHERE NOT active""",
                                                ["flow_features"], FQ.STRICT)),
    "f6_native_sessions": (batch_sessions, with_views(f"SELECT {_SESSION_COLS} FROM idle_flows", ["idle_flows"], _SESSION_CTES)),
    "f6_native_session_stream": (native_sessions, with_views(
        f"""SELECT {_SESSION_COLS} FROM idle_flows WHERE last_seen_us + {IDLE_US} - 1 <= (SELECT max(ts_us) FROM packets) - 10000000""",
        ["idle_flows", "packets"], _SESSION_CTES)),
}
