"""Packet streams to scored flows.

``stream_flows`` runs the batch segmentation on every micro-batch. What it carries from one
batch to the next is one row of sums per flow still open and the packets newer than the
watermark, kept as tables in the stream's folder. So a flow is cut exactly as in batch, the
work of a batch follows its new packets, a key with a third of all traffic is still spread over
time slots, and nothing but those tables has to survive an executor or a restart.

``session_flows`` is the plain Structured Streaming form for captures without packet cap:
event-time watermark, ``session_window``, late packets dropped.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from .. import schema as S
from ..errors import FlowLensError
from ..functions import columns as C
from ..operators import flows as FL
from ..operators import train as TR
from ..operators.score import agreement, with_prediction

PACKET = ["seq", "ts_us", "protocol", "src_ip", "src_port", "dst_ip", "dst_port", "length", "flags"]
PACKET_SCHEMA = ("seq bigint, ts_us bigint, protocol string, src_ip string, src_port int, dst_ip string, dst_port int, "
                 "length bigint, flags string")
Scorer = Callable[[DataFrame], DataFrame]


def model_scorer(primary: TR.FittedModel, baselines: dict[str, TR.FittedModel] | None = None) -> Scorer:
    """A function adding ``prediction`` and ``error`` to rows that carry the feature columns.

    It is a chain of ML transforms and column expressions, so it runs the same on a table
    and on a micro-batch, all flows of a batch at once.
    """
    baselines = baselines or {}
    used = sorted({f for m in (primary, *baselines.values()) for f in m.used})

    def unreadable(rows: DataFrame) -> Column:
        """A feature holds a text that is no number: that row fails, the others are scored."""
        texts = [f for f in used if dict(rows.dtypes).get(f) == "string"]
        bad = [C.quoted(f).isNotNull() & C.quoted(f).try_cast("double").isNull() for f in texts]
        return reduce(lambda a, b: a | b, bad, F.lit(False))

    def score(rows: DataFrame) -> DataFrame:
        rows = rows.withColumn("_unreadable", unreadable(rows))
        for name, model in baselines.items():
            scored = with_prediction(TR.score(model, rows), model.classes, truth=None)
            rows = scored.withColumnRenamed("predicted_label", name).drop("probability", "confidence")
        scored = with_prediction(TR.score(primary, rows), primary.classes, truth=None)
        label, confidence, p = F.col("predicted_label"), F.col("confidence"), F.col("probability")
        labels, same = agreement(label, list(baselines))
        prediction = F.struct(
            label.alias("prediction"),
            (~C.is_benign(label, primary.label_column)).alias("is_attack"),
            confidence.alias("confidence"),
            C.normalised_entropy(p, len(primary.classes)).alias("uncertainty"),
            labels.alias("model_agreement"),
            same.alias("models_agree"),
            ((confidence < S.REVIEW_CONFIDENCE) | ~same).alias("should_investigate"),
            C.probability_map(primary.classes, p).alias("probabilities"),
            C.evidence(primary.features, confidence).alias("evidence"),
        )
        failed = F.col("_unreadable") | p.isNull() | F.exists(p, lambda x: x.isNull() | F.isnan(x))
        return scored.withColumn("prediction", F.when(~failed, prediction)).withColumn(
            "error", F.when(failed, F.lit("The flow could not be scored."))
        ).drop("predicted_label", "confidence", "probability", "_unreadable", *baselines)

    return score


def live_records(flows: DataFrame, scorer: Scorer | None = None) -> DataFrame:
    """Flow records in the register's layout; ``flows`` needs a ``flow_id`` column."""
    records = FL.flow_records(flows)
    if scorer is not None:
        records = scorer(records)
    else:
        records = records.withColumn("prediction", F.lit(None).cast(S.PREDICTION_TYPE)).withColumn(
            "error", F.lit(S.NOT_ANALYZED))
    return _in_layout(records)


def _in_layout(records: DataFrame) -> DataFrame:
    return records.withColumn("features", C.feature_map(S.FLOW_FEATURES)).withColumn("simulation", F.lit(False)).select(
        *[F.col(f.name).cast(f.dataType).alias(f.name) for f in S.LIVE_FLOW_SCHEMA.fields])


def _closed_schema() -> T.StructType:
    """What a stream stores of a closed flow: its exact sums, of which the 78 features are a function, and its score."""
    sums = FL.oriented(SparkSession.active().createDataFrame([], _state_schema(S.IDLE_SECONDS * 1_000_000, S.PACKET_CAP))).schema
    wide = T.DecimalType(38, 0)  # as wide as any idle time and cap need
    fields = [T.StructField(f.name, wide if f.name == "iat_sq" else f.dataType) for f in sums.fields]
    return T.StructType([*fields, T.StructField("flow_id", T.LongType()), T.StructField("active", T.BooleanType()),
                         T.StructField("prediction", S.PREDICTION_TYPE), T.StructField("error", T.StringType())])


def _with_score(flows: DataFrame, scorer: Scorer | None) -> DataFrame:
    """Closed flows as they are stored."""
    if scorer is None:
        rows = flows.withColumn("prediction", F.lit(None)).withColumn("error", F.lit(S.NOT_ANALYZED))
    else:
        named = FL.flow_records(flows).columns
        rows = scorer(FL.flow_records(flows, [c for c in flows.columns if c not in named]))
    return rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in _closed_schema().fields])


def read_packets(spark: SparkSession, path: str, glob: str = "*", files_per_batch: int | None = None) -> DataFrame:
    """A stream of raw packet rows from Parquet files as they arrive."""
    reader = spark.readStream.schema(S.RAW_PACKET_SCHEMA).option("pathGlobFilter", glob)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


CLOCK = "batch_id bigint, watermark_us bigint, late_packets bigint, generation bigint"
WINDOW = "generation bigint, window_start_us bigint"


def _clock(spark: SparkSession, folder: str, batch_id: int) -> tuple[int | None, int]:
    """Watermark and window generation after the previous batch."""
    if batch_id == 0:
        return None, 0
    row = spark.read.schema(CLOCK).parquet(f"{folder}/clock/slot={(batch_id - 1) % 2}").first()
    if row is None or row["batch_id"] != batch_id - 1:
        raise FlowLensError(f"The carried state in {folder} does not belong to batch {batch_id - 1}.")
    return row["watermark_us"], row["generation"] or 0


def current_window(spark: SparkSession, folder: str) -> tuple[int, int | None]:
    """Generation and start of a stream's window; generation 0 has no start."""
    from ..sources.sinks import read_or_empty

    row = read_or_empty(spark, f"{folder}/windows", WINDOW).orderBy(F.desc("generation"), F.desc("window_start_us")).first()
    return (row["generation"], row["window_start_us"]) if row else (0, None)


def reset_window(spark: SparkSession, folder: str, window_start_us: int) -> int:
    """Begin a new window of a stream, running or not, and return its generation.

    From now on the register and its counters are empty, and the next batch discards what older generations left:
    open flows whole, and waiting and new packets from before ``window_start_us``. A start must not lie before the
    last one. A batch that is run again discards the same state again, as it starts from the same tables, and its
    flows go to the folder of its generation, so no flow of an older one comes back. Resets are one caller's at a time.
    """
    generation, start = current_window(spark, folder)
    if start is not None and window_start_us < start:
        raise FlowLensError(f"The window starts at {start} already.")
    spark.range(1).select(F.lit(generation + 1).cast("bigint").alias("generation"), F.lit(window_start_us).cast("bigint").alias(
        "window_start_us")).coalesce(1).write.mode("append").parquet(f"{folder}/windows")
    return generation + 1


def _of_window(folder: str, name: str, generation: int) -> str:
    return f"{folder}/{name}" if generation == 0 else f"{folder}/{name}-{generation}"


def state_columns(idle_us: int, cap: int) -> list[Column]:
    """The columns of an open flow's summary, of fixed types."""
    return [F.col(f.name).cast(f.dataType).alias(f.name) for f in _state_schema(idle_us, cap).fields]


def _state_schema(idle_us: int, cap: int) -> T.StructType:
    empty = SparkSession.active().createDataFrame([], PACKET_SCHEMA)
    return FL.accumulate(FL.segment(empty, idle_us, cap, slot_us=1), idle_us, cap).schema


def _carried(spark: SparkSession, folder: str, batch_id: int, idle_us: int, cap: int) -> tuple[DataFrame, DataFrame]:
    """What a batch left for the next: a row per open flow, and the packets newer than the watermark."""
    schema = _state_schema(idle_us, cap)
    if batch_id < 0:
        return spark.createDataFrame([], schema), spark.createDataFrame([], PACKET_SCHEMA)
    slot = f"slot={batch_id % 2}"
    return spark.read.schema(schema).parquet(f"{folder}/state/{slot}"), spark.read.schema(PACKET_SCHEMA).parquet(f"{folder}/ahead/{slot}")


def _in_window(state: DataFrame, ahead: DataFrame, generation: int, window: tuple[int, int | None]) -> tuple[DataFrame, DataFrame]:
    """What a batch of ``generation`` carried, as far as it belongs to ``window`` (generation, start)."""
    return (state, ahead) if generation == window[0] else (state.limit(0), FL.since(ahead, window[1]))


def _folded(state: DataFrame, packets: DataFrame, idle_us: int, cap: int, slot_us: int | None) -> DataFrame:
    """Sums per flow of open flows and packets that come after them."""
    members = FL.segment(packets, idle_us, cap, "strict", slot_us, state.select(*FL.KEY, "packet_count", "last_seen_us"))
    return FL.merged(state.unionByName(FL.accumulate(members, idle_us, cap)))


def stream_flows(
    packets: DataFrame,
    folder: str,
    delay_us: int,
    idle_us: int = S.IDLE_SECONDS * 1_000_000,
    cap: int = S.PACKET_CAP,
    scorer: Scorer | None = None,
    slot_us: int | None = None,
    interval: str | None = None,
) -> StreamingQuery:
    """Cut a stream of normalised packets into flows and write the closed ones.

    Packets may be late by up to ``delay_us`` of event time; those older than the watermark
    go to ``<folder>/late/batch=N`` unchanged, and the clock row has their count. ``<folder>/flows/batch=N`` holds the flows closed by batch N (sums and
    scores, ``closed_flows`` reads them as the register) and is replaced as a whole when a batch is run again, so each flow is written once. The two
    ``slot`` folders of the carried tables alternate: a batch that is run again still finds
    the state it started from. Without ``interval`` the stream takes what is there and ends. A batch belongs to the
    window that is current when it begins (``reset_window``); later windows' folders carry their generation's number.
    """

    def each(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        before, old = _clock(spark, folder, batch_id)
        generation, start = current_window(spark, folder)
        fresh = FL.since(batch.select(*PACKET), start)
        late_rows = 0
        if before is not None:
            late = f"{_of_window(folder, 'late', generation)}/batch={batch_id}"
            fresh.filter(F.col("ts_us") < before).write.mode("overwrite").parquet(late)
            late_rows = spark.read.schema(fresh.schema).parquet(late).count()
            fresh = fresh.filter(F.col("ts_us") >= before)
        newest = fresh.agg(F.max("ts_us")).first()[0]
        marks = [m for m in (before, None if newest is None else newest - delay_us) if m is not None]
        watermark = max(marks) if marks else None
        here = f"slot={batch_id % 2}"
        state, ahead = _in_window(*_carried(spark, folder, batch_id - 1, idle_us, cap), old, (generation, start))
        waiting = fresh.unionByName(ahead)
        if watermark is not None:
            due = waiting.filter(F.col("ts_us") <= watermark).persist()
            sums = _folded(state, due, idle_us, cap, slot_us).persist()
            closed = (F.col("packet_count") >= cap) | (F.lit(watermark) - F.col("last_seen_us") >= idle_us)
            done = FL.oriented(sums.filter(closed)).withColumn("flow_id", F.col("first_seq")).withColumn(
                "active", F.lit(False))
            _with_score(done, scorer).write.mode("overwrite").parquet(
                f"{_of_window(folder, 'flows', generation)}/batch={batch_id}")
            state = sums.filter(~closed).withColumns({
                "flow_start": F.lit(1).cast("bigint"), "first_position": F.lit(1).cast("bigint"), "last_position": F.col("packet_count")})
            state.select(*state_columns(idle_us, cap)).write.mode("overwrite").parquet(f"{folder}/state/{here}")
            waiting.filter(F.col("ts_us") > watermark).write.mode("overwrite").parquet(f"{folder}/ahead/{here}")
            sums.unpersist()
            due.unpersist()
        else:
            state.write.mode("overwrite").parquet(f"{folder}/state/{here}")
            waiting.write.mode("overwrite").parquet(f"{folder}/ahead/{here}")
        spark.range(1).select(
            F.lit(batch_id).cast("bigint").alias("batch_id"), F.lit(watermark).cast("bigint").alias("watermark_us"),
            F.lit(late_rows).cast("bigint").alias("late_packets"), F.lit(generation).cast("bigint").alias("generation"),
        ).write.mode("overwrite").parquet(f"{folder}/clock/{here}")

    writer = packets.writeStream.foreachBatch(each).option("checkpointLocation", f"{folder}/checkpoint")
    writer = writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)
    return writer.start()


def closed_flows(spark: SparkSession, folder: str) -> DataFrame:
    """The register written so far in the current window, its features derived from the stored sums; empty before its first batch."""
    from ..sources.sinks import read_or_empty

    stored = read_or_empty(spark, _of_window(folder, "flows", current_window(spark, folder)[0]), _closed_schema())
    return _in_layout(FL.flow_records(stored, ["prediction", "error"]))


def open_flows(
    spark: SparkSession, folder: str, idle_us: int = S.IDLE_SECONDS * 1_000_000, cap: int = S.PACKET_CAP
) -> DataFrame:
    """Flows still open after the last batch, with their features so far.

    Packets newer than the watermark are folded in, so a flow that they close shows as not active.
    """
    clock = spark.read.schema(CLOCK).parquet(f"{folder}/clock").orderBy(F.desc("batch_id")).first()
    carried = _carried(spark, folder, clock["batch_id"], idle_us, cap)
    state, ahead = _in_window(*carried, clock["generation"] or 0, current_window(spark, folder))
    sums = _folded(state, ahead, idle_us, cap, None)
    newest = ahead.agg(F.max("ts_us")).first()[0]
    horizon = max(x for x in (clock["watermark_us"], newest, 0) if x is not None)
    closed = (F.col("packet_count") >= cap) | (F.lit(horizon) - F.col("last_seen_us") >= idle_us)
    return FL.oriented(sums).withColumn("active", ~closed).withColumn("flow_id", F.col("first_seq"))


def late_packets(spark: SparkSession, folder: str) -> DataFrame:
    """The current window's packets that came after the watermark had passed them; empty before the second batch."""
    from ..sources.sinks import read_or_empty

    return read_or_empty(spark, _of_window(folder, "late", current_window(spark, folder)[0]), PACKET_SCHEMA).select(*PACKET)


def live_state(
    spark: SparkSession, folder: str, idle_us: int = S.IDLE_SECONDS * 1_000_000, cap: int = S.PACKET_CAP
) -> DataFrame:
    """The register with the flows still open: counters over it count every packet of the stream."""
    done = closed_flows(spark, folder).withColumn("active", F.lit(False))
    still = live_records(open_flows(spark, folder, idle_us, cap)).withColumn("active", F.lit(True))
    return done.unionByName(still.withColumn("error", F.lit(None).cast("string")))


def session_flows(packets: DataFrame, idle_us: int = S.IDLE_SECONDS * 1_000_000, delay: str = "10 seconds") -> DataFrame:
    """Idle-bounded flows without packet cap as a native streaming aggregation.

    A session window joins events up to and including its gap, a flow splits at ``idle``
    exactly, hence the gap of one microsecond less. Gap statistics need the previous packet
    and are not part of this form. Sessions of a key are merged within each task before the
    shuffle where the session's settings ask for it (``session()`` does).
    """
    keyed = FL.with_flow_key(packets).withColumn("ts", F.timestamp_micros("ts_us")).withWatermark("ts", delay)
    order = F.struct("ts_us", "seq")
    flows = keyed.groupBy(*FL.KEY, F.session_window("ts", f"{idle_us - 1} microseconds")).agg(
        F.min_by("seq", order).alias("first_seq"),
        F.min_by("src_ip", order).alias("source_ip"),
        F.min_by("src_port", order).alias("source_port"),
        F.min_by("dst_ip", order).alias("destination_ip"),
        F.min_by("dst_port", order).alias("destination_port"),
        F.min_by("from_a", order).alias("opener_a"),
        F.count("*").alias("packet_count"),
        F.sum("length").alias("bytes"),
        F.count_if("from_a").alias("a_n"),
        F.min("ts_us").alias("started_us"),
        F.max("ts_us").alias("last_seen_us"),
    )
    forward = F.when(F.col("opener_a"), F.col("a_n")).otherwise(F.col("packet_count") - F.col("a_n"))
    return flows.select(
        "first_seq", "protocol", "source_ip", "source_port", "destination_ip", "destination_port", "packet_count",
        "bytes", forward.alias("fwd_n"), (F.col("packet_count") - forward).alias("bwd_n"), "started_us", "last_seen_us",
    )
