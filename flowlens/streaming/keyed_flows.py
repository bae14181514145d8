"""Packets to flows with keyed state and timers.

The state of a flow key is one value, the sums of its open flow, and one list, the packets that the
watermark has not passed yet, one entry of columns per batch. Packets are folded into the flow in order of time when the watermark
passes them, so files may come in any order within the delay, and a timer closes a flow that stays
silent: no later packet of its key is needed. The open flows of a running or ended stream are read
from its checkpoint, as of any batch that is still kept.

A key's packets of a batch are one task's work here. ``flow_stream.stream_flows`` deals a hot key's packets
to many tasks, at the price of several jobs a batch; both give the same flows.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from .. import schema as S
from ..operators import flows as FL
from .flow_stream import Scorer, live_records

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PACKET = ["seq", "ts_us", "length", "flags", "from_a"]
#: The packets of a key that one batch brought, column by column.
AHEAD = "seq array<bigint>, ts_us array<bigint>, length array<bigint>, flags array<string>, from_a array<boolean>"
_SIDE = "{s}_n bigint, {s}_bytes bigint, {s}_sq bigint, {s}_min bigint, {s}_max bigint"
#: The sums of an open flow. Squares of gaps are a text, as they may need 38 digits.
FLOW = (
    "opener_a boolean, first_seq bigint, last_seq bigint, packet_count bigint, bytes bigint, len_sq bigint, len_min bigint, len_max bigint, "
    + _SIDE.format(s="a") + ", " + _SIDE.format(s="b") + ", started_us bigint, last_seen_us bigint, iat_sq string, iat_min bigint, "
    "iat_max bigint, " + ", ".join(f"{name} bigint" for name in FL.FLAG_LETTERS)
)
KEY_TYPES = "protocol string, a_ip string, a_port int, b_ip string, b_port int"
FLOW_FIELDS = [f.strip().split()[0] for f in FLOW.split(",")]


def opened(packet: tuple) -> dict[str, Any]:
    """The sums of a flow before its first packet."""
    seq, ts, _, _, from_a = packet
    flow: dict[str, Any] = dict.fromkeys(FLOW_FIELDS, 0)
    return flow | {"opener_a": from_a, "first_seq": seq, "started_us": ts, "last_seen_us": None, "len_min": None, "len_max": None,
                   "a_min": None, "a_max": None, "b_min": None, "b_max": None, "iat_sq": "0", "iat_min": None, "iat_max": None}


def added(flow: dict[str, Any], packet: tuple) -> None:
    """Fold one packet, the next in time, into the sums."""
    seq, ts, length, flags, from_a = packet
    side = "a" if from_a else "b"
    for n, total, squares, low, high in (("packet_count", "bytes", "len_sq", "len_min", "len_max"),
                                         tuple(f"{side}_{x}" for x in ("n", "bytes", "sq", "min", "max"))):
        flow[n] += 1
        flow[total] += length
        flow[squares] += length * length
        flow[low] = length if flow[low] is None else min(flow[low], length)
        flow[high] = length if flow[high] is None else max(flow[high], length)
    if flow["last_seen_us"] is not None:
        gap = ts - flow["last_seen_us"]
        flow["iat_sq"] = str(int(flow["iat_sq"]) + gap * gap)
        flow["iat_min"] = gap if flow["iat_min"] is None else min(flow["iat_min"], gap)
        flow["iat_max"] = gap if flow["iat_max"] is None else max(flow["iat_max"], gap)
    for name, letter in FL.FLAG_LETTERS.items():
        flow[name] += flags.count(letter)
    flow["last_seq"], flow["last_seen_us"] = seq, ts


def milliseconds(us: int) -> int:
    """The first whole millisecond at or after a time: the watermark is one."""
    return -(-us // 1000)


class FlowProcessor(StatefulProcessor):
    """One flow key: packets wait for the watermark, timers fold them and close silent flows."""

    def __init__(self, idle_us: int, cap: int):
        self.idle_us, self.cap = idle_us, cap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.flow = handle.getValueState("flow", FLOW)
        self.ahead = handle.getListState("ahead", AHEAD)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        columns = [list(c) for c in zip(*((r.seq, r.ts_us, r.length, r.flags, r.from_a) for r in rows), strict=True)]
        if columns:
            self.ahead.appendValue(tuple(columns))
            self.handle.registerTimer(milliseconds(min(columns[1])))
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        watermark = timerValues.getCurrentWatermarkInMs()
        waiting = [p for columns in self.ahead.get() for p in zip(*columns, strict=True)]
        due = sorted((p for p in waiting if milliseconds(p[1]) <= watermark), key=lambda p: (p[1], p[0]))
        rest = [p for p in waiting if milliseconds(p[1]) > watermark]
        held = self.flow.get()
        flow, closed = dict(zip(FLOW_FIELDS, held, strict=True)) if held else None, []
        for packet in due:
            if flow is not None and packet[1] - flow["last_seen_us"] >= self.idle_us:
                closed.append(flow)
                flow = None
            flow = flow or opened(packet)
            added(flow, packet)
            if flow["packet_count"] >= self.cap:
                closed.append(flow)
                flow = None
        if flow is not None and milliseconds(flow["last_seen_us"] + self.idle_us) <= watermark:
            closed.append(flow)
            flow = None
        if due and rest:
            self.ahead.put([tuple(list(c) for c in zip(*rest, strict=True))])
        elif due:
            self.ahead.clear()
        if rest:
            self.handle.registerTimer(milliseconds(min(p[1] for p in rest)))
        if flow is not None:
            if due:
                self.flow.update(tuple(flow[f] for f in FLOW_FIELDS))
            self.handle.registerTimer(milliseconds(flow["last_seen_us"] + self.idle_us))
        elif held:
            self.flow.clear()
        if closed:
            yield Row(flows=[dict(zip(FL.KEY, key, strict=True)) | f for f in closed])

    def close(self) -> None:
        pass


def keyed_flows(packets: DataFrame, delay: str = "10 seconds", idle_us: int = S.IDLE_SECONDS * 1_000_000, cap: int = S.PACKET_CAP,
                redelivered: bool = False) -> DataFrame:
    """The closed flows of a stream of normalised packets, in the layout of the flow table; ``flow_id`` is the first packet's ``seq``.

    ``redelivered``: the source delivers packets at least once, so a ``seq`` that comes again within the delay is
    dropped before anything counts it. Packets behind the watermark are dropped by Spark; the watermark is a whole
    millisecond, so a delay of zero asks that no batch begins in the millisecond in which the last one ended.
    """
    packets.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    timed = FL.with_flow_key(packets).withColumn("at", F.timestamp_millis(F.ceil(F.col("ts_us") / 1000))).withWatermark("at", delay)
    if redelivered:
        timed = timed.dropDuplicatesWithinWatermark(["seq"])
    closed = timed.select(*FL.KEY, "seq", "ts_us", "length", "flags", "from_a", "at").groupBy(*FL.KEY).transformWithState(
        FlowProcessor(idle_us, cap), f"flows array<struct<{KEY_TYPES}, {FLOW}>>", "Append", "EventTime")
    return in_layout(closed.select(F.inline("flows"))).withColumn("active", F.lit(False))


def in_layout(sums: DataFrame) -> DataFrame:
    whole = sums.withColumn("iat_sq", F.when(F.col("packet_count") > 1, F.col("iat_sq").cast("decimal(38,0)"))).withColumn("flow_start", F.lit(1).cast("bigint"))
    return FL.oriented(whole).withColumn("flow_id", F.col("first_seq"))


def write_flows(flows: DataFrame, folder: str, scorer: Scorer | None = None, interval: str | None = None) -> StreamingQuery:
    """Append closed flows as register records; without ``interval`` the stream takes what is there and ends."""
    writer = live_records(flows, scorer).writeStream.format("parquet").option("path", f"{folder}/flows").option(
        "checkpointLocation", f"{folder}/checkpoint").outputMode("append")
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()


def open_flows(spark: SparkSession, folder: str, batch_id: int | None = None, operator: int = 0) -> DataFrame:
    """The flows that a stream's checkpoint holds open, after its last batch or after ``batch_id``; the stream may be running.

    Packets that the watermark had not passed are not counted yet; ``waiting_packets`` has them.
    """
    held = _state(spark, folder, "flow", batch_id, operator).select("key.*", "value.*")
    return in_layout(held).withColumn("active", F.lit(True))


def waiting_packets(spark: SparkSession, folder: str, batch_id: int | None = None, operator: int = 0) -> DataFrame:
    """The packets ahead of the watermark, with their flow key."""
    held = _state(spark, folder, "ahead", batch_id, operator)
    return held.select("key.*", F.inline(F.arrays_zip(*[F.col(f"list_element.{c}").alias(c) for c in PACKET])))


def _state(spark: SparkSession, folder: str, name: str, batch_id: int | None, operator: int) -> DataFrame:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    reader = spark.read.format("statestore").option("stateVarName", name).option("operatorId", operator)
    if batch_id is not None:
        reader = reader.option("batchId", batch_id)
    return reader.load(f"{folder}/checkpoint")

