"""Packets to bidirectional flows to the 78-column feature vector, in batch.

Skew: a flow key may hold a third of all packets, so nothing is windowed by key alone.
Packets are windowed per (key, time slot), slots holding equal shares of the capture; one
summary row per (key, slot) carries the previous timestamp, the row offset and the open
session's start into the next slot.
Where no key has more than ``KEY_ROWS`` packets (counts combine on the map side), windows by key
alone are bounded as well, and packets are dealt and ordered once.
After that a flow is identified by (key, position of its first packet) and holds at most
``cap`` packets, and all statistics are one partially aggregated ``groupBy``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schema as S
from ..errors import FlowLensError
from ..functions.columns import iso_utc
from ..functions.prefix import ordered_lag, ordered_prefix, with_buckets

KEY = ["protocol", "a_ip", "a_port", "b_ip", "b_port"]
KEY_ROWS = 100_000  # packets of a key that one task may order
FLAG_LETTERS = {"fin": "F", "syn": "S", "rst": "R", "psh": "P", "ack": "A", "urg": "U"}


def normalise_packets(raw: DataFrame) -> DataFrame:
    """IPv4 packets with protocol name and ports; ports are 0 outside TCP and UDP."""
    protocol = (
        F.when(F.col("ip_proto") == 6, "TCP")
        .when(F.col("ip_proto") == 17, "UDP")
        .otherwise(F.col("ip_proto").cast("string"))
    )
    has_ports = F.col("ip_proto").isin(6, 17)
    return raw.filter(F.col("ip_version") == 4).select(
        "seq",
        "ts_us",
        protocol.alias("protocol"),
        "src_ip",
        F.when(has_ports, F.coalesce("src_port", F.lit(0))).otherwise(0).alias("src_port"),
        "dst_ip",
        F.when(has_ports, F.coalesce("dst_port", F.lit(0))).otherwise(0).alias("dst_port"),
        "length",
        F.when(F.col("ip_proto") == 6, F.coalesce("flags", F.lit(""))).otherwise("").alias("flags"),
    )


def with_flow_key(packets: DataFrame) -> DataFrame:
    """Both directions share one key: the two endpoints ordered by address text, then port.

    Key columns are never null: a packet without an address keeps its row, and the joins on
    the key need no null filter.
    """
    blank, none = F.lit(""), F.lit(0)
    source = F.struct(F.coalesce("src_ip", blank).alias("ip"), F.coalesce("src_port", none).alias("port"))
    target = F.struct(F.coalesce("dst_ip", blank).alias("ip"), F.coalesce("dst_port", none).alias("port"))
    low, high = F.least(source, target), F.greatest(source, target)
    return packets.withColumn("protocol", F.coalesce("protocol", blank)).select(
        "*",
        F.coalesce(low["ip"], blank).alias("a_ip"),
        F.coalesce(low["port"], none).alias("a_port"),
        F.coalesce(high["ip"], blank).alias("b_ip"),
        F.coalesce(high["port"], none).alias("b_port"),
        (source == low).alias("from_a"),
    )


def since(packets: DataFrame, window_start_us: int | None) -> DataFrame:
    """A new capture window forgets everything before its start."""
    return packets if window_start_us is None else packets.filter(F.col("ts_us") >= window_start_us)


def _slots(keyed: DataFrame, slot_us: int | None) -> DataFrame:
    """Add the packet's time slot, of fixed width or (default) of equal packet counts.

    Slots of equal counts over all keys follow the number of packets, so that bounds every
    (key, slot) group too, however hot the key and however bursty the capture.
    """
    if slot_us is not None:
        return keyed.withColumn("slot", F.floor(F.col("ts_us") / F.lit(slot_us)).cast("bigint"))
    return with_buckets(keyed, [], "ts_us").withColumnRenamed("bucket", "slot")


def _in_slot() -> Window:
    return Window.partitionBy(*KEY, "slot").orderBy("ts_us", "seq")


def _segment_by_key(keyed: DataFrame, idle_us: int, cap: int, carried: DataFrame | None) -> DataFrame:
    """``segment`` in strict mode for keys with few packets: one window over each key."""
    if carried is None:
        before = keyed.withColumns({"_n": F.lit(0).cast("bigint"), "_last": F.lit(None).cast("bigint")})
    else:
        opened = carried.select(*KEY, F.col("packet_count").alias("_n"), F.col("last_seen_us").alias("_last"))
        before = keyed.join(opened, KEY, "left").withColumn("_n", F.coalesce("_n", F.lit(0)))
    here = Window.partitionBy(*KEY).orderBy("ts_us", "seq")
    first = F.col("rn") == 1
    rows = before.withColumn("rn", F.row_number().over(here)).withColumn("prev", F.lag("ts_us").over(here))
    rows = rows.withColumn("prev", F.when(first, F.col("_last")).otherwise(F.col("prev"))).withColumn("position", F.col("_n") + F.col("rn"))
    splits = F.coalesce(F.col("ts_us") - F.col("prev") >= idle_us, F.lit(False)) | (first & F.col("prev").isNull())
    start = F.max(F.when(splits, F.col("position"))).over(here.rowsBetween(Window.unboundedPreceding, 0))
    # without a split so far the carried flow goes on, whose first position is 1
    rows = rows.withColumn("session_start", F.coalesce(start, F.lit(1)))
    return rows.withColumn("flow_start", F.col("position") - F.pmod(F.col("position") - F.col("session_start"), F.lit(cap)))


def _with_parity_breaks(keyed: DataFrame, idle_us: int) -> DataFrame:
    """Add ``brk``: idle is only noticed when some packet of any flow arrives late enough.

    The flow breaks when the packet just before this one, over all flows, came at least
    ``idle`` after the flow's own last packet. Two packets of the same microsecond are
    ordered by ``seq``, so it is enough to know each distinct timestamp's predecessor and
    its first ``seq``.
    """
    local = keyed.withColumn("prev_local", F.lag("ts_us").over(_in_slot()))
    ends = local.groupBy(*KEY, "slot").agg(F.max("ts_us").alias("_last"))
    ends = ends.select(
        *KEY, "slot", F.lag("_last").over(Window.partitionBy(*KEY).orderBy("slot")).alias("_carry")
    )
    own = local.join(ends, [*KEY, "slot"]).withColumn("own", F.coalesce("prev_local", "_carry"))
    clock = ordered_lag(
        keyed.groupBy("ts_us").agg(F.min("seq").alias("first_seq")), "ts_us", "clock_before"
    ).withColumnRenamed("ts_us", "clock_us")
    # only a packet after a long gap can break; the others get a key of their own that matches nothing
    gap = F.col("ts_us") - F.col("own") >= idle_us
    probe = F.when(gap, F.col("ts_us")).otherwise(-F.col("seq") - 1)
    before = F.when(F.col("seq") > F.col("first_seq"), F.col("ts_us")).otherwise(F.col("clock_before"))
    joined = own.withColumn("probe", probe).join(clock, F.col("probe") == F.col("clock_us"), "left")
    brk = F.col("own").isNull() | F.coalesce(before - F.col("own") >= idle_us, F.lit(False))
    return joined.withColumn("brk", brk).drop(
        "prev_local", "_carry", "own", "probe", "clock_us", "first_seq", "clock_before"
    )


def segment(
    packets: DataFrame,
    idle_us: int = S.IDLE_SECONDS * 1_000_000,
    cap: int = S.PACKET_CAP,
    mode: str = "strict",
    slot_us: int | None = None,
    carried: DataFrame | None = None,
) -> DataFrame:
    """Assign every packet to a flow.

    Adds ``position`` (row of the packet in its key), ``flow_start`` (position of the flow's
    first packet) and ``iat_us`` (gap to the previous packet of the same flow, else null).
    ``strict`` splits when the key was silent for ``idle``; ``parity`` splits when that
    silence was also noticed by another packet. Either way a flow ends at ``cap`` packets.
    ``carried`` (key, packet_count, last_seen_us) are flows open before the first packet, one
    per key at most; their packets take the first positions (``strict`` only).
    """
    if mode not in ("strict", "parity"):
        raise FlowLensError("mode must be strict or parity.")
    if idle_us <= 0 or cap < 1:
        raise FlowLensError("idle and cap must be positive.")
    keyed = with_flow_key(packets)
    if mode == "strict" and slot_us is None:
        most = keyed.groupBy(*KEY).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]
        if (most or 0) <= KEY_ROWS:
            rows = _segment_by_key(keyed, idle_us, cap, carried)
            gap = F.when(F.col("position") > F.col("flow_start"), F.col("ts_us") - F.col("prev"))
            return rows.withColumn("iat_us", gap).select(
                *packets.columns, *[c for c in KEY if c not in packets.columns], "from_a", "position", "flow_start", "iat_us")
    keyed = _slots(keyed, slot_us)
    if mode == "parity":
        keyed = _with_parity_breaks(keyed, idle_us)

    here = _in_slot()
    local = keyed.withColumn("rn", F.row_number().over(here)).withColumn("prev", F.lag("ts_us").over(here))
    if mode == "parity":
        splits = (F.col("rn") > 1) & F.col("brk")
        first_split = F.min_by("brk", F.struct("ts_us", "seq"))
    else:
        splits = F.col("ts_us") - F.col("prev") >= idle_us
        first_split = F.lit(None).cast("boolean")
    local = local.withColumn("split_rn", F.when(splits, F.col("rn")))
    local = local.withColumn(
        "last_split", F.max("split_rn").over(here.rowsBetween(Window.unboundedPreceding, 0))
    )

    # one row per (key, slot)
    summary = local.groupBy(*KEY, "slot").agg(
        F.count("*").alias("n"),
        F.min("ts_us").alias("first_ts"),
        F.max("ts_us").alias("last_ts"),
        F.max("split_rn").alias("slot_split"),
        first_split.alias("first_split"),
    )
    if carried is not None:
        none = F.lit(None)
        summary = summary.unionByName(carried.select(
            *KEY, F.lit(-1).alias("slot"), F.col("packet_count").alias("n"), F.col("last_seen_us").alias("first_ts"),
            F.col("last_seen_us").alias("last_ts"), none.cast("int").alias("slot_split"), none.cast("boolean").alias("first_split")))
    slots = Window.partitionBy(*KEY).orderBy("slot")
    earlier = slots.rowsBetween(Window.unboundedPreceding, -1)
    summary = summary.withColumn("prev_ts", F.lag("last_ts").over(slots)).withColumn(
        "offset", F.coalesce(F.sum("n").over(earlier), F.lit(0))
    )
    opens = F.coalesce("first_split", F.col("prev_ts").isNull() | (F.col("first_ts") - F.col("prev_ts") >= idle_us))
    summary = summary.withColumn("opens", opens).withColumn(
        "starts_here",
        F.when(F.col("slot_split").isNotNull(), F.col("offset") + F.col("slot_split"))
        .when(F.col("opens"), F.col("offset") + 1),
    )
    summary = summary.select(
        *KEY,
        "slot",
        "prev_ts",
        "offset",
        F.when(F.col("opens"), F.col("offset") + 1)
        .otherwise(F.last("starts_here", ignorenulls=True).over(earlier))
        .alias("entry_start"),
    )

    joined = local.join(summary, [*KEY, "slot"])
    session_start = F.coalesce(F.col("offset") + F.col("last_split"), F.col("entry_start"))
    joined = joined.withColumn("position", F.col("offset") + F.col("rn")).withColumn(
        "session_start", session_start
    )
    into_session = F.col("position") - F.col("session_start")
    joined = joined.withColumn("flow_start", F.col("position") - F.pmod(into_session, F.lit(cap)))
    previous = F.when(F.col("rn") == 1, F.col("prev_ts")).otherwise(F.col("prev"))
    return joined.withColumn(
        "iat_us", F.when(F.col("position") > F.col("flow_start"), F.col("ts_us") - previous)
    ).select(*packets.columns, *KEY, "from_a", "position", "flow_start", "iat_us")


def _flag_count(letter: str) -> Column:
    return F.sum(F.length("flags") - F.length(F.replace(F.col("flags"), F.lit(letter), F.lit(""))))


def accumulate(segmented: DataFrame, idle_us: int, cap: int, mode: str = "strict") -> DataFrame:
    """One row per flow with exact integer sums; partially aggregated before the shuffle."""
    # gaps inside a strict flow are below idle, so n*sum(x^2) usually fits a BIGINT
    wide = mode != "strict" or cap * cap * idle_us * idle_us >= 2**63
    gap = F.col("iat_us").cast("decimal(38,0)") if wide else F.col("iat_us")
    length, from_a = F.col("length"), F.col("from_a")
    sides = []
    for side, cond in (("a", from_a), ("b", ~from_a)):
        part = F.when(cond, length)
        sides += [
            F.count(part).alias(f"{side}_n"),
            F.coalesce(F.sum(part), F.lit(0)).alias(f"{side}_bytes"),
            F.coalesce(F.sum(part * part), F.lit(0)).alias(f"{side}_sq"),
            F.min(part).alias(f"{side}_min"),
            F.max(part).alias(f"{side}_max"),
        ]
    return segmented.groupBy(*KEY, "flow_start").agg(
        F.min_by("from_a", "position").alias("opener_a"),
        F.min_by("seq", "position").alias("first_seq"),
        F.max_by("seq", "position").alias("last_seq"),
        F.count("*").alias("packet_count"),
        F.sum("length").alias("bytes"),
        F.sum(length * length).alias("len_sq"),
        F.min("length").alias("len_min"),
        F.max("length").alias("len_max"),
        *sides,
        F.min("ts_us").alias("started_us"),
        F.max("ts_us").alias("last_seen_us"),
        F.sum(gap * gap).alias("iat_sq"),
        F.min("iat_us").alias("iat_min"),
        F.max("iat_us").alias("iat_max"),
        *[_flag_count(letter).alias(name) for name, letter in FLAG_LETTERS.items()],
        F.min("position").alias("first_position"),
        F.max("position").alias("last_position"),
    )


def merged(parts: DataFrame) -> DataFrame:
    """Rows of ``accumulate`` over different packets of the same flows, one row per flow."""
    ordered = {
        "opener_a": F.min_by("opener_a", "first_position"),
        "first_seq": F.min_by("first_seq", "first_position"),
        "last_seq": F.max_by("last_seq", "last_position"),
        "first_position": F.min("first_position"),
        "last_position": F.max("last_position"),
        "started_us": F.min("started_us"),
        "last_seen_us": F.max("last_seen_us"),
    }

    def whole(name: str) -> Column:
        if name in ordered:
            return ordered[name]
        return F.min(name) if name.endswith("_min") else F.max(name) if name.endswith("_max") else F.sum(name)

    names = [c for c in parts.columns if c not in (*KEY, "flow_start")]
    types = dict(parts.dtypes)
    return parts.groupBy(*KEY, "flow_start").agg(*[whole(c).cast(types[c]).alias(c) for c in names])


def oriented(flows: DataFrame) -> DataFrame:
    """Name endpoints and per-side sums from the opener's point of view."""
    opener = F.col("opener_a")

    def pick(one: str, other: str) -> Column:
        return F.when(opener, F.col(one)).otherwise(F.col(other))

    side = {}
    for stat in ("n", "bytes", "sq", "min", "max"):
        side[f"fwd_{stat}"] = pick(f"a_{stat}", f"b_{stat}")
        side[f"bwd_{stat}"] = pick(f"b_{stat}", f"a_{stat}")
    return flows.select(
        "protocol", "flow_start", "first_seq", "last_seq",
        pick("a_ip", "b_ip").alias("source_ip"),
        pick("a_port", "b_port").alias("source_port"),
        pick("b_ip", "a_ip").alias("destination_ip"),
        pick("b_port", "a_port").alias("destination_port"),
        "packet_count", "bytes", "len_sq", "len_min", "len_max",
        *[c.alias(n) for n, c in side.items()],
        "started_us", "last_seen_us", "iat_sq", "iat_min", "iat_max", *FLAG_LETTERS,
    )


def flow_table(
    packets: DataFrame,
    idle_us: int = S.IDLE_SECONDS * 1_000_000,
    cap: int = S.PACKET_CAP,
    mode: str = "strict",
    slot_us: int | None = None,
    flush_open: bool = False,
) -> DataFrame:
    """All flows of a capture; ``active`` marks those that are still open at its last packet."""
    flows = oriented(accumulate(segment(packets, idle_us, cap, mode, slot_us), idle_us, cap, mode))
    horizon = packets.agg(F.max("ts_us")).scalar()
    closed = (F.col("packet_count") >= cap) | (horizon - F.col("last_seen_us") >= idle_us)
    return flows.withColumn("active", F.lit(False) if flush_open else ~closed)


def with_flow_id(flows: DataFrame) -> DataFrame:
    """Number flows from 1 in the order their first packets arrived."""
    return ordered_prefix(flows.withColumn("_one", F.lit(1)), [], "first_seq", {"_before": "_one"}).withColumn(
        "flow_id", F.col("_before") + 1
    ).drop("_one", "_before", "_before_all")


def _std(n: Column, total: Column, squares: Column) -> Column:
    """Population standard deviation from exact sums, 0 below two values."""
    exact = "decimal(20,0)"
    spread = (n.cast(exact) * squares - total.cast(exact) * total.cast(exact)).cast("double")
    return F.when(n >= 2, F.sqrt(F.greatest(spread, F.lit(0.0))) / n).otherwise(F.lit(0.0))


def _mean(n: Column, total: Column) -> Column:
    return F.when(n > 0, total.cast("double") / n).otherwise(F.lit(0.0))


def feature_columns() -> dict[str, Column]:
    """The 78 features as expressions over a flow table row, in dataset order."""
    c = F.col
    zero = F.lit(0.0)

    def number(col: Column) -> Column:
        return F.coalesce(col.cast("double"), zero)

    duration_us = number(c("last_seen_us") - c("started_us"))
    seconds = F.greatest(duration_us / 1_000_000, F.lit(S.RATE_FLOOR_SECONDS))
    gaps = c("packet_count") - 1
    gap_sum = c("last_seen_us") - c("started_us")
    iat = {
        "Mean": _mean(gaps, gap_sum),
        "Std": _std(gaps, gap_sum, F.coalesce(c("iat_sq"), F.lit(0))),
        "Max": number(c("iat_max")),
        "Min": number(c("iat_min")),
    }
    length_mean = _mean(c("packet_count"), c("bytes"))
    length_std = _std(c("packet_count"), c("bytes"), c("len_sq"))
    out: dict[str, Column] = {
        "Destination Port": number(c("destination_port")),
        "Flow Duration": duration_us,
        "Flow Bytes/s": c("bytes") / seconds,
        "Flow Packets/s": c("packet_count") / seconds,
        "Min Packet Length": number(c("len_min")),
        "Max Packet Length": number(c("len_max")),
        "Packet Length Mean": length_mean,
        "Packet Length Std": length_std,
        "Packet Length Variance": length_std * length_std,
        "Average Packet Size": length_mean,
        "Total Fwd Packets": number(c("fwd_n")),
        "Total Backward Packets": number(c("bwd_n")),
        "Down/Up Ratio": c("bwd_n") / F.greatest(c("fwd_n"), F.lit(1)),
        "act_data_pkt_fwd": number(c("fwd_n")),
        "min_seg_size_forward": number(c("fwd_min")),
        "Fwd Header Length.1": number(c("fwd_n") * S.HEADER_BYTES),
        "Fwd IAT Total": duration_us,
    }
    for name, side in (("Fwd", "fwd"), ("Bwd", "bwd")):
        n, total, squares = c(f"{side}_n"), c(f"{side}_bytes"), c(f"{side}_sq")
        out[f"Total Length of {name} Packets"] = number(total)
        out[f"{name} Packet Length Max"] = number(c(f"{side}_max"))
        out[f"{name} Packet Length Min"] = number(c(f"{side}_min"))
        out[f"{name} Packet Length Mean"] = _mean(n, total)
        out[f"{name} Packet Length Std"] = _std(n, total, squares)
        out[f"Avg {name} Segment Size"] = _mean(n, total)
        out[f"{name} Header Length"] = number(n * S.HEADER_BYTES)
        out[f"{name} Packets/s"] = n / seconds
        out[f"Subflow {name} Packets"] = number(n)
        out[f"Subflow {name} Bytes"] = number(total)
    for stat, value in iat.items():
        out[f"Flow IAT {stat}"] = value
        # forward gaps are taken over all packets of the flow; backward gaps are not observed
        out[f"Fwd IAT {stat}"] = value
        out[f"Bwd IAT {stat}"] = zero
        out[f"Idle {stat}"] = zero
        out[f"Active {stat}"] = zero if stat == "Std" else duration_us
    out["Bwd IAT Total"] = zero
    for flag in FLAG_LETTERS:
        out[f"{flag.upper()} Flag Count"] = number(c(flag))
    for name in S.UNAVAILABLE_FEATURES:
        out[name] = zero
    return {name: out[name].alias(name) for name in S.FLOW_FEATURES}


def flow_features(flows: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """The 78-column feature vector of each flow next to the ``keep`` columns."""
    return flows.select(*(keep or []), *feature_columns().values())


def flow_records(flows: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    """Endpoint text, ISO UTC times and rounded duration of each flow, with its features and the ``extra`` columns."""
    keep = ["flow_id", "source_ip", "source_port", "destination_ip", "destination_port", "protocol",
            "packet_count", "bytes", "first_seq", "last_seq", "active"]
    return flows.select(
        *keep,
        F.concat_ws(":", "source_ip", F.col("source_port").cast("string")).alias("source"),
        F.concat_ws(":", "destination_ip", F.col("destination_port").cast("string")).alias("destination"),
        iso_utc(F.col("started_us")).alias("started_at"),
        iso_utc(F.col("last_seen_us")).alias("last_seen_at"),
        F.round((F.col("last_seen_us") - F.col("started_us")) / 1_000_000, 6).alias("duration_seconds"),
        "started_us",
        "last_seen_us",
        *feature_columns().values(),
        *extra,
    )
