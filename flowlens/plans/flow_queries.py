"""Packet, flow and live-register queries over the packet view."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema as S
from ..functions import columns as C
from ..operators import flows as FL
from ..operators import live as LV
from ..operators.score import agreement, with_prediction
from ..workspace import staged
from .views import CAP, IDLE_US, raw_packets, with_views

KEYS = "protocol, a_ip, a_port, b_ip, b_port"
EARLY_US = 1_704_844_800_000_000  # 2024-01-10, a capture-window start inside the packet view


def packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return FL.normalise_packets(raw_packets(spark, sf_dir))


def segmented(spark: SparkSession, sf_dir: str, mode: str = "strict") -> DataFrame:
    return FL.segment(packets(spark, sf_dir), IDLE_US, CAP, mode)


def flows(spark: SparkSession, sf_dir: str, mode: str = "strict") -> DataFrame:
    # numbering reads the flow table three times, so it is written once first
    return FL.with_flow_id(staged(FL.flow_table(packets(spark, sf_dir), IDLE_US, CAP, mode), "flows"))


# Deterministic two-class scores on flows, so that the register can be checked by SQL.
def _flow_scores() -> dict:
    s = F.col("first_seq")
    w0 = 1 + (s * 7919) % 97 + F.when((F.col("rst") == 0) & (s % 4 != 0), 150).otherwise(0)
    w1 = 1 + (s * 104729) % 97 + F.when((F.col("rst") > 0) & (s % 5 != 0), 150).otherwise(0)
    p = F.array(w0 / (w0 + w1), w1 / (w0 + w1))
    return {
        "probability": p,
        "random_forest": F.when((s % 7 == 0) | (F.col("rst") > 0), "1").otherwise("0"),
        "logistic_regression": F.when(F.col("bytes") % 3 == 0, "1").otherwise("0"),
        "failed": F.when(s % 29 == 0, F.lit("Scoring failed.")),
    }


def register(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flow register, built from the packets by each query that reads it; jobs store it once instead."""
    return scored_register(spark, sf_dir)


def scored_register(spark: SparkSession, sf_dir: str, with_features: bool = False) -> DataFrame:
    """Flow register with predictions, errors and the simulated flag."""
    base = flows(spark, sf_dir)
    sc = _flow_scores()
    base = with_prediction(
        base.withColumns({k: v for k, v in sc.items()}), ["0", "1"], truth=None
    )
    labels, same = agreement(F.col("predicted_label"), ["random_forest", "logistic_regression"])
    features = FL.feature_columns()
    names = list(features)
    confidence = F.col("confidence")
    prediction = F.struct(
        F.col("predicted_label").alias("prediction"),
        (~C.is_benign(F.col("predicted_label"), "is_attack")).alias("is_attack"),
        confidence.alias("confidence"),
        C.normalised_entropy(F.col("probability"), 2).alias("uncertainty"),
        labels.alias("model_agreement"),
        same.alias("models_agree"),
        ((confidence < S.REVIEW_CONFIDENCE) | ~same).alias("should_investigate"),
        C.probability_map(["0", "1"], F.col("probability")).alias("probabilities"),
        (C.evidence(names, confidence) if with_features else F.array().cast("array<string>")).alias("evidence"),
    )
    rows = base.withColumns(features) if with_features else base
    scored = LV.attach_predictions(rows, prediction, F.col("failed"))
    return scored.select(
        "flow_id", "first_seq", "protocol", "source_ip", "source_port", "destination_ip", "destination_port",
        F.concat_ws(":", "source_ip", F.col("source_port").cast("string")).alias("source"),
        F.concat_ws(":", "destination_ip", F.col("destination_port").cast("string")).alias("destination"),
        "packet_count", "bytes", "started_us", "last_seen_us", "active", "prediction", "error",
        (F.col("first_seq") % 31 == 0).alias("simulation"),
        LV.completed_at(IDLE_US, CAP).alias("completed_us"),
        *([C.quoted(n) for n in names] if with_features else []),
    )


# --- SQL twins ---------------------------------------------------------------------


def _segment_ctes(mode: str) -> dict[str, tuple[tuple[str, ...], str]]:
    if mode == "strict":
        prior = ("gaps", ("keyed",), f"""
            SELECT *, lag(ts_us) OVER k AS own, row_number() OVER k AS position,
              lag(ts_us) OVER k IS NULL OR ts_us - lag(ts_us) OVER k >= {IDLE_US} AS brk
            FROM keyed WINDOW k AS (PARTITION BY {KEYS} ORDER BY ts_us, seq)""")
    else:
        prior = ("gaps", ("keyed",), f"""
            SELECT *, own IS NULL OR clock - own >= {IDLE_US} AS brk FROM (
              SELECT *, lag(ts_us) OVER k AS own, row_number() OVER k AS position,
                lag(ts_us) OVER (ORDER BY ts_us, seq) AS clock
              FROM keyed WINDOW k AS (PARTITION BY {KEYS} ORDER BY ts_us, seq))""")
    features = ",\n".join(f'{expr} AS "{name}"' for name, expr in _feature_sql().items())
    return {
        prior[0]: (prior[1], prior[2]),
        "sessions": (("gaps",), f"""
            SELECT *, sum(CASE WHEN brk THEN 1 ELSE 0 END) OVER (PARTITION BY {KEYS} ORDER BY ts_us, seq) AS session
            FROM gaps"""),
        "chunks": (("sessions",), f"""
            SELECT *, (row_number() OVER (PARTITION BY {KEYS}, session ORDER BY ts_us, seq) - 1) // {CAP} AS chunk
            FROM sessions"""),
        "members": (("chunks",), f"""
            SELECT *, first_value(src_ip) OVER f AS o_ip, first_value(src_port) OVER f AS o_port,
              first_value(dst_ip) OVER f AS d_ip, first_value(dst_port) OVER f AS d_port,
              min(position) OVER f2 AS flow_start, ts_us - lag(ts_us) OVER f AS iat_us,
              src_ip = first_value(src_ip) OVER f AND src_port = first_value(src_port) OVER f AS fwd
            FROM chunks WINDOW f AS (PARTITION BY {KEYS}, session, chunk ORDER BY ts_us, seq),
              f2 AS (PARTITION BY {KEYS}, session, chunk)"""),
        "flow_rows": (("members",), f"""
            SELECT *, row_number() OVER (ORDER BY first_seq) AS flow_id,
              NOT (packet_count >= {CAP} OR max(last_seen_us) OVER () - last_seen_us >= {IDLE_US}) AS active,
              CASE WHEN packet_count >= {CAP} THEN last_seen_us ELSE last_seen_us + {IDLE_US} END AS completed_us
            FROM (SELECT protocol, o_ip AS source_ip, o_port AS source_port, d_ip AS destination_ip,
              d_port AS destination_port, CAST(min(flow_start) AS BIGINT) AS flow_start,
              arg_min(seq, position) AS first_seq, count(*) AS packet_count, CAST(sum(length) AS BIGINT) AS bytes,
              sum(length * length) AS len_sq, min(length) AS len_min, max(length) AS len_max,
              count(*) FILTER (fwd) AS fwd_n, count(*) FILTER (NOT fwd) AS bwd_n,
              CAST(coalesce(sum(length) FILTER (fwd), 0) AS BIGINT) AS fwd_bytes,
              CAST(coalesce(sum(length) FILTER (NOT fwd), 0) AS BIGINT) AS bwd_bytes,
              coalesce(sum(length * length) FILTER (fwd), 0) AS fwd_sq,
              coalesce(sum(length * length) FILTER (NOT fwd), 0) AS bwd_sq,
              min(length) FILTER (fwd) AS fwd_min, max(length) FILTER (fwd) AS fwd_max,
              min(length) FILTER (NOT fwd) AS bwd_min, max(length) FILTER (NOT fwd) AS bwd_max,
              min(ts_us) AS started_us, max(ts_us) AS last_seen_us,
              sum(iat_us::HUGEINT * iat_us::HUGEINT) AS iat_sq, min(iat_us) AS iat_min, max(iat_us) AS iat_max,
              {", ".join(f"CAST(sum(length(flags) - length(replace(flags, '{c}', ''))) AS BIGINT) AS {n}"
                         for n, c in FL.FLAG_LETTERS.items())}
            FROM members GROUP BY {KEYS}, session, chunk, o_ip, o_port, d_ip, d_port)"""),
        "flow_features": (("flow_rows",), f"SELECT *, {features} FROM flow_rows"),
        "register": (("flow_rows",), """
            SELECT *, CASE WHEN ok THEN lab END AS prediction, CASE WHEN ok THEN lab = '1' END AS is_attack,
              CASE WHEN ok THEN greatest(q0, q1) END AS confidence,
              CASE WHEN ok THEN -(q0 * ln(q0) + q1 * ln(q1)) / ln(2.0::DOUBLE) END AS uncertainty,
              CASE WHEN ok THEN rf = lab AND lr = lab END AS models_agree,
              CASE WHEN ok THEN greatest(q0, q1) < 0.9::DOUBLE OR NOT (rf = lab AND lr = lab) END AS should_investigate,
              CASE WHEN ok THEN q1 END AS attack_probability, first_seq % 31 = 0 AS simulation,
              CASE WHEN NOT active AND first_seq % 29 = 0 THEN 'Scoring failed.' END AS error,
              source_ip || ':' || source_port AS source, destination_ip || ':' || destination_port AS destination
            FROM (SELECT *, CASE WHEN q0 >= q1 THEN '0' ELSE '1' END AS lab, NOT active AND first_seq % 29 <> 0 AS ok,
                CASE WHEN first_seq % 7 = 0 OR rst > 0 THEN '1' ELSE '0' END AS rf,
                CASE WHEN bytes % 3 = 0 THEN '1' ELSE '0' END AS lr
              FROM (SELECT *, w0::DOUBLE / (w0 + w1)::DOUBLE AS q0, w1::DOUBLE / (w0 + w1)::DOUBLE AS q1
                FROM (SELECT *,
                    1 + (first_seq * 7919) % 97 + CASE WHEN rst = 0 AND first_seq % 4 <> 0 THEN 150 ELSE 0 END AS w0,
                    1 + (first_seq * 104729) % 97 + CASE WHEN rst > 0 AND first_seq % 5 <> 0 THEN 150 ELSE 0 END AS w1
                  FROM flow_rows)))"""),
    }


def _feature_sql() -> dict[str, str]:
    def mean(n: str, total: str) -> str:
        return f"CASE WHEN {n} > 0 THEN ({total})::DOUBLE / {n} ELSE 0.0::DOUBLE END"

    def std(n: str, total: str, sq: str) -> str:
        n, total = f"({n})::HUGEINT", f"({total})::HUGEINT"
        return (f"CASE WHEN {n} >= 2 THEN sqrt(greatest(({n} * ({sq}) - {total} * {total})::DOUBLE, 0.0::DOUBLE))"
                f" / {n}::DOUBLE ELSE 0.0::DOUBLE END")

    def num(x: str) -> str:
        return f"coalesce(({x})::DOUBLE, 0.0::DOUBLE)"

    dur = "(last_seen_us - started_us)"
    sec = f"greatest({dur}::DOUBLE / 1000000.0::DOUBLE, 1e-6::DOUBLE)"
    zero = "0.0::DOUBLE"
    f: dict[str, str] = {n: zero for n in S.UNAVAILABLE_FEATURES}
    f |= {
        "Destination Port": num("destination_port"), "Flow Duration": num(dur),
        "Flow Bytes/s": f"bytes::DOUBLE / {sec}", "Flow Packets/s": f"packet_count::DOUBLE / {sec}",
        "Min Packet Length": num("len_min"), "Max Packet Length": num("len_max"),
        "Packet Length Mean": mean("packet_count", "bytes"), "Average Packet Size": mean("packet_count", "bytes"),
        "Packet Length Std": std("packet_count", "bytes", "len_sq"),
        "Packet Length Variance": f"({std('packet_count', 'bytes', 'len_sq')}) * ({std('packet_count', 'bytes', 'len_sq')})",
        "Total Fwd Packets": num("fwd_n"), "Total Backward Packets": num("bwd_n"),
        "Total Length of Fwd Packets": num("fwd_bytes"), "Total Length of Bwd Packets": num("bwd_bytes"),
        "Down/Up Ratio": "bwd_n::DOUBLE / greatest(fwd_n, 1)::DOUBLE",
        "act_data_pkt_fwd": num("fwd_n"), "min_seg_size_forward": num("fwd_min"),
        "Fwd Header Length.1": num("fwd_n * 20"), "Fwd IAT Total": num(dur), "Bwd IAT Total": zero,
        "Active Mean": num(dur), "Active Max": num(dur), "Active Min": num(dur), "Active Std": zero,
    }
    for cap_name, s in (("Fwd", "fwd"), ("Bwd", "bwd")):
        f |= {
            f"{cap_name} Packet Length Max": num(f"{s}_max"), f"{cap_name} Packet Length Min": num(f"{s}_min"),
            f"{cap_name} Packet Length Mean": mean(f"{s}_n", f"{s}_bytes"),
            f"Avg {cap_name} Segment Size": mean(f"{s}_n", f"{s}_bytes"),
            f"{cap_name} Packet Length Std": std(f"{s}_n", f"{s}_bytes", f"{s}_sq"),
            f"{cap_name} Header Length": num(f"{s}_n * 20"), f"{cap_name} Packets/s": f"{s}_n::DOUBLE / {sec}",
            f"Subflow {cap_name} Packets": num(f"{s}_n"), f"Subflow {cap_name} Bytes": num(f"{s}_bytes"),
        }
    for stat in ("Mean", "Std", "Max", "Min"):
        f[f"Bwd IAT {stat}"] = f[f"Idle {stat}"] = zero
    for pre in ("Flow", "Fwd"):
        f |= {
            f"{pre} IAT Mean": mean("(packet_count - 1)", dur),
            f"{pre} IAT Std": std("packet_count - 1", dur, "coalesce(iat_sq, 0)"),
            f"{pre} IAT Max": num("iat_max"), f"{pre} IAT Min": num("iat_min"),
        }
    for flag in FL.FLAG_LETTERS:
        f[f"{flag.upper()} Flag Count"] = num(flag)
    return {n: f[n] for n in S.FLOW_FEATURES}


STRICT = _segment_ctes("strict")
PARITY = _segment_ctes("parity")


def _sql(body: str, *views: str, mode: str = "strict") -> str:
    return with_views(body, views, STRICT if mode == "strict" else PARITY)


# Standard deviations of gaps pass through wide integers; both sides round them.
ROUNDED = {"Flow IAT Std": 3, "Fwd IAT Std": 3}


def _features_out(df: DataFrame, names: list[str], keep: list[str]) -> DataFrame:
    return df.select(*keep, *[
        (F.round(C.quoted(n), ROUNDED[n]) if n in ROUNDED else C.quoted(n)).alias(n) for n in names
    ])


def _features_sql(names: list[str], keep: str) -> str:
    cols = ", ".join(f'round("{n}", {ROUNDED[n]}) AS "{n}"' if n in ROUNDED else f'"{n}"' for n in names)
    return _sql(f"SELECT {keep}, {cols} FROM flow_features", "flow_features")


def _feature_query(names: list[str]):
    def build(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = flows(spark, sf_dir).select("flow_id", *FL.feature_columns().values())
        return _features_out(rows, names, ["flow_id"])

    return build, _features_sql(names, "flow_id")


def _named(*parts: str) -> list[str]:
    return [n for n in S.FLOW_FEATURES if any(p in n for p in parts)]


_ALL = list(S.FLOW_FEATURES)
_REGISTER_COLS = ("flow_id, source, destination, source_port, destination_port, protocol, packet_count, bytes, "
                  "active, simulation, error, prediction, is_attack, confidence, round(uncertainty, 9) AS uncertainty, "
                  "models_agree, should_investigate, attack_probability")


def _flat(reg: DataFrame) -> DataFrame:
    return reg.select(
        "flow_id", "source", "destination", "source_port", "destination_port", "protocol", "packet_count", "bytes",
        "active", "simulation", "error", "prediction.prediction", "prediction.is_attack", "prediction.confidence",
        F.round("prediction.uncertainty", 9).alias("uncertainty"), "prediction.models_agree",
        "prediction.should_investigate",
        F.try_element_at("prediction.probabilities", F.lit("1")).alias("attack_probability"),
    )


def flow_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: packets to flows to per-protocol totals."""
    f = FL.flow_table(packets(spark, sf_dir), IDLE_US, CAP)
    return f.groupBy("protocol").agg(
        F.count("*").alias("flows"),
        F.count_if(F.col("active")).alias("active_flows"),
        F.sum("packet_count").alias("packets"),
        F.sum("bytes").alias("bytes"),
        F.sum("fwd_n").alias("fwd_packets"),
        F.sum("bwd_n").alias("bwd_packets"),
        F.sum(F.col("last_seen_us") - F.col("started_us")).alias("duration_us"),
        F.count_if(F.col("packet_count") >= CAP).alias("full_flows"),
    )


def _segment_out(mode: str):
    def build(spark: SparkSession, sf_dir: str) -> DataFrame:
        return segmented(spark, sf_dir, mode).select(
            "seq", *FL.KEY, "position", "flow_start", "iat_us",
        )

    return build, _sql("SELECT seq, protocol, a_ip, a_port, b_ip, b_port, position, "
                       "CAST(flow_start AS BIGINT) AS flow_start, iat_us FROM members", "members", mode=mode)


def _direction(spark: SparkSession, sf_dir: str) -> DataFrame:
    seg = segmented(spark, sf_dir)
    heads = FL.accumulate(seg, IDLE_US, CAP).select(*FL.KEY, "flow_start", "opener_a")
    return seg.join(heads, [*FL.KEY, "flow_start"]).select("seq", (F.col("from_a") == F.col("opener_a")).alias("forward"))


def _window_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = FL.since(packets(spark, sf_dir), EARLY_US)
    return FL.flow_table(kept, IDLE_US, CAP).agg(
        F.sum("packet_count").alias("packets"), F.count("*").alias("flows"),
        F.count_if(F.col("active")).alias("active_flows"),
    )


def since_start() -> dict:
    """The views of strict flows over the packets since ``EARLY_US``."""
    from .views import CTES

    return STRICT | {"packets": (("raw_packets",), CTES["packets"][1] + f" AND ts_us >= {EARLY_US}")}


def _window_sql() -> str:
    return with_views("SELECT CAST(sum(packet_count) AS BIGINT) AS packets, count(*) AS flows, "
                      "count(*) FILTER (active) AS active_flows FROM flow_rows", ["flow_rows"], since_start())


def _record(spark: SparkSession, sf_dir: str) -> DataFrame:
    return FL.flow_records(flows(spark, sf_dir)).filter(~F.col("active")).select(
        "flow_id", "source", "destination", "protocol", "started_at", "last_seen_at", "duration_seconds",
        "packet_count", "bytes")


_ISO = ("CASE WHEN {c} % 1000000 = 0 THEN strftime(make_timestamp({c}), '%Y-%m-%dT%H:%M:%S+00:00') "
        "ELSE strftime(make_timestamp({c}), '%Y-%m-%dT%H:%M:%S.%f+00:00') END")

Q: dict[str, tuple] = {
    "flow_activity": (flow_activity, _sql(f"""
        SELECT protocol, count(*) AS flows, count(*) FILTER (active) AS active_flows,
          CAST(sum(packet_count) AS BIGINT) AS packets, CAST(sum(bytes) AS BIGINT) AS bytes,
          CAST(sum(fwd_n) AS BIGINT) AS fwd_packets, CAST(sum(bwd_n) AS BIGINT) AS bwd_packets,
          CAST(sum(last_seen_us - started_us) AS BIGINT) AS duration_us,
          count(*) FILTER (packet_count >= {CAP}) AS full_flows
        FROM flow_rows GROUP BY protocol""", "flow_rows")),
    "f1_ipv4_packets": (
        lambda s, d: raw_packets(s, d).filter(F.col("ip_version") == 4).groupBy("ip_proto").agg(
            F.count("*").alias("packets"), F.sum("length").alias("bytes")),
        _sql("SELECT ip_proto, count(*) AS packets, CAST(sum(length) AS BIGINT) AS bytes FROM raw_packets "
             "WHERE ip_version = 4 GROUP BY ip_proto", "raw_packets")),
    "f2_protocol_ports": (
        packets, _sql("SELECT seq, ts_us, protocol, src_ip, src_port, dst_ip, dst_port, length, flags FROM packets",
                      "packets")),
    "f3_flow_key": (
        lambda s, d: FL.with_flow_key(packets(s, d)).select("seq", *FL.KEY),
        _sql("SELECT seq, protocol, a_ip, a_port, b_ip, b_port FROM keyed", "keyed")),
    "f4_direction": (_direction, _sql("SELECT seq, fwd AS forward FROM members", "members")),
    "f6_segment_strict": _segment_out("strict"),
    "f6_segment_parity": _segment_out("parity"),
    "f7_flow_id": (
        lambda s, d: flows(s, d).select("flow_id", "first_seq", "protocol", "flow_start"),
        _sql("SELECT flow_id, first_seq, protocol, flow_start FROM flow_rows", "flow_rows")),
    "f7_flow_id_parity": (
        lambda s, d: flows(s, d, "parity").select("flow_id", "first_seq", "packet_count", "active"),
        _sql("SELECT flow_id, first_seq, packet_count, active FROM flow_rows", "flow_rows", mode="parity")),
    "f8_accumulators": (
        lambda s, d: flows(s, d).select("flow_id", "packet_count", "bytes", "fwd_n", "bwd_n", "fwd_bytes",
                                        "bwd_bytes", "started_us", "last_seen_us"),
        _sql("SELECT flow_id, packet_count, bytes, fwd_n, bwd_n, fwd_bytes, bwd_bytes, started_us, last_seen_us "
             "FROM flow_rows", "flow_rows")),
    "f5_flag_counts": _feature_query(_named("Flag Count")),
    "f9_length_stats": _feature_query(_named("Packet Length", "Packet Size")),
    "f10_inter_arrival": _feature_query(_named("IAT", "Flow Duration")),
    "f11_rates": _feature_query(_named("/s")),
    "f12_header_ratio": _feature_query(_named("Header", "Ratio")),
    "f13_subflow_active_idle": _feature_query(_named("Subflow", "Segment", "Active", "Idle", "act_data", "min_seg")),
    "f14_unavailable": _feature_query([*S.UNAVAILABLE_FEATURES, *_named("Bwd IAT")]),
    "f15_feature_vector": _feature_query(_ALL),
    "f16_completed_records": (_record, _sql(f"""
        SELECT flow_id, source_ip || ':' || source_port AS source, destination_ip || ':' || destination_port AS destination,
          protocol, {_ISO.format(c='started_us')} AS started_at, {_ISO.format(c='last_seen_us')} AS last_seen_at,
          round((last_seen_us - started_us)::DOUBLE / 1000000.0::DOUBLE, 6) AS duration_seconds, packet_count, bytes
        FROM flow_rows WHERE NOT active""", "flow_rows")),
    "f17_active_flows": (
        lambda s, d: _features_out(
            flows(s, d).filter("active").select("flow_id", "packet_count", *FL.feature_columns().values()),
            _ALL, ["flow_id", "packet_count"]),
        _features_sql(_ALL, "flow_id, packet_count") + " WHERE active"),
    "f18_j3_attached_predictions": (lambda s, d: _flat(scored_register(s, d)),
                                    _sql(f"SELECT {_REGISTER_COLS} FROM register", "register")),
    "f19_window_counters": (
        lambda s, d: LV.counters(register(s, d)), _sql("""
        SELECT CAST(sum(packet_count) AS BIGINT) AS packets_captured, count(*) AS flows_detected,
          count(*) FILTER (NOT active AND prediction IS NOT NULL) AS flows_analyzed,
          count(*) FILTER (is_attack) AS suspicious_flows, count(*) FILTER (NOT active) AS predictions_used
        FROM register""", "register")),
    "f20_alerts": (lambda s, d: _flat(LV.recent_alerts(register(s, d), 25)), _sql(f"""
        SELECT {_REGISTER_COLS} FROM register WHERE is_attack ORDER BY completed_us, flow_id LIMIT 25""", "register")),
    "f21_highest_risk": (lambda s, d: _flat(LV.highest_risk(register(s, d))), _sql(f"""
        SELECT {_REGISTER_COLS} FROM register WHERE is_attack
        ORDER BY register.confidence DESC, completed_us, flow_id LIMIT 1""", "register")),
    "f22_recent_flows": (lambda s, d: _flat(LV.recent(register(s, d), 25)), _sql(f"""
        SELECT {_REGISTER_COLS} FROM register WHERE NOT active ORDER BY completed_us, flow_id LIMIT 25""", "register")),
    "f23_flow_by_id": (lambda s, d: _flat(LV.flow_by_id(register(s, d), 17)), _sql(f"""
        SELECT {_REGISTER_COLS} FROM register WHERE NOT active AND flow_id = 17""", "register")),
    "f24_flow_evidence": (
        lambda s, d: LV.flow_evidence(scored_register(s, d, True), 17).select(
            "flow_id", "source", "destination", "protocol", "prediction.prediction", "prediction.confidence", "error",
            C.quoted("Flow Duration"), C.quoted("Flow Bytes/s"), C.quoted("Destination Port")),
        with_views("""
        SELECT r.flow_id, source, r.destination, r.protocol, prediction, confidence,
          CASE WHEN prediction IS NULL THEN coalesce(error, 'Flow was not analyzed.') END AS error,
          "Flow Duration", "Flow Bytes/s", "Destination Port"
        FROM register r JOIN flow_features f ON r.flow_id = f.flow_id WHERE NOT r.active AND r.flow_id = 17""",
                   ["register", "flow_features"], STRICT)),
    "f25_touching_port": (lambda s, d: _flat(LV.touching_port(register(s, d), 443)), _sql(f"""
        SELECT {_REGISTER_COLS} FROM register WHERE NOT active AND (source_port = 443 OR destination_port = 443)""",
                                                                                       "register")),
    "j4_selected_alerts": (
        lambda s, d: LV.selected_alerts(LV.touching_port(register(s, d), 443)).select("flow_id"),
        _sql("SELECT flow_id FROM register WHERE is_attack AND (source_port = 443 OR destination_port = 443)",
             "register")),
    "f26_u2_alert_ports": (lambda s, d: LV.alert_ports(register(s, d)), _sql("""
        SELECT DISTINCT port FROM (SELECT source_port AS port FROM register WHERE is_attack AND NOT simulation
          UNION ALL SELECT destination_port FROM register WHERE is_attack AND NOT simulation)""", "register")),
    "f27_elevated_uncertainty": (
        lambda s, d: LV.elevated_uncertainty(register(s, d)).select("flow_id"),
        _sql("SELECT flow_id FROM register WHERE uncertainty >= 0.3::DOUBLE", "register")),
    "f28_agreement_tally": (lambda s, d: LV.agreement_tally(register(s, d)), _sql("""
        SELECT count(*) FILTER (models_agree) AS agree, count(*) FILTER (NOT models_agree) AS disagree
        FROM register""", "register")),
    "f29_flow_summary": (
        lambda s, d: LV.flow_summary(register(s, d)).select(
            "flow_id", "source", "destination", "source_port", "destination_port", "protocol", "packet_count",
            "bytes", "is_attack", "prediction", "attack_probability", "confidence", "models_agree", "simulation",
            F.try_element_at("model_agreement", F.lit("random_forest")).alias("random_forest")),
        _sql("""SELECT flow_id, source, destination, CASE WHEN NOT simulation THEN source_port END AS source_port,
          CASE WHEN NOT simulation THEN destination_port END AS destination_port, protocol, packet_count, bytes,
          is_attack, prediction, attack_probability, confidence, models_agree, simulation,
          CASE WHEN prediction IS NOT NULL THEN rf END AS random_forest FROM register WHERE NOT active""", "register")),
    "f30_network_summary": (lambda s, d: LV.network_summary(register(s, d)), _sql("""
        SELECT *, flows_analyzed || ' flows analyzed and ' || suspicious_flows || ' suspicious flows detected.' AS answer
        FROM (SELECT count(*) FILTER (prediction IS NOT NULL) AS flows_analyzed,
          count(*) FILTER (is_attack) AS suspicious_flows,
          (SELECT flow_id FROM register WHERE is_attack ORDER BY confidence DESC, completed_us, flow_id LIMIT 1)
            AS highest_risk_flow,
          max(confidence) FILTER (is_attack) AS highest_risk_confidence FROM register)""", "register")),
    "f31_u1_activity": (lambda s, d: LV.activity(register(s, d)), _sql("""
        SELECT flow_id, source, destination, protocol, packet_count, bytes,
          CASE WHEN NOT active THEN coalesce(prediction, error) END AS prediction, confidence,
          CASE WHEN NOT active THEN CASE WHEN is_attack AND simulation THEN 'SIMULATED ATTACK'
            WHEN is_attack THEN 'ATTACK' ELSE coalesce(prediction, error) END END AS display,
          CASE WHEN active THEN 'Active' ELSE 'Completed' END AS status FROM register""", "register")),
    "f32_window_start": (_window_counters, _window_sql()),
    "f33_captured_only": (
        lambda s, d: LV.captured_only(register(s, d)).groupBy("protocol").agg(F.count("*").alias("flows")),
        _sql("SELECT protocol, count(*) AS flows FROM register WHERE NOT simulation GROUP BY protocol", "register")),
}
