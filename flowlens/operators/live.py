"""Queries over the flow register: counters, alerts, ports, agreement, activity.

Input is a table of flows with ``active``, a nullable ``prediction`` struct, a nullable
``error`` and a ``simulation`` flag.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from ..errors import FlowLensError

IS_ALERT = "prediction.is_attack"


def attach_predictions(flows: DataFrame, prediction: Column, error: Column) -> DataFrame:
    """Prediction on completed flows only; a failed scoring leaves null and its error text."""
    usable = ~F.col("active") & error.isNull()
    return flows.withColumn("prediction", F.when(usable, prediction)).withColumn(
        "error", F.when(~F.col("active"), error)
    )


def completed_at(idle_us: int, cap: int) -> Column:
    """When a flow left the open table: at its last packet if full, else after the idle time."""
    return F.when(F.col("packet_count") >= cap, F.col("last_seen_us")).otherwise(F.col("last_seen_us") + idle_us)


def _alert() -> Column:
    return ~F.col("active") & F.coalesce(F.col(IS_ALERT), F.lit(False))


def alerts(flows: DataFrame) -> DataFrame:
    return flows.filter(_alert())


def recent(flows: DataFrame, limit: int, order: str = "completed_us") -> DataFrame:
    """First completed flows in completion order."""
    return flows.filter(~F.col("active")).orderBy(order, "flow_id").limit(max(0, limit))


def recent_alerts(flows: DataFrame, limit: int, order: str = "completed_us") -> DataFrame:
    return alerts(flows).orderBy(order, "flow_id").limit(S.clamp_limit(limit))


def counters(flows: DataFrame) -> DataFrame:
    """Window counters in one pass; every packet belongs to exactly one flow."""
    done = ~F.col("active")
    return flows.agg(
        F.coalesce(F.sum("packet_count"), F.lit(0)).alias("packets_captured"),
        F.count("*").alias("flows_detected"),
        F.count_if(done & F.col("prediction").isNotNull()).alias("flows_analyzed"),
        F.count_if(_alert()).alias("suspicious_flows"),
        F.count_if(done).alias("predictions_used"),
    )


def highest_risk(flows: DataFrame, order: str = "completed_us") -> DataFrame:
    """The alert of largest confidence, the first completed wins ties."""
    return alerts(flows).orderBy(F.desc("prediction.confidence"), order, "flow_id").limit(1)


def network_summary(flows: DataFrame) -> DataFrame:
    """Counters, status and the highest-risk flow in one aggregation."""
    best = F.struct(F.col("prediction.confidence"), -F.col("completed_us"), -F.col("flow_id"))
    summary = flows.agg(
        F.count_if(~F.col("active") & F.col("prediction").isNotNull()).alias("flows_analyzed"),
        F.count_if(_alert()).alias("suspicious_flows"),
        F.max_by(F.when(_alert(), F.col("flow_id")), F.when(_alert(), best)).alias("highest_risk_flow"),
        F.max(F.when(_alert(), F.col("prediction.confidence"))).alias("highest_risk_confidence"),
    )
    return summary.withColumn(
        "answer",
        F.concat(
            F.col("flows_analyzed").cast("string"), F.lit(S.SUMMARY_ANALYZED),
            F.col("suspicious_flows").cast("string"), F.lit(S.SUMMARY_SUSPICIOUS),
        ),
    )


def flow_by_id(flows: DataFrame, flow_id: int) -> DataFrame:
    """The completed flow of that number; a number that no completed flow has is an error."""
    found = flows.filter(~F.col("active") & (F.col("flow_id") == flow_id))
    if found.isEmpty():
        raise FlowLensError(f"There is no completed flow {flow_id}.")
    return found


def flow_evidence(flows: DataFrame, flow_id: int) -> DataFrame:
    """Prediction, features and endpoints of one flow, or why it was not analysed."""
    failed = F.col("prediction").isNull()
    return flow_by_id(flows, flow_id).withColumn(
        "error", F.when(failed, F.coalesce("error", F.lit(S.NOT_ANALYZED)))
    )


def touching_port(flows: DataFrame, port: int) -> DataFrame:
    return flows.filter(~F.col("active") & ((F.col("source_port") == port) | (F.col("destination_port") == port)))


def selected_alerts(selection: DataFrame) -> DataFrame:
    """The alerts among selected flows."""
    return alerts(selection)


def alert_ports(flows: DataFrame) -> DataFrame:
    """Distinct ports seen in alerts of captured traffic, ascending."""
    return (
        alerts(flows).filter(~F.col("simulation"))
        .select(F.explode(F.array("source_port", "destination_port")).alias("port"))
        .distinct()
        .orderBy("port")
    )


def elevated_uncertainty(flows: DataFrame, threshold: float = S.ELEVATED_UNCERTAINTY) -> DataFrame:
    return flows.filter(~F.col("active") & (F.col("prediction.uncertainty") >= threshold))


def agreement_tally(flows: DataFrame) -> DataFrame:
    """Flows on which the baselines agree or disagree; unscored flows count in neither."""
    done = ~F.col("active")
    return flows.agg(
        F.count_if(done & F.col("prediction.models_agree")).alias("agree"),
        F.count_if(done & ~F.col("prediction.models_agree")).alias("disagree"),
    )


def flow_summary(flows: DataFrame) -> DataFrame:
    """Analyst projection of completed flows; simulated rows have no network port."""
    port = {c: F.when(~F.col("simulation"), F.col(c)).alias(c) for c in ("source_port", "destination_port")}
    return flows.filter(~F.col("active")).select(
        "flow_id", "source", "destination", *port.values(), "protocol", "packet_count", "bytes",
        "prediction.is_attack", "prediction.prediction",
        F.try_element_at("prediction.probabilities", F.lit("1")).alias("attack_probability"),
        "prediction.confidence", "prediction.uncertainty", "prediction.models_agree",
        "prediction.model_agreement", "simulation",
        F.coalesce("prediction.evidence", F.array().cast("array<string>")).alias("evidence"),
    )


def activity(flows: DataFrame) -> DataFrame:
    """Completed flows and open flows in one table with a status text."""
    common = ["flow_id", "source", "destination", "protocol", "packet_count", "bytes"]
    shown = F.coalesce("prediction.prediction", "error")
    attack = F.when(F.col("simulation"), S.SIMULATED_TEXT).otherwise(S.ATTACK_TEXT)
    completed = flows.filter(~F.col("active")).select(
        *common,
        shown.alias("prediction"),
        F.col("prediction.confidence").alias("confidence"),
        F.when(F.col(IS_ALERT), attack).otherwise(shown).alias("display"),
        F.lit(S.STATUS_COMPLETED).alias("status"),
    )
    open_now = flows.filter("active").select(*common, F.lit(S.STATUS_ACTIVE).alias("status"))
    return completed.unionByName(open_now, allowMissingColumns=True)


def captured_only(flows: DataFrame) -> DataFrame:
    return flows.filter(~F.col("simulation"))
