"""Table schemas, feature names and label conventions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import types as T

from .errors import FlowLensError

# --- fixed values -----------------------------------------------------------
# The 78 numeric flow features of the public CICIDS2017 flow tables, in file order.
FLOW_FEATURES: tuple[str, ...] = (
    "Destination Port",
    "Flow Duration",
    "Total Fwd Packets",
    "Total Backward Packets",
    "Total Length of Fwd Packets",
    "Total Length of Bwd Packets",
    "Fwd Packet Length Max",
    "Fwd Packet Length Min",
    "Fwd Packet Length Mean",
    "Fwd Packet Length Std",
    "Bwd Packet Length Max",
    "Bwd Packet Length Min",
    "Bwd Packet Length Mean",
    "Bwd Packet Length Std",
    "Flow Bytes/s",
    "Flow Packets/s",
    "Flow IAT Mean",
    "Flow IAT Std",
    "Flow IAT Max",
    "Flow IAT Min",
    "Fwd IAT Total",
    "Fwd IAT Mean",
    "Fwd IAT Std",
    "Fwd IAT Max",
    "Fwd IAT Min",
    "Bwd IAT Total",
    "Bwd IAT Mean",
    "Bwd IAT Std",
    "Bwd IAT Max",
    "Bwd IAT Min",
    "Fwd PSH Flags",
    "Bwd PSH Flags",
    "Fwd URG Flags",
    "Bwd URG Flags",
    "Fwd Header Length",
    "Bwd Header Length",
    "Fwd Packets/s",
    "Bwd Packets/s",
    "Min Packet Length",
    "Max Packet Length",
    "Packet Length Mean",
    "Packet Length Std",
    "Packet Length Variance",
    "FIN Flag Count",
    "SYN Flag Count",
    "RST Flag Count",
    "PSH Flag Count",
    "ACK Flag Count",
    "URG Flag Count",
    "CWE Flag Count",
    "ECE Flag Count",
    "Down/Up Ratio",
    "Average Packet Size",
    "Avg Fwd Segment Size",
    "Avg Bwd Segment Size",
    "Fwd Header Length.1",
    "Fwd Avg Bytes/Bulk",
    "Fwd Avg Packets/Bulk",
    "Fwd Avg Bulk Rate",
    "Bwd Avg Bytes/Bulk",
    "Bwd Avg Packets/Bulk",
    "Bwd Avg Bulk Rate",
    "Subflow Fwd Packets",
    "Subflow Fwd Bytes",
    "Subflow Bwd Packets",
    "Subflow Bwd Bytes",
    "Init_Win_bytes_forward",
    "Init_Win_bytes_backward",
    "act_data_pkt_fwd",
    "min_seg_size_forward",
    "Active Mean",
    "Active Std",
    "Active Max",
    "Active Min",
    "Idle Mean",
    "Idle Std",
    "Idle Max",
    "Idle Min",
)

# Features a packet-header stream cannot observe: reported as an explicit zero.
UNAVAILABLE_FEATURES: tuple[str, ...] = (
    "Fwd PSH Flags",
    "Bwd PSH Flags",
    "Fwd URG Flags",
    "Bwd URG Flags",
    "CWE Flag Count",
    "ECE Flag Count",
    "Fwd Avg Bytes/Bulk",
    "Fwd Avg Packets/Bulk",
    "Fwd Avg Bulk Rate",
    "Bwd Avg Bytes/Bulk",
    "Bwd Avg Packets/Bulk",
    "Bwd Avg Bulk Rate",
    "Init_Win_bytes_forward",
    "Init_Win_bytes_backward",
)

# Capture days in calendar order, label column names, metadata columns.
DAY_ORDER: tuple[str, ...] = ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday")
LABEL_NAMES: tuple[str, ...] = ("label", "target", "class", "attack", "is_attack")
METADATA_COLUMNS: tuple[str, ...] = ("day", "file")
BENIGN = "BENIGN"

# Cell texts the usual CSV readers of such tables take for "missing".
MISSING_TOKENS: tuple[str, ...] = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)

# Flow segmentation and sampling defaults.
IDLE_SECONDS = 5
PACKET_CAP = 100
HEADER_BYTES = 20
RATE_FLOOR_SECONDS = 1e-6
SEED = 42
TEST_SIZE = 0.2
BLOCK_ROWS = 10_000
MAX_ROWS = 100_000
HIGH_CONFIDENCE = 0.8
REVIEW_CONFIDENCE = 0.9
ELEVATED_UNCERTAINTY = 0.3
ERROR_RISK = 0.25
ATTACK_RISK = 0.15

# Texts that are part of the results.
EVIDENCE_MISSING = " feature values were missing and median-imputed."
EVIDENCE_LARGEST = "Highest-magnitude observed feature: "
EVIDENCE_SURE = "High confidence"
EVIDENCE_UNSURE = "Review manually: model confidence is below 0.8."
NOT_ANALYZED = "Flow was not analyzed."
SUMMARY_ANALYZED = " flows analyzed and "
SUMMARY_SUSPICIOUS = " suspicious flows detected."
STATUS_ACTIVE = "Active"
STATUS_COMPLETED = "Completed"
ATTACK_TEXT = "ATTACK"
SIMULATED_TEXT = "SIMULATED ATTACK"
BETTER = "better"
NOT_BETTER = "worse or equal"
# --- end of fixed values ----------------------------------------------------

RAW_PACKET_SCHEMA = T.StructType([
    T.StructField("seq", T.LongType()),
    T.StructField("ts_us", T.LongType()),
    T.StructField("ip_version", T.IntegerType()),
    T.StructField("ip_proto", T.IntegerType()),
    T.StructField("src_ip", T.StringType()),
    T.StructField("src_port", T.IntegerType()),
    T.StructField("dst_ip", T.StringType()),
    T.StructField("dst_port", T.IntegerType()),
    T.StructField("length", T.LongType()),
    T.StructField("flags", T.StringType()),
])

CLEAN_FLOW_SCHEMA = T.StructType(
    [T.StructField(name, T.FloatType()) for name in FLOW_FEATURES]
    + [
        T.StructField("Label", T.StringType()),
        T.StructField("day", T.StringType()),
        T.StructField("file", T.StringType()),
        T.StructField("is_attack", T.ByteType()),
    ]
)

PREDICTION_TYPE = T.StructType([
    T.StructField("prediction", T.StringType()),
    T.StructField("is_attack", T.BooleanType()),
    T.StructField("confidence", T.DoubleType()),
    T.StructField("uncertainty", T.DoubleType()),
    T.StructField("model_agreement", T.MapType(T.StringType(), T.StringType())),
    T.StructField("models_agree", T.BooleanType()),
    T.StructField("should_investigate", T.BooleanType()),
    T.StructField("probabilities", T.MapType(T.StringType(), T.DoubleType())),
    T.StructField("evidence", T.ArrayType(T.StringType())),
])

LIVE_FLOW_SCHEMA = T.StructType([
    T.StructField("flow_id", T.LongType()),
    T.StructField("source", T.StringType()),
    T.StructField("destination", T.StringType()),
    T.StructField("source_ip", T.StringType()),
    T.StructField("source_port", T.IntegerType()),
    T.StructField("destination_ip", T.StringType()),
    T.StructField("destination_port", T.IntegerType()),
    T.StructField("protocol", T.StringType()),
    T.StructField("started_at", T.StringType()),
    T.StructField("last_seen_at", T.StringType()),
    T.StructField("duration_seconds", T.DoubleType()),
    T.StructField("packet_count", T.LongType()),
    T.StructField("bytes", T.LongType()),
    T.StructField("features", T.MapType(T.StringType(), T.DoubleType())),
    T.StructField("prediction", PREDICTION_TYPE),
    T.StructField("error", T.StringType()),
    T.StructField("simulation", T.BooleanType()),
])


def label_candidates(columns: Sequence[str]) -> list[str]:
    """Columns whose name marks them as a label, in table order."""
    return [c for c in columns if c.lower() in LABEL_NAMES]


def detect_label(columns: Sequence[str], requested: str | None = None) -> str:
    """The requested label column, else the first candidate."""
    if requested is not None:
        if requested in columns:
            return requested
        raise FlowLensError(f"The table has no column '{requested}' to use as label.")
    found = label_candidates(columns)
    if not found:
        raise FlowLensError("None of the columns looks like a label; pass one by name.")
    return found[0]


def numeric_features(schema: T.StructType, label: str) -> list[str]:
    """Numeric columns a model may use: no label candidate and no metadata."""
    barred = set(label_candidates(schema.names)) | {label, *METADATA_COLUMNS}
    features = [
        f.name for f in schema.fields
        if f.name not in barred and isinstance(f.dataType, T.NumericType)
    ]
    if not features:
        raise FlowLensError("The table has no numeric column left to train on.")
    return features


def clamp_limit(limit: int, low: int = 1, high: int = 100) -> int:
    """Result limits are kept within 1..100."""
    return max(low, min(int(limit), high))
