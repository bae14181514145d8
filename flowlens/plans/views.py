"""The engine's input tables derived from the benchmark tables, in Spark and as SQL.

Each Spark view has a SQL twin of the same name and columns in ``CTES``; ``with_views``
puts the ones a query needs in front of it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..workspace import configure

# Segmentation parameters on the packet view, whose packets are minutes apart.
IDLE_US = 6 * 3600 * 1_000_000
CAP = 3

CLASSES = ["BENIGN", "DoS", "PortScan"]
MODELS: dict[str, tuple[tuple[int, int, int], int]] = {
    "primary": ((7919, 104729, 1299709), 0),
    "random_forest": ((15485863, 32452843, 49979687), 1),
    "logistic_regression": ((67867967, 86028121, 104395301), 2),
}
FEATURES = ["line_count", "qty_sum", "qty_min", "qty_max", "price_cents", "discount_pct"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return configure(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def micros(ts: str) -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp"))


# --- packets ------------------------------------------------------------------


def raw_packets_from(events: DataFrame) -> DataFrame:
    user, kind = F.col("user_id"), F.col("event_type")
    proto = F.when(user % 10 == 0, 1).when(user % 3 == 0, 17).otherwise(6)
    client_ip = F.concat(F.lit("10.0.0."), user.cast("string"))
    server_ip = F.concat(F.lit("172.16.0."), (user % 4).cast("string"))
    client_port = F.when(proto != 1, (40000 + user).cast("int"))
    server_port = F.when(proto != 1, F.lit(443))
    reply = kind.isin("view", "error")
    letters = (
        F.when(kind == "signup", "S").when(kind == "view", "SA").when(kind == "click", "PA")
        .when(kind == "purchase", "FA").otherwise("RA")
    )
    return events.select(
        F.col("event_id").alias("seq"),
        micros("ts").alias("ts_us"),
        F.when(user % 25 == 24, 6).otherwise(4).alias("ip_version"),
        proto.alias("ip_proto"),
        F.when(reply, server_ip).otherwise(client_ip).alias("src_ip"),
        F.when(reply, server_port).otherwise(client_port).alias("src_port"),
        F.when(reply, client_ip).otherwise(server_ip).alias("dst_ip"),
        F.when(reply, client_port).otherwise(server_port).alias("dst_port"),
        (F.floor("value").cast("bigint") + 40).alias("length"),
        F.when(proto == 6, letters).otherwise("").alias("flags"),
    )


def raw_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw_packets_from(table(spark, sf_dir, "events"))


# --- labelled rows and deterministic scores -------------------------------------


def labelled_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.count("*").alias("line_count"),
        F.sum(F.col("l_quantity").cast("bigint")).alias("qty_sum"),
        F.min(F.col("l_quantity").cast("bigint")).alias("qty_min"),
        F.max(F.col("l_quantity").cast("bigint")).alias("qty_max"),
        F.sum(F.round(F.col("l_extendedprice") * 100).cast("bigint")).alias("price_cents"),
        F.sum(F.round(F.col("l_discount") * 100).cast("bigint")).alias("discount_pct"),
    )
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", "o_orderpriority")
    label = (
        F.when(F.col("o_orderpriority") == "1-URGENT", "DoS")
        .when(F.col("o_orderpriority") == "2-HIGH", "PortScan")
        .otherwise("BENIGN")
    )
    return orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey")).select(
        F.col("o_orderkey").alias("sample_id"),
        *FEATURES,
        F.date_format("o_orderdate", "EEEE").alias("day"),
        label.alias("Label"),
        (label != "BENIGN").cast("int").alias("is_attack"),
    )


def _weights(model: str, label: Column) -> list[Column]:
    multipliers, off = MODELS[model]
    sid = F.col("sample_id")
    return [
        F.lit(1) + (sid * m) % 97 + F.when((label == c) & ((sid + off) % 4 != 0), 150).otherwise(0)
        for c, m in zip(CLASSES, multipliers)
    ]


def scored(spark: SparkSession, sf_dir: str, binary: bool = False) -> DataFrame:
    """Predictions of three models, one row per (model, sample): sample columns, label, probability array."""
    rows = labelled_flows(spark, sf_dir)
    weights = {f"_{m}_{i}": w for m in MODELS for i, w in enumerate(_weights(m, F.col("Label")))}
    weighted = rows.withColumns(weights)
    per_model = []
    for model in MODELS:
        w = [F.col(f"_{model}_{i}") for i in range(3)]
        if binary:
            w = [w[0], w[1] + w[2]]
        total = sum(w[1:], w[0])
        per_model.append(F.struct(F.lit(model).alias("model"), F.array(*[x / total for x in w]).alias("probability")))
    out = weighted.select("sample_id", *FEATURES, "day", "Label", "is_attack", F.inline(F.array(*per_model)))
    label = F.col("is_attack").cast("string") if binary else F.col("Label")
    return out.withColumn("true_label", label)


BINARY = ["0", "1"]

# --- dirty text rows ---------------------------------------------------------------

DIRTY_FEATURES = ["Flow Duration", "Total Fwd Packets", "Fwd Header Length.1", "Flow Bytes/s", "Bwd URG Flags"]


def dirty_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw text rows with infinities, NaN, empty cells, junk, odd labels and repeated rows."""
    key = F.col("l_orderkey") % 41
    duration = (
        F.when(key == 0, "Infinity").when(key == 1, "-Infinity").when(key == 2, "NaN")
        .when(key == 3, "").when(key == 4, "abc")
        .otherwise(F.round(F.col("l_discount") * 100).cast("bigint").cast("string"))
    )
    rate = (
        F.when(F.col("l_partkey") % 37 == 0, "Infinity").when(F.col("l_partkey") % 37 == 1, "NaN")
        .otherwise(F.round(F.col("l_tax") * 100).cast("bigint").cast("string"))
    )
    label = (
        F.when(F.col("l_returnflag") == "A", "BENIGN")
        .when(F.col("l_returnflag") == "N", "BENIGN ")
        .when(F.col("l_linestatus") == "F", "Web Attack ï¿½ XSS")
        .otherwise(" DoS Hulk")
    )
    rows = table(spark, sf_dir, "lineitem").select(
        duration.alias("Flow Duration"),
        F.col("l_quantity").cast("bigint").cast("string").alias("Total Fwd Packets"),
        F.col("l_linenumber").cast("string").alias("Fwd Header Length.1"),
        rate.alias("Flow Bytes/s"),
        F.lit("0").alias("Bwd URG Flags"),
        label.alias("Label"),
        F.concat(F.lower(F.date_format("l_shipdate", "EEEE")), F.lit("-lines.csv")).alias("file"),
        F.when(F.col("l_partkey") % 50 == 0, 2).otherwise(1).alias("copies"),
    )
    return rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).drop("copy", "copies")


# --- SQL twins ----------------------------------------------------------------------


def _sql_scored(model: str, binary: bool) -> str:
    m, off = MODELS[model]
    w = [
        f"(1 + (sample_id * {x}) % 97 + CASE WHEN Label = '{c}' AND (sample_id + {off}) % 4 <> 0 THEN 150 ELSE 0 END)"
        for c, x in zip(CLASSES, m)
    ]
    if binary:
        w = [w[0], f"({w[1]} + {w[2]})"]
    names = BINARY if binary else CLASSES
    weights = ", ".join(f"{x} AS w{i}" for i, x in enumerate(w))
    total = " + ".join(f"w{i}" for i in range(len(w)))
    probs = ", ".join(f"w{i}::DOUBLE / ({total})::DOUBLE AS p{i}" for i in range(len(w)))
    top = "greatest(" + ", ".join(f"p{i}" for i in range(len(w))) + ")"
    pick = "CASE " + " ".join(f"WHEN p{i} = {top} THEN '{n}'" for i, n in enumerate(names)) + " END"
    label = "CAST(is_attack AS VARCHAR)" if binary else "Label"
    return (
        f"SELECT '{model}' AS model, *, {pick} AS predicted_label, {top} AS confidence, "
        f"({pick}) = true_label AS correct FROM (SELECT *, {probs} FROM (SELECT sample_id, "
        f"{', '.join(FEATURES)}, day, Label, is_attack, {label} AS true_label, {weights} FROM labelled_flows))"
    )


CTES: dict[str, tuple[tuple[str, ...], str]] = {
    "raw_packets": ((), """
        SELECT event_id AS seq, epoch_us(ts) AS ts_us,
          CASE WHEN user_id % 25 = 24 THEN 6 ELSE 4 END AS ip_version,
          CASE WHEN user_id % 10 = 0 THEN 1 WHEN user_id % 3 = 0 THEN 17 ELSE 6 END AS ip_proto,
          CASE WHEN event_type IN ('view','error') THEN '172.16.0.' || (user_id % 4) ELSE '10.0.0.' || user_id END AS src_ip,
          CASE WHEN user_id % 10 = 0 THEN NULL WHEN event_type IN ('view','error') THEN 443 ELSE 40000 + user_id END AS src_port,
          CASE WHEN event_type IN ('view','error') THEN '10.0.0.' || user_id ELSE '172.16.0.' || (user_id % 4) END AS dst_ip,
          CASE WHEN user_id % 10 = 0 THEN NULL WHEN event_type IN ('view','error') THEN 40000 + user_id ELSE 443 END AS dst_port,
          CAST(floor(value) AS BIGINT) + 40 AS length,
          CASE WHEN user_id % 10 = 0 OR user_id % 3 = 0 THEN '' WHEN event_type = 'signup' THEN 'S'
            WHEN event_type = 'view' THEN 'SA' WHEN event_type = 'click' THEN 'PA'
            WHEN event_type = 'purchase' THEN 'FA' ELSE 'RA' END AS flags
        FROM events"""),
    "packets": (("raw_packets",), """
        SELECT seq, ts_us,
          CASE ip_proto WHEN 6 THEN 'TCP' WHEN 17 THEN 'UDP' ELSE CAST(ip_proto AS VARCHAR) END AS protocol,
          src_ip, CAST(CASE WHEN ip_proto IN (6, 17) THEN coalesce(src_port, 0) ELSE 0 END AS INTEGER) AS src_port,
          dst_ip, CAST(CASE WHEN ip_proto IN (6, 17) THEN coalesce(dst_port, 0) ELSE 0 END AS INTEGER) AS dst_port,
          length, flags
        FROM raw_packets WHERE ip_version = 4"""),
    "keyed": (("packets",), """
        SELECT *,
          CASE WHEN src_ip < dst_ip OR (src_ip = dst_ip AND src_port <= dst_port) THEN src_ip ELSE dst_ip END AS a_ip,
          CASE WHEN src_ip < dst_ip OR (src_ip = dst_ip AND src_port <= dst_port) THEN src_port ELSE dst_port END AS a_port,
          CASE WHEN src_ip < dst_ip OR (src_ip = dst_ip AND src_port <= dst_port) THEN dst_ip ELSE src_ip END AS b_ip,
          CASE WHEN src_ip < dst_ip OR (src_ip = dst_ip AND src_port <= dst_port) THEN dst_port ELSE src_port END AS b_port
        FROM packets"""),
    "labelled_flows": ((), """
        SELECT o_orderkey AS sample_id, line_count, qty_sum, qty_min, qty_max, price_cents, discount_pct,
          dayname(o_orderdate) AS day,
          CASE o_orderpriority WHEN '1-URGENT' THEN 'DoS' WHEN '2-HIGH' THEN 'PortScan' ELSE 'BENIGN' END AS Label,
          CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 1 ELSE 0 END AS is_attack
        FROM orders JOIN (
          SELECT l_orderkey, count(*) AS line_count, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS qty_sum,
            min(CAST(l_quantity AS BIGINT)) AS qty_min, max(CAST(l_quantity AS BIGINT)) AS qty_max,
            CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS price_cents,
            CAST(sum(CAST(round(l_discount * 100) AS BIGINT)) AS BIGINT) AS discount_pct
          FROM lineitem GROUP BY l_orderkey) ON o_orderkey = l_orderkey"""),
    "scored": (("labelled_flows",), " UNION ALL ".join(_sql_scored(m, False) for m in MODELS)),
    "scored_binary": (("labelled_flows",), " UNION ALL ".join(_sql_scored(m, True) for m in MODELS)),
    "dirty_lines": ((), """
        SELECT CASE l_orderkey % 41 WHEN 0 THEN 'Infinity' WHEN 1 THEN '-Infinity' WHEN 2 THEN 'NaN'
            WHEN 3 THEN '' WHEN 4 THEN 'abc' ELSE CAST(CAST(round(l_discount * 100) AS BIGINT) AS VARCHAR) END AS "Flow Duration",
          CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) AS "Total Fwd Packets",
          CAST(l_linenumber AS VARCHAR) AS "Fwd Header Length.1",
          CASE l_partkey % 37 WHEN 0 THEN 'Infinity' WHEN 1 THEN 'NaN'
            ELSE CAST(CAST(round(l_tax * 100) AS BIGINT) AS VARCHAR) END AS "Flow Bytes/s",
          '0' AS "Bwd URG Flags",
          CASE WHEN l_returnflag = 'A' THEN 'BENIGN' WHEN l_returnflag = 'N' THEN 'BENIGN '
            WHEN l_linestatus = 'F' THEN 'Web Attack ï¿½ XSS' ELSE ' DoS Hulk' END AS "Label",
          lower(dayname(l_shipdate)) || '-lines.csv' AS file
        FROM lineitem, (VALUES (1), (2)) AS c(copy) WHERE copy = 1 OR l_partkey % 50 = 0"""),
}


def with_views(sql: str, names: Sequence[str], extra: dict[str, tuple[tuple[str, ...], str]] | None = None) -> str:
    """Prefix ``sql`` with the CTEs it needs, dependencies first."""
    known = {**CTES, **(extra or {})}
    order: list[str] = []

    def visit(name: str) -> None:
        if name in order or name not in known:
            return
        for parent in known[name][0]:
            visit(parent)
        order.append(name)

    for n in names:
        visit(n)
    parts = [f"{n} AS ({known[n][1].strip()})" for n in order]
    return ("WITH " + ",\n".join(parts) + "\n" if parts else "") + sql.strip()
