"""Writers: clean table, count tables, experiment rows, live state."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema as S
from ..errors import FlowLensError


def write_clean(clean: DataFrame, path: str) -> None:
    """The clean flow table, one folder per capture day."""
    clean.write.mode("overwrite").partitionBy("day").parquet(path)


def write_counts(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", "true").csv(path)


def append_experiment(
    spark: SparkSession,
    path: str,
    metrics: DataFrame,
    reliability: DataFrame,
    profile: DataFrame,
    description: Mapping[str, str],
) -> None:
    """Append one experiment: description, preprocessing, and its long tables as JSON text."""
    def document(df: DataFrame):
        return df.agg(F.to_json(F.collect_list(F.struct(*[F.col(f"`{c}`") for c in df.columns])))).scalar()

    # metrics, bins and column profiles have one row per model, bin or column
    row = spark.range(1).select(
        F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'").alias("timestamp_utc"),
        F.lit(S.SEED).alias("random_seed"),
        *[F.lit(v).alias(k) for k, v in description.items()],
        document(profile).alias("dataset"),
        document(metrics).alias("metrics"),
        document(reliability).alias("reliability"),
        F.lit("NaN").alias("infinite_values"),
        F.lit(True).alias("numeric_coercion"),
        F.array(*[F.lit(c) for c in S.METADATA_COLUMNS]).alias("metadata_excluded"),
    )
    row.coalesce(1).write.mode("append").json(path)


def read_or_empty(spark: SparkSession, path: str, schema) -> DataFrame:
    """A stored table, empty with the right columns when nothing was written yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except Exception as error:
        if "PATH_NOT_FOUND" in str(error):
            return spark.createDataFrame([], schema)
        raise FlowLensError(f"The table at {path} cannot be read: {error}") from error


def read_live_state(spark: SparkSession, path: str) -> DataFrame:
    """The stored flow register."""
    return read_or_empty(spark, path, S.LIVE_FLOW_SCHEMA)


def write_audit(report: DataFrame, path: str) -> None:
    """One audit row per file."""
    report.write.mode("overwrite").json(path)
