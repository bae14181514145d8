"""Where a job may write its intermediate tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def configure(spark: SparkSession) -> SparkSession:
    """Session settings the results depend on (only run-time ones)."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``, which every executor and the driver can reach.

    Where that is unset (tests, local runs) the warehouse, which is shared on every cluster too.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    return (named or f"{spark.conf.get('spark.sql.warehouse.dir')}/_stages").rstrip("/")


def run_folder(spark: SparkSession, name: str) -> str:
    """A new folder path for one run of one job."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def staged(df: DataFrame, name: str, rows_a_group: int | None = None) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    Cuts lineage: a lost executor re-reads files instead of re-running the job so far,
    and several readers share one computation. ``rows_a_group`` is for rows of megabytes: writers and
    readers hold a row group, whose size is otherwise looked at after the first hundred rows.
    """
    path = run_folder(df.sparkSession, name)
    df.write.options(**{"parquet.block.row.count.limit": rows_a_group} if rows_a_group else {}).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
