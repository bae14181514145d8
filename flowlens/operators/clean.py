"""Raw text captures to the clean flow table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C

PROVENANCE = ("file", "file_path", "file_columns", "day")


def feature_names(df: DataFrame, label: str = "Label") -> list[str]:
    return [c for c in df.columns if c not in (label, "is_attack", *PROVENANCE)]


def coerce(raw: DataFrame, label: str = "Label") -> DataFrame:
    """Features as float32 with infinities and junk null, the label printable, day from file name."""
    features = feature_names(raw, label)
    # parsed in a projection of its own, so that each cell is parsed once
    parsed = raw.select(*[C.parsed_cell(C.quoted(f)).cast("float").alias(f) for f in features], C.quoted(label), "file")
    return parsed.select(
        *[C.finite(C.quoted(f)).alias(f) for f in features],
        C.printable_label(C.quoted(label)).alias(label),
        C.capture_day(F.col("file")).alias("day"),
        "file",
    )


def deduplicate(rows: DataFrame, label: str = "Label") -> DataFrame:
    """One row per (features, label), kept from the first file in name order, with its copy count.

    Copies differ only in provenance, so the smallest file name is the first occurrence.
    Grouping is by the values themselves and combines on the map side: a row that makes up
    a third of the table leaves each task once.
    """
    features = feature_names(rows, label)
    keys = [C.quoted(c) for c in (*features, label)]
    once = rows.groupBy(*keys).agg(F.min("file").alias("file"), F.count("*").alias("copies"))
    return once.select(
        *keys, C.capture_day(F.col("file")).alias("day"), "file",
        C.attack_flag(C.quoted(label)).alias("is_attack"), "copies",
    )


def clean(raw: DataFrame, label: str = "Label") -> DataFrame:
    """The clean flow table: deduplicated, flagged, unknown days null."""
    rows = deduplicate(coerce(raw, label), label).drop("copies")
    return rows.withColumn("day", C.known_day(F.col("day")))


def conflicts(rows: DataFrame, features: Sequence[str], label: str = "Label") -> DataFrame:
    """Clean rows whose features also occur under another label.

    ``rows`` are coerced rows, deduplicated or not: a clean row is a distinct label of its
    features, so one grouping with the set of labels counts them. Labels are few per row.
    """
    named = F.struct(C.quoted(label))
    return (
        rows.groupBy(*[C.quoted(f) for f in features]).agg(F.size(F.collect_set(named)).cast("bigint").alias("n"))
        .agg(F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("conflicting_rows"))
    )


def reconciliation(deduplicated: DataFrame, features: Sequence[str]) -> DataFrame:
    """Rows before and after deduplication, and the number of feature columns."""
    return deduplicated.agg(
        F.sum("copies").alias("rows_before"),
        F.count("*").alias("rows_after"),
        (F.sum("copies") - F.count("*")).alias("rows_removed"),
        F.lit(len(features)).alias("feature_columns"),
    )


def rows_by_day_label(clean_rows: DataFrame, label: str = "Label") -> DataFrame:
    """Observed (day, label) groups with known days."""
    return clean_rows.filter(F.col("day").isNotNull()).groupBy("day", C.quoted(label)).agg(
        F.count("*").alias("rows")
    )


def in_day_order(rows: DataFrame, *then: str) -> DataFrame:
    return rows.orderBy(C.day_rank(F.col("day")), *then)
