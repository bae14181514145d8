"""Per-file audit and dataset profile."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schema as S
from ..functions import columns as C
from ..functions.prefix import MAX_CLASSES

def _missing(cell: Column) -> Column:
    return cell.isNull() | cell.isin(*S.MISSING_TOKENS)


def _cells(raw: DataFrame) -> list[str]:
    return [c for c in raw.columns if c not in ("file", "file_path", "file_columns")]


def audit(raw: DataFrame) -> DataFrame:
    """Per file: rows, columns, infinite cells in numeric columns, missing cells.

    A column is numeric in a file when every present cell of that file parses, so the test
    and the counts come from the same pass. With ``file_columns`` a file has those columns
    only, and cells of others are not counted.
    """
    own = F.col("file_columns") if "file_columns" in raw.columns else F.array(*[F.lit(c) for c in _cells(raw)])
    cells = _cells(raw)
    # parsed in a projection of its own, so that each cell is parsed once
    parsed = raw.select(
        "file", own.alias("own"),
        *[_missing(C.quoted(c)).alias(f"m{i}") for i, c in enumerate(cells)],
        *[C.parsed_cell(C.quoted(c)).alias(f"v{i}") for i, c in enumerate(cells)],
    )
    aggs = []
    for i in range(len(cells)):
        missing, value = F.col(f"m{i}"), F.col(f"v{i}")
        aggs += [
            F.count_if(~missing & (F.abs(value) == F.lit(float("inf")))).alias(f"inf{i}"),
            F.count_if(missing).alias(f"nan{i}"),
            F.count_if(~missing & value.isNull()).alias(f"bad{i}"),
        ]
    per_file = parsed.groupBy("file").agg(F.count("*").alias("rows"), F.max("own").alias("own"), *aggs)
    numeric_inf = [F.when(F.col(f"bad{i}") == 0, F.col(f"inf{i}")).otherwise(0) for i in range(len(cells))]
    missing = [F.when(F.array_contains("own", c), F.col(f"nan{i}")).otherwise(0) for i, c in enumerate(cells)]
    return per_file.select(
        "file",
        "rows",
        F.size("own").alias("cols"),
        sum(numeric_inf[1:], numeric_inf[0]).cast("bigint").alias("inf_cells"),
        sum(missing[1:], missing[0]).cast("bigint").alias("nan_cells"),
    )


def duplicate_rows(raw: DataFrame) -> DataFrame:
    """Per file: rows minus distinct rows over all columns, cells compared as parsed values."""
    values = []
    for name in _cells(raw):
        cell = C.quoted(name)
        number = C.parsed_cell(cell)
        values.append(F.when(~_missing(cell), F.coalesce(number.cast("string"), cell)).alias(name))
    return (
        raw.select("file", *values).groupBy("file", *[C.quoted(c) for c in _cells(raw)]).count()
        .groupBy("file").agg(F.sum(F.col("count") - 1).alias("duplicate_rows"))
    )


def label_histogram(raw: DataFrame, label: str = "Label") -> DataFrame:
    return raw.filter(C.quoted(label).isNotNull()).groupBy("file", C.quoted(label)).agg(F.count("*").alias("rows"))


def audit_report(raw: DataFrame, label: str = "Label") -> DataFrame:
    """Audit, duplicates and label counts, one row per file.

    A column with more than ``MAX_CLASSES`` values in a file is no label, and the job fails.
    """
    listed = label_histogram(raw, label).groupBy("file").agg(
        F.slice(F.array_sort(F.collect_list(F.struct(C.quoted(label), "rows"))), 1, MAX_CLASSES).alias("labels"), F.count("*").alias("n"))
    too_many = F.raise_error(F.concat(F.lit("Too many labels in "), "file"))
    labels = listed.select("file", F.when(F.col("n") <= MAX_CLASSES, F.to_json(F.map_from_entries("labels"))).otherwise(
        too_many.cast("string")).alias("labels"))
    return audit(raw).join(duplicate_rows(raw), "file").join(labels, "file", "left")


def _is_missing(df: DataFrame, name: str) -> Column:
    cell = C.quoted(name)
    floating = isinstance(df.schema[name].dataType, (T.FloatType, T.DoubleType))
    return cell.isNull() | F.isnan(cell) if floating else cell.isNull()


def column_profile(df: DataFrame) -> DataFrame:
    """Per column: place, missing cells, constant or not, numeric or not, label candidate or not.

    Constant means one value counting missing as a value: all missing, or none missing and
    min = max. That needs no distinct counting, so the whole table is one aggregation.
    """
    entries = []
    aggs = [F.count("*").alias("rows")]
    candidates = set(S.label_candidates(df.columns))
    for i, name in enumerate(df.columns):
        present = F.when(~_is_missing(df, name), C.quoted(name))
        aggs += [F.count(present).alias(f"n{i}"), F.min(present).alias(f"lo{i}"), F.max(present).alias(f"hi{i}")]
        filled = F.col(f"n{i}")
        constant = (filled == 0) | ((filled == F.col("rows")) & (F.col(f"lo{i}") == F.col(f"hi{i}")))
        entries.append(F.struct(
            F.lit(i).alias("place"),
            F.lit(name).alias("column_name"),
            (F.col("rows") - filled).alias("missing_cells"),
            constant.alias("is_constant"),
            F.lit(isinstance(df.schema[name].dataType, T.NumericType)).alias("is_numeric"),
            F.lit(name in candidates).alias("label_candidate"),
        ))
    return df.agg(*aggs).select(F.inline(F.array(*entries)))


def table_profile(df: DataFrame) -> DataFrame:
    """Row, column and numeric counts and total missing cells of a table."""
    numeric = sum(isinstance(f.dataType, T.NumericType) for f in df.schema.fields)
    missing = [F.count_if(_is_missing(df, c)) for c in df.columns]
    return df.agg(
        F.count("*").alias("rows"),
        F.lit(len(df.columns)).alias("columns"),
        F.lit(numeric).alias("numeric_features"),
        sum(missing[1:], missing[0]).alias("missing_cells"),
    )


def class_count_report(df: DataFrame, limit: int = 20) -> DataFrame:
    """The most frequent values of each label candidate, missing counted as a value."""
    out = None
    for name in S.label_candidates(df.columns):
        text = C.quoted(name).cast("string")
        top = (
            df.groupBy(text.alias("value")).agg(F.count("*").alias("rows"))
            .orderBy(F.desc("rows"), F.asc_nulls_last("value")).limit(limit)
            .select(F.lit(name).alias("label_column"), "value", "rows")
        )
        out = top if out is None else out.unionByName(top)
    return out


def class_coverage(held_out: DataFrame, label: str, classes: Sequence[str]) -> DataFrame:
    """Observed against expected classes of the held-out rows."""
    return held_out.agg(F.count_distinct(C.quoted(label)).alias("observed_classes")).select(
        "observed_classes",
        F.lit(len(classes)).alias("expected_classes"),
        (F.col("observed_classes") < len(classes)).alias("incomplete"),
    )
