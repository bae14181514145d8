"""Flow table files: CSV captures, Parquet tables, JSON records, fingerprints."""

from __future__ import annotations

import csv
import re
from collections.abc import Callable, Sequence
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schema as S
from ..errors import FlowLensError
from ..operators.sample import block_sample, literal_name, row_positions
from .byte_ranges import BLOCK, block_digests, first_lines, whole_digests

LATIN1 = "ISO-8859-1"
FILES_A_TASK = 1_000  # whose header lines a task reads
READER_LIMIT = (1 << 31) - 1 - (1 << 20)  # bytes that the reader of whole files takes as one value


def normalised_names(header: Sequence[str | None]) -> list[str]:
    """Header cells without padding; the n-th repeat of a name gets the suffix ``.n``."""
    def numbered(names: Sequence[str]) -> list[str]:
        used: set[str] = set()
        out = []
        for name in names:
            free, repeat = name, 0
            while free in used:
                repeat += 1
                free = f"{name}.{repeat}"
            used.add(free)
            out.append(free)
        return out

    cells = [c if c else f"Unnamed: {i}" for i, c in enumerate(header)]
    return numbered([n.strip() for n in numbered(cells)])


def list_files(spark: SparkSession, path: str | list[str], glob: str) -> DataFrame:
    """``path`` and ``length`` of every matching file below ``path``; contents are not read."""
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", glob)
        .load(path)
        .select("path", "length")
    )


def empty_files(spark: SparkSession, path: str, glob: str) -> DataFrame:
    """``path`` and ``length`` of the files without a byte: Spark's file sources give no row for them.

    Their names come from the source's file index, which the driver holds anyway.
    """
    listed = list_files(spark, path, glob)
    source = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
    names = source.inputFiles()
    rows = [(re.sub("^file:///", "file:/", unquote(n)), 0) for n in names] if len(names) > listed.count() else []
    return spark.createDataFrame(rows, "path string, length bigint").join(listed, "path", "left_anti")


def _csv(spark: SparkSession):
    return spark.read.option("encoding", LATIN1).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.csv")


def csv_layouts(spark: SparkSession, path: str | list[str]) -> dict[tuple[str, ...], list[str]]:
    """The files of each layout: column names from the header line to paths in order.

    Of a file only its first line is read; files reach the driver as names only.
    """
    files = list_files(spark, path, "*.csv")
    count = files.count()
    if not count:
        raise FlowLensError(f"No CSV files found below {path}.")
    lines = first_lines(files, -(-count // FILES_A_TASK)).collect()
    headers = {r["path"]: bytes(r["line"]).decode("latin-1") for r in lines if r["line"] is not None}
    closed = [literal_name(r["path"]) for r in lines if r["line"] is None]
    out: dict[tuple[str, ...], list[str]] = {}
    for name, line in sorted((headers | (_scanned_headers(spark, closed) if closed else {})).items()):
        cells = next(csv.reader([line]), [])
        out.setdefault(tuple(normalised_names(cells)), []).append(name)
    return out


def _scanned_headers(spark: SparkSession, paths: list[str]) -> dict[str, str]:
    """The header lines of files that only the JVM can open, by a scan: the first line of a file stands where its first block starts."""
    lines = _csv(spark).option("sep", "\u0001").option("quote", "").schema("line string").csv(paths)
    first = lines.filter("_metadata.file_block_start = 0").select(
        F.col("_metadata.file_path").alias("path"), F.monotonically_increasing_id().alias("place"), "line")
    return {unquote(r["path"]): r["line"] or "" for r in first.groupBy("path").agg(F.min_by("line", "place").alias("line")).collect()}


def _rows_of_layout(spark: SparkSession, names: tuple[str, ...], paths: str | list[str]) -> DataFrame:
    layout = T.StructType([T.StructField(n, T.StringType()) for n in names])
    return _csv(spark).option("header", "true").schema(layout).csv(paths).select(
        "*",
        F.col("_metadata.file_name").alias("file"),
        F.col("_metadata.file_path").alias("file_path"),
        F.array(*[F.lit(n) for n in names]).alias("file_columns"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_place"),
    )


def _capture_rows(spark: SparkSession, path: str | list[str]) -> DataFrame:
    layouts = csv_layouts(spark, path)
    if len(layouts) == 1:
        return _rows_of_layout(spark, next(iter(layouts)), path)
    frames = [_rows_of_layout(spark, names, [literal_name(p) for p in paths]) for names, paths in layouts.items()]
    rows = concat_by_name(frames)
    own = ["file", "file_path", "file_columns", "_block", "_place"]
    return rows.select(*[f"`{c}`" for c in rows.columns if c not in own], *own)


def read_capture_csv(spark: SparkSession, path: str) -> DataFrame:
    """All CSV captures below ``path`` as text columns plus ``file``, ``file_path`` and ``file_columns``.

    Each file is read by its own header line, and files of different layouts are stacked by
    column name; ``file_columns`` lists the columns that a row's file has.
    """
    return _capture_rows(spark, path).drop("_block", "_place")


def read_csv_head(spark: SparkSession, path: str, max_rows: int) -> DataFrame:
    """The first rows of the CSV files below ``path``, in path and file order, as text columns.

    Only the files that hold these rows are read. Their rows are counted per block, and a row's
    place is its block's offset and its number in the block, so nothing is sorted as a whole.
    """
    def count(files: list[str]) -> int:
        return _capture_rows(spark, files).count()

    rows = _capture_rows(spark, _first_files(spark, path, "*.csv", max_rows, count))
    blocks = rows.groupBy("file_path", "_block").agg(F.count("*").alias("_n"))
    earlier = Window.orderBy("file_path", "_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = blocks.withColumn("_offset", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).filter(F.col("_offset") < max_rows).drop("_n")
    number = F.row_number().over(Window.partitionBy("file_path", "_block").orderBy("_place"))
    placed = rows.join(F.broadcast(offsets), ["file_path", "_block"]).withColumn("_number", number)  # a row per block read
    return placed.filter(F.col("_offset") + F.col("_number") <= max_rows).drop(
        "_block", "_place", "_offset", "_number", "file", "file_path", "file_columns")


def _first_files(spark: SparkSession, path: str, glob: str, rows: int, count: Callable[[list[str]], int]) -> list[str]:
    """The first files below ``path``, in path order, that hold ``rows`` rows together (or all)."""
    files, wanted = list_files(spark, path, glob), 1
    while True:
        paths = [literal_name(r["path"]) for r in files.orderBy("path").limit(wanted).collect()]
        if not paths:
            raise FlowLensError(f"No files found below {path}.")
        if len(paths) < wanted or count(paths) >= rows:
            return paths
        wanted *= 4


def concat_by_name(frames: Sequence[DataFrame]) -> DataFrame:
    """Stack tables by column name, absent columns null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def typed(rows: DataFrame, label: str | None) -> DataFrame:
    """Text columns that hold numbers only become doubles, NaN and infinities null.

    One pass decides for all columns; a column with any other text stays text.
    """
    from ..functions.columns import numeric_cell, quoted

    texts = [f.name for f in rows.schema.fields if isinstance(f.dataType, T.StringType) and f.name != label]
    if not texts:
        return clean_numbers(rows)
    wrong = rows.agg(*[F.count_if(_not_a_number(quoted(c))).alias(f"c{i}") for i, c in enumerate(texts)]).first()
    numeric = {c for i, c in enumerate(texts) if not wrong[f"c{i}"]}
    return clean_numbers(rows.select(*[
        (numeric_cell(quoted(c)) if c in numeric else quoted(c)).alias(c) for c in rows.columns
    ]))


def _not_a_number(cell: Column) -> Column:
    from ..functions.columns import numeric_cell

    known = cell.isNull() | cell.isin(*S.MISSING_TOKENS) | cell.rlike(r"(?i)^\s*[+-]?inf(inity)?\s*$")
    return ~known & numeric_cell(cell).isNull()


def clean_numbers(rows: DataFrame) -> DataFrame:
    """NaN and infinities of floating columns become null; names lose their padding."""
    from ..functions.columns import finite, quoted

    floating = {f.name for f in rows.schema.fields if isinstance(f.dataType, (T.FloatType, T.DoubleType))}
    return rows.select(*[
        (finite(quoted(c)) if c in floating else quoted(c)).alias(c.strip()) for c in rows.columns
    ])


def load_table(spark: SparkSession, path: str, max_rows: int | None = None, label: str | None = None) -> DataFrame:
    """A CSV file or a Parquet table, cleaned; ``max_rows`` makes it a working sample.

    A sample is the head of a CSV file and rows of spread blocks of a Parquet table.
    """
    kind = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if kind not in ("csv", "parquet"):
        raise FlowLensError("A table file must end in .csv or .parquet.")
    try:
        if kind == "csv":
            return typed(_all_csv(spark, path) if max_rows is None else read_csv_head(spark, path, max_rows), label)
        return clean_numbers(spark.read.parquet(path) if max_rows is None else block_sample(spark, path, max_rows))
    except Exception as error:
        if "PATH_NOT_FOUND" in str(error) or "does not exist" in str(error):
            raise FlowLensError(f"There is no file or folder {path}.") from error
        raise


def _all_csv(spark: SparkSession, path: str) -> DataFrame:
    return read_capture_csv(spark, path).drop("file", "file_path", "file_columns")


def records_from_json(rows: DataFrame, column: str, schema: T.StructType) -> DataFrame:
    """Record objects held as JSON text, one per row."""
    return rows.select(F.from_json(column, schema).alias("record")).select("record.*")


def read_records(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).json(path)


def read_upload(spark: SparkSession, path: str, label: str | None = None, max_rows: int | None = None) -> tuple[DataFrame, DataFrame]:
    """All rows of a file to score (``max_rows``: its first ones), and the same without their label column."""
    if path.rstrip("/").lower().endswith(".parquet"):
        rows = clean_numbers(spark.read.parquet(path) if max_rows is None else _parquet_head(spark, path, max_rows))
    elif path.rstrip("/").lower().endswith(".csv"):
        rows = typed(_all_csv(spark, path) if max_rows is None else read_csv_head(spark, path, max_rows), label)
    else:
        raise FlowLensError("A file to score must end in .csv or .parquet.")
    if label is not None and label not in rows.columns:
        raise FlowLensError(f"The file has no column '{label}'.")
    return rows, rows.drop(label) if label else rows


def _parquet_head(spark: SparkSession, path: str, max_rows: int) -> DataFrame:
    """The first rows in path and file order; only the files that hold them are read."""
    paths = _first_files(spark, path, "*.parquet", max_rows, lambda files: spark.read.parquet(*files).count())
    rows, _ = row_positions(spark, paths, "_position")
    return rows.filter(F.col("_position") < max_rows).drop("_position")


def fingerprint(spark: SparkSession, path: str, glob: str = "*", whole_limit: int = READER_LIMIT) -> DataFrame:
    """SHA-256 of every file below ``path``, of any size, one row per file.

    Files of up to ``whole_limit`` bytes are read by Spark's reader of whole files, larger ones piece by piece.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
    hashed = files.filter(F.col("length") <= whole_limit).select("path", "length", F.sha2("content", 256).alias("sha256"))
    large = list_files(spark, path, glob).filter(F.col("length") > whole_limit)
    if not large.isEmpty():
        hashed = hashed.unionByName(whole_digests(large).select("path", "length", F.lower(F.hex("digest")).alias("sha256")))
    hashed = hashed.unionByName(empty_files(spark, path, glob).withColumn("sha256", F.sha2(F.lit(b""), 256)))
    return hashed.select(_file_name(), "length", "sha256")


def block_fingerprint(spark: SparkSession, path: str, glob: str = "*", block_bytes: int = BLOCK) -> DataFrame:
    """``root`` over the SHA-256 of every file's blocks, which are hashed in parallel: (file, length, blocks, root)."""
    files = list_files(spark, path, glob).unionByName(empty_files(spark, path, glob))
    return block_digests(files, block_bytes).select(_file_name(), "length", "blocks", "root")


def _file_name() -> Column:
    return F.element_at(F.split("path", "/"), -1).alias("file")
