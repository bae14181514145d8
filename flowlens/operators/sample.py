"""Block samples, class caps, splits and bootstrap draws, all by hash order."""

from __future__ import annotations

import math
import re
from collections.abc import Mapping
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schema as S
from ..errors import FlowLensError
from ..functions.columns import is_benign, quoted
from ..functions.prefix import class_counts, hash_cutoffs, hash_key, within_cutoff
from ..workspace import staged


def literal_path(path: str) -> str:
    """A file's URI as a reader's path that names this file alone."""
    return literal_name(unquote(path))


def literal_name(path: str) -> str:
    """The same for a path that is not percent-encoded, as a file listing has it."""
    return re.sub(r"([\[\]{}*?\\])", r"\\\1", path)


def file_offsets(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(_file, _n, _offset) of every file of a Parquet table, in path order, as a stored table.

    Needs the row counts only, which the files' footers hold; the window sees a row per file.
    """
    rows = spark.read.parquet(*([path] if isinstance(path, str) else path))
    sizes = rows.groupBy(F.col("_metadata.file_path").alias("_file")).agg(F.count("*").alias("_n"))
    earlier = Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)
    return staged(sizes.select("_file", "_n", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_offset")), "file-offsets")


def row_positions(spark: SparkSession, path: str | list[str], out: str = "row_position") -> tuple[DataFrame, int]:
    """A Parquet table with each row's 0-based place, files in path order, and its row count."""
    offsets = file_offsets(spark, path)
    total = offsets.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
    return _placed(spark, path, offsets.select("_file", "_offset"), out), total


def _placed(spark: SparkSession, path: str | list[str], offsets: DataFrame, out: str) -> DataFrame:
    """The rows of the files in ``offsets`` with their place; a small list of files is broadcast by its stored size."""
    rows = spark.read.parquet(*([path] if isinstance(path, str) else path)).select(
        "*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row")
    )
    placed = rows.join(offsets, "_file").withColumn(out, F.col("_offset") + F.col("_row"))
    return placed.drop("_file", "_row", "_offset")


def block_sample(
    spark: SparkSession,
    path: str,
    max_rows: int = S.MAX_ROWS,
    block_rows: int = S.BLOCK_ROWS,
    seed: int = S.SEED,
    keep_position: bool = False,
) -> DataFrame:
    """Rows from evenly spaced blocks of a Parquet table, at most ``max_rows`` in all.

    The chosen blocks follow from the files' row counts, and only files that hold rows of
    them are read.
    """
    offsets = file_offsets(spark, path)
    total = offsets.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
    blocks = max(1, math.ceil(total / block_rows))
    chosen = min(blocks, max(10, math.ceil(max_rows / 1000)))
    per_block = max(1, math.ceil(max_rows / chosen))

    # The i-th chosen block is floor(i * step), the last one is the last block.
    block = F.floor(F.col("row_position") / F.lit(block_rows)).cast("bigint")
    step = (blocks - 1) / (chosen - 1) if chosen > 1 else 0.0

    def edge(i: Column) -> Column:
        return F.when(i == chosen - 1, F.lit(blocks - 1)).otherwise(F.floor(i * F.lit(step)))

    if chosen == 1:
        picked = F.when(block == 0, F.lit(0))
    elif chosen == blocks:
        picked = block
    else:
        guess = F.floor(block / F.lit(step)).cast("bigint")
        near = F.array(guess, guess + 1)
        hit = F.filter(near, lambda i: (i < chosen) & (edge(i) == block))
        picked = F.try_element_at(hit, F.lit(1))
    full = min(per_block, block_rows)
    # the chosen blocks are at most a few per thousand sampled rows
    starts = [min(i, blocks - 1) * block_rows for i in (
        range(blocks) if chosen == blocks else [blocks - 1 if chosen > 1 and i == chosen - 1 else math.floor(i * step) for i in range(chosen)])]
    held = F.exists(F.array(*[F.lit(x) for x in starts]), lambda x: (x < F.col("_offset") + F.col("_n")) & (x + block_rows > F.col("_offset")))
    files = offsets.filter(held)
    # the file list is of the sample's size; the reader gets the names
    names = [literal_path(r["_file"]) for r in files.select("_file").collect()]
    rows = _placed(spark, names or path, files.select("_file", "_offset"), "row_position")
    rank = F.row_number().over(
        Window.partitionBy("_picked").orderBy(hash_key(F.col("row_position"), seed))
    )
    sampled = (
        rows.withColumn("_picked", picked).filter(F.col("_picked").isNotNull())
        .withColumn("_rank", rank)
        .filter((F.col("_rank") <= per_block) & (F.col("_rank") <= F.lit(max_rows) - F.col("_picked") * full))
    )
    return sampled.drop("_picked", "_rank", *([] if keep_position else ["row_position"]))


def class_caps(counts: Mapping[str, int], max_rows: int) -> dict[str, int]:
    """Rows kept per class: an equal cap each, then cut to ``max_rows`` in class order."""
    cap = max_rows // len(counts) + 1
    left, out = max_rows, {}
    for name in sorted(counts):
        out[name] = max(0, min(counts[name], cap, left))
        left -= out[name]
    return out


def capped_by_class(df: DataFrame, label: str, sample_id: str, max_rows: int, seed: int = S.SEED) -> DataFrame:
    """At most ``max_rows`` rows, no class above its cap; unchanged when already small enough."""
    counts = class_counts(df, label)
    if sum(counts.values()) <= max_rows:
        return df
    cutoffs = hash_cutoffs(df, label, sample_id, class_caps(counts, max_rows), seed)
    return df.filter(within_cutoff(quoted(label), quoted(sample_id), cutoffs, seed))


def split_quotas(counts: Mapping[str, int], test_size: float = S.TEST_SIZE) -> dict[str, int]:
    """Test rows per class: the total rounded up, shared out by largest remainder."""
    total = sum(counts.values())
    wanted = math.ceil(test_size * total)
    out = {c: n * wanted // total for c, n in counts.items()}
    by_remainder = sorted(counts, key=lambda c: (-(counts[c] * wanted % total), c))
    for name in by_remainder[: wanted - sum(out.values())]:
        out[name] += 1
    return out


def with_split(
    df: DataFrame, label: str, sample_id: str, test_size: float = S.TEST_SIZE, seed: int = S.SEED
) -> DataFrame:
    """Add ``split`` (train/test), stratified unless a class has a single row.

    The split is a filter on the row's own hash, so it costs no shuffle and every model,
    baseline and re-run sees the same one.
    """
    if not 0 < test_size < 1:
        raise FlowLensError("test_size must lie between 0 and 1.")
    counts = class_counts(df, label)
    if len(counts) < 2:
        raise FlowLensError("A split needs a label with at least two classes.")
    if min(counts.values()) >= 2:
        stratum = quoted(label).cast("string")
        quotas = split_quotas(counts, test_size)
    else:
        stratum = F.lit("all")
        quotas = {"all": math.ceil(test_size * sum(counts.values()))}
    keyed = df.withColumn("_stratum", stratum)
    cutoffs = hash_cutoffs(keyed, "_stratum", sample_id, quotas, seed)
    test = within_cutoff(F.col("_stratum"), quoted(sample_id), cutoffs, seed)
    return keyed.withColumn("split", F.when(test, "test").otherwise("train")).drop("_stratum")


def bootstrap(
    df: DataFrame, label: str, sample_id: str, kind: str, count: int = 5, seed: int = S.SEED,
    label_column: str | None = None,
) -> DataFrame:
    """``count`` rows (1..25) of attack or benign rows drawn with replacement.

    Draw ``i`` is the row whose hash under seed ``seed:i`` is smallest: independent uniform
    draws in one pass, reduced to ``count`` rows before anything is shuffled.
    """
    if kind not in ("attack", "benign"):
        raise FlowLensError("kind is either attack or benign.")
    count = S.clamp_limit(count, 1, 25)
    benign = is_benign(quoted(label), label_column or label)
    pool = df.filter(~benign if kind == "attack" else benign)
    sid = quoted(sample_id)

    def draw(i: int) -> Column:
        key = F.md5(F.concat(sid.cast("string"), F.lit(f":{seed}:{i}")))
        return F.min(F.struct(key.alias("key"), sid.alias("id")))["id"].alias(f"d{i}")

    draws = pool.agg(*[draw(i) for i in range(1, count + 1)]).select(
        F.posexplode(F.array(*[F.col(f"d{i}") for i in range(1, count + 1)])).alias("draw", "_id")
    ).select((F.col("draw") + 1).alias("draw"), "_id")
    # at most 25 rows
    return pool.join(F.broadcast(draws), sid == F.col("_id")).drop("_id")


def held_out_examples(test: DataFrame, label: str, sample_id: str, label_column: str | None = None) -> DataFrame:
    """The first benign and the first attack row of the held-out split."""
    attack = ~is_benign(quoted(label), label_column or label)
    rest = [c for c in test.columns]
    return (
        test.groupBy(attack.alias("expected_attack"))
        .agg(F.min_by(F.struct(*[quoted(c) for c in rest]), quoted(sample_id)).alias("row"))
        .select("expected_attack", *[F.col("row").getField(c).alias(c) for c in rest])
    )


def head(df: DataFrame, order: str, n: int) -> DataFrame:
    return df.orderBy(quoted(order)).limit(n)
