"""Running sums and ranks over a whole table without a single-task sort.

``ordered_prefix`` cuts the order column into even buckets, sums each bucket, runs the prefix
over the (small) bucket table and finishes inside the buckets. The order column must be
distinct within a group - callers group by it first - so equal values are already one row
and the buckets stay even whatever the value skew.

``hash_cutoffs`` turns "the first q rows of each class in hash order" into one hash
threshold per class, so that sampling and splitting are plain filters.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import FlowLensError
from ..workspace import staged
from .columns import quoted

# A label with more classes than this is an identifier, not a class.
MAX_CLASSES = 10_000
HASH_DIGITS = 4  # hash digits counted at a time
RANKED_ROWS = 1_000_000  # rows of a class that one task may rank
ROWS_PER_BUCKET = 100_000
LEAST_BUCKETS = 64
CELLS_PER_BUCKET = 4


def bucket_count(rows: int) -> int:
    """Buckets of about ``ROWS_PER_BUCKET`` rows, at least ``LEAST_BUCKETS``; so few rows as one bucket has need no more."""
    return 1 if rows <= ROWS_PER_BUCKET else max(LEAST_BUCKETS, -(-rows // ROWS_PER_BUCKET))


def with_buckets(df: DataFrame, groups: Sequence[str], order: str, buckets: int | None = None) -> DataFrame:
    """Add ``bucket``: an order-preserving, evenly filled bucket number within each group.

    Rows are counted per cell of equal width between a group's smallest and largest value, and
    a cell with more than its share is counted again in finer cells between its own bounds. The
    counts combine on the map side, and running sums over the cells give the buckets, so no
    task sees more than the cells. Null values come first. ``groups`` are models or feature
    columns, one row of bounds each. ``df`` is read four times, or twice where one bucket is enough.
    """
    keys = [F.col(g) for g in groups]
    value = quoted(order).cast("double")
    spans = df.groupBy(*keys).agg(F.min(value).alias("_low"), F.max(value).alias("_high"), F.count("*").alias("_rows"))
    if groups:
        spans = staged(spans, "spans")
        by_group = df.join(F.broadcast(spans), list(groups))
        most = spans.agg(F.coalesce(F.max("_rows"), F.lit(0))).first()[0]
    else:
        one = spans.first()
        by_group = df.withColumns({c: F.lit(one[c]).cast(t) for c, t in spans.dtypes})
        most = one["_rows"]
    buckets = buckets or bucket_count(most)
    if buckets == 1:
        # not a literal: joins on the bucket must stay joins on a key
        return df.withColumn("bucket", F.pmod(F.hash(quoted(order)), F.lit(1)))
    cells = CELLS_PER_BUCKET * buckets

    def among(low: str, high: str, n: Column) -> Column:
        """The cell of the value among ``n`` of equal width; all in the first where there is no width."""
        share = F.when(F.col(high) > F.col(low), (value - F.col(low)) / (F.col(high) - F.col(low))).otherwise(0.0)
        return F.coalesce(F.least(F.floor(share * n), n - 1), F.lit(-1)).cast("bigint")

    placed = by_group.withColumn("_cell", among("_low", "_high", F.lit(cells))).drop("_low", "_high")
    share = F.col("_rows") / F.lit(float(buckets))
    counted = staged(placed.groupBy(*keys, "_rows", "_cell").agg(
        F.count("*").alias("_n"), F.min(value).alias("_from"), F.max(value).alias("_to")), "cells")
    counted = counted.withColumn("_parts", F.when(
        (F.col("_n") > share / 2) & (F.col("_from") < F.col("_to")), F.ceil(CELLS_PER_BUCKET * F.col("_n") / share)))
    split = counted.filter(F.col("_parts").isNotNull()).select(*keys, "_cell", "_from", "_to", "_parts")
    finer = placed.join(split, [*groups, "_cell"], "left").withColumn(
        "_part", F.when(F.col("_parts").isNull(), 0).otherwise(among("_from", "_to", F.col("_parts"))).cast("bigint")).drop("_from", "_to", "_parts")
    pieces = finer.groupBy(*keys, "_rows", "_cell", "_part").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_cell", "_part").rowsBetween(Window.unboundedPreceding, -1)
    number = F.floor(F.coalesce(F.sum("_n").over(before), F.lit(0)) * buckets / F.col("_rows"))
    numbered = staged(pieces.select(*keys, "_cell", "_part", number.cast("int").alias("bucket")), "buckets")
    return finer.join(numbered, [*groups, "_cell", "_part"]).drop("_cell", "_part", "_rows")


def ordered_prefix(
    df: DataFrame,
    groups: Sequence[str],
    order: str,
    sums: Mapping[str, str],
    buckets: int | None = None,
) -> DataFrame:
    """For each output name, the sum of its column over all rows of the group ordered before.

    ``<name>`` excludes the row itself; ``<name>_all`` is the group total.
    """
    cut = with_buckets(df, groups, order, buckets)
    group_cols = [F.col(g) for g in groups]
    over_buckets = Window.partitionBy(*group_cols).orderBy("bucket")
    before = over_buckets.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*group_cols)
    totals = cut.groupBy(*groups, "bucket").agg(*[F.sum(c).alias(f"_in_{n}") for n, c in sums.items()])
    # a row per group and bucket
    totals = totals.select(
        *groups,
        "bucket",
        *[F.coalesce(F.sum(f"_in_{n}").over(before), F.lit(0)).alias(f"_pre_{n}") for n in sums],
        *[F.sum(f"_in_{n}").over(whole).alias(f"{n}_all") for n in sums],
    )
    inside = Window.partitionBy(*group_cols, F.col("bucket")).orderBy(quoted(order)).rowsBetween(
        Window.unboundedPreceding, -1
    )
    joined = cut.join(totals, [*groups, "bucket"])
    for name, column in sums.items():
        joined = joined.withColumn(
            name, F.col(f"_pre_{name}") + F.coalesce(F.sum(column).over(inside), F.lit(0))
        )
    return joined.drop("bucket", *[f"_pre_{n}" for n in sums])


def ordered_lag(df: DataFrame, order: str, out: str, buckets: int | None = None) -> DataFrame:
    """The previous value of a distinct order column over the whole table."""
    cut = with_buckets(df, [], order, buckets)
    ends = cut.groupBy("bucket").agg(F.max(order).alias("_last")).select(
        "bucket", F.lag("_last").over(Window.orderBy("bucket")).alias("_carry")
    )
    inside = Window.partitionBy("bucket").orderBy(quoted(order))
    return (
        cut.join(ends, "bucket")
        .withColumn(out, F.coalesce(F.lag(order).over(inside), F.col("_carry")))
        .drop("bucket", "_carry")
    )


def hash_key(sample_id: Column, seed: int) -> Column:
    """A uniform, engine-independent sort key of a row."""
    return F.md5(F.concat(sample_id.cast("string"), F.lit(f":{seed}")))


def class_counts(df: DataFrame, label: str) -> dict[str, int]:
    """Rows per class on the driver: the class list is model metadata, checked to be small."""
    found = df.groupBy(quoted(label).cast("string").alias("label")).count().limit(MAX_CLASSES + 1).collect()
    if len(found) > MAX_CLASSES:
        raise FlowLensError(f"Column '{label}' has more than {MAX_CLASSES} values and is not a label.")
    return {r["label"]: r["count"] for r in sorted(found, key=lambda r: str(r["label"]))}


def hash_cutoffs(
    df: DataFrame, label: str, sample_id: str, quotas: Mapping[str, int], seed: int
) -> dict[str, str]:
    """The hash of the ``quota``-th row of each class in hash order.

    Counts per (class, leading hash digits) find the digits that hold the threshold, by more
    digits until at most ``RANKED_ROWS`` rows of a class share them; only those are ranked.
    Ids must be distinct.
    """
    wanted = {c: q for c, q in quotas.items() if q > 0}
    if not wanted:
        return {}
    keyed = df.select(
        quoted(label).cast("string").alias("label"),
        hash_key(quoted(sample_id), seed).alias("hash"),
    )
    # per class the digits so far and the place of the wanted row among the rows that share them
    found = {c: ("", q) for c, q in wanted.items()}
    digits = 0
    while True:
        heads = F.create_map(*[F.lit(x) for c, (head, _) in found.items() for x in (c, head)])
        places = F.create_map(*[F.lit(x) for c, (_, place) in found.items() for x in (c, place)])
        head = F.try_element_at(heads, F.col("label"))
        near = keyed.filter(F.col("hash").startswith(head) if digits else head.isNotNull())
        if digits and most <= RANKED_ROWS:
            break
        digits += HASH_DIGITS
        running = Window.partitionBy("label").orderBy("head").rowsBetween(Window.unboundedPreceding, 0)
        place = F.try_element_at(places, F.col("label"))
        # one row per class, and class_counts has checked the number of classes
        marks = (
            near.withColumn("head", F.substring("hash", 1, digits)).groupBy("label", "head").count()
            .withColumn("upto", F.sum("count").over(running))
            .filter((F.col("upto") >= place) & (F.col("upto") - F.col("count") < place))
            .select("label", "head", "count", (place - F.col("upto") + F.col("count")).alias("place")).collect()
        )
        found = {r["label"]: (r["head"], r["place"]) for r in marks}
        most = max((r["count"] for r in marks), default=0)
        if not found:
            return {}
    rank = F.row_number().over(Window.partitionBy("label").orderBy("hash"))
    rows = near.withColumn("rank", rank).filter(F.col("rank") == F.try_element_at(places, F.col("label"))).select("label", "hash").collect()
    return {r["label"]: r["hash"] for r in rows}


def within_cutoff(label: Column, sample_id: Column, cutoffs: Mapping[str, str], seed: int) -> Column:
    """True for the rows at or below their class's hash threshold."""
    if not cutoffs:
        return F.lit(False)
    limit = F.create_map(*[F.lit(x) for pair in cutoffs.items() for x in pair])
    return F.coalesce(hash_key(sample_id, seed) <= F.try_element_at(limit, label.cast("string")), F.lit(False))
