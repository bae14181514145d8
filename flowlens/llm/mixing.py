"""Mixing sources to target weights by Pareto order sampling.

A source's target divided by its size is the number of copies its documents are to get. Every
document has the whole part for certain; the fraction is the inclusion probability of one more
copy. Documents are ranked by Pareto's ratio, random odds over inclusion odds, and taken in that
order until the source's words are reached. The order is never sorted as a whole: words are summed
per source and bucket of the rank, the bucket in which the target lies is found from those sums,
and only its rows are ordered. What is missing there is filled from all later documents that fit.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, nested, once, parts, small, staged, text_or_empty

WEIGHTS = (3, 1, 2)  # of the sources in code-point order, repeating
SHARE = 1.5  # the mix's words as a share of all words
MOST_COPIES = 2
BUCKET_ROWS = 20_000  # documents of a source that share a bucket, at most about
LEAST_BUCKETS = 1024
LOOK = 64  # documents on each side of the cut that may be exchanged to come near the target
BROADCAST_SOURCES = 100_000


@dataclass
class Mix:
    """How a document is drawn: the plan per source, and the documents behind the cuts that fill the gaps."""

    sources: DataFrame
    filled: DataFrame
    buckets: int
    seed: int


def sized(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size): size is the number of words; a null text has none."""
    return docs.select("doc_id", "source", F.regexp_count(text_or_empty("text"), F.lit(WORD)).cast("long").alias("size"))


def uniform(seed: int) -> Column:
    """A number between 0 and 1 that depends on the doc_id and the seed alone."""
    high = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col("doc_id")), 11)
    return (high.cast("double") + 0.5) / F.lit(float(1 << 53))


def rank(seed: int) -> Column:
    """Pareto's ratio of random odds to inclusion odds, moved monotonically to 0..1."""
    u = uniform(seed)
    ratio = (u / (1 - u)) / (F.col("chance") / (1 - F.col("chance")))
    return ratio / (1 + ratio)


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST_COPIES) -> DataFrame:
    """(source, source_size, target) from a row per source: shares by weight, none above ``most`` times its size.

    Resharing the excess ends where target = min(cap, level * weight) with one level for all. With
    the sources in order of cap / weight the level follows from running sums, so no loop is needed.
    The windows see one row per source.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    listed = sizes.withColumn("place", F.row_number().over(by_name) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    by_cap = Window.orderBy(F.col("cap") / F.col("weight"), "place")
    every = Window.partitionBy()
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    after = by_cap.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    ranked = listed.withColumn("weight", weight).withColumn("cap", most * F.col("source_size").cast("double"))
    total = share * F.sum("source_size").over(every).cast("double")
    ranked = ranked.withColumn("level", (total - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after))
    # the level is that of the first source that its cap does not stop
    free = F.when(F.col("level") <= F.col("cap") / F.col("weight"), F.struct(F.col("cap") / F.col("weight"), "place", "level"))
    ranked = ranked.withColumn("level", F.min(free).over(every)["level"])
    return ranked.select("source", "source_size", F.when(
        F.col("level").isNull() | (F.col("cap") <= F.col("level") * F.col("weight")), F.col("cap")).otherwise(
        F.col("level") * F.col("weight")).alias("target"))


def fill(ranked: DataFrame, cuts: DataFrame) -> DataFrame:
    """(_source, doc_id, size) of the documents behind each cut (_source, first_bucket, cut, gap) that fill its gap.

    A round takes, in rank order, the documents no larger than the gap up to the first that goes beyond
    it; the next goes on behind that one with what is missing. It ends where no later document fits.
    """
    def behind(rows: DataFrame, state: DataFrame) -> DataFrame:
        rows = rows.join(small(state.withColumnRenamed("_source", "_state"), BROADCAST_SOURCES), F.col("_source").eqNullSafe(F.col("_state")))
        after = F.col("at").isNull() | (F.struct("rank", "doc_id") > F.col("at"))
        return rows.where((F.col("bucket") >= F.col("from")) & after).drop("_state", "at", "from")

    state = staged(cuts.where("gap >= 1").select("_source", F.col("gap").cast("double").alias("gap"), F.col("first_bucket").alias("from"), F.col("cut").alias("at")), "gap")
    later = behind(ranked.select("_source", "bucket", "rank", "doc_id", "size"), state).groupBy("_source", "bucket", "rank", "doc_id", "gap").agg(
        F.sum("size").alias("size")).where("size between 1 and gap").drop("gap")
    later = staged(later, "later")
    taken = later.select("_source", "doc_id", "size").limit(0)
    while not state.isEmpty():
        fit = behind(later, state).where("size <= gap")
        sums = fit.groupBy("_source", "gap", "bucket").agg(F.sum("size").alias("words"))
        sums = sums.withColumn("upto", F.sum("words").over(Window.partitionBy("_source").orderBy("bucket")))
        over = F.min(F.when(F.col("upto") > F.col("gap"), F.struct("bucket", (F.col("upto") - F.col("words")).alias("before"))))
        edge = staged(sums.groupBy(F.col("_source").alias("_edge")).agg(over.alias("edge")), "edge")
        fit = fit.join(small(edge, BROADCAST_SOURCES), F.col("_source").eqNullSafe(F.col("_edge"))).drop("_edge")
        whole = fit.where(F.col("edge").isNull() | (F.col("bucket") < F.col("edge.bucket"))).select("_source", "doc_id", "size")
        inside = fit.where(F.col("bucket") == F.col("edge.bucket")).withColumn(
            "upto", F.col("edge.before") + F.sum("size").over(Window.partitionBy("_source").orderBy("rank", "doc_id")))
        inside = staged(inside, "inside")
        taken = taken.union(staged(whole.union(inside.where("upto <= gap").select("_source", "doc_id", "size")), "fill"))
        state = inside.groupBy("_source").agg(
            (F.first("gap") - F.coalesce(F.max(F.when(F.col("upto") <= F.col("gap"), F.col("upto"))), F.first("edge.before"))).alias("gap"),
            F.first("edge.bucket").alias("from"), F.min(F.when(F.col("upto") > F.col("gap"), F.struct("rank", "doc_id"))).alias("at"))
        state = staged(state.where("gap >= 1"), "gap")
    return taken


def plan(rows: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST_COPIES,
         seed: int = 42) -> Mix:
    """The plan of a stored table ``rows`` (doc_id, source, size).

    Per source: target, whole copies, and which documents get one more: those up to the cut in rank
    order, but for one document near the cut at most, and those behind it that fill the target.
    Documents of one doc_id are drawn together. A source without words has nothing to draw.
    """
    sizes = staged(rows.groupBy("source").agg(F.sum("size").alias("source_size")), "sources")
    goal = targets(sizes, weights, share, most)
    copies = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    goal = goal.withColumn("whole", F.floor(copies + 1e-12)).withColumn("chance", F.greatest(copies - F.col("whole"), F.lit(0.0)))
    goal = staged(goal.withColumn("rest", F.greatest(F.col("target") - F.col("whole") * F.col("source_size"), F.lit(0.0)))
                  .withColumnRenamed("source", "_source"), "targets")
    n = max(LEAST_BUCKETS, parts(rows.count(), BUCKET_ROWS))
    some = rows.join(small(goal.where("chance > 0"), BROADCAST_SOURCES), F.col("source").eqNullSafe(F.col("_source")))
    ranked = some.withColumn("rank", rank(seed)).withColumn("bucket", F.floor(F.col("rank") * n))
    sums = ranked.groupBy("_source", "rest", "bucket").agg(F.sum("size").alias("words"), F.count("*").alias("docs"))
    through = Window.partitionBy("_source").orderBy("bucket")
    sums = sums.withColumn("upto", F.sum("words").over(through)).withColumn("docs_upto", F.sum("docs").over(through))
    # the first bucket that goes beyond the rest, and around it buckets with the documents looked at
    cut = F.min(F.when(F.col("upto") > F.col("rest"), F.struct(
        "bucket", (F.col("docs_upto") - F.col("docs")).alias("first"), F.col("docs_upto").alias("last"))))
    sums = sums.withColumn("cut", cut.over(Window.partitionBy("_source")))
    near = sums.where((F.col("docs_upto") > F.col("cut.first") - LOOK) & (F.col("docs_upto") - F.col("docs") < F.col("cut.last") + LOOK))
    near = staged(near.groupBy("_source").agg(
        F.min("bucket").alias("first_bucket"), F.max("bucket").alias("last_bucket"),
        F.min(F.struct("bucket", (F.col("upto") - F.col("words")).alias("words")))["words"].alias("before"))
        .withColumnRenamed("_source", "_near"), "cuts")
    by_rank = Window.partitionBy("_source").orderBy("rank", "doc_id")
    backwards = Window.partitionBy("_source").orderBy(F.desc("rank"), F.desc("doc_id"))
    close = (ranked.join(small(near, BROADCAST_SOURCES), F.col("_source").eqNullSafe(F.col("_near")))
             .where(F.col("bucket").between(F.col("first_bucket"), F.col("last_bucket")))
             .groupBy("_source", "rest", "before", "first_bucket", "last_bucket", "rank", "doc_id").agg(F.sum("size").alias("size"))
             .withColumn("upto", F.col("before") + F.sum("size").over(by_rank))
             .withColumn("in", F.col("upto") <= F.col("rest"))
             .withColumn("after", F.sum(F.when(~F.col("in"), 1).otherwise(0)).over(by_rank))
             .withColumn("back", F.sum(F.when(F.col("in"), 1).otherwise(0)).over(backwards)))
    close = staged(close.where(F.when(F.col("in"), F.col("back") <= LOOK).otherwise(F.col("after") <= LOOK)), "close")
    cuts = staged(close.groupBy("_source", "first_bucket", "last_bucket").agg(
        F.max(F.when(F.col("in"), F.struct("rank", "doc_id"))).alias("cut"),
        (F.first("rest") - F.coalesce(F.max(F.when(F.col("in"), F.col("upto"))), F.first("before"))).alias("gap")), "gaps")
    filled = fill(ranked, cuts)
    own = filled.select(F.col("_source").alias("_own"), F.col("doc_id").alias("_id"), F.lit(True).alias("own"))
    same = F.col("_source").eqNullSafe(F.col("_own")) & F.col("doc_id").eqNullSafe(F.col("_id"))
    item = F.struct("rank", "doc_id", "size")
    lists = close.join(own, same, "left").groupBy("_source").agg(
        F.array_sort(F.collect_list(F.when(F.col("in"), item))).alias("last"),
        F.array_sort(F.collect_list(F.when(~F.col("in") & F.col("own").isNull(), item))).alias("left"))
    words = filled.groupBy("_source").agg(F.sum("size").alias("words"))
    words, lists = words.withColumnRenamed("_source", "_w"), lists.withColumnRenamed("_source", "_l")
    cuts = cuts.join(lists, F.col("_source").eqNullSafe(F.col("_l"))).join(words, F.col("_source").eqNullSafe(F.col("_w")), "left")
    cuts = cuts.withColumn("gap", F.col("gap") - F.coalesce("words", F.lit(0))).drop("_l", "_w", "words")
    ids = F.array().cast("array<bigint>")
    # one exchange of a taken document (or none) for one that is not, if it brings the words nearer
    cuts = once(cuts, given=F.concat(F.array(F.struct(F.lit(None).cast("double").alias("rank"), F.lit(None).cast("bigint").alias("doc_id"),
                                                       F.lit(0).cast("bigint").alias("size"))), F.col("last")))
    swaps = F.flatten(F.transform("given", lambda g: F.transform("left", lambda x: F.struct(
        F.abs(F.col("gap") - x["size"] + g["size"]).alias("off"), x["doc_id"].alias("add"), g["doc_id"].alias("drop"), g["size"].alias("size")))))
    cuts = once(cuts, swap=F.array_min(swaps))
    better = F.coalesce(F.col("swap.off") < F.abs("gap"), F.lit(False))
    cuts = cuts.select(F.col("_source").alias("_cut"), "first_bucket", "last_bucket", F.col("cut.rank").alias("cut_rank"), F.col("cut.doc_id").alias("cut_id"),
                       F.when(better, F.array("swap.add")).otherwise(ids).alias("extra"),
                       F.when(better & (F.col("swap.size") > 0), F.array("swap.drop")).otherwise(ids).alias("without"))
    sources = goal.join(cuts, F.col("_source").eqNullSafe(F.col("_cut")), "left").drop("_cut")
    return Mix(staged(sources, "mix"), filled.select(F.col("_source").alias("_filled"), F.col("doc_id").alias("_filled_id")), n, seed)


def drawn(docs: DataFrame, mix: Mix) -> DataFrame:
    """``docs`` (doc_id, source, and size or other columns) with source_size, target and copies.

    A document within the buckets around the cut is taken up to the cut, unless it is in
    ``without``, or if it is in ``extra`` or fills the gap; before them it is taken, and after them it is not.
    """
    made = ["_source", "whole", "chance", "rest", "first_bucket", "last_bucket", "cut_rank", "cut_id", "extra", "without", "_filled", "_filled_id", "_fills"]
    joined = docs.join(small(mix.sources, BROADCAST_SOURCES), F.col("source").eqNullSafe(F.col("_source")))
    filled = small(mix.filled.withColumn("_fills", F.lit(True)), BROADCAST_SOURCES)
    joined = joined.join(filled, F.col("source").eqNullSafe(F.col("_filled")) & F.col("doc_id").eqNullSafe(F.col("_filled_id")), "left")
    before = F.coalesce(F.struct("_rank", "doc_id") <= F.struct("cut_rank", "cut_id"), F.lit(False)) & F.col("cut_rank").isNotNull()
    listed = lambda c: F.coalesce(F.array_contains(c, F.col("doc_id")), F.lit(False))
    around = (before & ~listed("without")) | listed("extra")
    one_more = F.when(F.col("chance") <= 0, False).when(F.col("first_bucket").isNull() | (F.col("_bucket") < F.col("first_bucket")), True).when(
        F.col("_fills"), True).otherwise(
        (F.col("_bucket") <= F.col("last_bucket")) & around)
    ranked = joined.withColumn("_rank", F.when(F.col("chance") > 0, rank(mix.seed))).withColumn("_bucket", F.floor(F.col("_rank") * mix.buckets))
    return ranked.withColumn("copies", (F.col("whole") + one_more.cast("int")).cast("int")).drop("_rank", "_bucket", *made)


def mixed(docs: DataFrame, seed: int = 42) -> DataFrame:
    """Every row of ``docs`` (doc_id, text, source) as doc_id, size, source_size, target and taken (words)."""
    rows = staged(sized(docs), "sizes")
    return drawn(rows, plan(rows, seed=seed)).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def take_mix(docs: DataFrame, seed: int = 42) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them, columns unchanged."""
    rows = staged(sized(docs), "sizes")
    plain = nested(docs, doc_id=F.col("doc_id"), source=F.col("source"))
    out = drawn(plain, plan(rows, seed=seed)).where("copies > 0")
    return out.select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")
