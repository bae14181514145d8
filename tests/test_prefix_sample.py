"""Prefix sums, hash thresholds, caps, splits, block samples, draws."""

import math
import random
from collections import Counter

import pytest
from flowlens.errors import FlowLensError
from flowlens.functions import prefix as P
from flowlens.operators import sample as SM
from pyspark.sql import functions as F


def test_ordered_prefix_on_uneven_values(spark):
    rng = random.Random(1)
    values = sorted({rng.choice([rng.random() * 1e-9, 1 - rng.random() * 1e-12, rng.random()]) for _ in range(3000)})
    rows = [(g, v, rng.randint(1, 9)) for g in ("a", "b") for v in values]
    df = spark.createDataFrame(rows, "g string, v double, n long")
    got = {(r["g"], r["v"]): (r["before"], r["before_all"]) for r in P.ordered_prefix(df, ["g"], "v", {"before": "n"}).collect()}
    total = Counter()
    for g, v, n in sorted(rows):
        assert got[(g, v)][0] == total[g]
        total[g] += n
    assert all(got[(g, v)][1] == total[g] for g, v, _ in rows)


def test_buckets_stay_even(spark):
    # nearly all distinct values lie in a tiny range
    df = spark.range(20_000).select((F.col("id") / 1e12 + F.when(F.col("id") == 5, 1.0).otherwise(0.0)).alias("v"))
    sizes = [r["count"] for r in P.with_buckets(df, [], "v", 64).groupBy("bucket").count().collect()]
    assert len(sizes) == 64 and max(sizes) < 2 * 20_000 / 64


def test_ordered_lag(spark):
    df = spark.createDataFrame([(x * x,) for x in range(500)], "t long")
    got = {r["t"]: r["p"] for r in P.ordered_lag(df, "t", "p").collect()}
    assert got[0] is None and all(got[x * x] == (x - 1) ** 2 for x in range(1, 500))


def test_hash_cutoffs_are_exact(spark):
    # one class holds nearly everything
    df = spark.range(30_000).select("id", F.when(F.col("id") % 1000 == 0, "rare").otherwise("common").alias("label"))
    quotas = {"rare": 7, "common": 12_345}
    cut = P.hash_cutoffs(df, "label", "id", quotas, 42)
    kept = df.filter(P.within_cutoff(F.col("label"), F.col("id"), cut, 42)).groupBy("label").count()
    assert {r["label"]: r["count"] for r in kept.collect()} == quotas


def test_label_that_is_an_id(spark, monkeypatch):
    monkeypatch.setattr(P, "MAX_CLASSES", 10)
    with pytest.raises(FlowLensError):
        P.class_counts(spark.range(50).select(F.col("id").cast("string").alias("label")), "label")


def test_caps():
    counts = {"a": 10, "b": 500, "c": 800}
    assert SM.class_caps(counts, 300) == {"a": 10, "b": 101, "c": 101}
    assert SM.class_caps({"a": 200, "b": 200}, 100) == {"a": 51, "b": 49}


def test_quotas():
    got = SM.split_quotas({"a": 988, "b": 12}, 0.2)
    assert got == {"a": 198, "b": 2}
    for seed in range(50):
        rng = random.Random(seed)
        counts = {c: rng.randint(2, 400) for c in "abcd"[: rng.randint(2, 4)]}
        q = SM.split_quotas(counts, 0.2)
        assert sum(q.values()) == math.ceil(0.2 * sum(counts.values()))
        assert all(abs(q[c] - 0.2 * counts[c]) < 2 for c in counts)


def test_split_sizes_and_stability(spark):
    df = spark.range(1000).select(F.col("id").alias("sid"), F.when(F.col("id") < 12, "1").otherwise("0").alias("y"))
    a = SM.with_split(df, "y", "sid")
    got = {(r["y"], r["split"]): r["count"] for r in a.groupBy("y", "split").count().collect()}
    assert got == {("0", "test"): 198, ("0", "train"): 790, ("1", "test"): 2, ("1", "train"): 10}
    b = SM.with_split(df.repartition(7), "y", "sid")
    assert a.exceptAll(b).count() == 0


def test_split_needs_two_classes(spark):
    with pytest.raises(FlowLensError):
        SM.with_split(spark.range(10).withColumn("y", F.lit("a")), "y", "id")


def test_block_sample_over_several_files(spark, tmp_path):
    path = str(tmp_path / "t.parquet")
    spark.range(1050).repartitionByRange(4, "id").sortWithinPartitions("id").write.parquet(path)
    rows = SM.block_sample(spark, path, max_rows=120, block_rows=50, keep_position=True).collect()
    assert len(rows) == 120
    # 21 blocks, 10 of them chosen at equal steps
    chosen = {int(i * 20 / 9) for i in range(9)} | {20}
    assert {r["row_position"] // 50 for r in rows} == chosen
    assert SM.block_sample(spark, path, max_rows=5000, block_rows=50).count() == 500
    # no more blocks than are taken: the whole table, the short last block included
    assert SM.block_sample(spark, path, max_rows=5000, block_rows=110).count() == 1050


def test_draws_repeat_and_differ(spark):
    df = spark.range(3).select(F.col("id").alias("sid"), F.lit("DoS").alias("y"))
    rows = SM.bootstrap(df, "y", "sid", "attack", 25).collect()
    assert sorted(r["draw"] for r in rows) == list(range(1, 26))
    assert len({r["sid"] for r in rows}) == 3
    assert SM.bootstrap(df, "y", "sid", "benign", 5).count() == 0
    with pytest.raises(FlowLensError):
        SM.bootstrap(df, "y", "sid", "other")
