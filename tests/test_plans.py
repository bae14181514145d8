"""Physical plans: pruned scans, no Python in batch, no cross products, no whole-table windows."""

import re

import __spark_entry__ as entry
import pytest
from flowlens.operators import evaluate as EV
from flowlens.operators import flows as FL
from flowlens.plans import clean_queries, eval_queries, flow_queries
from pyspark.sql import functions as F

PYTHON = ("ArrowEvalPython", "BatchEvalPython", "MapInPandas", "FlatMapGroupsInPandas", "PythonUDF")
PLANNED = ["flow_activity", "f15_feature_vector", "f6_segment_strict", "f6_segment_parity", "f19_window_counters",
           "a1_audit", "p6_deduplicate", "a9_conflicts", "d4_stratified_split", "m11_m14_records", "e7_e8_ranking",
           "e15_comparison_binary", "i2_high_risk", "i8_cohort_rows"]


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", PLANNED)
def test_no_python_and_no_cross_product(name, spark, sf_dir):
    text = plan(entry.queries()[name](spark, sf_dir))
    assert not any(p in text for p in PYTHON)
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_segmentation_shuffles_packets_once(spark, sf_dir):
    text = plan(flow_queries.segmented(spark, sf_dir))
    # one exchange of packets per (key, slot) and its narrow copy for the summary; the summary by key and back
    assert len(re.findall(r"Exchange hashpartitioning\(protocol", text)) <= 4 and "Exchange SinglePartition" not in text
    for window in re.findall(r"\n[ :+|-]*Window .*", text):
        assert "a_ip" in window.rsplit("], [", 2)[1]


def test_key_needs_no_null_filter(spark, sf_dir):
    text = plan(flow_queries.segmented(spark, sf_dir))
    assert "isnotnull(least" not in text and "isnotnull(aggregate" not in text


def test_flow_scan_reads_needed_columns(spark, sf_dir):
    text = plan(flow_queries.flow_activity(spark, sf_dir))
    assert "props" not in text


def test_top_k_is_a_heap(spark, sf_dir):
    assert "TakeOrderedAndProject" in plan(entry.queries()["i2_high_risk"](spark, sf_dir))


def test_flow_sums_combine_before_the_shuffle(spark, sf_dir):
    text = plan(FL.accumulate(flow_queries.segmented(spark, sf_dir), 5_000_000, 100))
    assert re.search(r"partial_sum|partial_count", text)


def test_dedup_combines_before_the_shuffle(spark, sf_dir):
    text = plan(clean_queries.Q["p6_deduplicate"][0](spark, sf_dir))
    assert "partial_min" in text and len(re.findall(r"Exchange hashpartitioning", text)) == 1


def test_confusion_is_one_pass(spark, sf_dir):
    text = plan(eval_queries.confusion(spark, sf_dir))
    assert text.count("FileScan") == 2  # orders and lineitem, once each


def test_ranking_windows_inside_buckets(spark, sf_dir):
    text = plan(EV.ranking(eval_queries.predictions(spark, sf_dir, True), "1"))
    row_windows = [w for w in re.findall(r"\n[ :+|-]*Window .*", text) if "score" in w]
    assert row_windows and all("bucket" in w for w in row_windows)


def test_filter_reaches_the_scan(spark, tmp_path):
    spark.range(100).select(F.col("id").alias("ts_us"), F.lit(4).alias("ip_version")).write.parquet(str(tmp_path / "p"))
    kept = FL.since(spark.read.parquet(str(tmp_path / "p")), 50)
    assert "GreaterThanOrEqual(ts_us,50)" in plan(kept)


def test_bucket_bounds_meet_in_no_single_task(spark, sf_dir):
    for name in ("flow_activity", "f6_segment_strict", "f6_segment_parity", "e7_e8_ranking"):
        assert "percentile_approx" not in plan(entry.queries()[name](spark, sf_dir))


def test_a_sample_reads_the_files_of_its_blocks(spark, tmp_path):
    from flowlens.operators import sample as SM

    path = str(tmp_path / "t.parquet")
    spark.range(20_000).repartitionByRange(40, "id").sortWithinPartitions("id").write.parquet(path)
    rows = SM.block_sample(spark, path, max_rows=100, block_rows=100)
    assert rows.count() == 100
    assert 0 < len([f for f in rows.inputFiles() if "/t.parquet/" in f]) <= 20
