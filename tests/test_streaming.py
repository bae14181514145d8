"""Streaming runs against the batch flow table."""

import random

import pytest
from flowlens import schema as S
from flowlens.errors import FlowLensError
from flowlens.operators import flows as FL
from flowlens.operators import live as LV
from flowlens.streaming import flow_stream as FS
from pyspark.sql import functions as F

SECOND = 1_000_000
IDLE, CAP = 5 * SECOND, 4


def raw_rows(n=400, seed=5):
    rng = random.Random(seed)
    at, rows = 1_700_000_000 * SECOND, []
    for seq in range(n):
        at += rng.choice([1, 1000, SECOND, 2 * SECOND, 5 * SECOND, 9 * SECOND])
        client, port = f"10.0.0.{rng.choice([1, 1, 1, 1, 2, 3])}", 1000
        a, b = ((client, port), ("9.0.0.1", 443))[:: rng.choice([1, -1])]
        rows.append((seq, at, 4, 6, *a, *b, rng.randint(40, 1500), rng.choice(["S", "A", "PA"])))
    return rows


def write_files(spark, rows, folder, parts):
    step = -(-len(rows) // parts)
    for i in range(parts):
        chunk = spark.createDataFrame(rows[i * step:(i + 1) * step], S.RAW_PACKET_SCHEMA)
        chunk.coalesce(1).write.mode("append").parquet(str(folder))


def run(spark, source, folder, delay=0):
    stream = FL.normalise_packets(FS.read_packets(spark, str(source), "*.parquet", files_per_batch=1))
    FS.stream_flows(stream, str(folder), delay, IDLE, CAP).awaitTermination()


def as_set(df):
    cols = ["flow_id", "source", "destination", "packet_count", "bytes", "duration_seconds"]
    return {tuple(r) for r in df.select(*cols).collect()}


def batch(spark, rows):
    packets = FL.normalise_packets(spark.createDataFrame(rows, S.RAW_PACKET_SCHEMA))
    return FL.flow_table(packets, IDLE, CAP).withColumn("flow_id", F.col("first_seq"))


@pytest.mark.parametrize("parts", [1, 5])
def test_stream_equals_batch(spark, tmp_path, parts):
    rows = raw_rows()
    write_files(spark, rows, tmp_path / "in", parts)
    run(spark, tmp_path / "in", tmp_path / "out")
    whole = batch(spark, rows)
    got = FS.closed_flows(spark, str(tmp_path / "out"))
    assert as_set(got) == as_set(FL.flow_records(whole).filter("NOT active"))
    still = FS.open_flows(spark, str(tmp_path / "out"), IDLE, CAP)
    assert {r["first_seq"] for r in still.collect()} == {r["first_seq"] for r in whole.filter("active").collect()}
    features = {r["flow_id"]: r["features"] for r in got.collect()}
    expected = FL.flow_features(whole.filter("NOT active"), ["flow_id"]).collect()
    assert all(features[r["flow_id"]] == {f: r[f] for f in S.FLOW_FEATURES} for r in expected)


def test_restart_continues(spark, tmp_path):
    rows = raw_rows()
    write_files(spark, rows[:200], tmp_path / "in", 2)
    run(spark, tmp_path / "in", tmp_path / "out")
    write_files(spark, rows[200:], tmp_path / "in", 2)
    run(spark, tmp_path / "in", tmp_path / "out")
    assert as_set(FS.closed_flows(spark, str(tmp_path / "out"))) == as_set(
        FL.flow_records(batch(spark, rows)).filter("NOT active"))


def test_window_reset(spark, tmp_path):
    """A reset between batches discards open flows, waiting packets and the register; a batch run again does it again."""
    rows, folder = raw_rows(), str(tmp_path / "out")
    start = rows[200][1]
    write_files(spark, rows[:200], tmp_path / "in", 2)
    run(spark, tmp_path / "in", folder, delay=20 * SECOND)
    assert FS.live_state(spark, folder, IDLE, CAP).count() and FS.current_window(spark, folder) == (0, None)
    assert FS.reset_window(spark, folder, start) == 1
    assert FS.live_state(spark, folder, IDLE, CAP).count() == 0
    late = [(1000 + i, rows[100 + i][1], *rows[i][2:]) for i in range(5)]  # of the old window: gone, not late
    write_files(spark, late + rows[200:], tmp_path / "in", 2)
    run(spark, tmp_path / "in", folder, delay=20 * SECOND)
    want = as_set(FL.flow_records(batch(spark, rows[200:])))
    assert as_set(FS.live_state(spark, folder, IDLE, CAP)) == want
    assert as_set(FL.flow_records(FL.flow_table(FL.since(FL.normalise_packets(
        spark.createDataFrame(rows + late, S.RAW_PACKET_SCHEMA)), start), IDLE, CAP).withColumn("flow_id", F.col("first_seq")))) == want
    assert FS.late_packets(spark, folder).count() == 0
    last = max((tmp_path / "out" / "checkpoint" / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    last.rename(tmp_path / "commit")  # the batch runs again
    last.with_name(f".{last.name}.crc").rename(tmp_path / "crc")
    run(spark, tmp_path / "in", folder, delay=20 * SECOND)
    assert as_set(FS.live_state(spark, folder, IDLE, CAP)) == want
    with pytest.raises(FlowLensError):
        FS.reset_window(spark, folder, start - 1)


def test_late_packets(spark, tmp_path):
    rows = raw_rows(300)
    # neighbours swapped across file borders, all within the delay
    shuffled = list(rows)
    for i in range(59, 299, 60):
        shuffled[i], shuffled[i + 1] = shuffled[i + 1], shuffled[i]
    write_files(spark, shuffled, tmp_path / "in", 5)
    run(spark, tmp_path / "in", tmp_path / "out", delay=20 * SECOND)
    whole = as_set(FL.flow_records(batch(spark, rows)))
    state = FS.live_state(spark, str(tmp_path / "out"), IDLE, CAP)
    assert as_set(state) == whole
    assert LV.counters(state).first()["packets_captured"] == 300
    assert FS.late_packets(spark, str(tmp_path / "out")).count() == 0


def test_too_late_is_kept_apart(spark, tmp_path):
    rows = raw_rows(100)
    late = (1000, rows[0][1] + 1, *rows[0][2:])
    write_files(spark, rows, tmp_path / "in", 1)
    run(spark, tmp_path / "in", tmp_path / "out")
    before = as_set(FS.closed_flows(spark, str(tmp_path / "out")))
    write_files(spark, [late], tmp_path / "in", 1)
    run(spark, tmp_path / "in", tmp_path / "out")
    assert as_set(FS.closed_flows(spark, str(tmp_path / "out"))) == before
    assert [r["seq"] for r in FS.late_packets(spark, str(tmp_path / "out")).collect()] == [1000]
    clock = spark.read.parquet(str(tmp_path / "out" / "clock")).orderBy(F.desc("batch_id")).first()
    assert clock["late_packets"] == 1


def test_equal_timestamps_across_batches(spark, tmp_path):
    base = 1_700_000_000 * SECOND
    rows = [(i, base + (i // 7) * SECOND, 4, 6, "a", 1, "b", 2, 60, "") for i in range(70)]
    write_files(spark, rows, tmp_path / "in", 9)
    run(spark, tmp_path / "in", tmp_path / "out")
    assert as_set(FS.closed_flows(spark, str(tmp_path / "out"))) == as_set(
        FL.flow_records(batch(spark, rows)).filter("NOT active"))


def test_foreign_state_is_refused(spark, tmp_path):
    spark.range(1).selectExpr("7L AS batch_id", "1L AS watermark_us").write.parquet(str(tmp_path / "clock" / "slot=0"))
    with pytest.raises(FlowLensError):
        FS._clock(spark, str(tmp_path), 1)


def test_register_counts(spark, tmp_path):
    rows = raw_rows(100)
    write_files(spark, rows, tmp_path / "in", 1)
    run(spark, tmp_path / "in", tmp_path / "out")
    counts = LV.counters(FS.closed_flows(spark, str(tmp_path / "out")).withColumn("active", F.lit(False))).first()
    assert counts["flows_analyzed"] == 0 and counts["predictions_used"] == counts["flows_detected"] > 0


def test_native_sessions_split_at_idle(spark):
    base = 1_700_000_000 * SECOND
    rows = [(i, base + t, 4, 6, "a", 1, "b", 2, 60, "") for i, t in enumerate([0, IDLE - 1, 2 * IDLE - 1, 3 * IDLE])]
    packets = FL.normalise_packets(spark.createDataFrame(rows, S.RAW_PACKET_SCHEMA))
    got = sorted((r["first_seq"], r["packet_count"]) for r in FS.session_flows(packets, IDLE).collect())
    assert got == [(0, 2), (2, 1), (3, 1)]


def test_few_packets_a_key_are_ordered_once(spark, monkeypatch):
    """Where no key has many packets no slots are made, and flows are those of the slots, with flows carried or not."""
    packets = FL.normalise_packets(spark.createDataFrame(raw_rows(300), S.RAW_PACKET_SCHEMA)).cache()
    keyed = FL.with_flow_key(packets)
    newest = packets.agg(F.min("ts_us")).first()[0]
    carried = keyed.filter("src_port = 1000").select(*FL.KEY).distinct().limit(2).withColumns({
        "packet_count": F.lit(CAP - 1).cast("bigint"), "last_seen_us": F.lit(newest - SECOND)})
    rows = ["seq", "position", "flow_start", "iat_us", "from_a"]

    def cut(held):
        return {tuple(r) for r in FL.segment(packets, IDLE, CAP, carried=held).select(*rows).collect()}

    with monkeypatch.context() as m:
        m.setattr(FL, "KEY_ROWS", 0)
        want = [cut(None), cut(carried)]
    monkeypatch.setattr(FL, "_slots", None)
    assert [cut(None), cut(carried)] == want and want[0] != want[1] and len(want[0]) == 300


def test_stored_flows_are_sums(spark, tmp_path):
    """A batch stores sums and scores; the register's features are derived where they are read."""
    write_files(spark, raw_rows(60), tmp_path / "in", 1)
    run(spark, tmp_path / "in", tmp_path / "out")
    stored = spark.read.parquet(str(tmp_path / "out" / "flows"))
    assert "features" not in stored.columns and {"len_sq", "iat_sq", "prediction", "error"} <= set(stored.columns)
    got = FS.closed_flows(spark, str(tmp_path / "out"))
    assert got.dtypes == spark.createDataFrame([], S.LIVE_FLOW_SCHEMA).dtypes and {r["error"] for r in got.collect()} == {S.NOT_ANALYZED}
    assert all(set(r["features"]) == set(S.FLOW_FEATURES) for r in got.collect())
