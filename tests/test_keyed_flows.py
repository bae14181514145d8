"""Keyed state and timers against the batch flow table."""

import time

from flowlens import schema as S
from flowlens.operators import flows as FL
from flowlens.streaming import flow_stream as FS
from flowlens.streaming import keyed_flows as KF
from pyspark.sql import functions as F
from test_streaming import CAP, IDLE, SECOND, as_set, batch, raw_rows, write_files


def run(spark, source, folder, delay="0 seconds", redelivered=False):
    stream = FL.normalise_packets(FS.read_packets(spark, str(source), "*.parquet", files_per_batch=1))
    KF.write_flows(KF.keyed_flows(stream, delay, IDLE, CAP, redelivered), str(folder)).awaitTermination()


def closed(spark, folder):
    return spark.read.schema(S.LIVE_FLOW_SCHEMA).parquet(f"{folder}/flows")


def want(spark, rows, active):
    """Batch flows that the last watermark, a whole millisecond, leaves open or closed."""
    mark = max(KF.milliseconds(r[1]) for r in rows)
    over = (F.col("packet_count") >= CAP) | (F.ceil((F.col("last_seen_us") + IDLE) / 1000) <= mark)
    return batch(spark, rows).filter(~over if active else over)


def test_batches_restart_and_state(spark, tmp_path):
    # without a delay a file must not begin in the millisecond in which the last one ended
    rows = [(r[0], r[1] // 1000 * 1000 + 1000 * r[0], *r[2:]) for r in raw_rows()]
    write_files(spark, rows[:200], tmp_path / "in", 2)
    run(spark, tmp_path / "in", tmp_path / "out")
    half = as_set(closed(spark, tmp_path / "out"))
    last = max(int(p.name) for p in (tmp_path / "out" / "checkpoint" / "commits").iterdir() if p.name.isdigit())
    write_files(spark, rows[200:], tmp_path / "in", 2)
    run(spark, tmp_path / "in", tmp_path / "out")
    got = closed(spark, tmp_path / "out")
    assert half < as_set(got) == as_set(FL.flow_records(want(spark, rows, False)))
    features = {r["flow_id"]: r["features"] for r in got.collect()}
    expected = FL.flow_features(want(spark, rows, False), ["flow_id"]).collect()
    assert all(features[r["flow_id"]] == {f: r[f] for f in S.FLOW_FEATURES} for r in expected)
    fields = ["first_seq", "packet_count", "bytes", "started_us", "last_seen_us"]
    for held, part in ((KF.open_flows(spark, str(tmp_path / "out")), rows), (KF.open_flows(spark, str(tmp_path / "out"), last), rows[:200])):
        assert {tuple(r) for r in held.select(fields).collect()} == {tuple(r) for r in want(spark, part, True).select(fields).collect()}
    assert KF.waiting_packets(spark, str(tmp_path / "out")).count() == 0


def test_out_of_order_and_redelivered(spark, tmp_path):
    rows = raw_rows(200)
    shuffled = rows[:50] + rows[60:70] + rows[50:60] + rows[70:] + rows[195:]
    write_files(spark, shuffled, tmp_path / "in", 4)
    end = (9_000, rows[-1][1] + 3600 * SECOND, *rows[-1][2:])  # passes the delay
    run(spark, tmp_path / "in", tmp_path / "out", "100 seconds", True)
    write_files(spark, [end], tmp_path / "in", 1)
    run(spark, tmp_path / "in", tmp_path / "out", "100 seconds", True)
    assert as_set(closed(spark, tmp_path / "out")) == as_set(FL.flow_records(batch(spark, rows)))
    assert [r["seq"] for r in KF.waiting_packets(spark, str(tmp_path / "out")).collect()] in ([], [9_000])


def test_hot_key(spark, tmp_path):
    base = 1_700_000_000 * SECOND
    rows = [(i, base + i * 1000, 4, 6, "a", 1, "b" if i % 10 else f"c{i % 7}", 2, 60 + i % 9, "A") for i in range(20_000)]
    write_files(spark, rows, tmp_path / "in", 2)
    start = time.time()
    run(spark, tmp_path / "in", tmp_path / "out")
    assert as_set(closed(spark, tmp_path / "out")) == as_set(FL.flow_records(want(spark, rows, False)))
    assert time.time() - start < 120


def test_waiting_packets_are_columns(spark, tmp_path):
    """Behind a long delay all packets wait, an entry per key and batch, not one per packet."""
    rows = raw_rows(120)
    write_files(spark, rows, tmp_path / "in", 2)
    run(spark, tmp_path / "in", tmp_path / "out", "1000 days")
    waiting = KF.waiting_packets(spark, str(tmp_path / "out"))
    packets = FL.with_flow_key(FL.normalise_packets(spark.createDataFrame(rows, S.RAW_PACKET_SCHEMA)))
    assert {tuple(r) for r in waiting.collect()} == {tuple(r) for r in packets.select(*FL.KEY, *KF.PACKET).collect()}
    entries = KF._state(spark, str(tmp_path / "out"), "ahead", None, 0).count()
    assert entries <= 2 * packets.select(*FL.KEY).distinct().count() < len(rows)


def test_stored_parts_are_batches(spark, sf_dir, tmp_path, monkeypatch):
    """Every part is as many files as a stream takes at a time, later parts in later files, no millisecond in two parts."""
    from flowlens.plans import ml_queries as MQ

    monkeypatch.setattr(MQ, "ROWS_A_FILE", 40)
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    path, files = MQ._stored_events(events, str(tmp_path / "events"), 3)
    stored = sorted((tmp_path / "events").glob("*.parquet"), key=lambda p: p.stat().st_mtime_ns)
    assert files > 1 and len(stored) == 3 * files
    ends = []
    for i in range(3):
        part = spark.read.parquet(*[str(p) for p in stored[i * files:(i + 1) * files]]).select(F.ceil(MQ._at() / 1000).alias("ms"))
        ends.append(part.agg(F.min("ms"), F.max("ms")).first())
    assert ends[0][1] < ends[1][0] and ends[1][1] < ends[2][0]
    assert spark.read.parquet(path).count() == events.count()
