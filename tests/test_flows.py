"""Segmentation, direction, features and flow ids against hand-made and simulated captures."""

import math
import random

import pytest
from flowlens import schema as S
from flowlens.errors import FlowLensError
from flowlens.functions.prefix import bucket_count
from flowlens.operators import flows as FL

SECOND = 1_000_000
PACKET = ("seq long, ts_us long, protocol string, src_ip string, src_port int, dst_ip string, dst_port int, "
          "length long, flags string")
ENDS = {"x": ("10.0.0.1", 1000), "y": ("10.0.0.2", 1000), "z": ("10.0.0.3", 1000)}
SERVER = ("9.0.0.1", 443)


def packets(spark, rows):
    """rows: (key name, seconds, reply?, length, flags)"""
    out = []
    for seq, (key, at, reply, length, flags) in enumerate(rows):
        src, dst = (SERVER, ENDS[key]) if reply else (ENDS[key], SERVER)
        out.append((seq, 1_700_000_000 * SECOND + int(round(at * SECOND)), "TCP", *src, *dst, length, flags))
    return spark.createDataFrame(out, PACKET)


def simulate(rows, idle, cap, parity):
    """Packet by packet: fold into the open flow, then close what is full or silent."""
    open_flows, members, closed = {}, [], set()
    last = {}
    n = 0
    for seq, (key, at, *_rest) in enumerate(rows):
        now = int(round(at * SECOND))
        if not parity and key in open_flows and now - last[key] >= idle:
            closed.add(open_flows.pop(key)[0])
        if key not in open_flows:
            n += 1
            open_flows[key] = [n, 0]
        flow = open_flows[key]
        flow[1] += 1
        last[key] = now
        members.append((seq, flow[0]))
        for other in list(open_flows):
            if now - last[other] >= idle or open_flows[other][1] >= cap:
                closed.add(open_flows.pop(other)[0])
    return members, closed


def grouping(spark, rows, idle, cap, mode, slot=None):
    seg = FL.segment(packets(spark, rows), idle, cap, mode, slot).select("seq", *FL.KEY, "flow_start").collect()
    return {r["seq"]: tuple(r)[1:] for r in seg}


def same_partition(ours, theirs):
    pairs = {(ours[s], f) for s, f in theirs}
    return len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs})


HAND = [("x", t, False, 60, "") for t in (0, 6)] + [("y", t, False, 60, "") for t in (7, 13)] + [
    ("x", t, False, 60, "") for t in (13.5, 14)]


@pytest.mark.parametrize("mode,starts", [("strict", {0, 1, 2, 3, 4}), ("parity", {0, 2, 4})])
def test_idle_split(spark, mode, starts):
    got = FL.flow_table(packets(spark, HAND), 5 * SECOND, 100, mode).select("first_seq").collect()
    assert {r[0] for r in got} == starts


@pytest.mark.parametrize("mode", ["strict", "parity"])
@pytest.mark.parametrize("seed", range(4))
def test_random_captures(spark, mode, seed):
    rng = random.Random(seed)
    at, rows = 0.0, []
    for _ in range(160):
        at += rng.choice([0, 0.001, 0.5, 1, 2, 4.999999, 5, 5.000001, 7])
        rows.append((rng.choice("xxxxyz"), at, rng.random() < 0.4, rng.randint(40, 1500), "A"))
    cap = rng.choice([2, 3, 7])
    theirs, closed = simulate(rows, 5 * SECOND, cap, mode == "parity")
    for slot in (5 * SECOND, 60 * SECOND, None):
        assert same_partition(grouping(spark, rows, 5 * SECOND, cap, mode, slot), theirs)
    table = FL.flow_table(packets(spark, rows), 5 * SECOND, cap, mode).select("first_seq", "active").collect()
    first = {}
    for seq, flow in theirs:
        first.setdefault(flow, seq)
    assert {r["first_seq"]: r["active"] for r in table} == {s: f not in closed for f, s in first.items()}


def test_cap_chunks(spark):
    rows = [("x", i * 0.01, False, 60, "A") for i in range(205)]
    got = FL.flow_table(packets(spark, rows)).orderBy("first_seq").select("packet_count", "active").collect()
    assert [tuple(r) for r in got] == [(100, False), (100, False), (5, True)]


def test_chunk_spans_slots(spark):
    # one session over many slots, chunks counted from the session start
    rows = [("x", i * 4.0, False, 60, "A") for i in range(50)]
    got = FL.flow_table(packets(spark, rows), 5 * SECOND, 20, slot_us=7 * SECOND).orderBy("first_seq").collect()
    assert [r["packet_count"] for r in got] == [20, 20, 10]
    assert [r["iat_max"] for r in got] == [4 * SECOND] * 3


def test_opener_decides_direction(spark):
    rows = [("x", 0, False, 100, ""), ("x", 1, True, 200, ""), ("x", 2, True, 300, ""), ("x", 3, False, 50, "")]
    got = FL.flow_table(packets(spark, rows), 5 * SECOND, 2).orderBy("first_seq").collect()
    assert [(r["source_ip"], r["fwd_n"], r["bwd_n"], r["fwd_bytes"]) for r in got] == [
        ("10.0.0.1", 1, 1, 100), ("9.0.0.1", 1, 1, 300)]


def test_single_packet(spark):
    row = FL.flow_features(FL.flow_table(packets(spark, [("x", 0, False, 60, "SA")]))).first().asDict()
    assert row["Flow Duration"] == 0 and row["Flow Packets/s"] == 1_000_000 and row["Flow Bytes/s"] == 60_000_000
    assert row["SYN Flag Count"] == row["ACK Flag Count"] == 1
    assert all(v == 0 for k, v in row.items() if "IAT" in k or k.endswith("Std"))


def test_feature_values(spark):
    rows = [("x", 0, False, 100, "S"), ("x", 0.5, True, 60, "SA"), ("x", 2, False, 200, "PA"), ("x", 4, True, 1000, "FA")]
    row = FL.flow_features(FL.flow_table(packets(spark, rows))).first().asDict()
    assert list(row) == list(S.FLOW_FEATURES) and len(row) == 78

    def std(xs):
        m = sum(xs) / len(xs)
        return math.sqrt(sum((x - m) ** 2 for x in xs) / len(xs))

    gaps = [0.5e6, 1.5e6, 2e6]
    want = {
        "Destination Port": 443, "Flow Duration": 4e6, "Total Fwd Packets": 2, "Total Length of Bwd Packets": 1060,
        "Fwd Packet Length Std": std([100, 200]), "Bwd Packet Length Max": 1000, "Bwd Packet Length Min": 60,
        "Flow Bytes/s": 340, "Flow Packets/s": 1, "Fwd Packets/s": 0.5, "Flow IAT Mean": sum(gaps) / 3,
        "Flow IAT Std": std(gaps), "Flow IAT Max": 2e6, "Flow IAT Min": 5e5, "Fwd IAT Total": 4e6, "Bwd IAT Total": 0,
        "Packet Length Mean": 340, "Packet Length Variance": std([100, 60, 200, 1000]) ** 2, "Down/Up Ratio": 1,
        "Fwd Header Length": 40, "Fwd Header Length.1": 40, "SYN Flag Count": 2, "ACK Flag Count": 3, "FIN Flag Count": 1,
        "PSH Flag Count": 1, "Active Max": 4e6, "Idle Max": 0, "Init_Win_bytes_forward": 0, "min_seg_size_forward": 100,
        "Subflow Bwd Bytes": 1060, "Average Packet Size": 340, "act_data_pkt_fwd": 2,
    }
    for name, value in want.items():
        assert row[name] == pytest.approx(value, rel=1e-9), name


def test_packets_are_conserved(spark):
    rng = random.Random(9)
    rows = [(rng.choice("xyz"), i * 1.7, rng.random() < 0.5, 60, "") for i in range(300)]
    total = FL.flow_table(packets(spark, rows), 5 * SECOND, 10).groupBy().sum("packet_count").first()[0]
    assert total == 300


def test_flush_open(spark):
    got = FL.flow_table(packets(spark, HAND), 5 * SECOND, 100, flush_open=True).filter("active").count()
    assert got == 0


def test_hot_key_is_spread(spark):
    # one key holds nearly all packets and sends most of them in one burst
    rows = [("x", i * 1e-4 if i < 3000 else i * 1.0, False, 60, "") for i in range(4000)] + [("y", 5000.0, False, 60, "")]
    slots = FL._slots(FL.with_flow_key(packets(spark, rows)), None).groupBy(*FL.KEY, "slot").count()
    share = 4001 / bucket_count(4001)
    assert slots.agg({"count": "max"}).first()[0] <= 2 * share
    flows = FL.with_flow_id(FL.flow_table(packets(spark, rows))).orderBy("flow_id").collect()
    assert [r["flow_id"] for r in flows] == list(range(1, len(flows) + 1))
    assert [r["packet_count"] for r in flows] == [100] * 40 + [1]


def test_other_protocols_have_no_ports(spark):
    raw = spark.createDataFrame(
        [(1, 1, 4, 1, "a", 5, "b", 6, 60, "S"), (2, 2, 4, 17, "a", 5, "b", 6, 60, "S"), (3, 3, 6, 6, "a", 5, "b", 6, 60, "S")],
        S.RAW_PACKET_SCHEMA)
    got = FL.normalise_packets(raw).orderBy("seq").collect()
    assert [(r["protocol"], r["src_port"], r["flags"]) for r in got] == [("1", 0, ""), ("UDP", 5, "")]


def test_bad_parameters(spark):
    with pytest.raises(FlowLensError):
        FL.segment(packets(spark, HAND), mode="loose")
    with pytest.raises(FlowLensError):
        FL.segment(packets(spark, HAND), idle_us=0)
