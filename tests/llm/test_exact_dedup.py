import hashlib

import numpy as np
import pytest
from flowlens.llm import exact_dedup as E
from pyspark.sql import functions as F


def brute(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    out = []
    for i, t in rows:
        ids = groups[t or ""]
        known = [x for x in ids if x is not None]
        keep = max(known) if known else None
        out.append((i, keep, len(ids), i == keep, hashlib.sha256((t or "").encode()).hexdigest()))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in E.exact_groups(df).collect()), key=str)


def test_documents(docs, texts):
    assert got(docs) == brute(texts)


def test_edges(edge, clash, empty, edge_rows):
    want = brute([r[:2] for r in edge_rows])
    assert got(edge) == want == got(clash)
    assert got(empty) == []
    left = E.drop_copies(clash)
    assert left.columns == clash.columns
    assert sorted((r["doc_id"] for r in left.collect()), key=str) == sorted((r[0] for r in want if r[3]), key=str)


def test_hot_group(spark):
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "same").otherwise(F.col("id").cast("string")).alias("text"))
    rows = E.exact_groups(df.repartition(8)).where("text_sha256 = sha2('same', 256)").collect()
    assert len(rows) == 1000 and {(r["keep_id"], r["group_size"]) for r in rows} == {(2997, 1000)}


def same(held, prints, counts):
    got = E.decoded(held)
    assert got[0].tolist() == prints.tolist() and got[1].tolist() == counts.tolist()


@pytest.mark.parametrize("bits", [64, 61, 40, 16])
def test_filter_round_trip(bits):
    """Full and crowded filters, runs that push others on, counters of several digits."""
    rng = np.random.default_rng(bits)
    for n in (0, 1, 2, 7, 100, 5000, 70_000 if bits > 16 else 30_000):
        for spread in (bits, 12):  # few quotients: long runs
            prints = np.unique(rng.integers(0, 2**min(spread, 63), n, np.uint64) << np.uint64(bits - min(spread, bits)))
            prints = np.unique(prints & np.uint64((1 << bits) - 1))
            counts = np.where(rng.random(len(prints)) < 0.3, rng.integers(1, 1 << 40, len(prints)), 1)
            held = E.encoded(prints, counts, bits)
            same(held, prints, counts)
            r = bits - held.quotient_bits
            assert len(held.remainders) == (held.slots * r + 7) // 8 and (r == E.LEAST_REMAINDER or len(prints) <= E.LOAD * 2**held.quotient_bits)


def test_pack():
    values = np.arange(70_001, dtype=np.uint64) * np.uint64(7919) & np.uint64(0x1FFFF)
    assert len(E.pack(values, 17)) == -(-70_001 * 17 // 8) and (E.unpack(E.pack(values, 17), 17, len(values)) == values).all()


def test_filters_merge_without_loss():
    """Filters of different sizes merge into the filter that one build over all fingerprints gives."""
    rng = np.random.default_rng(0)
    a, b, c = (rng.integers(0, 2**64, n, np.uint64) for n in (5000, 300, 40))
    b[:100], c[:] = a[:100], a[7]
    every = np.concatenate([a, b, c])
    merged = E.merge_filters([E.build_filter(x) for x in (a, b, c)])
    assert merged == E.build_filter(every)
    same(merged, *np.unique(every, return_counts=True))
    none = E.build_filter(np.empty(0, np.uint64))
    assert len(E.decoded(E.merge_filters([none, none]))[0]) == 0 and E.merge_filters([none, merged]) == merged


def test_equal_fingerprints_of_different_texts(spark):
    """Filters only route: texts are told apart by their bytes even where a print is repeated."""
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "doc_id long, text string")
    assert {(r["doc_id"], r["keep_id"]) for r in E.exact_groups(df).collect()} == {(1, 2), (2, 2), (3, 3)}
