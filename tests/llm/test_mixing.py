import re

import pytest
from flowlens.llm import mixing as M
from pyspark.sql import functions as F

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_targets(sizes, weights=(3, 1, 2), share=1.5, most=2):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, fixed = share * sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in fixed]
        rest, all_w = total - sum(fixed.values()), sum(w[s] for s in free)
        goal = {s: rest * w[s] / all_w for s in free}
        above = [s for s in free if goal[s] > most * sizes[s]]
        if not above:
            return {**fixed, **goal}
        fixed |= {s: float(most * sizes[s]) for s in above}


def rows(df):
    return M.mixed(df).collect()


def test_documents(docs):
    got = rows(docs)
    source = {r["doc_id"]: r["source"] for r in docs.collect()}
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    sizes, taken, largest = {}, {}, {}
    for r in got:
        s = source[r["doc_id"]]
        assert r["size"] == len(WORD.findall(text[r["doc_id"]]))
        assert r["taken"] in (0, r["size"], 2 * r["size"])
        sizes[s] = sizes.get(s, 0) + r["size"]
        taken[s] = taken.get(s, 0) + r["taken"]
        largest[s] = max(largest.get(s, 0), r["size"])
    want = brute_targets(sizes)
    for r in got:
        s = source[r["doc_id"]]
        assert r["source_size"] == sizes[s] and r["target"] == pytest.approx(want[s])
    assert all(abs(taken[s] - want[s]) <= largest[s] / 2 for s in sizes)
    assert sum(abs(taken[s] - want[s]) for s in sizes) < 0.03 * sum(want.values())


def test_reruns_agree(docs):
    assert sorted(rows(docs)) == sorted(rows(docs.repartition(7)))


def test_edges(edge, clash, empty):
    got = rows(edge)
    assert len(got) == 10 and rows(empty) == []
    assert sorted(map(str, got)) == sorted(map(str, rows(clash)))
    sizes = {}
    for r in got:
        sizes.setdefault(r["source_size"], r["target"])
        assert 0 <= r["taken"] <= 2 * r["size"]
    assert M.take_mix(clash).columns == clash.columns
    assert M.take_mix(empty).count() == 0
    assert M.take_mix(edge).count() >= 1


def test_all_sources_null(spark):
    df = spark.createDataFrame([(i, "a b c d", None) for i in range(100)], "doc_id long, text string, source string")
    got = rows(df)
    assert {r["target"] for r in got} == {600.0} and sum(r["taken"] for r in got) == 600


def test_inclusion_is_fair(spark):
    """Over seeds every document is taken about as often as its inclusion probability says."""
    df = spark.createDataFrame([(i, i % 2, 1 + i % 5) for i in range(60)], "doc_id long, source long, size long")
    df = df.withColumn("source", F.col("source").cast("string"))
    times = {}
    for seed in range(10):
        for r in M.drawn(df, M.plan(df, seed=seed)).collect():
            times.setdefault((r["source"], r["target"] / r["source_size"]), []).append(r["copies"])
    for (_, copies), taken in times.items():
        assert sum(taken) / len(taken) == pytest.approx(copies, abs=0.12)


def test_a_long_document_at_the_cut(spark):
    """What a document too long for the gap leaves is filled from all later ones, however many that takes."""
    rows = [(i, "s", 50 + i * 37 % 200) for i in range(2000)] + [(5000, "s", 150_000)]
    df = spark.createDataFrame(rows, "doc_id long, source string, size long")
    for seed in (0, 2):
        got = M.drawn(df, M.plan(df, seed=seed)).collect()
        assert sum(r["size"] * r["copies"] for r in got) == pytest.approx(got[0]["target"], abs=50)
