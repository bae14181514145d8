import re

import numpy as np
import xxhash
from flowlens.llm import simhash as S
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_print(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = WORD.findall(low)
    hashes = [xxhash.xxh64_intdigest(" ".join(w[i:i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(rows):
    prints = [brute_print(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return sorted(((d, f"{prints[i]:016x}", least.get(find(i))) for i, (d, _) in enumerate(rows)), key=str)


def got(df):
    return sorted((tuple(r) for r in S.near_groups(df).collect()), key=str)


def test_documents(docs, texts):
    assert got(docs) == brute(texts)


def test_edges(edge, clash, empty, edge_rows):
    want = brute([r[:2] for r in edge_rows])
    assert got(edge) == want == got(clash)
    assert got(empty) == []
    left = S.one_of_each(clash)
    assert left.columns == clash.columns
    assert sorted({r["doc_id"] for r in left.collect()} - {None}) == sorted({r[2] for r in want} - {None})


@given(st.integers(0, 2**64 - 1), st.integers(0, 2**64 - 1))
@settings(max_examples=300, deadline=None)
def test_lower_bound(a, b):
    def point(f):
        return [(f >> 2 * s & 1) + (f >> 2 * s + 1 & 1) for s in range(32)]

    assert sum(abs(x - y) for x, y in zip(point(a), point(b), strict=True)) <= (a ^ b).bit_count()


def test_links_are_complete(spark):
    rng = np.random.default_rng(1)
    prints = [int(x) for x in rng.integers(0, 2**64, 60, np.uint64)] + [0, 2**64 - 1, 1 << 63, 3 << 62]
    for p in list(prints):
        for k in (1, 2, 3, 4):
            q = p
            for b in rng.choice(64, k, replace=False):
                q ^= 1 << int(b)
            prints.append(q)
    prints = sorted(set(prints))
    df = spark.createDataFrame([(S.signed(p),) for p in prints], "fingerprint long")
    for k in (0, 1, 2, 3, 5):
        found = {frozenset((r["a"], r["b"])) for r in S.links(df, k).collect()}
        want = {frozenset((S.signed(a), S.signed(b))) for i, a in enumerate(prints) for b in prints[:i] if (a ^ b).bit_count() <= k}
        assert found == want


def test_components_of_a_chain(spark):
    chain = spark.range(200).select((F.col("id") * 7 % 200).alias("a"), ((F.col("id") + 1) * 7 % 200).alias("b")).where("id < 199")
    rows = S.components(chain).collect()
    assert {r["root"] for r in rows} == {0} and len(rows) == 199
