import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from flowlens.llm import periodic_runs as P
from hypothesis import given, settings
from hypothesis import strategies as st

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_runs(x):
    """Every maximal stretch by trying all periods at all places."""
    n, out = len(x), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if x[i] != x[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and x[j] == x[j + q]:
                j += 1
            if j + q - i >= max(6, 4 * q):
                out.setdefault((i, j + q - i), q)
            i = j + 1
    return sorted((s, k, q) for (s, k), q in out.items())


def brute(doc_id, text):
    words = WORD.findall(text or "")
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(words)
    gone = {i for s, k, q in runs for i in range(s + q, s + k)}
    best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=None)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc_id, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None,
            sha("".join(f"{s},{k},{q}\n" for s, k, q in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def got(df):
    cols = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    return sorted((tuple(r) for r in P.digests(df).select(cols).collect()), key=str)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(1, 3), min_size=1, max_size=9), st.integers(1, 9)), max_size=8))
def test_runs(parts):
    x = [c for unit, times in parts for c in unit * times]
    assert P.runs_of(np.array(x, np.int64)) == brute_runs(x)


def test_runs_of_many_periods():
    rng = random.Random(3)
    for _ in range(60):
        x = []
        for _ in range(rng.randint(1, 5)):
            x += [rng.randint(1, 4) for _ in range(rng.randint(0, 40))]
            x += ([rng.randint(1, 50) for _ in range(rng.randint(1, 60))] * rng.randint(3, 8))[:rng.randint(1, 400)]
        assert P.runs_of(np.array(x, np.int64)) == brute_runs(x)


@pytest.mark.parametrize("prime", P.PRIMES)
def test_mismatches(prime):
    rng = np.random.default_rng(1)
    for length in (1, 2, 8, 32):
        b, w = rng.integers(1, 2**20, (3, length)), rng.integers(1, 2**20, (3, 2 * length - 1))
        want = [[sum((int(b[r, j]) - int(w[r, s + j])) ** 2 for j in range(length)) % prime[0] for s in range(length)] for r in range(3)]
        assert P.mismatches(b, w, *prime).tolist() == want


def test_documents(docs, texts):
    assert got(docs) == sorted((brute(i, t) for i, t in texts), key=str)


def test_edges(edge, clash, empty, edge_rows):
    small = [r for r in edge_rows if r[0] != 8]
    rows = [r for r in got(edge) if r[0] != 8]
    assert rows == sorted((brute(i, t) for i, t, *_ in small), key=str)
    assert got(clash) == got(edge) and got(empty) == []


def test_long_runs_take_linear_time():
    one = np.ones(400_000, np.int64)
    assert P.runs_of(one) == [(0, 400_000, 1)]
    unit = np.arange(1, 1001)
    assert P.runs_of(np.tile(unit, 300)) == [(0, 300_000, 1000)]


def test_ties(spark):
    rows = [(1, "a a a a a a b c b c b c b c b c b c d d d d d d"), (3, "x y x y x y x y z q q q q q q q q")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(df) == sorted((brute(i, t) for i, t in rows), key=str)
