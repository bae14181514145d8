import math
import re
from collections import Counter
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow.parquet as pq
from flowlens.llm import lexical_search as S
from hypothesis import given, settings
from hypothesis import strategies as st

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items):
    bags = [(i, Counter(terms(t))) for i, t in docs]
    bags = [(i, b, sum(b.values())) for i, b in bags if b]
    n_docs, total = len(bags), sum(n for *_, n in bags)
    df = Counter(t for _, b, _ in bags for t in b)
    wanted = {}
    for item, text in items:
        wanted.setdefault(item, set()).update(terms(text))
    out = []
    for item, ts in wanted.items():
        weight = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) for t in ts if df[t]}
        scores = [(sum(w * (1_000_000_000 * b[t] // (1000 * b[t] + 8 * (10 + 90 * n * n_docs // total))) for t, w in weight.items() if b[t]), i)
                  for i, b, n in bags]
        best = sorted(((-s, i is None, i or 0) for s, i in scores if s > 0))[:10]
        out += [(item, k, None if none else i, -s) for k, (s, none, i) in enumerate(best, 1)]
    return sorted(out, key=str)


def got(docs, items):
    return sorted((tuple(r) for r in S.ranked(docs, items).select("item_id", "rank", "doc_id", "score").collect()), key=str)


def test_documents(spark, sf_dir, docs, texts):
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    rows = got(docs, items)
    assert rows == brute(texts, [(r["item_id"], r["text"]) for r in items.collect()]) and len(rows) > 100


def test_several_blocks_and_slices(spark, sf_dir, docs, texts, monkeypatch):
    monkeypatch.setattr(S, "ITEMS_AT_ONCE", 15)
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    sizes = S.corpus_sizes(docs)
    assert S.index(docs.repartition(5), *sizes).count() == 5
    assert got(docs.repartition(5), items) == brute(texts, [(r["item_id"], r["text"]) for r in items.collect()])


def test_a_stored_block_is_a_row_group(spark, sf_dir, docs, texts, monkeypatch):
    """Who writes or reads the index holds one block, however many a task has."""
    stored, keep = {}, S.staged

    def watched(df, name, *rest, **named):
        stored[name] = keep(df, name, *rest, **named)
        return stored[name]

    monkeypatch.setattr(S, "staged", watched)
    monkeypatch.setattr(S, "BLOCK_DOCS", 9)
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    assert got(docs.coalesce(1), items) == brute(texts, [(r["item_id"], r["text"]) for r in items.collect()])
    held = [pq.ParquetFile(unquote(urlparse(f).path)).metadata for f in stored["index"].inputFiles()]
    assert sum(m.num_rows for m in held) > 10 and all(m.num_row_groups == m.num_rows for m in held)


def test_edges(spark, edge, clash, empty, edge_rows):
    asked = [(1, "One TWO é x the"), (1, "word"), (None, "text"), (3, None), (4, "..."), (5, "nothing-of-it stands there"), (6, "漢字 é")]
    items = spark.createDataFrame(asked, "item_id long, text string")
    want = brute([r[:2] for r in edge_rows], asked)
    assert got(edge, items) == want == got(clash, items.selectExpr("*", "1 AS rank", "2 AS score", "3 AS doc_id"))
    assert got(empty, items) == [] and got(edge, items.limit(0)) == []


def test_ties_and_copies(spark):
    docs = [(i, "a common copy") for i in range(40, 0, -1)] + [(7, "a common copy"), (None, "a common copy"), (99, "a rare one")]
    items = [(1, "common"), (2, "rare"), (3, "copy a")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert got(df, spark.createDataFrame(items, "item_id long, text string")) == brute(docs, items)


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.tuples(st.integers(0, 40), st.integers(0, 300)), st.integers(0, 10**6), min_size=1, max_size=200), st.integers(1, 5))
def test_treap(cells, k):
    rows, cols = (np.array(x) for x in zip(*cells, strict=True))
    made = S.planted(rows, cols, np.array([*cells.values()]))
    tree = S.Treap(made["height"], made["bits"], np.array(made["level_ends"]), made["below"], made["greatest"])
    asked, weights = np.array([0, 3, 40, 12]), np.array([5, 1, 2, 9])
    scores = Counter()
    for (r, c), v in cells.items():
        for a, w in zip(asked.tolist(), weights.tolist(), strict=True):
            scores[c] += v * w * (r == a)
    want = sorted((-s, c) for c, s in scores.items() if s > 0)[:k]
    assert [(-s, c) for s, c in tree.best(asked, weights, np.arange(1024), k)] == want
