import re
from itertools import combinations

import corpus_pipeline as C
from flowlens.llm import near_copies as N
from flowlens.llm import simhash as S
from pyspark.sql import functions as F

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    w = [x.lower() for x in WORD.findall(text or "")]
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    """The (doc_id, text) that stay, by comparing all pairs."""
    rows = sorted({(i is None, i or 0, t or "") for i, t in rows})
    sets, root = [shingles(t) for *_, t in rows], list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in combinations(range(len(rows)), 2):
        if rows[i][2] == rows[j][2] or sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
            root[max(find(i), find(j))] = min(find(i), find(j))
    return sorted({(None if unknown else i, t) for k, (unknown, i, t) in enumerate(rows) if find(k) == k}, key=str)


def stage(spark, df):
    return sorted({(r["doc_id"], r["text"] or "") for r in C.near_dedup_stage(spark, df, "").collect()}, key=str)


def edited(n, edits, name=""):
    return " ".join(f"other{name}" if i in edits else f"w{name}{i}" for i in range(n))


def test_stage_on_documents(spark, docs, texts):
    want = brute(texts)
    assert stage(spark, docs) == want and len(want) < len({t for _, t in texts})


def test_stage_on_similar_texts(spark):
    """Chains and groups around the threshold, and a hub whose copies are too far from each other."""
    rows = [(g * 100 + k, edited(100 + 40 * g, {g * 7 % 90 + 9 * j for j in range(k)}, f"{g}x")) for g in range(12) for k in range(6)]
    rows += [(5000 + k, edited(200, {20 * k, 20 * k + 10, 20 * k + 15})) for k in range(10)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows)
    assert stage(spark, df) == want and 12 < len(want) < len(rows) - 12


def test_stage_on_null_ids_and_two_texts(spark):
    copy, alone, other = edited(100, {50}), "a text alone with its words and no copy", "something else that stands once under this number"
    rows = [(1, edited(100, ())), (None, copy), (None, alone), (3, copy), (3, other), (4, ""), (5, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert stage(spark, df) == brute(rows) == sorted([(1, rows[0][1]), (None, alone), (3, other), (4, "")], key=str)


def test_edges(edge, clash, empty, edge_rows):
    def got(df):
        return sorted({(r["doc_id"], r["text"] or "") for r in N.one_of_each(df).collect()}, key=str)

    assert got(edge) == brute([r[:2] for r in edge_rows]) == got(clash)
    assert N.one_of_each(clash).columns == clash.columns and got(empty) == []


def test_simhash_keeps_rows_by_id_and_text(spark):
    """Two null ids of which one is a copy, and one doc_id with a copy and another text."""
    text, alone, other = edited(100, ()), "a text alone with its words and no copy", "something else that stands once under this number"
    df = spark.createDataFrame([(1, text), (None, text.upper()), (None, alone), (3, text.upper()), (3, other)], "doc_id long, text string")
    left = {(r["doc_id"], r["text"]) for r in S.one_of_each(df).collect()}
    assert left == {(1, text), (None, alone), (3, other)}


def test_large_groups_cost_no_squares(spark):
    """A hub with many copies of which some are only near another copy: pairs follow the number of texts."""
    rows = [(k, edited(120, {(7 * k + 13 * j) % 120 for j in range(k % 3 + 1)}, "hub")) for k in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    pairs, plain = [], N.similar

    def counted(found, *rest):
        pairs.append(found.count())
        return plain(found, *rest)

    N.similar = counted
    try:
        assert stage(spark, df) == brute(rows)
    finally:
        N.similar = plain
    assert sum(pairs) < 40 * len(rows)


def test_recall(spark, docs, texts):
    """Of the pairs of a similarity of 0.8 or more, both texts are in one component."""
    rows = N.staged(N.sketches(docs), "sketches")
    roots = {bytes(r["node"]): bytes(r["root"]) for r in S.components(N.links(rows, docs)).collect()}
    of = {r["doc_id"]: bytes(r["digest"]) for r in rows.select("doc_id", "digest").collect()}
    sets = [(i, shingles(t)) for i, t in texts if t]
    near = [(i, j) for (i, a), (j, b) in combinations(sets, 2) if len(a & b) >= 0.8 * len(a | b)]
    met = [of[i] == of[j] or roots.get(of[i], of[i]) == roots.get(of[j], of[j]) for i, j in near]
    assert len(near) > 5 and sum(met) >= 0.99 * len(met)


def test_fingerprints_link_texts(spark):
    """Method (9) is a step of its own: without MinHash keys it links the texts within its distance, after the exact check."""
    rows = [(1, edited(900, ())), (2, edited(900, {899})), (3, edited(900, {0})), (4, edited(900, (), "far")), (5, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sketched = N.staged(N.sketches(docs).withColumn("keys", F.array().cast("array<long>")), "sketches")
    of = {bytes(r["digest"]): r["doc_id"] for r in sketched.collect()}
    points = N.staged(sketched.where("n > 0").select("fingerprint").distinct(), "points")
    assert points.count() == 4 and S.links(points).count() > 0

    def linked(percent):
        return sorted({of[bytes(d)] for r in N.links(sketched, docs, percent=percent).collect() for d in r})

    assert linked(80) == [1, 2, 3] and linked(100) == []
