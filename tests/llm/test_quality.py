import re

import pytest
from flowlens.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    w = WORD.findall(text)
    lines, seen, dup = text.split("\n"), set(), 0
    for x in lines:
        if WORD.search(x):
            dup += x in seen
            seen.add(x)
    places = {}
    for i in range(len(w) - 4):
        places.setdefault(tuple(w[i:i + 5]), []).append(i)
    covered = {i + k for p in places.values() if len(p) > 1 for i in p for k in range(5)}
    failed = len(w) < 10 or 100 * len(covered) > 20 * len(w)
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(covered), failed)


def test_counts(docs, texts):
    got = {r["doc_id"]: tuple(r)[1:7] for r in quality.verdicts(docs).collect()}
    assert got == {i: brute(t) for i, t in texts}


def test_edges(edge, clash, empty, edge_rows):
    rows = quality.verdicts(edge).collect()
    assert sorted(map(str, rows)) == sorted(map(str, quality.verdicts(clash).collect()))
    assert len(rows) == 10 and quality.verdicts(empty).count() == 0
    want = sorted(str((i, *brute(t))) for i, t, *_ in edge_rows)
    assert sorted(str(tuple(r)[:7]) for r in rows) == want
    assert not any(r["kept"] for r in rows if r["base_failed"])
    assert quality.clean(empty).columns == empty.columns
    assert quality.clean(clash).columns == clash.columns


@pytest.mark.parametrize(("line", "fails"), [
    ("Home | News | About | Contact", True), ("This work is licensed under the GNU General Public License.", True),
    ("SHOUT!! AT!! ALL!!", True), ("Menu", True), ("Yes.", False), ("a plain line of some words without an end", False),
    ("An ordinary sentence, with commas; and an end.", False), ("He said: \"Go!\"", False), ("5 > 3 in a sentence.", False),
])
def test_lines(spark, line, fails):
    from pyspark.sql import functions as F

    assert spark.range(1).select(quality.line_verdict(F.lit(line)).alias("f")).first()["f"]["fails"] is fails


def test_notices_are_no_loss(spark):
    text = "It was a fair day and all went out to see it.\nThis work is licensed under the GNU General Public License, version 3."
    df = spark.createDataFrame([(1, text), (2, text.split("\n")[1] + " " * 3)], "doc_id long, text string")
    assert {r["doc_id"]: r["text"] for r in quality.clean(df).collect()} == {1: text.split("\n")[0]}


def test_line_first(spark):
    body = "This is a proper sentence with enough words to stay in the text."
    nav = "Home | News | About | Contact | Imprint | More"
    df = spark.createDataFrame([(1, f"{body}\n{nav}"), (2, "\n".join([nav + f" | {k}" for k in "abcdefgh"] + ["It is."])), (3, body)], "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in quality.clean(df).collect()}
    assert got == {1: body, 3: body}


def test_clean_documents_stay(spark, sf_dir, docs):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1")
    rows = quality.verdicts(docs).join(labels, "doc_id").where("not base_failed")
    assert rows.where("not kept").count() == 0 < rows.count()
