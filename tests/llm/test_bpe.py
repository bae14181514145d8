import hashlib

import public_tokenizers
import pytest
from flowlens.llm import bpe as B
from pyspark.sql import functions as F
from tokenizers import Tokenizer


@pytest.fixture(scope="module")
def whole():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def brute(rows, whole):
    out = []
    for i, text in rows:
        ids = whole.encode(text or "", add_special_tokens=False).ids
        back = whole.decode(ids, skip_special_tokens=False)
        sha = [hashlib.sha256(t.encode()).hexdigest() for t in (",".join(map(str, ids)), back)]
        out.append((i, len(ids), *sha))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in B.digests(df).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()), key=str)


def test_documents(docs, texts, whole):
    assert got(docs) == brute(texts, whole)


def test_edges(edge, clash, empty, edge_rows, whole):
    assert got(edge) == brute([r[:2] for r in edge_rows], whole) == got(clash)
    assert got(empty) == []


ODD = ["<|endoftext|>", "x <|endoftext|>  y", "a  <|endoftext|><|endoftext|>\n\n b", "<|endof<|endoftext|>text|>", "it's we'll 'sx ''re 't", "  lead\t\ttail  ",
       "a  b\x85c 　　d", "12 345٣² Ⅻ", "!!?? --x", "ࡰᲉ new letters \U00010d40 12", "\U0001f600\U0001f468‍\U0001f469 é",
       "￾￿", "a" * 5000, "ab1!" * 3000, " " * 3000, "\n" * 10 + "x", "\r\n\r\n  \r\nq", "กิน हि", "\x00\x01\x7f"]


def test_odd_texts(spark, whole):
    rows = [*enumerate(ODD)]
    assert got(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows, whole)


def test_all_characters(spark, whole):
    """The split in Spark knows every character as the tokenizer does, or leaves the text to it."""
    rows = [(c, f"a{chr(c)}a1{chr(c)}1!{chr(c)}! {chr(c)} ") for c in [*range(0x3100), *range(0xA000, 0xD800, 7), *range(0xE000, 0x20000), *range(0xE0000, 0xE0200)] if c % 3 == 0 or c < 0x3100 or 0xFF00 < c < 0x12000]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    known = B.with_words(df, "byte_bpe_50k").where(F.col("odd").isNull()).collect()
    texts = dict(rows)
    assert len(known) > 20_000
    for r in known:
        assert r["words"] == B.own_words(texts[r["doc_id"]], "byte_bpe_50k"), hex(r["doc_id"])


def test_round_trip(docs, texts, whole):
    """Ids are the tokenizer's, and the join with the pieces gives the texts back."""
    ids = B.encoded(docs)
    want = {i: whole.encode(t or "", add_special_tokens=False).ids for i, t in texts}
    assert {r["doc_id"]: r["ids"] for r in ids.collect()} == want
    assert {r["doc_id"]: r["text"] for r in B.decoded(ids).collect()} == {i: t or "" for i, t in texts}


def test_decode_of_any_ids(spark, whole):
    rows = [(1, [447, 222, 98]), (2, []), (3, [50256, 15496, 50256]), (4, [255, 254])]
    got = {r["doc_id"]: r["text"] for r in B.decoded(spark.createDataFrame(rows, "doc_id long, ids array<int>")).collect()}
    assert got == {i: whole.decode(ids, skip_special_tokens=False) for i, ids in rows}


def test_each_word_is_encoded_once(spark, docs, monkeypatch):
    words = B.encoded_words(B.distinct_words(B.with_words(docs.repartition(4), "byte_bpe_50k"), "byte_bpe_50k"), "byte_bpe_50k")
    plan = words._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning(word") == 1 and "Sort [word" in plan
