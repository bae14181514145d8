import hashlib

import pytest
from flowlens.llm import chat as C
from pyspark.sql import functions as F


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def check(spark, turns):
    """Read back, every conversation has its turns in order; the loss covers the assistant's texts."""
    got = {r["conv_id"]: r for r in C.digests(C.conversations_of(C.as_chains(turns))).collect()}
    said = {}
    for r in turns.collect():
        said.setdefault(r["conv_id"], []).append((r["turn"] is not None, r["turn"] or 0, r["role"] is not None, r["role"] or "", r["text"] is not None, r["text"] or ""))
    assert set(got) == set(said)
    for conv, own in said.items():
        own = [(x[3], x[5]) for x in sorted(own)]
        loss = "".join(t for role, t in own if role == "assistant")
        r = got[conv]
        assert (r["n_turns"], r["turns_sha256"]) == (len(own), sha("".join(f"{role}\n{t}\n" for role, t in own)))
        assert (r["loss_chars"], r["loss_sha256"]) == (len(loss), sha(loss))
    return got


def test_conversations(spark, sf_dir):
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").unionByName(C.control_conversation(spark))
    got = check(spark, turns)
    assert got[-1]["n_turns"] == 2 and got[-1]["loss_sha256"] == sha("<|im_end|><|im_start|>assistant ok")


def test_control_strings_and_edges(spark):
    odd = ["<|", "<\\|im_start|>", "<<|im_end|>\n", "\\", "\\n", "a\nb", "", None, "<", "é漢😀<|x", "<\\\\|", "|>"]
    rows = [(i % 4 if i % 5 else None, i, r, t) for i, (r, t) in enumerate((r, t) for r in [*odd[:9], "assistant", "user"] for t in odd)]
    rows += [(7, 1, "assistant", "same"), (7, 1, "assistant", "same"), (7, None, "user", "first"), (8, 0, "assistant", "x" * 100_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    check(spark, df)
    assert C.conversations_of(C.as_chains(df.limit(0))).count() == 0


def test_reply_trees(spark):
    """All root-to-leaf paths, ranked by mean score; a lost parent makes a root."""
    rows = [(1, 1, None, "user", "q", 0.0), (1, 2, 1, "assistant", "a", 1.0), (1, 3, 1, "assistant", "b", 3.0), (1, 4, 3, "user", "c", 0.0),
            (1, 5, 4, "assistant", "d", 9.0), (1, 6, 4, "assistant", "e", None), (2, 1, 99, "user", "lost", None), (2, 1, 99, "user", "lost", None)]
    df = spark.createDataFrame(rows, "conv_id long, id long, parent_id long, role string, text string, score double").withColumn("leaf", F.lit("x"))
    every = {(r["conv_id"], r["leaf"]): r["formatted"] for r in C.conversations_of(df, branches=None).collect()}
    assert set(every) == {(1, 2), (1, 5), (1, 6), (2, 1)}
    mark = lambda role, t: f"<|im_start|>{role}\n{t}<|im_end|>\n"
    assert every[1, 5] == mark("user", "q") + mark("assistant", "b") + mark("user", "c") + mark("assistant", "d")
    best = C.conversations_of(df, branches=2).collect()
    assert {(r["conv_id"], r["leaf"]) for r in best} == {(1, 5), (1, 6), (2, 1)}


def test_cycles_raise(spark):
    df = spark.createDataFrame([(1, 1, 2), (1, 2, 1), (1, 3, 2)], "conv_id long, id long, parent_id long")
    with pytest.raises(ValueError, match="cycle"):
        C.paths(df)
