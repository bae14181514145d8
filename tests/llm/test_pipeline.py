"""Every stage of the pipeline against a brute-force version on its own input."""

from collections import Counter

import corpus_pipeline as C
import pytest
import test_exact_dedup
import test_mixing
import test_near_copies
import test_packing
from flowlens.llm import quality


@pytest.fixture(scope="module")
def steps(spark, sf_dir, tmp_path_factory):
    """The input of each stage and, last, the result; each written and read again."""
    folder = tmp_path_factory.mktemp("pipeline")
    docs, out = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for i, (_, stage) in enumerate(C.STAGES):
        out.append(docs)
        stage(spark, docs, sf_dir).write.parquet(str(folder / str(i)))
        docs = spark.read.parquet(str(folder / str(i)))
    return [*out, docs]


def pairs(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def test_columns(steps):
    assert all(s.columns == steps[0].columns for s in steps[:-1])
    assert {"doc_id", "sequence_id", "offset", "length"} <= set(steps[-1].columns)


def test_quality(steps):
    kept = {r["doc_id"] for r in quality.verdicts(steps[0]).where("kept").collect()}
    rows = steps[1].collect()
    texts = dict(pairs(steps[0]))
    assert {r["doc_id"] for r in rows} == kept and 0 < len(kept) < steps[0].count()
    for r in rows:
        lines = Counter(texts[r["doc_id"]].split("\n"))
        assert not Counter(r["text"].split("\n")) - lines and r["n_chars"] == len(r["text"])


def test_exact(steps):
    want = {r[0] for r in test_exact_dedup.brute(pairs(steps[1])) if r[3]}
    assert sorted(i for i, _ in pairs(steps[2])) == sorted(want)


def test_near(steps):
    want = test_near_copies.brute(pairs(steps[2]))
    assert sorted(pairs(steps[3]), key=str) == want and len(want) < steps[2].count()


def test_mix(steps):
    rows, copies = steps[3].collect(), Counter(r["doc_id"] for r in steps[4].collect())
    assert set(copies) <= {r["doc_id"] for r in rows} and max(copies.values()) <= 2
    sizes, taken, largest = Counter(), Counter(), Counter()
    for r in rows:
        n = len(test_mixing.WORD.findall(r["text"]))
        sizes[r["source"]] += n
        taken[r["source"]] += n * copies[r["doc_id"]]
        largest[r["source"]] = max(largest[r["source"]], n)
    want = test_mixing.brute_targets(dict(sizes))
    assert all(abs(taken[s] - want[s]) <= largest[s] / 2 for s in sizes)


def test_packed(steps):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    once = dict(pairs(steps[4]))
    rows = steps[5].collect()
    tokens = {i: len(tokenizer.encode(t, add_special_tokens=False).ids) + 1 for i, t in once.items()}
    assert sum(r["length"] for r in rows) == sum(tokens[i] for i, _ in pairs(steps[4]))
    places = {}
    for r in rows:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in places.values():
        end = 0
        for offset, length in sorted(own):
            assert offset == end
            end += length
        assert end <= 2048
    first = {(r["doc_id"], r["piece"]): r for r in rows}
    test_packing.check([*first.values()], [*once.items()], tokenizer, gapless=False)


def test_odd_tables(spark, edge, empty, tmp_path):
    """Nulls, empty texts, repeated rows, a long text, and an empty table go through every stage."""
    for name, docs in (("edge", edge), ("empty", empty)):
        docs.write.parquet(str(tmp_path / name / "documents.parquet"))
        out = C.run(spark, str(tmp_path / name)).collect()
        assert (len(out) > 0) is (name == "edge")
