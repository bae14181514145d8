import array
import zlib

import pytest
from flowlens.llm import packing as P
from hypothesis import given, settings
from hypothesis import strategies as st


@pytest.fixture(scope="module")
def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


@pytest.fixture(scope="module")
def own():
    return P.ByteTokenizer()


def check(rows, docs, tokenizer, longest=2048, gapless=True):
    """Ids and cuts as the tokenizer gives them; sequences gapless from 0 and not too long."""
    pieces, sequences = {}, {}
    for r in rows:
        pieces.setdefault(r["doc_id"], []).append(r)
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for doc_id, text in docs:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [0]
        at = 0
        for k, r in enumerate(sorted(pieces[doc_id], key=lambda r: r["piece"])):
            assert (r["piece"], r["start"]) == (k, at)
            assert r["ids_crc32"] == zlib.crc32(array.array("I", ids[at:at + r["length"]]).tobytes())
            at += r["length"]
            assert k == 0 or r["length"] == longest
        assert at == len(ids) and (len(ids) > longest or len(pieces[doc_id]) == 1)
    for own in sequences.values() if gapless else ():
        end = 0
        for offset, length in sorted(own):
            assert offset == end
            end += length
        assert end <= longest
    return len(sequences)


def test_documents(docs, texts, tokenizer):
    rows = P.pack_documents(docs).collect()
    n = check(rows, texts, tokenizer)
    assert n <= 1.02 * sum(r["length"] for r in rows) / 2048 + 1


def test_edges(edge, clash, empty, edge_rows, tokenizer):
    rows = P.pack_documents(clash).collect()
    check([r for r in rows if r["doc_id"] == 8 or r["doc_id"] == 9], [r[:2] for r in edge_rows if r[0] in (8, 9)], tokenizer, gapless=False)
    assert sorted(r["doc_id"] for r in rows if r["doc_id"] == 5) == [5, 5]
    assert {r["doc_id"]: r["length"] for r in rows}[1] == 1
    assert P.pack_documents(empty).count() == 0
    assert P.pack_documents(edge).count() == len(rows)


def test_ids_and_sequences(spark, tokenizer):
    df = spark.createDataFrame([(1, "a b c"), (2, None)], "doc_id long, text string")
    pieces = P.pack_documents(df, keep_ids=True)
    got = P.sequences(pieces).collect()
    ids = tokenizer.encode("a b c", add_special_tokens=False).ids + [0]
    assert len(got) == 1 and sorted(got[0]["ids"]) == sorted([*ids, 0])


def test_cut():
    assert list(P.cut(5, 2)) == [(0, 0, 1), (1, 1, 2), (2, 3, 2)]
    assert list(P.cut(4, 2)) == [(0, 0, 2), (1, 2, 2)]
    assert list(P.cut(2, 2)) == [(0, 0, 2)]


@given(st.text(alphabet=" \n\t.,'sabÉ漢1<|>-", max_size=40))
@settings(max_examples=400, deadline=None)
def test_ids(tokenizer, own, text):
    assert own.ids(text) == array.array("I", tokenizer.encode(text, add_special_tokens=False).ids).tobytes()


@given(st.lists(st.integers(1, 50), max_size=200), st.integers(1, 8))
@settings(max_examples=200, deadline=None)
def test_best_fit(lengths, most):
    """Each piece goes to the open bin with the least room that holds it; the fullest closes first."""
    bins, open_bins, n = P.OpenBins(50, most), {}, 0
    for length in lengths:
        b, offset = bins.place(length)
        fit = [f for f in open_bins.values() if f >= length]
        if fit:
            assert open_bins[b] == min(fit)
        else:
            assert b == n
            n += 1
            open_bins[b] = 50
        assert offset == 50 - open_bins[b]
        open_bins[b] -= length
        if not open_bins[b]:
            del open_bins[b]
        if len(open_bins) > most:
            least = min(open_bins.values())
            gone = [k for k in open_bins if k not in {x for level in bins.open for x in level}]
            assert len(gone) == 1 and open_bins.pop(gone[0]) == least
