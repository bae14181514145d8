"""Byte-level BPE through a table of distinct words.

Texts are split into words in Spark, by the tokenizer's own pattern. What a task reads at a time is a
batch: its words get numbers, and a document is the sequence of its words' numbers. The batches'
distinct words are dealt and sorted by word, so that every word is encoded once, however many documents and
batches have it. The ids go back to the batches by word number, and each document takes those of its
words by position. Ids become text again by a join with the piece of each id.

No text is sent anywhere: only distinct words, their ids, and word numbers.
"""

from __future__ import annotations

import functools
import hashlib
import json
import os
import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty

VOCABULARY = "byte_bpe_50k"
#: White space of the tokenizer's pattern (a fixed value): all of Unicode's.
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: The tokenizer's pattern (a fixed value), with the white space spelled out.
PATTERN = (f"'s|'t|'re|'ve|'m|'ll|'d| ?\\p{{L}}+| ?\\p{{N}}+| ?[^{SPACE}\\p{{L}}\\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
UNASSIGNED = "\\p{Cn}"  # characters that the JVM does not know; the tokenizer may know them as letters


def vocabulary_file(vocabulary: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(f"{vocabulary}.json")


@functools.cache
def special_tokens(vocabulary: str) -> dict[str, int]:
    """Strings that are one token wherever they stand."""
    with open(vocabulary_file(vocabulary), encoding="utf-8") as f:
        return {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}


@functools.cache
def tokenizer(vocabulary: str):
    """The tokenizer of this worker, on one thread."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(vocabulary_file(vocabulary))
    found.no_truncation()
    found.no_padding()
    return found


@functools.cache
def pieces(vocabulary: str) -> list[bytes]:
    """The bytes of each id. In a byte-level vocabulary a letter stands for each byte.

    Bytes that print are their own letters, the others take the letters from 256 on, in order.
    """
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    odd = [b for b in range(256) if b not in prints]
    byte_of = {chr(b): b for b in prints} | {chr(256 + i): b for i, b in enumerate(odd)}
    with open(vocabulary_file(vocabulary), encoding="utf-8") as f:
        entries = json.load(f)["model"]["vocab"]
    special = special_tokens(vocabulary)
    out = [b""] * (1 + max(*entries.values(), *special.values()))
    for piece, i in entries.items():
        out[i] = bytes(byte_of[c] for c in piece)
    for text, i in special.items():
        out[i] = text.encode()
    return out


def split_words(text: Column, specials: Iterable[str]) -> Column:
    """The words of a text, in order: together they are the text. Special strings are words of their own."""
    def words(part: Column) -> Column:
        return F.regexp_extract_all(part, F.lit(PATTERN), F.lit(0))

    quoted = "|".join(re.sub(r"(\W)", r"\\\1", s) for s in sorted(specials, key=len, reverse=True))
    if not quoted:
        return words(text)
    marks = F.regexp_extract_all(text, F.lit(f"({quoted})"), F.lit(0))
    between = F.split(text, quoted, -1)
    mixed = F.flatten(F.transform(between, lambda part, i: F.concat(F.when(i > 0, F.slice(marks, i, 1)).otherwise(F.array().cast("array<string>")), words(part))))
    return F.when(text.rlike(quoted), mixed).otherwise(words(text))


def own_words(text: str, vocabulary: str) -> list[str]:
    """The words of a text by the tokenizer's own splitter, for texts with characters that the JVM does not know."""
    specials = special_tokens(vocabulary)
    marks = "|".join(re.escape(s) for s in sorted(specials, key=len, reverse=True))
    out: list[str] = []
    for part in re.split(f"({marks})", text) if marks else [text]:
        if part in specials:
            out.append(part)
        elif part:
            out += [part[a:b] for _, (a, b) in tokenizer(vocabulary).pre_tokenizer.pre_tokenize_str(part)]
    return out


def with_words(docs: DataFrame, vocabulary: str) -> DataFrame:
    """(doc_id, words, odd): the words of a text, or the text itself where the JVM can't split it."""
    text = text_or_empty("text")
    unknown = text.rlike(UNASSIGNED)
    return docs.select(F.col("doc_id").cast("long"),
                       F.when(unknown, F.array().cast("array<string>")).otherwise(split_words(text, special_tokens(vocabulary))).alias("words"),
                       F.when(unknown, text).alias("odd"))


def numbered(batches: Iterable[pa.RecordBatch], vocabulary: str) -> Iterator[tuple[int, pa.Array, np.ndarray, np.ndarray, pa.Array]]:
    """Of each batch its number, doc_ids, the ends of the documents' words, the words' numbers, and the distinct words."""
    first = TaskContext.get().partitionId() << 32
    for k, batch in enumerate(batches):
        words, odd = batch.column(1), batch.column(2)
        if odd.null_count < len(odd):
            both = zip(words.to_pylist(), odd.to_pylist(), strict=True)
            words = pa.array([w if o is None else own_words(o, vocabulary) for w, o in both], pa.list_(pa.string()))
        coded = words.flatten().dictionary_encode()
        yield first + k, batch.column(0), np.cumsum(pc.list_value_length(words).to_numpy()), coded.indices.to_numpy(), coded.dictionary


def mark(words: pa.Array) -> int:
    """A checksum of a batch's distinct words in order."""
    return zlib.crc32("\0".join(words.to_pylist()).encode())


def pack(numbers: np.ndarray) -> bytes:
    """Numbers below 2^32, compressed: their lowest bytes first, then the next, and so on."""
    import zstandard

    return zstandard.compress(numbers.astype(np.uint32).view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def unpack(packed: bytes) -> np.ndarray:
    import zstandard

    planes = np.frombuffer(zstandard.decompress(packed), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view(np.uint32).ravel()


def distinct_words(rows: DataFrame, vocabulary: str) -> DataFrame:
    """(batch, number, word, mark) of every batch's distinct words; mark: the checksum, with the first word."""
    def words(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, _, _, _, found in numbered(batches, vocabulary):
            marks = np.zeros(len(found), np.int64)
            if len(found):
                marks[0] = mark(found)
            table = pa.table([pa.array(np.full(len(found), batch)), pa.array(np.arange(len(found), dtype=np.int32)), found, pa.array(marks)],
                             names=["batch", "number", "word", "mark"])
            yield from table.to_batches(max_chunksize=50_000)

    return rows.mapInArrow(words, "batch long, number int, word string, mark long")


def word_numbers(rows: DataFrame, vocabulary: str) -> DataFrame:
    """(batch, doc_id, numbers, mark): the word numbers of every document, compressed."""
    def numbers(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, ids, ends, codes, found in numbered(batches, vocabulary):
            out = [pack(codes[a:b]) for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(out), batch)), ids, pa.array(out, pa.binary()), pa.array(np.full(len(out), mark(found)))],
                names=["batch", "doc_id", "numbers", "mark"])

    return rows.mapInArrow(numbers, "batch long, doc_id long, numbers binary, mark long")


def encoded_words(words: DataFrame, vocabulary: str) -> DataFrame:
    """(batch, numbers, counts, ids, mark): ``words`` with their ids, several words of a batch in a row, compressed.

    Equal words come one after the other, and each distinct word is encoded once.
    """
    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[str, list[int]] | None = None  # equal words may lie in two batches
        for rows in batches:
            if not rows.num_rows:
                continue
            coded = rows.column(2).dictionary_encode()
            own = coded.dictionary.to_pylist()
            known = 1 if last and own[0] == last[0] else 0
            ids = ([last[1]] if known else []) + [e.ids for e in tokenizer(vocabulary).encode_batch(own[known:], add_special_tokens=False)]
            last = own[-1], ids[-1]
            order = np.argsort(rows.column(0).to_numpy(), kind="stable")
            batch, number, marks = (rows.column(c).to_numpy()[order] for c in (0, 1, 3))
            lists = pa.array(ids, pa.list_(pa.int32())).take(coded.indices.take(pa.array(order)))
            counts = pc.list_value_length(lists).to_numpy()
            flat, ends = lists.flatten().to_numpy(), np.cumsum(counts)
            starts = np.flatnonzero(np.r_[True, batch[1:] != batch[:-1]]).tolist()
            out = []
            for a, b in zip(starts, [*starts[1:], len(batch)], strict=True):
                out.append((int(batch[a]), pack(number[a:b]), pack(counts[a:b]), pack(flat[ends[a] - counts[a]:ends[b - 1]]), int(marks[a:b].max())))
            cols = zip(*out, strict=True)
            types = (pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["batch", "numbers", "counts", "ids", "mark"])

    dealt = words.repartition("word").sortWithinPartitions("word")
    return dealt.mapInArrow(encode, "batch long, numbers binary, counts binary, ids binary, mark long")


class Assembler:
    """A batch's distinct words by number: their ids and decoded bytes."""

    def __init__(self, words: pa.Table, vocabulary: str):
        none = np.zeros(0, np.uint32)
        self.numbers, self.lengths, flat = (np.concatenate([none, *map(unpack, words.column(c).to_pylist())]).astype(np.int64) for c in ("numbers", "counts", "ids"))
        self.mark = max(words.column("mark").to_pylist(), default=zlib.crc32(b""))
        # the join of ids and pieces: a piece's place is its id
        parts = pa.array(pieces(vocabulary), pa.binary()).take(pa.array(flat)).to_pylist()
        texts = pc.cast(pa.array(flat), pa.string()).to_pylist()
        ends = np.cumsum(self.lengths)
        order = np.argsort(self.numbers)
        spans = [*zip((ends - self.lengths)[order].tolist(), ends[order].tolist(), strict=True)]
        self.numbers, self.lengths = self.numbers[order], self.lengths[order]
        self.ids = [",".join(texts[a:b]) for a, b in spans]
        self.decoded = [b"".join(parts[a:b]) for a, b in spans]

    def check(self, marks: pa.ChunkedArray) -> None:
        if not (self.numbers == np.arange(len(self.numbers))).all() or any(m != self.mark for m in pc.unique(marks).to_pylist()):
            raise ValueError("The documents were read in another order the second time: store them as a table first.")

    def document(self, packed: bytes) -> tuple[int, str, bytes]:
        """Tokens, ids joined by commas, and the decoded bytes of a document's packed word numbers."""
        numbers = unpack(packed)
        at = numbers.tolist()
        return int(self.lengths[numbers].sum()), ",".join(map(self.ids.__getitem__, at)), b"".join(map(self.decoded.__getitem__, at))


def _assembled(docs: DataFrame, vocabulary: str, schema: str, output) -> DataFrame:
    """``output(doc_ids, assembler, packed)`` as a table, for each batch of documents."""
    rows = with_words(docs, vocabulary)

    def assemble(words: pa.Table, documents: pa.Table) -> pa.Table:
        if not documents.num_rows:
            raise ValueError("The documents were read in another order the second time: store them as a table first.")
        own = Assembler(words, vocabulary)
        own.check(documents.column("mark"))
        return output(documents.column("doc_id"), own, documents.column("numbers").to_pylist())

    words = encoded_words(distinct_words(rows, vocabulary), vocabulary).groupBy("batch")
    return words.cogroup(word_numbers(rows, vocabulary).groupBy("batch")).applyInArrow(assemble, schema)


def encoded(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """``docs`` (doc_id, text), a stored table, as doc_id and ids (array).

    A null text is empty and has no ids; null doc_ids and repeated rows stay rows of their own, an empty
    table gives an empty one, other columns are not read. ``docs`` is read twice and must give its rows in
    the same order, as a stored table does; otherwise the job fails.
    """
    def output(doc_ids: pa.ChunkedArray, own: Assembler, packed: list[bytes]) -> pa.Table:
        ids = [[int(x) for x in t.split(",")] if t else [] for _, t, _ in map(own.document, packed)]
        return pa.table([doc_ids, pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return _assembled(docs, vocabulary, "doc_id long, ids array<int>", output)


def decoded(tokens: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """``tokens`` (doc_id, ids), one row per doc_id, as doc_id and text: the ids joined with their pieces.

    The piece table has a row per id of the vocabulary and is broadcast. Ids of no piece are passed over, bytes that are
    no UTF-8 become replacement characters; no ids give the empty text.
    """
    spark = tokens.sparkSession
    table = spark.createDataFrame(list(enumerate(pieces(vocabulary))), "id int, piece binary")
    rows = tokens.select("doc_id", F.posexplode_outer("ids").alias("at", "id"))
    found = rows.join(F.broadcast(table), "id", "left").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("at", F.hex("piece").alias("piece")))).alias("parts"))
    joined = F.unhex(F.array_join(F.transform("parts", lambda p: p["piece"]), ""))
    return found.select("doc_id", F.make_valid_utf8(joined.cast("string")).alias("text"))


def digests(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of the ids joined by commas) and decoded_sha256 of each of ``docs``; see ``encoded``."""
    def output(doc_ids: pa.ChunkedArray, own: Assembler, packed: list[bytes]) -> pa.Table:
        counts, ids, texts = [], [], []
        for n, listed, text in map(own.document, packed):
            counts.append(n)
            ids.append(hashlib.sha256(listed.encode()).hexdigest())
            texts.append(hashlib.sha256(text.decode(errors="replace").encode()).hexdigest())
        return pa.table([doc_ids, pa.array(counts, pa.int64()), pa.array(ids, pa.string()), pa.array(texts, pa.string())],
                        names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return _assembled(docs, vocabulary, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", output)
