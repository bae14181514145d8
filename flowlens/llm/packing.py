"""Best-fit packing of tokenised documents into sequences of bounded length.

Documents are tokenised where they are read; only (document, piece, start, length, CRC) rows of a
few bytes go on. Those rows are dealt by hash to as many tasks as their number asks for, and each
task packs its rows by bounded-space best-fit: a fixed number of bins is open, a bitset has a bit
for every free space that some open bin has, the smallest free space that holds the next piece is
its lowest set bit from the piece's length on, and when too many bins are open the fullest closes.
"""

from __future__ import annotations

import array
import base64
import re
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import parts, staged, text_or_empty

MAX_LENGTH = 2048
END = 0  # the id after each document
OPEN_BINS = 65_536  # open bins of a task
PIECES_PER_TASK = 2_000_000
CACHED_WORDS = 250_000  # words whose ids a worker remembers

PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: A blank before white space or the end: the next token is then not simply " word".
_ODD_BLANK = re.compile(r" (?:\s|$)")


class ByteTokenizer:
    """Ids of the public byte-level BPE vocabulary, equal to the ``tokenizers`` file's own.

    A blank before a visible character always begins a token, so a text's ids are those of its
    blank-separated words put together, and the ids of a word are computed once per worker. A
    text that holds a special token, which ``tokenizers`` gives one id, goes through it whole.
    """

    def __init__(self, vocabulary: str = "byte_bpe_50k"):
        import public_tokenizers as public
        import tiktoken

        self.file = public.path(f"{vocabulary}.json")
        with open(public.path(f"{vocabulary}.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        self.bpe = tiktoken.Encoding("public", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.special = "<|endoftext|>"
        self.whole = None
        self.cache: dict[str, bytes] = {}
        self.marks = {mark: self.plain(mark) for mark in ".,"}

    def plain(self, text: str) -> bytes:
        return array.array("I", self.bpe.encode_ordinary(text)).tobytes()

    def word(self, word: str) -> bytes:
        """The ids of a blank and ``word``, whose own characters may be any but blanks."""
        if word.isalpha():
            ids = array.array("I", self.bpe._core_bpe.encode_single_piece(f" {word}".encode())).tobytes()
        elif word[-1:] in self.marks and word[:-1].isalpha():
            head = self.cache.get(word[:-1])
            if head is None:
                head = self.cache[word[:-1]] = self.word(word[:-1])
            ids = head + self.marks[word[-1]]
        else:
            ids = self.plain(f" {word}")
        return ids

    def ids(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit numbers."""
        if self.special in text:
            if self.whole is None:
                from tokenizers import Tokenizer

                self.whole = Tokenizer.from_file(self.file)
            return array.array("I", self.whole.encode(text, add_special_tokens=False).ids).tobytes()
        if _ODD_BLANK.search(text):
            return self.plain(text)
        first, *rest = text.split(" ")
        cache = self.cache
        try:  # most texts have no word that is new
            return b"".join([self.plain(first), *map(cache.__getitem__, rest)])
        except KeyError:
            pass
        if len(cache) > CACHED_WORDS:
            cache.clear()
        for w in rest:
            if w not in cache:
                cache[w] = self.word(w)
        return b"".join([self.plain(first), *map(cache.__getitem__, rest)])


def cut(length: int, longest: int) -> Iterator[tuple[int, int, int]]:
    """(piece, start, length): whole if it fits, else pieces of ``longest`` after a shorter first one."""
    at, piece = 0, 0
    step = length if length <= longest else length % longest or longest
    while at < length:
        yield piece, at, step
        at, piece, step = at + step, piece + 1, longest


def tokenised(docs: DataFrame, longest: int = MAX_LENGTH, vocabulary: str = "byte_bpe_50k", keep_ids: bool = False) -> DataFrame:
    """A row per piece of each document; with ``keep_ids`` also its ids as an array.

    A null text is empty and has the end id alone; a null ``doc_id`` stays null.
    """
    schema = PIECE_SCHEMA + (", ids array<long>" if keep_ids else "")
    names = [c.split()[0] for c in schema.split(", ")]

    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = ByteTokenizer(vocabulary)
        end = array.array("I", [END]).tobytes()
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = tokenizer.ids(text) + end
                for piece, start, length in cut(len(ids) // 4, longest):
                    own = ids[4 * start:4 * (start + length)]
                    rows.append((doc_id, piece, start, length, zlib.crc32(own),
                                 *([array.array("I", own).tolist()] if keep_ids else [])))
            cols = list(zip(*rows, strict=True)) or [[]] * len(names)
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=False)], names=names)

    return docs.select(F.col("doc_id").cast("long"), text_or_empty("text").alias("text")).mapInArrow(encode, schema)


class OpenBins:
    """Bounded-space best-fit: at most ``most`` open bins, found by a bitset over free space."""

    def __init__(self, size: int, most: int, first: int = 0):
        self.size, self.most, self.next = size, most, first
        self.bits = 0
        self.open: list[list[int]] = [[] for _ in range(size + 1)]
        self.count = 0

    def take(self, free: int) -> int:
        bins = self.open[free]
        bin_id = bins.pop()
        if not bins:
            self.bits &= ~(1 << free)
        self.count -= 1
        return bin_id

    def place(self, length: int) -> tuple[int, int]:
        """The bin and the offset in it for a piece of 1 to ``size`` tokens."""
        fits = self.bits >> length
        if fits:
            free = length + (fits & -fits).bit_length() - 1
            bin_id = self.take(free)
        else:
            free, bin_id = self.size, self.next
            self.next += 1
        left = free - length
        if left:
            self.open[left].append(bin_id)
            self.bits |= 1 << left
            self.count += 1
            if self.count > self.most:  # the fullest has the least free space
                self.take((self.bits & -self.bits).bit_length() - 1)
        return bin_id, self.size - free


def packed(pieces: DataFrame, longest: int = MAX_LENGTH, open_bins: int = OPEN_BINS, per_task: int = PIECES_PER_TASK) -> DataFrame:
    """``pieces`` (a stored table) with ``sequence_id`` and ``offset``.

    Pieces arrive in a fixed pseudo-random order, so that long and short ones mix, and in runs of
    ``open_bins`` with the longest first; a task that runs again gives the same result.
    Repeated rows are packed as often as they come.
    """
    rows = pieces.count()
    names = [*pieces.columns, "sequence_id", "offset"]
    schema = ", ".join([*(f"`{n}` {t}" for n, t in pieces.dtypes), "sequence_id long", "offset long"])
    at = pieces.columns.index("length")

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins = OpenBins(longest, open_bins, TaskContext.get().partitionId() << 40)
        for run in runs(batches, open_bins):
            lengths = run.column(at).to_pylist()
            places: list = [None] * len(lengths)
            for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
                places[i] = bins.place(lengths[i])
            ids, offsets = zip(*places, strict=True)
            for part in pa.Table.from_arrays([*run.columns, pa.array(ids, pa.int64()), pa.array(offsets, pa.int64())], names=names).to_batches():
                yield part

    order = F.xxhash64("doc_id", "piece")
    dealt = pieces.repartition(parts(rows, per_task), order).sortWithinPartitions(order, "doc_id", "piece", "start", "length", "ids_crc32")
    return dealt.mapInArrow(pack, schema)


def runs(batches: Iterable[pa.RecordBatch], size: int) -> Iterator[pa.Table]:
    """The rows in tables of about ``size`` rows."""
    held, n = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            n += batch.num_rows
        if n >= size:
            yield pa.Table.from_batches(held)
            held, n = [], 0
    if held:
        yield pa.Table.from_batches(held)


def pack_documents(docs: DataFrame, longest: int = MAX_LENGTH, vocabulary: str = "byte_bpe_50k", keep_ids: bool = False,
                   open_bins: int = OPEN_BINS, per_task: int = PIECES_PER_TASK) -> DataFrame:
    """Tokenise and pack ``docs`` (doc_id, text): a row per piece with its sequence and offset there.

    An empty table gives an empty one; columns besides ``doc_id`` and ``text`` are not read.
    """
    pieces = staged(tokenised(docs, longest, vocabulary, keep_ids), "pieces")
    return packed(pieces, longest, open_bins, per_task)


def sequences(pieces: DataFrame) -> DataFrame:
    """The packed ids of each sequence, from ``pack_documents(..., keep_ids=True)``; a sequence is of bounded length."""
    own = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return pieces.groupBy("sequence_id").agg(F.flatten(F.transform(own, lambda p: p["ids"])).alias("ids"))
