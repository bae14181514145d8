"""Ranked lexical search over K2-treaps of blocks of documents.

A block of documents is a grid: a row per term, a column per document, and in each cell that holds
something the impact of the term in the document. The grid is stored as a K2-treap: a compressed
quadtree that has, for each quarter that is not empty, one bit with its parent and the greatest
impact in it, as the difference to its parent's. Children are found by counting bits.

A search descends for all its terms together: a range of documents stands for one quadtree cell per
term, namely the cell on the path of the term's row, and the weighted sum of those cells' maxima
bounds every score in the range. Ranges are halved best first, until none that is left can beat the
last of the best documents found; a range of one document has its exact score. Blocks are searched
where they lie, and only each block's best are merged.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import parts, small, staged, text_or_empty

BEST = 10  # documents of an item
BLOCK_DOCS = 1 << 12
BLOCK_CELLS = 1 << 18  # a block closes at so many cells, after a whole document: a few megabytes
AT_ONCE = 128  # ranges that are halved at once
ITEMS_AT_ONCE = 10_000  # items of one pass over the index
BROADCAST_ROWS = 1_000_000
#: A term is a longest run of these (a fixed value of the contract): digits, letters and all beyond ASCII.
TERM = "[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"

#: Bytes of no term become blanks, A-Z become a-z.
_FOLDED = bytes(b + 32 if 65 <= b <= 90 else b if b > 127 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))

INDEX = ("block long, ids array<long>, terms array<string>, df array<int>, height int, bits binary, level_ends array<int>, "
         "below array<int>, greatest int")


def terms_of(text: bytes) -> list[bytes]:
    """The terms in order; what is not ASCII belongs to terms."""
    return text.translate(_FOLDED).split()


def corpus_sizes(docs: DataFrame) -> tuple[int, int]:
    """Documents with a term, and terms with repeats."""
    n = docs.select(F.regexp_count(text_or_empty("text"), F.lit(TERM)).cast("long").alias("n"))
    row = n.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    return row[0], row[1]


def impacts(tf: np.ndarray, n: np.ndarray, documents: int, terms: int) -> np.ndarray:
    """The part of a term's score that depends on the document: in thousandths of a thousandth, saturating."""
    m = 10 + (90 * n * documents) // terms
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


def spread(x: np.ndarray) -> np.ndarray:
    """The bits of 32-bit numbers at the even places of 64-bit ones."""
    x = x.astype(np.uint64)
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        x = (x | (x << np.uint64(shift))) & np.uint64(mask)
    return x


def planted(rows: np.ndarray, columns: np.ndarray, values: np.ndarray) -> dict:
    """The K2-treap of a grid that has at least one cell; each cell comes once.

    Nodes are numbered by level from the root, 0. ``bits`` has four bits per node above the cells: which
    quarters are not empty. The j-th bit that is set leads to node j. ``below``: a node's distance to its
    parent's maximum.
    """
    height = max(1, int(max(rows.max(), columns.max())).bit_length())
    z = spread(rows) << np.uint64(1) | spread(columns)
    order = np.argsort(z)
    keys, maxima = z[order], values[order].astype(np.int64)
    bits, below, counts = [], [], [len(keys)]
    for _ in range(height):
        above = keys >> np.uint64(2)
        first = np.r_[True, above[1:] != above[:-1]]
        parent = np.cumsum(first) - 1
        higher = np.maximum.reduceat(maxima, np.flatnonzero(first))
        own = np.zeros(4 * len(higher), bool)
        own[4 * parent + (keys & np.uint64(3)).astype(np.int64)] = True
        bits.append(own)
        below.append(higher[parent] - maxima)
        keys, maxima = above[first], higher
        counts.append(len(keys))
    return {"height": height, "bits": np.packbits(np.concatenate(bits[::-1])).tobytes(), "level_ends": np.cumsum(counts[::-1]).tolist(),
            "below": np.concatenate(below[::-1]).astype(np.int32), "greatest": int(maxima[0])}


class Treap:
    """A K2-treap as read back: child numbers and maxima of all nodes."""

    def __init__(self, height: int, bits: bytes, level_ends: np.ndarray, below: np.ndarray, greatest: int):
        self.height = height
        inner = int(level_ends[height - 1])
        self.bits = np.unpackbits(np.frombuffer(bits, np.uint8), count=4 * inner).astype(bool)
        self.rank = np.cumsum(self.bits, dtype=np.int32)
        parents = np.flatnonzero(self.bits) // 4
        self.maxima = np.empty(len(below) + 1, np.int64)
        self.maxima[0] = greatest
        for start, end in zip(level_ends[:-1], level_ends[1:], strict=True):
            self.maxima[start:end] = self.maxima[parents[start - 1:end - 1]] - below[start - 1:end - 1]

    def best(self, rows: np.ndarray, weights: np.ndarray, ids: np.ndarray, k: int) -> list[tuple[int, int]]:
        """(score, column) of the k highest scores above zero, equal ones by ``ids`` (distinct ranks of the columns)."""
        nodes, depth, column = np.zeros((1, len(rows)), np.int64), np.zeros(1, np.int64), np.zeros(1, np.int64)
        bound = np.array([(weights * self.maxima[0]).sum()])
        scores, columns, least = np.zeros(0, np.int64), np.zeros(0, np.int64), 1
        while len(bound):
            if len(bound) > AT_ONCE:
                order = np.argpartition(-bound, AT_ONCE)
                now, later = order[:AT_ONCE], order[AT_ONCE:]
            else:
                now, later = np.arange(len(bound)), np.zeros(0, np.int64)
            row_bit = (rows >> (self.height - 1 - depth[now])[:, None]) & 1
            halves = []
            for bit in (0, 1):
                at = 4 * nodes[now] + 2 * row_bit + bit
                there = (nodes[now] >= 0) & self.bits[np.maximum(at, 0)]
                child = np.where(there, self.rank[np.maximum(at, 0)], -1)
                halves.append((child, depth[now] + 1, 2 * column[now] + bit, (self.maxima[child] * there * weights).sum(axis=1)))
            child, deeper, place, sums = (np.concatenate(x) for x in zip(*halves, strict=True))
            whole = (deeper == self.height) & (sums >= least)
            if whole.any():
                scores, columns = np.r_[scores, sums[whole]], np.r_[columns, place[whole]]
                order = np.lexsort((ids[columns], -scores))[:k]
                scores, columns = scores[order], columns[order]
                least = max(1, int(scores[-1])) if len(scores) == k else 1
            open_ = (deeper < self.height) & (sums >= least)
            keep = later[bound[later] >= least]
            nodes, depth = np.concatenate([nodes[keep], child[open_]]), np.r_[depth[keep], deeper[open_]]
            column, bound = np.r_[column[keep], place[open_]], np.r_[bound[keep], sums[open_]]
        return [*zip(scores.tolist(), columns.tolist(), strict=True)]


class Block:
    """The grid of the documents read so far."""

    def __init__(self):
        self.ids: list[int | None] = []
        self.numbers: dict[bytes, int] = {}
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.sizes: list[int] = []
        self.cells = 0

    def add(self, doc_id: int | None, text: bytes) -> None:
        terms = terms_of(text)
        if not terms:
            return
        counts, numbers = Counter(terms), self.numbers
        rows = np.fromiter((numbers.setdefault(t, len(numbers)) for t in counts), np.int64, len(counts))
        self.parts.append((rows, np.fromiter(counts.values(), np.int64, len(counts))))
        self.ids.append(doc_id)
        self.sizes.append(len(terms))
        self.cells += len(counts)

    def row(self, number: int, documents: int, terms: int) -> dict:
        lengths = [len(rows) for rows, _ in self.parts]
        rows, tf = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        columns = np.repeat(np.arange(len(self.ids)), lengths)
        values = impacts(tf, np.repeat(np.array(self.sizes), lengths), documents, terms)
        names = pa.array(list(self.numbers), pa.binary()).cast(pa.string())
        return planted(rows, columns, values) | {"block": number, "ids": self.ids, "terms": names, "df": np.bincount(rows).astype(np.int32)}


def index(docs: DataFrame, documents: int, terms: int) -> DataFrame:
    """A row per block of ``docs`` (doc_id, text), built where the documents are read.

    ``documents`` and ``terms``: see ``corpus_sizes``. Documents without a term are in no block; a null
    doc_id and repeated rows are documents like others; other columns are not read.
    """
    names = [c.split()[0] for c in INDEX.split(", ")]
    types = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.string()), pa.list_(pa.int32()), pa.int32(), pa.binary(),
             pa.list_(pa.int32()), pa.list_(pa.int32()), pa.int32()]

    def column(value, kind: pa.DataType) -> pa.Array:
        if isinstance(value, np.ndarray | pa.Array):
            flat = pa.array(value) if isinstance(value, np.ndarray) else value
            return pa.ListArray.from_arrays(pa.array([0, len(flat)], pa.int32()), flat.cast(kind.value_type))
        return pa.array([value], kind)

    def build(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, block = TaskContext.get().partitionId() << 32, Block()

        def closed() -> pa.RecordBatch:
            row = block.row(number, documents, terms)
            return pa.RecordBatch.from_arrays([column(row[n], t) for n, t in zip(names, types, strict=True)], names=names)

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), strict=True):
                block.add(doc_id, text.as_py())
                if block.cells >= BLOCK_CELLS or len(block.ids) >= BLOCK_DOCS:
                    yield closed()
                    number, block = number + 1, Block()
        if block.ids:
            yield closed()

    return docs.select(F.col("doc_id").cast("long"), text_or_empty("text").alias("text")).mapInArrow(build, INDEX)


def item_terms(items: DataFrame) -> DataFrame:
    """(item_id, term) of ``items`` (item_id, text), each once; rows of one item_id are one item."""
    folded = F.translate(text_or_empty("text"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    found = F.regexp_extract_all(folded, F.lit(TERM), F.lit(0))
    return items.select(F.col("item_id").cast("long"), F.explode(found).alias("term")).distinct()


def weighted(asked: DataFrame, blocks: DataFrame, documents: int) -> DataFrame:
    """(item_id, term, weight) of the stored ``asked`` (item_id, term); terms of no document are left out."""
    names = small(staged(asked.select("term").distinct(), "terms"), BROADCAST_ROWS)
    held = blocks.select(F.explode(F.arrays_zip("terms", "df")).alias("t")).select(F.col("t.terms").alias("term"), F.col("t.df").alias("df"))
    df = held.join(names, "term", "left_semi").groupBy("term").agg(F.sum("df").alias("df"))
    ratio = (2.0 * documents + 2.0) / (2.0 * F.col("df") + 1.0)
    return asked.join(df.select("term", F.floor(1000.0 * F.log(ratio)).alias("weight")), "term").select("item_id", "term", "weight")


def block_best(blocks: DataFrame, asked: list[tuple[int | None, list[str], list[int]]], k: int) -> DataFrame:
    """(item_id, doc_id, score): each block's k best documents for each of ``asked`` (item_id, terms, weights)."""
    every = sorted({t for _, terms, _ in asked for t in terms})
    place = {t: i for i, t in enumerate(every)}
    plan = [(item, np.array([place[t] for t in terms], np.int64), np.array(weights, np.int64)) for item, terms, weights in asked]

    def search(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = pa.array(every, pa.string())
        for batch in batches:
            for i in range(batch.num_rows):
                held = {n: batch.column(n).slice(i, 1) for n in batch.schema.names}
                flat = {n: held[n].flatten() for n in ("ids", "terms", "below", "level_ends")}
                rows_of = pc.fill_null(pc.index_in(wanted, value_set=flat["terms"]), -1).to_numpy().astype(np.int64)
                ids = flat["ids"].to_pylist()
                order = sorted(range(len(ids)), key=lambda j: (ids[j] is None, ids[j] or 0, j))
                by_id = np.empty(len(ids), np.int64)
                by_id[order] = np.arange(len(ids))
                # columns beyond the documents are empty and never reached
                tree = Treap(held["height"][0].as_py(), held["bits"][0].as_py(), flat["level_ends"].to_numpy(), flat["below"].to_numpy(),
                             held["greatest"][0].as_py())
                out: list[tuple] = []
                for item, at, weights in plan:
                    rows = rows_of[at]
                    there = (rows >= 0) & (weights > 0)
                    if there.any():
                        out += [(item, ids[c], s) for s, c in tree.best(rows[there], weights[there], by_id, k)]
                cols = list(zip(*out, strict=True)) or [(), (), ()]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["item_id", "doc_id", "score"])

    return blocks.select("ids", "terms", "height", "bits", "level_ends", "below", "greatest").mapInArrow(search, "item_id long, doc_id long, score long")


def ranked(docs: DataFrame, items: DataFrame, k: int = BEST) -> DataFrame:
    """The k highest-scoring documents of ``docs`` (doc_id, text) for each of ``items`` (item_id, text).

    Returns item_id, rank (from 1), doc_id, score (above 0). Equal scores go by doc_id, null last; a
    document that comes twice is ranked twice. Null texts have no terms; an item without terms, or an empty table,
    has no rows. Other columns are not read.
    """
    documents, terms = corpus_sizes(docs)
    blocks = staged(index(docs, documents, max(1, terms)), "index", rows_a_group=1)
    asked = staged(weighted(staged(item_terms(items), "asked"), blocks, documents), "weighted")
    count = asked.select("item_id").distinct().count()
    slices, found = parts(count, ITEMS_AT_ONCE), None
    for s in range(slices):
        mine = asked.where(F.pmod(F.xxhash64("item_id"), F.lit(slices)) == s) if slices > 1 else asked
        rows = mine.groupBy("item_id").agg(F.collect_list("term").alias("terms"), F.collect_list("weight").alias("weights")).collect()
        own = block_best(blocks, [(r["item_id"], r["terms"], r["weights"]) for r in rows], k)
        found = own if found is None else found.unionByName(own)
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
