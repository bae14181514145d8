"""Periodic runs of words, found by block convolution.

At scale L = 1, 2, 4, ... a document's words (as numbers) are cut into aligned blocks of L words.
A run whose smallest period q is in [L, 2L) and which is at least 4 q long holds a whole block that
comes again q words later, so it is enough to find the distances d in [L, 2L) at which a block's
words come again: the sum of squared differences of block and window is zero there. Those sums are
exact: their cross term is a convolution by number-theoretic transforms modulo two primes. Each
distance found is a seed, from which the stretch of period d is extended word by word.

Two exact rules spare transforms: a block with a word that does not come again within its window
has no such distance, and a block inside a run that is known already repeats at its multiples only.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty

LEAST_WORDS = 6  # length of a run, at least
LEAST_PERIODS = 4  # whole periods in a run, at least
PRIMES = ((998_244_353, 3), (469_762_049, 3))  # fixed values: primes and their primitive roots
BATCH = 1 << 18  # numbers that are transformed at once
STEP = 64  # words that an extension compares first

Run = tuple[int, int, int]  # start, length, period


def _power(base: int, exponents: np.ndarray, prime: int) -> np.ndarray:
    out, factor, left = np.ones(len(exponents), np.uint64), np.uint64(base), exponents.astype(np.uint64)
    modulus = np.uint64(prime)
    while left.any():
        out = np.where(left & np.uint64(1), out * factor % modulus, out)
        factor = factor * factor % modulus
        left >>= np.uint64(1)
    return out


def transformed(rows: np.ndarray, prime: int, root: int, inverse: bool = False) -> np.ndarray:
    """The number-theoretic transform of each row; the rows' length is a power of two."""
    size, modulus = rows.shape[1], np.uint64(prime)
    x, span = rows.astype(np.uint64) % modulus, 1
    x = x.reshape(len(x), size, 1)
    while span < size:  # halves of stride size/(2 span) are joined
        half = x.shape[1] // 2
        turn = pow(root, (prime - 1) // (2 * span), prime)
        turn = pow(turn, -1, prime) if inverse else turn
        even, odd = x[:, :half], x[:, half:] * _power(turn, np.arange(span), prime) % modulus
        x = np.concatenate([(even + odd) % modulus, (even + modulus - odd) % modulus], axis=2)
        span *= 2
    x = x.reshape(len(rows), size)
    return x * np.uint64(pow(size, -1, prime)) % modulus if inverse else x


def mismatches(blocks: np.ndarray, windows: np.ndarray, prime: int, root: int) -> np.ndarray:
    """Modulo ``prime``, the sum of squared differences of each block and its window at the shifts 0 .. L-1.

    A block has L numbers, its window 2 L - 1.
    """
    n, length = blocks.shape
    size, modulus = 2 * length, np.uint64(prime)
    left, right = np.zeros((n, size), np.uint64), np.zeros((n, size), np.uint64)
    left[:, (-np.arange(length)) % size] = blocks  # reversed: the product correlates
    right[:, :2 * length - 1] = windows
    product = transformed(left, prime, root) * transformed(right, prime, root) % modulus
    cross = transformed(product, prime, root, inverse=True)[:, :length]
    own = (blocks.astype(np.uint64) ** 2 % modulus).sum(axis=1, keepdims=True) % modulus
    sums = np.cumsum(np.pad(windows.astype(np.uint64) ** 2 % modulus, ((0, 0), (1, 0))), axis=1)
    theirs = (sums[:, length:] - sums[:, :length]) % modulus
    return (own + theirs + modulus + modulus - 2 * cross % modulus) % modulus


def repeats(codes: np.ndarray, starts: np.ndarray, length: int) -> Iterator[tuple[int, int]]:
    """(start, distance) of the blocks at ``starts`` that come again ``distance`` in [L, 2L) words later."""
    padded = np.concatenate([codes, np.zeros(3 * length, codes.dtype)])  # zero is no word's number
    at_once = max(1, BATCH // (2 * length))
    for i in range(0, len(starts), at_once):
        own = starts[i:i + at_once]
        blocks = padded[own[:, None] + np.arange(length)]
        windows = padded[own[:, None] + length + np.arange(2 * length - 1)]
        zero = np.ones((len(own), length), bool)
        for prime, root in PRIMES:
            zero &= mismatches(blocks, windows, prime, root) == 0
        for row, shift in np.argwhere(zero).tolist():
            yield int(own[row]), length + shift


def extended(codes: np.ndarray, start: int, length: int, distance: int) -> tuple[int, int]:
    """(start, end) of the longest stretch of period ``distance`` around a block that comes again."""
    low, high, step = start, start + length, STEP  # codes[i] == codes[i + distance] for low <= i < high
    while low:
        to = max(0, low - step)
        differ = np.flatnonzero(codes[to:low] != codes[to + distance:low + distance])
        low = to + int(differ[-1]) + 1 if len(differ) else to
        if len(differ):
            break
        step *= 2
    step, last = STEP, len(codes) - distance
    while high < last:
        to = min(last, high + step)
        differ = np.flatnonzero(codes[high:to] != codes[high + distance:to + distance])
        high = high + int(differ[0]) if len(differ) else to
        if len(differ):
            break
        step *= 2
    return low, high + distance


def covering(found: dict[tuple[int, int], int], n: int) -> tuple[np.ndarray, np.ndarray]:
    """For each place the end and the period of the known run that starts there or before and ends last."""
    ends, periods = np.zeros(n, np.int64), np.ones(n, np.int64)
    for (low, high), q in sorted(found.items()):
        ends[low], periods[low] = high, q
    reach = np.maximum.accumulate(ends)
    owner = np.maximum.accumulate(np.where(ends == reach, np.arange(n), 0))
    return reach, periods[owner]


def runs_of(codes: np.ndarray) -> list[Run]:
    """All runs of a sequence of positive numbers, by start and period."""
    n = len(codes)
    if n < LEAST_WORDS:
        return []
    order = np.argsort(codes, kind="stable")
    again = np.full(n, n, np.int64)  # how far the next equal number is
    same = codes[order[1:]] == codes[order[:-1]]
    again[order[:-1][same]] = (order[1:] - order[:-1])[same]
    found: dict[tuple[int, int], int] = {}  # the smallest period of each stretch
    length, farthest = 1, again
    while LEAST_PERIODS * length <= n:
        blocks = np.arange(len(farthest)) * length
        may = (farthest <= 2 * length - 1) & (blocks + 2 * length <= n)
        reach, period = covering(found, n)
        may &= reach[blocks] < blocks + 3 * length
        tried: dict[int, tuple[int, int]] = {}  # the last stretch of each distance
        for start, distance in repeats(codes, blocks[may], length):
            low, high = tried.get(distance, (0, 0))
            if low <= start and start + length + distance <= high:
                continue
            if start + length + distance <= reach[start] and distance % period[start] == 0:
                continue
            low, high = tried[distance] = extended(codes, start, length, distance)
            if high - low >= max(LEAST_WORDS, LEAST_PERIODS * distance):
                found[low, high] = min(distance, found.get((low, high), distance))
        length *= 2
        even = len(farthest) // 2 * 2
        farthest = np.maximum(farthest[:even:2], farthest[1:even:2])
    return sorted((low, high - low, q) for (low, high), q in found.items())


def planted(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The words with the repetition that the number of the document stands for; a null number plants none."""
    n = len(words)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    unit = words[a:a + p]
    return words[:a] + (unit * -(-(n - a) // p))[:n - a]


def numbered(words: list[bytes]) -> np.ndarray:
    """A number from 1 for each word, the same for equal words."""
    numbers: dict[bytes, int] = {}
    return np.fromiter((numbers.setdefault(w, len(numbers) + 1) for w in words), np.int64, len(words))


def collapsed(words: list[bytes], runs: list[Run]) -> list[bytes]:
    """The words without those that come after the first period of a run."""
    if not runs:
        return words
    change = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    kept = np.cumsum(change[:-1]) == 0
    return [w for w, k in zip(words, kept.tolist(), strict=True) if k]


def document_runs(docs: DataFrame, plant: bool = False) -> DataFrame:
    """``docs`` (doc_id, text) as doc_id, runs (start, length, period), collapsed (the text without repeats).

    Words are what stands between white space; a null text has none. Each row is judged for itself,
    where it is read: repeated rows and null ids give a row each, an empty table an empty one, and
    other columns are not read. ``plant``: see ``planted``.
    """
    runs_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def find(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            every, texts = [], []
            ids = batch.column(0).to_pylist()
            for doc_id, text in zip(ids, batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
                words = text.split()  # bytes split at ASCII white space only
                if plant:
                    words = planted(words, doc_id)
                runs = runs_of(numbered(words))
                every.append([dict(zip(("start", "length", "period"), r, strict=True)) for r in runs])
                texts.append(b" ".join(collapsed(words, runs)).decode())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(every, runs_type), pa.array(texts, pa.string())],
                                             names=["doc_id", "runs", "collapsed"])

    rows = docs.select(F.col("doc_id").cast("long"), text_or_empty("text").alias("text"))
    return rows.mapInArrow(find, "doc_id long, runs array<struct<start: long, length: long, period: long>>, collapsed string")


def digests(docs: DataFrame, plant: bool = True) -> DataFrame:
    """Per document the number of runs, the strongest run, and digests of all runs and of the collapsed text."""
    def better(a, b):
        """The sign of a sort: the greater length / period first, then by place."""
        left, right = a["length"] * b["period"], b["length"] * a["period"]
        return (F.when(left > right, -1).when(left < right, 1).when(a["start"] < b["start"], -1).when(a["start"] > b["start"], 1)
                .when(a["period"] < b["period"], -1).otherwise(1))

    best = F.when(F.size("runs") > 0, F.element_at(F.array_sort("runs", better), 1))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    text = F.concat(F.array_join(lines, "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))
    rows = document_runs(docs, plant).withColumn("best", best)
    return rows.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"), F.col("best.length").alias("length"),
        F.col("best.period").alias("period"), F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(text, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
