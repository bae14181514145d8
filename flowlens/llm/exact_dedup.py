"""Exact deduplication by counting quotient filters.

Each task turns its documents' 64-bit fingerprints into counting quotient filters, one per part of the
fingerprints' range, of packed remainders with counters in the slots behind them. Filters of one part merge
without loss by merging their sorted remainders and adding counters, whatever their sizes, so the merged
filter holds the exact count of every fingerprint.
Fingerprints counted more than once route their documents to the comparison of bytes.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import nested, parts, small, staged, text_or_empty

SLICE = 1 << 20  # fingerprints merged by one task, about
LOAD = 0.95  # slots in use, at most, before a filter gets another quotient bit
LEAST_REMAINDER = 8  # bits
PACKED_AT_ONCE = 1 << 16  # slots, a multiple of 8: 4 MB of single bits
BROADCAST_ROWS = 2_000_000  # fingerprints of 8 bytes
BROADCAST_COPIES = 200_000  # (doc_id, SHA-256) of about 100 bytes
FILTER = "bits int, quotient_bits int, slots long, occupied binary, run_ends binary, digits binary, remainders binary"


class Filter(NamedTuple):
    """A counting quotient filter of fingerprints of ``bits`` bits.

    A fingerprint's high ``quotient_bits`` name its home slot, its low bits are the remainder kept there or
    behind. ``occupied`` marks the quotients that have a run, ``run_ends`` each run's last slot; runs lie in the order of
    their quotients, each from its home slot on or right behind the run before it. Within a run remainders ascend. A
    fingerprint counted c > 1 times has c - 1 behind its remainder as digits in slots marked in ``digits``. Slots are packed
    to as many bits as a remainder has. Slots may go on behind the last quotient's.
    """

    bits: int
    quotient_bits: int
    slots: int
    occupied: bytes
    run_ends: bytes
    digits: bytes
    remainders: bytes


Counted = tuple[np.ndarray, np.ndarray]  # ascending different fingerprints, their counts


def pack(values: np.ndarray, bits: int) -> bytes:
    """Unsigned numbers, ``bits`` bits each, highest bit first."""
    parts = []
    for i in range(0, len(values), PACKED_AT_ONCE):
        single = np.unpackbits(values[i:i + PACKED_AT_ONCE].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        parts.append(np.packbits(single[:, 64 - bits:]).tobytes())
    return b"".join(parts)


def unpack(packed: bytes, bits: int, count: int) -> np.ndarray:
    """The numbers that ``pack`` packed."""
    out = np.empty(count, np.uint64)
    for i in range(0, count, PACKED_AT_ONCE):
        n = min(PACKED_AT_ONCE, count - i)
        single = np.unpackbits(np.frombuffer(packed, np.uint8, (n * bits + 7) // 8, i * bits // 8), count=n * bits).reshape(n, bits)
        whole = np.zeros((n, 64), np.uint8)
        whole[:, 64 - bits:] = single
        out[i:i + n] = np.packbits(whole, axis=1).view(">u8")[:, 0]
    return out


def _marks(places: np.ndarray, size: int) -> bytes:
    marked = np.zeros(size, np.uint8)
    marked[places] = 1
    return np.packbits(marked).tobytes()


def _marked(marks: bytes, size: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(marks, np.uint8), count=size).astype(bool)


def encoded(prints: np.ndarray, counts: np.ndarray, bits: int = 64) -> Filter:
    """The filter of ascending different fingerprints below 2**bits and their counts, as large as they need."""
    q = min(max(1, int(len(prints) / LOAD - 1).bit_length()), bits - LEAST_REMAINDER)
    while True:
        r = bits - q
        more = (counts - 1).astype(np.uint64)
        width = np.ones(len(prints), np.int64)  # slots of each fingerprint
        for d in range(0, 64, r):
            width += (more >> np.uint64(d)) > 0
        total = int(width.sum())
        if total <= LOAD * (1 << q) or r <= LEAST_REMAINDER:
            break
        q += 1
    low = np.uint64((1 << r) - 1)
    quotient = (prints >> np.uint64(r)).astype(np.int64)
    number = np.arange(total)
    of_slot = np.repeat(quotient, width)
    place = np.maximum.accumulate(of_slot - number) + number if total else number
    slots = max(1 << q, int(place[-1]) + 1) if total else 1 << q
    first = np.cumsum(width) - width
    values = np.zeros(slots, np.uint64)
    values[place[first]] = prints & low
    digit = np.ones(total, bool)
    digit[first] = False
    for d in range(int(width.max(initial=1)) - 1):
        long = width > d + 1
        values[place[first[long] + 1 + d]] = (more[long] >> np.uint64(d * r)) & low
    last = np.flatnonzero(np.r_[of_slot[1:] != of_slot[:-1], True]) if total else number
    return Filter(bits, q, slots, _marks(quotient, 1 << q), _marks(place[last], slots), _marks(place[digit], slots), pack(values, r))


def decoded(held: Filter) -> Counted:
    """The fingerprints of a filter in ascending order, and their counts."""
    r = held.bits - held.quotient_bits
    home = np.flatnonzero(_marked(held.occupied, 1 << held.quotient_bits))
    if not len(home):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    ends = np.flatnonzero(_marked(held.run_ends, held.slots))
    starts = np.maximum(home, np.r_[0, ends[:-1] + 1])
    length = ends - starts + 1
    begun = np.cumsum(length) - length
    number = np.arange(int(length.sum()))
    place = number + np.repeat(starts - begun, length)
    values, digit = unpack(held.remainders, r, held.slots)[place], _marked(held.digits, held.slots)[place]
    heads = np.flatnonzero(~digit)
    prints = np.repeat(home, length)[heads].astype(np.uint64) << np.uint64(r) | values[heads]
    step = number - np.repeat(heads, np.diff(np.r_[heads, len(number)])) - 1  # of a digit: 0, 1, ...
    parts = np.where(digit, values << (np.where(digit, step, 0) * r).astype(np.uint64), np.uint64(0))
    return prints, np.add.reduceat(parts, heads).astype(np.int64) + 1


def build_filter(prints: np.ndarray, bits: int = 64) -> Filter:
    """The filter of fingerprints in any order, repeats counted."""
    return encoded(*np.unique(prints, return_counts=True), bits)


def merged_counts(a: Counted, b: Counted) -> Counted:
    """Two ascending lists as one, counts of equal fingerprints added."""
    prints = np.concatenate([a[0], b[0]])
    order = np.argsort(prints, kind="stable")  # merges two sorted runs
    prints, counts = prints[order], np.concatenate([a[1], b[1]])[order]
    first = np.flatnonzero(np.r_[True, prints[1:] != prints[:-1]]) if len(prints) else np.empty(0, np.int64)
    return prints[first], np.add.reduceat(counts, first) if len(first) else counts


def merge_filters(filters: list[Filter]) -> Filter:
    """The filter of all inputs, whatever their sizes: runs are read in order, merged by sorted remainders, counters added."""
    held = [decoded(f) for f in filters]
    while len(held) > 1:  # a balanced tree of merges
        held = [merged_counts(held[i], held[i + 1]) if i + 1 < len(held) else held[i] for i in range(0, len(held), 2)]
    return encoded(*held[0], filters[0].bits)


def partition_filters(fingerprints: DataFrame, part_bits: int) -> DataFrame:
    """A row per task and part: the filter of the task's fingerprints whose first ``part_bits`` bits name the part."""
    bits = 64 - part_bits

    def build(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Counted = (np.empty(0, np.uint64), np.empty(0, np.int64))
        fresh, n = [], 0
        for batch in batches:
            fresh.append(batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64))
            n += len(fresh[-1])
            if n >= SLICE:
                own, fresh, n = merged_counts(own, np.unique(np.concatenate(fresh), return_counts=True)), [], 0
        if fresh:
            own = merged_counts(own, np.unique(np.concatenate(fresh), return_counts=True))
        prints, counts = own
        part = (prints >> np.uint64(bits)).astype(np.int64)
        starts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]]) if len(prints) else np.empty(0, np.int64)
        below = np.uint64((1 << bits) - 1)
        for s, e in zip(starts, [*starts[1:], len(prints)], strict=False):
            held = encoded(prints[s:e] & below, counts[s:e], bits)
            yield pa.RecordBatch.from_pylist([{"part": int(part[s]), **held._asdict()}], schema=layout)

    layout = pa.schema([("part", pa.int32()), ("bits", pa.int32()), ("quotient_bits", pa.int32()), ("slots", pa.int64()),
                        *((c, pa.binary()) for c in ("occupied", "run_ends", "digits", "remainders"))])
    return fingerprints.mapInArrow(build, f"part int, {FILTER}")


def merged_repeats(filters: DataFrame, part_bits: int) -> DataFrame:
    """The fingerprints that the merged filters count more than once: (fingerprint, copies).

    A part's filters, one per task at most, come together in one task; fingerprints are uniform, and a
    task's filter holds each of them once, so no part is larger than its share.
    """
    def merge(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        prints, counts = decoded(merge_filters([Filter(*r) for r in rows[list(Filter._fields)].itertuples(index=False)]))
        often = counts > 1
        whole = prints[often] | np.uint64(int(key[0]) << (64 - part_bits))
        return pd.DataFrame({"fingerprint": whole.view(np.int64), "copies": counts[often]})

    return filters.repartition(1 << part_bits, "part").groupBy("part").applyInPandas(merge, "fingerprint long, copies long")


def part_bits(rows: int) -> int:
    """Of the parts that are merged apart: at least eight, each of about ``SLICE`` fingerprints at most."""
    return max(3, (parts(rows, SLICE) - 1).bit_length())


def exact_groups(docs: DataFrame) -> DataFrame:
    """Every row of ``docs`` (doc_id, text) with its group of byte-equal texts.

    Returns doc_id, keep_id (largest doc_id of the group), group_size (its rows), kept and
    text_sha256. A null text is empty. Null doc_ids are less than any other; a group of them
    alone keeps them. Rows that repeat a doc_id and a text are one document: they count as rows
    and are kept or dropped together. Other columns are not read.
    """
    text = text_or_empty("text")
    keyed = docs.select(F.col("doc_id"), text.alias("text"), F.xxhash64(text).alias("fingerprint"))
    rows = staged(keyed.select("doc_id", "fingerprint", F.sha2("text", 256).alias("text_sha256")), "prints")
    bits = part_bits(rows.count())
    repeats = staged(merged_repeats(partition_filters(rows.select("fingerprint"), bits), bits), "repeats")
    often = small(repeats.select("fingerprint"), BROADCAST_ROWS)
    # equal bytes: the text itself is a grouping key; copies combine before they are sent
    groups = (keyed.join(often, "fingerprint", "left_semi")
              .groupBy("fingerprint", "text").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
              .select("fingerprint", F.sha2("text", 256).alias("text_sha256"), "keep_id", "group_size"))
    groups = staged(groups, "groups")
    keep = F.coalesce("keep_id", "doc_id")
    return rows.join(groups, ["fingerprint", "text_sha256"], "left").select(
        "doc_id", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.col("doc_id").eqNullSafe(keep).alias("kept"), "text_sha256")


def drop_copies(docs: DataFrame) -> DataFrame:
    """``docs`` with the row of the largest doc_id of each group of equal texts, all columns."""
    dropped = staged(exact_groups(docs).where(~F.col("kept")).select(
        F.col("doc_id").alias("dropped_id"), F.col("text_sha256").alias("dropped_sha")), "copies")
    rows = nested(docs, id=F.col("doc_id"), sha=F.sha2(text_or_empty("text"), 256))
    same = F.col("id").eqNullSafe(F.col("dropped_id")) & (F.col("sha") == F.col("dropped_sha"))
    return rows.join(small(dropped, BROADCAST_COPIES), same, "left_anti").select("row.*")
