"""Near-duplicates by SimHash, found through segment popcounts.

A 64-bit fingerprint is cut into 32 segments of two bits, and each segment's bit count is one
coordinate. One differing bit changes one coordinate by at most one, so the Manhattan distance of
two such points is a lower bound of the fingerprints' Hamming distance. The 32 coordinates are
dealt to k // 2 + 1 groups: points within Manhattan distance k agree up to one unit step in at least
one group. A group's coordinates are a grid cell; each point enters its own cell and the cells one
step below it, so two points one step apart meet in the lower one's cell. Pairs that meet are
verified on the fingerprints, inside the join. Equal fingerprints are one point before all that.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import nested, small, staged, text_or_empty

WIDTH = 3  # words of a shingle
MAX_DISTANCE = 3  # differing bits of a link
SEED = 42
SEGMENTS = 32
BLOCK = 65_536  # hashes whose bits are counted at once
BROADCAST_ROWS = 200_000
_LOW = 0x5555555555555555  # the lower bit of each segment

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def shingles(text: bytes, width: int = WIDTH) -> list[bytes]:
    """The runs of ``width`` words, A-Z in lower case, joined by one blank; of fewer words the whole sequence."""
    found = text.translate(_LOWER).split()  # bytes split at ASCII white space only
    if not found:
        return []
    joined = b" ".join(found)
    ends = np.cumsum([len(w) + 1 for w in found]) - 1
    if len(found) <= width:
        return [joined]
    starts = np.r_[0, ends[:-1] + 1]
    return [joined[s:e] for s, e in zip(starts[:len(found) - width + 1].tolist(), ends[width - 1:].tolist(), strict=True)]


def simhash(hashes: np.ndarray) -> int:
    """Bit b is 1 if more than half of the 64-bit hashes have it; of no hashes zero."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), BLOCK):
        part = hashes[at:at + BLOCK].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits((2 * ones > len(hashes)).astype(np.uint8), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(doc_id, fingerprint, digest) of each row; a null text is empty, without words the fingerprint is zero."""
    def compute(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest

        for batch in batches:
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            prints = [simhash(np.array([xxh64_intdigest(s, SEED) for s in shingles(t, width)], np.uint64)) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(prints, np.uint64).view(np.int64)), batch.column(2)],
                                             names=["doc_id", "fingerprint", "digest"])

    text = text_or_empty("text")
    rows = docs.select(F.col("doc_id").cast("long"), text.alias("text"), F.sha2(text, 256).alias("digest"))
    return rows.mapInArrow(compute, "doc_id long, fingerprint long, digest string")


def signed(value: int) -> int:
    """A 64-bit pattern as Spark's signed long."""
    return value - (1 << 64) if value >> 63 else value


def popcounts(fingerprint: Column) -> Column:
    """The bit counts of the 32 segments, two bits each, in the segments' places."""
    low, upper = F.lit(_LOW), F.shiftrightunsigned(fingerprint, 1)
    one = fingerprint.bitwiseXOR(upper).bitwiseAND(low)
    two = fingerprint.bitwiseAND(upper).bitwiseAND(low)
    return one.bitwiseOR(F.shiftleft(two, 1))


def groups_of_segments(distance: int) -> list[range]:
    """distance // 2 + 1 runs of segments: in one of them two points differ by one step at most."""
    n = distance // 2 + 1
    if not 0 <= distance < 64 or n > SEGMENTS:
        raise ValueError("the distance is from 0 to 63")
    return [range(SEGMENTS * g // n, SEGMENTS * (g + 1) // n) for g in range(n)]


def grid(points: DataFrame, distance: int = MAX_DISTANCE) -> DataFrame:
    """Each fingerprint in its cells: (fingerprint, part, cell, below); below: the cell of a lower neighbour."""
    def cells(part: int, segments: range) -> list[Column]:
        mask = sum(3 << (2 * s) for s in segments)
        own = F.col("counts").bitwiseAND(F.lit(signed(mask)))
        made = [F.struct(F.lit(part).alias("part"), own.alias("cell"), F.lit(False).alias("below"))]
        for s in segments if distance else ():
            count = F.shiftrightunsigned("counts", 2 * s).bitwiseAND(F.lit(3))
            step = F.when(count == 1, F.lit(signed(1 << (2 * s)))).otherwise(F.lit(signed(3 << (2 * s))))  # 1 to 0, 2 to 1
            made.append(F.when(count > 0, F.struct(F.lit(part).alias("part"), own.bitwiseXOR(step).alias("cell"), F.lit(True).alias("below"))))
        return made

    every = [c for i, g in enumerate(groups_of_segments(distance)) for c in cells(i, g)]
    return (points.select("fingerprint", popcounts(F.col("fingerprint")).alias("counts"))
            .select("fingerprint", F.explode(F.array(*every)).alias("at")).where(F.col("at").isNotNull())
            .select("fingerprint", "at.part", "at.cell", "at.below"))


def links(points: DataFrame, distance: int = MAX_DISTANCE) -> DataFrame:
    """The pairs (a, b) of distinct fingerprints with at most ``distance`` differing bits; a pair may come twice."""
    placed = grid(points, distance)
    own = placed.where(~F.col("below")).select(F.col("fingerprint").alias("a"), "part", "cell")
    other = placed.select(F.col("fingerprint").alias("b"), F.col("part").alias("part2"), F.col("cell").alias("cell2"), "below")
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance
    met = (F.col("part") == F.col("part2")) & (F.col("cell") == F.col("cell2"))
    return own.join(other, met & (F.col("below") | (F.col("a") < F.col("b"))) & (F.col("a") != F.col("b")) & near).select("a", "b")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of ``edges`` (a, b); root is the component's smallest node.

    Large-star and small-star steps in turn until the edges are stars. Each step joins edges with
    their nodes' smallest neighbours; each round is written to the shared folder.
    """
    def stars(e: DataFrame, large: bool) -> DataFrame:
        if large:
            around = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
            least = around.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
            moved = around.where(F.col("b") > F.col("a")).join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        else:  # a > b in every edge
            least = e.groupBy("a").agg(F.min("b").alias("m"))
            moved = e.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
        return moved.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()

    def mark(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    now = staged(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before, seen = None, mark(now)
    while seen != before and seen[0]:
        now = staged(stars(staged(stars(now, True), "large"), False), "edges")
        before, seen = seen, mark(now)
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))


def fingerprint_roots(rows: DataFrame, distance: int = MAX_DISTANCE) -> DataFrame:
    """(fingerprint, least, root) of the stored rows' fingerprints: their smallest doc_id, their component's smallest fingerprint."""
    points = rows.groupBy("fingerprint").agg(F.min("doc_id").alias("least"))
    points = staged(points, "points")
    roots = components(links(points, distance))
    return points.join(roots, points["fingerprint"] == roots["node"], "left").select(
        "fingerprint", "least", F.coalesce("root", "fingerprint").alias("root"))


def near_groups(docs: DataFrame, width: int = WIDTH, distance: int = MAX_DISTANCE) -> DataFrame:
    """Every row of ``docs`` (doc_id, text) with its fingerprint and component.

    Returns doc_id, fingerprint (16 hexadecimal digits) and component_id, the smallest doc_id that
    links reach; null only where the component has none but null ids. Repeated rows repeat.
    Other columns are not read.
    """
    rows = staged(fingerprints(docs, width).drop("digest"), "simhash")
    rooted = fingerprint_roots(rows, distance)
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    moved = rooted.join(ids, "root").select("fingerprint", "component_id")
    moved = staged(moved, "components")
    return rows.join(moved, "fingerprint").select(
        "doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, width: int = WIDTH, distance: int = MAX_DISTANCE) -> DataFrame:
    """``docs`` with one document of each component, the one with the smallest doc_id; all columns.

    A null doc_id comes last, and of one doc_id with several texts one text stays. Rows that repeat
    a doc_id and a text are one document.
    """
    rows = staged(fingerprints(docs, width), "simhash")
    roots = staged(fingerprint_roots(rows, distance).select("fingerprint", "root"), "roots")
    place = F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "digest")
    rooted = rows.join(roots, "fingerprint").select("root", place.alias("place"))
    several = staged(rooted.groupBy("root").agg(F.min("place").alias("keep"), F.max("place").alias("last"))
                     .where(~F.col("keep").eqNullSafe(F.col("last"))).select("root", "keep"), "several")
    dropped = rooted.join(small(several, BROADCAST_ROWS), "root").where(~F.col("place").eqNullSafe(F.col("keep")))
    dropped = staged(dropped.select(F.col("place.doc_id").alias("dropped_id"), F.col("place.digest").alias("dropped")).distinct(), "near")
    plain = nested(docs, id=F.col("doc_id"), digest=F.sha2(text_or_empty("text"), 256))
    gone = F.col("id").eqNullSafe(F.col("dropped_id")) & (F.col("digest") == F.col("dropped"))
    return plain.join(small(dropped, BROADCAST_ROWS), gone, "left_anti").select("row.*")
