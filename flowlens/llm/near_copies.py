"""Near copies by the Jaccard similarity of their five-word shingles.

Texts are first met by SimHash and segment popcounts (method 9): the texts of a component of fingerprints are
compared with one of them, and those found similar are linked. A similarity of 0.8 is about 10 differing
bits of 64, which a grid reaches only with cells so coarse that candidates grow with the square of the table. So
the texts beyond the fingerprints' distance are met by MinHash: a text has ``BANDS`` keys of ``ROWS`` minima each, and two texts with a
similarity of 0.8 differ in every key with a probability of 7 in 10,000. The texts of a key are not
compared with each other but with one of them, its pivot, at first the one that shares the most
keys. Texts found similar are one component; keys that still hold several components elect a
pivot outside the first one's for another round, until a round finds nothing. So a round costs as
many pairs as texts, however large a group of copies is. Before whole shingle sets are compared, one
bit of each of 256 minima rules out pairs that are far below the similarity.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import nested, small, staged, text_or_empty
from .simhash import MAX_DISTANCE, SEED, components, shingles, simhash
from .simhash import links as fingerprint_links

WIDTH = 5  # words of a shingle
PERCENT = 80  # of the shingles of both texts together that near copies share, at least
BANDS = 24
ROWS = 6
BITS = 256  # minima of which one bit is kept
MAX_BITS = 51  # that may differ: of two texts of similarity 0.8 it is 26 on average, with a standard deviation of 5
BLOCK = 512  # hashes that are permuted at once
SALTS = 64  # tasks that a pivot's texts are dealt to
BROADCAST_ROWS = 1_000_000  # rows of a fixed width of at most 48 bytes

_DRAWN = np.random.default_rng(SEED).integers(0, 2**64, (2, BITS, 1), np.uint64)
_TIMES, _PLUS = _DRAWN[0] | np.uint64(1), _DRAWN[1]


def shingle_hashes(text: bytes, width: int = WIDTH) -> np.ndarray:
    """The distinct 64-bit hashes of the shingles, ascending."""
    from xxhash import xxh64_intdigest

    return np.unique(np.array([xxh64_intdigest(s, SEED) for s in shingles(text, width)], np.uint64))


def sketch(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A key per band, a hash of its number and its minima, and a bit of each minimum as four numbers; no keys of no hashes."""
    if not len(hashes):
        return np.zeros(0, np.uint64), np.zeros(BITS // 64, np.uint64)
    least = np.full(BITS, 2**64 - 1, np.uint64)
    for at in range(0, len(hashes), BLOCK):
        least = np.minimum(least, (_TIMES * hashes[at:at + BLOCK] + _PLUS).min(axis=1))
    out = np.arange(BANDS, dtype=np.uint64)
    for minima in least[:BANDS * ROWS].reshape(BANDS, ROWS).T:
        out = (out ^ minima) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(32)
    mixed = least * np.uint64(0x9E3779B97F4A7C15)
    return out, np.packbits((mixed >> np.uint64(63)).astype(np.uint8)).view(np.uint64)


def lists(values: list[np.ndarray]) -> pa.Array:
    """Unsigned 64-bit values as lists of Spark's longs."""
    ends = np.cumsum([0, *map(len, values)]).astype(np.int32)
    flat = np.concatenate([np.zeros(0, np.uint64), *values]).view(np.int64)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))


def digest() -> Column:
    """16 bytes that stand for a text; a null text is empty."""
    return F.unhex(F.substring(F.sha2(text_or_empty("text"), 256), 1, 32))


def sketches(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """Every row as doc_id, digest, n (distinct shingles), fingerprint (of these), keys and bits."""
    names = ["doc_id", "digest", "n", "fingerprint", "keys", "bits"]

    def compute(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_hashes(t, width) for t in batch.column(2).cast(pa.binary()).to_pylist()]
            drawn = [sketch(s) for s in sets]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([len(s) for s in sets], pa.int64()),
                                              pa.array(np.array([simhash(s) for s in sets], np.uint64).view(np.int64)),
                                              lists([k for k, _ in drawn]), lists([b for _, b in drawn])], names=names)

    rows = docs.select(F.col("doc_id").cast("long"), digest().alias("digest"), text_or_empty("text").alias("text"))
    return rows.mapInArrow(compute, "doc_id long, digest binary, n long, fingerprint long, keys array<long>, bits array<long>")


def shingle_sets(docs: DataFrame, digests: DataFrame, width: int = WIDTH) -> DataFrame:
    """(digest, hashes) of the texts in ``digests`` (digest), each once."""
    def compute(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_hashes(t, width) for t in batch.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), lists(sets)], names=["digest", "hashes"])

    rows = docs.select(digest().alias("digest"), text_or_empty("text").alias("text"))
    wanted = rows.join(small(digests, BROADCAST_ROWS), "digest", "left_semi")
    return wanted.mapInArrow(compute, "digest binary, hashes array<long>").dropDuplicates(["digest"])


def similar(pairs: DataFrame, docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """The pairs (a, b) of the stored ``pairs`` whose shingle sets have the similarity; many a may have one b.

    The sets of all a of a b go to ``SALTS`` tasks, with b's set first in each.
    """
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("digest")).distinct()
    sets = staged(shingle_sets(docs, staged(nodes, "nodes"), width), "sets")
    salted = pairs.withColumn("salt", F.pmod(F.xxhash64("a"), F.lit(SALTS)).cast("int"))
    members = salted.join(sets, F.col("a") == F.col("digest")).select("b", "salt", "a", "hashes")
    pivots = salted.select("b", "salt").distinct().join(sets, F.col("b") == F.col("digest")).select(
        "b", "salt", F.lit(None).cast("binary").alias("a"), "hashes")

    def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(0, np.int64)
        for batch in batches:
            found = []
            for i, (a, b) in enumerate(zip(batch.column(2).to_pylist(), batch.column(0).to_pylist(), strict=True)):
                hashes = batch.column(3)[i].values.to_numpy()
                if a is None:
                    own = np.sort(hashes)
                elif len(own) and len(hashes):
                    at = np.searchsorted(own, hashes)
                    both = int((own[np.minimum(at, len(own) - 1)] == hashes).sum())
                    if 100 * both >= percent * (len(own) + len(hashes) - both):
                        found.append((a, b))
            a, b = zip(*found, strict=True) if found else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["a", "b"])

    dealt = members.unionByName(pivots).repartition("b", "salt").sortWithinPartitions("b", "salt", F.asc_nulls_first("a"))
    return dealt.mapInArrow(compare, "a binary, b binary")


def fingerprint_pairs(rows: DataFrame, percent: int = PERCENT, distance: int = MAX_DISTANCE) -> DataFrame:
    """(a, b): the texts of each component of fingerprints and the one of them that they are compared with."""
    texts = staged(rows.where("n > 0").select("fingerprint", "digest", "n").distinct(), "prints")
    roots = components(fingerprint_links(staged(texts.select("fingerprint").distinct(), "points"), distance))
    rooted = staged(texts.join(roots, texts["fingerprint"] == roots["node"], "left").select(
        F.coalesce("root", "fingerprint").alias("root"), "digest", "n"), "rooted")
    groups = rooted.groupBy("root").agg(F.min(F.struct("digest", "n")).alias("pivot"), F.max("digest").alias("last"))
    several = staged(groups.where("pivot.digest <> last").select("root", "pivot"), "groups")
    b = F.col("pivot")
    near = (F.col("digest") != b["digest"]) & (100 * F.least("n", b["n"]) >= percent * F.greatest("n", b["n"]))
    return rooted.join(small(several, BROADCAST_ROWS), "root").where(near).select(F.col("digest").alias("a"), b["digest"].alias("b"))


def both_ways(pairs: DataFrame) -> DataFrame:
    return pairs.union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))


def links(rows: DataFrame, docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """(a, b): as many pairs of near copies as join their components; ``rows``: the stored sketches of ``docs``."""
    text = F.struct("digest", "n", "bits")
    placed = rows.select(F.explode("keys").alias("key"), text.alias("text"))
    crowds = placed.groupBy("key").agg(F.count("*").alias("crowd"), F.min("text.digest").alias("low"), F.max("text.digest").alias("high"))
    crowds = staged(crowds.where("low <> high").select("key", "crowd"), "crowds")
    members = staged(placed.join(small(crowds, BROADCAST_ROWS), "key"), "members")
    fame = members.groupBy("text.digest").agg(F.sum("crowd").alias("fame"))
    members = staged(members.join(fame, F.col("text.digest") == F.col("digest")).select("key", "text", "fame", "digest"), "famed")

    pairs = staged(fingerprint_pairs(rows, percent), "pairs")
    tried, found = both_ways(pairs), staged(similar(pairs, docs, width, percent), "similar")
    turn, new, roots = 0, found, None
    while True:
        if not new.isEmpty():
            roots = small(staged(components(found), "roots"), BROADCAST_ROWS)
        elif turn > 1:
            return found
        turn += 1
        now = members.withColumn("root", F.col("digest"))
        if roots is not None:
            now = members.join(roots, members["digest"] == roots["node"], "left").select("key", "text", "fame", "digest", F.coalesce("root", "digest").alias("root"))
        if turn == 1:
            first = F.struct("fame", "digest")
        else:
            heads = now.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.max_by("root", F.struct("fame", "digest")).alias("lead"))
            lead = heads.where("low <> high").select("key", "lead")
            now = staged(now.join(small(staged(lead, "open"), BROADCAST_ROWS), "key"), "open_members")
            first = F.struct(F.col("root") != F.col("lead"), F.xxhash64("digest", F.lit(turn)), "digest")
        pivots = staged(now.groupBy("key").agg(F.max_by(F.struct("text", "root"), first).alias("pivot")), "pivots")
        a, b = F.col("text"), F.col("pivot.text")
        differ = sum(F.bit_count(a["bits"][i].bitwiseXOR(b["bits"][i])) for i in range(BITS // 64))
        near = (F.col("root") != F.col("pivot.root")) & (100 * F.least(a["n"], b["n"]) >= percent * F.greatest(a["n"], b["n"])) & (differ <= MAX_BITS)
        pairs = now.join(small(pivots, BROADCAST_ROWS // 4), "key").where(near).select(a["digest"].alias("a"), b["digest"].alias("b")).distinct()
        pairs = staged(pairs.join(tried, ["a", "b"], "left_anti"), "pairs")
        tried = tried.union(both_ways(pairs))
        new = staged(similar(pairs, docs, width, percent), "similar")
        found = found.union(new)


def one_of_each(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """``docs`` with one document of each component of near copies, the one with the smallest doc_id; all columns.

    A null doc_id comes last, and of one doc_id with several texts one text stays. Rows that repeat
    a doc_id and a text are one document.
    """
    rows = staged(sketches(docs, width), "sketches")
    roots = small(staged(components(links(rows, docs, width, percent)), "roots"), BROADCAST_ROWS)
    place = F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "digest")
    rooted = rows.select("doc_id", "digest").join(roots, F.col("digest") == F.col("node"), "left").select(
        F.coalesce("root", "digest").alias("root"), place.alias("place"))
    several = staged(rooted.groupBy("root").agg(F.min("place").alias("keep"), F.max("place").alias("last")).where(~F.col("keep").eqNullSafe(F.col("last")))
                     .select("root", "keep"), "several")
    dropped = rooted.join(small(several, BROADCAST_ROWS), "root").where(~F.col("place").eqNullSafe(F.col("keep")))
    dropped = staged(dropped.select(F.col("place.doc_id").alias("dropped_id"), F.col("place.digest").alias("dropped")).distinct(), "near")
    plain = nested(docs, id=F.col("doc_id").cast("long"), digest=digest())
    gone = F.col("id").eqNullSafe(F.col("dropped_id")) & (F.col("digest") == F.col("dropped"))
    return plain.join(small(dropped, BROADCAST_ROWS), gone, "left_anti").select("row.*")
