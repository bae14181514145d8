"""Line deduplication by content-defined chunks.

A text's lines are cut into clauses, so that long lines have several units as well. The units are
hashed, the lows of a rolling hash of the last units are where chunks end, and so equal runs of
units are cut alike wherever they stand in a text. Chunks of several units that occur at more than
one place of the corpus are compared byte by byte, and each is extended, unit by unit, into those
before and after it that are equal at both places (64-bit hashes of the units). The first place keeps its copy, and the others
lose theirs where the run is long enough. Only hashes are shuffled for all chunks; the texts of those
whose hash repeats are compared by grouping, which combines copies before they are sent. Built-in
functions only.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import once, small, staged, text_or_empty

ROLL = 2  # units in the rolling hash
LEAST_UNITS = 2  # of a chunk
LEAST_WORDS = 30  # of a run that goes, or
LEAST_ENDS = 2  # so many line ends in it
BROADCAST_ROWS = 1_000_000  # hashes of 8 bytes
MARKS = "。！？，；："  # of scripts without blanks
#: A unit ends behind a line end, a mark with a blank, or one of ``MARKS``; the second form leaves out the line end or blank.
UNIT_END = r"(?<=\n)|(?<=[.!?,;:] )"
BETWEEN = r"\n| (?<=[.!?,;:] )"


def split_at(text: Column, pattern: str) -> Column:
    """The text cut at ``pattern`` and behind ``MARKS``, for which only texts that have some are searched."""
    has_marks = reduce(lambda a, b: a | b, [F.contains(text, F.lit(m)) for m in MARKS])
    return F.when(has_marks, F.split(text, rf"{pattern}|(?<=[{MARKS}])(?!\n)")).otherwise(F.split(text, pattern))


def units(text: Column) -> Column:
    """The units of a text in order; put together they are the text."""
    return split_at(text, UNIT_END)


def rolling(hashes: Column, roll: int = ROLL) -> Column:
    """The hash of each unit's hash and those of the ``roll`` - 1 units before it."""
    return F.transform(hashes, lambda h, i: F.xxhash64(h, *[F.get(hashes, i - k) for k in range(1, roll)]))


def chunk_ends(rolled: Column) -> Column:
    """The places of the last units of the chunks: where the rolling hash is lower than its neighbours, and the end.

    Two ends have a unit between them, so only a text's last chunk can be a single unit, and
    where an end lies depends on the few units around it alone.
    """
    last = F.size(rolled) - 1
    lowest = lambda i: (F.get(rolled, i) < F.get(rolled, i - 1)) & (F.get(rolled, i) <= F.get(rolled, i + 1))
    return F.filter(F.sequence(F.lit(0), last), lambda i: (i == last) | F.coalesce(lowest(i), F.lit(False)))


def cut(docs: DataFrame) -> DataFrame:
    """Per row of ``docs`` its doc_id, text_hash, units (without what separates them), their hashes, and the chunks' ends."""
    rows = docs.select("doc_id", text_or_empty("text").alias("text"))
    rows = once(rows, text_hash=F.xxhash64("text"), split=split_at(F.col("text"), BETWEEN))
    rows = once(rows.drop("text"), hashes=F.transform("split", lambda u: F.xxhash64(u)))
    rows = once(rows, rolled=rolling(F.col("hashes")))
    return once(rows, ends=chunk_ends(F.col("rolled"))).drop("rolled")


def each_chunk(rows: DataFrame, least_units: int, **cols: Column) -> DataFrame:
    """A row per chunk of so many units: doc_id, text_hash, chunk (from 0), first (unit), size, chunk_hash and ``cols``.

    ``cols`` are expressions of ``rows``, the chunk's number, and the first units of the chunk before, itself and the next.
    Only what is asked for is in the exploded rows, not the whole text.
    """
    end = lambda c: F.coalesce(F.get("ends", c) + 1, F.lit(0))
    def made(e: Column, c: Column) -> Column:
        first = end(c - 1)
        size = e + 1 - first
        after = F.coalesce(F.get("ends", c + 1) + 1, e + 1)
        known = [f(end(c - 2), first, size, after).alias(n) for n, f in cols.items()]
        hashed = F.xxhash64(F.slice("hashes", first + 1, size))
        return F.when(size >= least_units, F.struct(c.alias("chunk"), first.alias("first"), size.alias("size"), hashed.alias("chunk_hash"), *known))

    listed = F.filter(F.transform("ends", made), lambda x: x.isNotNull())
    return rows.select("doc_id", "text_hash", F.inline(listed))


def chunked(docs: DataFrame, least_units: int = LEAST_UNITS) -> DataFrame:
    """The chunks with their ``units`` and the hashes of the units ``before`` (last first) and ``after`` in the neighbouring chunks."""
    return each_chunk(
        cut(docs), least_units,
        units=lambda earlier, first, size, later: F.slice("split", first + 1, size),
        before=lambda earlier, first, size, later: F.reverse(F.slice("hashes", earlier + 1, first - earlier)),
        after=lambda earlier, first, size, later: F.slice("hashes", first + size + 1, later - first - size))


def alike(a: Column, b: Column) -> Column:
    """How many first elements two lists share."""
    differs = F.array_position(F.zip_with(a, b, lambda x, y: x.eqNullSafe(y)), F.lit(False))
    return F.when(differs == 0, F.size(a)).otherwise(differs - 1).cast("int")


def repeated_spans(docs: DataFrame, least_units: int = LEAST_UNITS) -> DataFrame:
    """The runs of units found at an earlier place: (doc_id, text_hash, start, stop), overlapping ones as one.

    Of equal chunks the one in the smallest doc_id (null first), and there the first, is the
    earlier place. So every unit of a run equals one of a smaller place, and the smallest stays.
    """
    place = F.struct("doc_id", "text_hash", "chunk")
    slim, at = each_chunk(cut(docs), least_units), F.xxhash64("doc_id", "text_hash", "chunk")
    often = slim.groupBy("chunk_hash").agg(F.min(at).alias("a"), F.max(at).alias("b")).where("a <> b").select("chunk_hash")
    found = chunked(docs, least_units).join(small(staged(often, "often"), BROADCAST_ROWS), "chunk_hash", "left_semi")
    found = found.where(F.exists("units", lambda u: u.rlike(r"\S"))).withColumn("sha", F.unhex(F.sha2(F.array_join("units", "\n"), 256)))
    found = staged(found, "chunks")
    groups = found.groupBy("chunk_hash", "sha", "units").agg(F.min(F.struct(place.alias("place"), "before", "after")).alias("keep"), F.max(place).alias("last"))
    groups = staged(groups.where(F.col("keep.place") != F.col("last")).drop("last", "units"), "repeats")
    pairs = found.drop("units").join(groups, ["chunk_hash", "sha"]).where(place != F.col("keep.place"))
    spans = pairs.select("doc_id", "text_hash", (F.col("first") - alike(F.col("before"), F.col("keep.before"))).alias("start"),
                         (F.col("first") + F.col("size") + alike(F.col("after"), F.col("keep.after"))).alias("stop"))
    # spans of a document that meet or overlap are one
    own = Window.partitionBy("doc_id", "text_hash").orderBy("start", "stop")
    reach = F.max("stop").over(own.rowsBetween(Window.unboundedPreceding, -1))
    spans = spans.withColumn("new", F.coalesce(F.col("start") > reach, F.lit(True)).cast("int"))
    spans = spans.withColumn("run", F.sum("new").over(own.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return spans.groupBy("doc_id", "text_hash", "run").agg(F.min("start").alias("start"), F.max("stop").alias("stop")).drop("run")


def deduplicated(docs: DataFrame, least_words: int = LEAST_WORDS, least_ends: int = LEAST_ENDS) -> DataFrame:
    """Every row of ``docs`` (doc_id, text) with the text that stays.

    Repeated runs of at least ``least_words`` words or ``least_ends`` line ends go. Returns doc_id,
    n_lines, removed_units, removed_spans (start and stop, in units) and clean_text. A null text is
    one empty unit. Rows that repeat a doc_id and a text are one place: they lose the same runs.
    Chunks without a visible character stay. Other columns are not read.
    """
    gone = repeated_spans(docs).groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_list(F.struct("start", "stop"))).alias("spans"))
    gone = staged(gone.select(F.col("doc_id").alias("gone_id"), F.col("text_hash").alias("gone_hash"), "spans"), "gone")
    rows = docs.select("doc_id", text_or_empty("text").alias("text"))
    rows = rows.withColumn("text_hash", F.xxhash64("text"))
    rows = rows.join(gone, rows["doc_id"].eqNullSafe(gone["gone_id"]) & (rows["text_hash"] == gone["gone_hash"]), "left")
    none = F.array().cast("array<struct<start:int,stop:int>>")
    rows = once(rows.select("doc_id", "text", F.coalesce("spans", none).alias("spans")), split=F.when(F.size("spans") > 0, units(F.col("text"))).otherwise(F.array("text")),
                n_lines=F.size(F.split("text", "\n")).cast("long"))
    piece = lambda start, stop: F.array_join(F.slice("split", start + 1, stop - start), "")
    told = F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop"), piece(s["start"], s["stop"]).alias("text")))
    long = lambda s: (F.regexp_count(s["text"], F.lit(r"\S+")) >= least_words) | (F.regexp_count(s["text"], F.lit("\n")) >= least_ends)
    rows = once(rows, told=told)
    rows = once(rows.withColumn("told", F.filter("told", long)),
                removed_spans=F.transform("told", lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop")))).drop("told")
    # what stands between the removed spans
    starts = F.concat(F.array(F.lit(0)), F.transform("removed_spans", lambda s: s["stop"]))
    ends = F.concat(F.transform("removed_spans", lambda s: s["start"]), F.array(F.size("split")))
    rows = once(rows, between=F.arrays_zip(starts.alias("s"), ends.alias("e")))
    removed = F.aggregate("removed_spans", F.lit(0), lambda a, s: a + s["stop"] - s["start"])
    return rows.select("doc_id", "n_lines", removed.cast("long").alias("removed_units"), "removed_spans",
                       F.array_join(F.transform("between", lambda b: piece(b["s"], b["e"])), "").alias("clean_text"))


def digests(docs: DataFrame) -> DataFrame:
    """A row per document: doc_id, n_lines, removed_units, clean_chars and the digest of the text that stays."""
    return deduplicated(docs).select("doc_id", "n_lines", "removed_units", F.length("clean_text").cast("long").alias("clean_chars"),
                                     F.sha2("clean_text", 256).alias("clean_sha256"))
