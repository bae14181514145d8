"""URL rules, and a Bloom filter cascade for the block list.

The cascade's first filter holds the listed keys; the second the keys of the corpus that the first
takes for listed though they are not; the third the listed keys that the second takes; and so on
until a filter takes no wrong key. Since the false positives are those of the complete key universe,
walking down the filters answers membership exactly for every key of the corpus, as an expression
on the row: the filters come as scalar subqueries, nothing is joined. Built-in functions only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged

BITS_PER_KEY = 10
HASHES = 4
MAX_WORDS = 8_000_000  # of 64 bits: the largest filter that is sent to all tasks

# The rules (verdict, host, path) and the words of listed hosts.
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
LISTED = r"(^|[.-])(adult|casino|pills?|bets?|ads|spam|porn|xxx|viagra|payday)([.-]|$)"

_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    """After the first "://" up to a slash, question mark, number sign or the end, A-Z in lower case; else empty."""
    host = F.coalesce(F.regexp_extract(url, _URL, 1), F.lit(""))
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """After the host up to a question mark, number sign or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def longest_rule(host: Column, path: Column, rules=RULES) -> Column:
    """The rule (rule, verdict) with the longest text that fits the host or a parent domain, and the path's start; else null."""
    fitting = [F.when(((host == h) | host.endswith(f".{h}")) & path.startswith(p),
                      F.struct(F.lit(len(h + p)).alias("length"), F.lit(h + p).alias("rule"), F.lit(v).alias("verdict"))) for v, h, p in rules]
    return F.array_max(F.array(*fitting))


@dataclass
class Cascade:
    """The filters from the first level on: (stored words, number of bits) each."""

    levels: list[tuple[DataFrame, int]]


def positions(key: Column, level: int, bits: int) -> list[Column]:
    return [F.pmod(F.xxhash64(F.lit(level), F.lit(i), key), F.lit(bits)) for i in range(HASHES)]


def bloom(keys: DataFrame, level: int, bits: int) -> DataFrame:
    """The filter of a column ``key`` as a stored row: its 64-bit words in order."""
    at = keys.select(F.explode(F.array(*positions(F.col("key"), level, bits))).alias("at"))
    one = F.expr("shiftleft(1L, cast(at % 64 as int))")
    words = at.select((F.col("at") / 64).cast("long").alias("word"), one.alias("bits"))
    every = keys.sparkSession.range(bits // 64).select(F.col("id").alias("word"), F.lit(0).cast("long").alias("bits"))
    full = words.groupBy("word").agg(F.bit_or("bits").alias("bits")).union(every).groupBy("word").agg(F.bit_or("bits").alias("bits"))
    return staged(full.agg(F.transform(F.array_sort(F.collect_list(F.struct("word", "bits"))), lambda w: w["bits"]).alias("words")), "bloom")


def taken(key: Column, level: int, stored: DataFrame, bits: int) -> Column:
    """Whether the filter has all bits of the key."""
    words = stored.scalar()
    test = F.lit(True)
    for at in positions(key, level, bits):
        word = F.get(words, F.floor(at / 64).cast("int"))
        test = test & (F.getbit(word, (at % 64).cast("int")) == 1)
    return test


def build(universe: DataFrame) -> Cascade | None:
    """The cascade over a stored table of distinct keys (key, listed); None where a filter would be above ``MAX_WORDS``.

    Every level stores about the share of wrong keys of the one before, so a few levels suffice.
    Without listed keys there are no levels, and nothing is a member.
    """
    inside, outside = universe.where("listed").select("key"), universe.where("not listed").select("key")
    levels: list[tuple[DataFrame, int]] = []
    n = inside.count()
    while n:
        words = -(-BITS_PER_KEY * n // 64) + 1
        if words > MAX_WORDS:
            return None
        level = len(levels)
        stored = bloom(inside, level, 64 * words)
        levels.append((stored, 64 * words))
        wrong = staged(outside.where(taken(F.col("key"), level, stored, 64 * words)), "wrong")
        inside, outside, n = wrong, inside, wrong.count()
    return Cascade(levels)


def member(key: Column, cascade: Cascade) -> Column:
    """Whether a key of the universe is listed: the first level that does not take it decides."""
    answer = F.lit(len(cascade.levels) % 2 == 1)
    for level in reversed(range(len(cascade.levels))):
        stored, bits = cascade.levels[level]
        answer = F.when(taken(key, level, stored, bits), answer).otherwise(F.lit(level % 2 == 1))
    return answer


def judged(pages: DataFrame, listed: str = LISTED, rules=RULES) -> DataFrame:
    """Every row of ``pages`` (page_id, url) with host, path, rule and verdict.

    The longest fitting rule decides; other pages are blocked if their host is on the block list,
    the hosts of the corpus with a word of ``listed``. A null url, or one without "://", has an empty
    host and path, no rule, and is allowed. Rows are judged one by one; other columns are not read.
    A list too long for filters that every task can hold is joined instead.
    """
    parts = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    universe = staged(parts.select(F.col("host").alias("key")).distinct().withColumn("listed", F.col("key").rlike(listed)), "hosts")
    cascade = build(universe)
    ruled = parts.withColumn("fit", longest_rule(F.col("host"), F.col("path"), rules))
    if cascade is None:
        ruled = ruled.join(universe.where("listed"), F.col("host") == F.col("key"), "left")
        on_list = F.coalesce("listed", F.lit(False))
    else:
        on_list = member(F.col("host"), cascade)
    own = F.when(on_list, "block").otherwise("allow")
    return ruled.select("page_id", "host", "path", F.col("fit.rule").alias("rule"), F.coalesce("fit.verdict", own).alias("verdict"))
