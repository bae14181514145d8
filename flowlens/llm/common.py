"""What several training-data operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..workspace import staged

__all__ = ["nested", "once", "parts", "small", "staged", "table", "text_or_empty", "words"]

#: White space that separates words (a fixed value of the contracts): blank, tab, LF, VT, FF, CR.
SPACES = "[ \\t\\n\\x0B\\f\\r]+"
WORD = "[^ \\t\\n\\x0B\\f\\r]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(col: str | Column) -> Column:
    """A null text counts as the empty text."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def words(text: Column) -> Column:
    """The runs of characters that are not white space, in order."""
    return F.filter(F.split(text, SPACES), lambda w: w != "")


def once(df: DataFrame, **cols: Column) -> DataFrame:
    """Add columns that are computed once per row, however often they are read later.

    The optimizer copies the expression of a projected column into each place that reads it, and
    a lambda over an array would then repeat it per element; a generator is not copied.
    """
    made = F.struct(*[c.alias(n) for n, c in cols.items()])
    keep = [F.col(f"`{c}`") for c in df.columns if c not in cols]
    return df.select(*keep, F.inline(F.array(made)))


def parts(rows: int, per_task: int) -> int:
    """So many tasks that none gets more than about ``per_task`` rows."""
    return max(1, -(-rows // per_task))


def small(df: DataFrame, most: int) -> DataFrame:
    """A stored table of at most ``most`` rows as the broadcast side of a join; a larger one is shuffled."""
    return F.broadcast(df) if df.count() <= most else df


def nested(docs: DataFrame, **cols: Column) -> DataFrame:
    """The rows of ``docs`` whole in one column ``row``, beside the named columns: no name can clash."""
    own = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    return docs.select(own.alias("row"), *[c.alias(n) for n, c in cols.items()])
