"""Sampling and splitting queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import sample as SM
from ..sources import flow_files as FF
from ..workspace import configure
from .views import FEATURES, labelled_flows, table, with_views

MAX_ROWS, BLOCK = 1500, 200
CAPPED = 3000


def _md5(sid: str, suffix: str = "42") -> str:
    return f"md5(CAST({sid} AS VARCHAR) || ':{suffix}')"


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return SM.block_sample(configure(spark), f"{sf_dir}/events.parquet", MAX_ROWS, BLOCK, keep_position=True).select(
        "event_id", "user_id", "row_position")


_BLOCKS = f"""
WITH sizes AS (SELECT CAST(greatest(1, ceil(count(*) / {BLOCK}.0)) AS BIGINT) AS b FROM events),
params AS (SELECT b, least(b, greatest(10, CAST(ceil({MAX_ROWS} / 1000.0) AS BIGINT))) AS s FROM sizes),
chosen AS (SELECT i, CASE WHEN i = s - 1 THEN b - 1 ELSE CAST(floor(i * ((b - 1)::DOUBLE / (s - 1)::DOUBLE)) AS BIGINT) END AS block,
    CAST(ceil({MAX_ROWS}::DOUBLE / s) AS BIGINT) AS per
  FROM params, range(0, 1000000) AS r(i) WHERE i < s),
ranked AS (SELECT event_id, user_id, event_id AS row_position, i, per,
    row_number() OVER (PARTITION BY i ORDER BY {_md5('event_id')}) AS rn
  FROM events JOIN chosen ON event_id // {BLOCK} = block)
SELECT event_id, user_id, row_position FROM ranked
WHERE rn <= per AND rn <= {MAX_ROWS} - i * least(per, {BLOCK})"""


def capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return SM.capped_by_class(labelled_flows(spark, sf_dir), "Label", "sample_id", CAPPED).select("sample_id", "Label")


_CAPPED = with_views(f"""
SELECT sample_id, Label FROM (
  SELECT *, coalesce(sum(kept) OVER (ORDER BY Label ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM (SELECT Label, least(n, {CAPPED} // (count(*) OVER ()) + 1) AS kept FROM (SELECT Label, count(*) AS n FROM labelled_flows GROUP BY Label))
) q JOIN (SELECT sample_id, Label, row_number() OVER (PARTITION BY Label ORDER BY {_md5('sample_id')}) AS rn FROM labelled_flows) r
USING (Label) WHERE rn <= kept AND before + rn <= {CAPPED}""", ["labelled_flows"])


def split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return SM.with_split(labelled_flows(spark, sf_dir), "Label", "sample_id").select("sample_id", "Label", "split")


SPLIT_CTE = {
    "quotas": (("labelled_flows",), """
        SELECT Label, floor_q + CASE WHEN row_number() OVER (ORDER BY rest DESC, Label) <= wanted - sum(floor_q) OVER () THEN 1 ELSE 0 END AS quota
        FROM (SELECT Label, n * wanted // total AS floor_q, n * wanted % total AS rest, wanted FROM (
          SELECT Label, n, CAST(sum(n) OVER () AS BIGINT) AS total, CAST(ceil(0.2::DOUBLE * sum(n) OVER ()) AS BIGINT) AS wanted
          FROM (SELECT Label, count(*) AS n FROM labelled_flows GROUP BY Label)))"""),
    "split": (("labelled_flows", "quotas"), f"""
        SELECT r.*, CASE WHEN rn <= quota THEN 'test' ELSE 'train' END AS split
        FROM (SELECT *, row_number() OVER (PARTITION BY Label ORDER BY {_md5('sample_id')}) AS rn FROM labelled_flows) r JOIN quotas USING (Label)"""),
}


def single_row_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A class with one row makes the split unstratified."""
    rows = labelled_flows(spark, sf_dir).withColumn(
        "Label", F.when(F.col("sample_id") == 1, "Heartbleed").otherwise(F.col("Label")))
    return SM.with_split(rows, "Label", "sample_id").select("sample_id", "split")


def _draws_sql(kind: str, count: int) -> str:
    cond = "is_attack = 1" if kind == "attack" else "is_attack = 0"
    draws = " UNION ALL ".join(
        f"SELECT * FROM (SELECT {i} AS draw, sample_id, {', '.join(FEATURES)} FROM labelled_flows WHERE {cond} "
        f"ORDER BY {_md5('sample_id', f'42:{i}')} LIMIT 1)" for i in range(1, count + 1))
    return with_views(draws, ["labelled_flows"])


def draws(kind: str, count: int):
    return lambda s, d: SM.bootstrap(labelled_flows(s, d), "Label", "sample_id", kind, count).select("draw", "sample_id", *FEATURES)


Q: dict[str, tuple] = {
    "d1_s4_block_sample": (blocks, _BLOCKS),
    "d2_head": (lambda s, d: SM.head(table(s, d, "events"), "event_id", 250).select("event_id", "user_id"),
                "SELECT event_id, user_id FROM events ORDER BY event_id LIMIT 250"),
    "d3_class_cap": (capped, _CAPPED),
    "d4_stratified_split": (split, with_views("SELECT sample_id, Label, split FROM split", ["split"], SPLIT_CTE)),
    "d4_unstratified_split": (single_row_class, with_views(f"""
        SELECT sample_id, CASE WHEN row_number() OVER (ORDER BY {_md5('sample_id')}) <= (SELECT CAST(ceil(0.2::DOUBLE * count(*)) AS BIGINT)
          FROM labelled_flows) THEN 'test' ELSE 'train' END AS split FROM labelled_flows""", ["labelled_flows"])),
    "d5_bootstrap_attack": (draws("attack", 5), _draws_sql("attack", 5)),
    "d5_bootstrap_benign": (draws("benign", 25), _draws_sql("benign", 25)),
    "d6_held_out_examples": (
        lambda s, d: SM.held_out_examples(
            SM.with_split(labelled_flows(s, d), "Label", "sample_id").filter("split = 'test'"), "Label", "sample_id"
        ).select("expected_attack", "sample_id", *FEATURES, "Label"),
        with_views(f"""SELECT is_attack = 1 AS expected_attack, sample_id, {', '.join(FEATURES)}, Label FROM (
          SELECT *, row_number() OVER (PARTITION BY is_attack ORDER BY sample_id) AS place FROM split WHERE split = 'test')
          WHERE place = 1""", ["split"], SPLIT_CTE)),
    "s4_load_parquet": (
        lambda s, d: FF.load_table(configure(s), f"{d}/events.parquet", 5_000).select("event_id", "user_id", "value"),
        f"""WITH n AS (SELECT CAST(ceil(count(*) / 10000.0) AS BIGINT) AS b FROM events),
          p AS (SELECT b, least(b, 10) AS s FROM n),
          chosen AS (SELECT i, s, CASE WHEN i = s - 1 THEN b - 1 ELSE CAST(floor(i * ((b - 1)::DOUBLE / (s - 1)::DOUBLE)) AS BIGINT) END AS block
            FROM p, range(0, 1000) AS r(i) WHERE i < s)
          SELECT event_id, user_id, value FROM (SELECT *, row_number() OVER (PARTITION BY event_id // 10000 ORDER BY {_md5('event_id')}) AS rn
            FROM events) JOIN chosen ON event_id // 10000 = block
          WHERE rn <= ceil(5000.0 / s) AND rn <= 5000 - i * least(CAST(ceil(5000.0 / s) AS BIGINT), 10000)"""),
}
