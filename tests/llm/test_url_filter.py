import re

from flowlens.llm import url_filter as U
from pyspark.sql import functions as F

RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]


def brute(url):
    if url is None or "://" not in url:
        host = path = ""
    else:
        rest = url.split("://", 1)[1]
        host = re.split(r"[/?#]", rest)[0]
        path = re.split(r"[?#]", rest[len(host):])[0]
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fit = [(len(h + p), h + p, v) for v, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    rule, verdict = (max(fit)[1:]) if fit else (None, "block" if re.search(U.LISTED, host) else "allow")
    return host, path, rule, verdict


ODD = [None, "", "no host", "http://", "HTTP://A.Example.ORG/es/x?y#z", "http://example.org", "http://example.org?x/es/", "x://b.com/de/#", "x://b.com/fr",
       "x://com/de/", "x://notexample.org/es/", "http://casino.net/a://b/", "http://Ü.example.net/\n/x", "x://ads.net", "x://www.cheap-pills.com/fr/1", "x://y.z?://q.org/"]


def test_pages(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    got = {r["page_id"]: tuple(r)[1:] for r in U.judged(pages).collect()}
    assert got == {r["page_id"]: brute(r["url"]) for r in pages.collect()}


def test_edges(spark):
    df = spark.createDataFrame([(i, u) for i, u in enumerate(ODD)] + [(None, "x://ads.net"), (3, "http://")], "page_id long, url string")
    df = df.withColumn("host", F.lit("clash")).withColumn("verdict", F.lit(1))
    got = sorted(map(str, (tuple(r) for r in U.judged(df).collect())))
    assert got == sorted(str((r["page_id"], *brute(r["url"]))) for r in df.collect())
    assert U.judged(df.limit(0)).count() == 0


def test_cascade_is_exact(spark):
    keys = spark.range(6000).select(F.concat(F.lit("host"), F.col("id")).alias("key"), (F.xxhash64("id") % 5 == 0).alias("listed"))
    cascade = U.build(keys)
    assert len(cascade.levels) >= 2
    assert keys.where(U.member(F.col("key"), cascade) != F.col("listed")).count() == 0
    assert U.build(keys.withColumn("listed", F.lit(False))).levels == []


def test_no_join(spark, sf_dir):
    plan = U.judged(spark.read.parquet(f"{sf_dir}/pages.parquet"))._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan


def test_a_list_beyond_the_filters_is_joined(spark, sf_dir, monkeypatch):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    want = sorted(map(tuple, U.judged(pages).collect()), key=str)
    monkeypatch.setattr(U, "MAX_WORDS", 0)
    assert U.build(spark.createDataFrame([("a", True)], "key string, listed boolean")) is None
    assert sorted(map(tuple, U.judged(pages).collect()), key=str) == want
