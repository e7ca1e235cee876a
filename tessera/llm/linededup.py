"""Cross-site boilerplate: lines that many distinct sites share.

The lines' hashes are written once, with their sites and places. A HyperLogLog sketch of the sites of each line is merged
by aggregation. A line whose estimate lies clear of the threshold is decided by it; those near the threshold get an exact
count of distinct sites. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch

#: A line on so many distinct sites or more is boilerplate.
MIN_SITES = 5
#: log2 of the sketch's registers: a standard error of about 1.6 % at 12. Small counts are held exactly.
LG_K = 12
#: Estimates within this share of the threshold are counted exactly: over six standard errors either way.
BAND = 0.2


SPACES = " \t\n\x0b\x0c\r"


def digest(value: Column) -> Column:
    """16 bytes of the SHA-256: among 10^12 lines no two are taken for one."""
    return F.substring(F.unhex(F.sha2(value, 256)), 1, 16)


def lines_of(docs: DataFrame) -> DataFrame:
    """docs(a, b, site, text) as (a, b, site, pos, line): the place and the digest, without white space at its ends, of each
    line that isn't blank."""
    rows = docs.select("a", "b", "site", F.posexplode(F.split("text", "\n")).alias("pos", "raw")).withColumn("bare", F.btrim("raw", F.lit(SPACES)))
    return rows.where("bare <> ''").select("a", "b", "site", "pos", digest(F.col("bare")).alias("line"))


def boilerplate(s: Scratch, lines: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """lines(site, line, ...): the lines on min_sites distinct sites or more; null is no site."""
    lines = lines.where("site is not null").select("site", "line")
    low, high = min_sites * (1 - BAND), min_sites * (1 + BAND)
    sketched = lines.groupBy("line").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", LG_K)).alias("n"))
    sketched = s.table(sketched.where(F.col("n") >= low), "sketched")
    sure = sketched.where(F.col("n") > high).select("line")
    near = sketched.where(F.col("n") <= high).select("line")
    # The distinct pairs of a line and a site are made with map-side combining, so a line on every page costs a row a site and task.
    exact = lines.join(near, "line").select("line", "site").distinct().groupBy("line").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_sites).select("line")
    return s.table(sure.union(exact), "boilerplate")


def dedup(spark: SparkSession, docs: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """docs(doc_id, text, source, ...): a row for each row of docs: (doc_id, n_lines, n_removed, text), where text has lost
    its boilerplate lines.

    Lines are split at \\n; blank ones stay and count in neither number. Null text: no line, and null back. A null source
    is no site, but its lines are removed like any. Repeated rows each keep their row. Other columns are ignored. An empty
    table gives an empty result.
    """
    s = Scratch(spark)
    # a and b name a document; rows that share both have the same text, hence the same lines in the same places.
    rows = docs.select(F.col("doc_id").alias("doc_id"), F.xxhash64("doc_id").alias("a"), digest(F.col("text")).alias("b"), F.col("source").cast("string").alias("site"), F.col("text").alias("text"))
    lines = s.table(lines_of(rows), "lines")
    found = boilerplate(s, lines, min_sites)
    # Of each document that has boilerplate, the places of these lines in order.
    hits = s.table(lines.join(found, "line").groupBy("a", "b").agg(F.array_sort(F.collect_set("pos")).alias("gone")), "hits")
    s.keep("hits")
    df = rows.drop("site").join(hits.hint("shuffle_hash"), ["a", "b"], "left").withColumn("_lines", F.when(F.col("gone").isNotNull(), F.split("text", "\n")))
    # The stretches between two lines that go.
    after = lambda j: F.when(j == 0, 0).otherwise(F.get("gone", j - 1) + 1)
    stretch = lambda j: F.slice("_lines", after(j) + 1, F.coalesce(F.get("gone", j), F.size("_lines")) - after(j))
    left = F.flatten(F.transform(F.sequence(F.lit(0), F.size("gone")), stretch))
    n = F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D][^\n]*")), F.lit(0)).cast("long")
    removed = F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).cast("long")
    text = F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(left, "\n"))
    return df.select("doc_id", n.alias("n_lines"), removed.alias("n_removed"), text.alias("text"))
