"""How far the sources of a language differ in their words: smoothed shares of each term, compared by absolute difference.

DataFrame functions only. Terms are exploded and counted with map-side combining; the kept vocabulary of a language is
crossed with its groups to fill in zeros; a self-join on language and term gives the pairs; windows rank.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, partitions

#: What lies between terms.
BETWEEN = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A term is kept in a language if at least so many of its documents have it.
MIN_DOCS = 30
#: Of the terms that a group has more of than its language, so many are reported.
TOP = 50
#: Shares are in units of one in so many.
UNITS = 1_000_000_000
#: Added to each term's count.
SMOOTH = 5


def share(count: Column, total: Column, kinds: Column) -> Column:
    """1 + floor(UNITS * (count + SMOOTH) / (total + SMOOTH * kinds)), exactly: in decimals, since the product may pass 64 bits."""
    wide = lambda c: c.cast("decimal(20,0)")
    up = (F.lit(UNITS).cast("decimal(10,0)") * (wide(count) + F.lit(SMOOTH))).cast("decimal(38,0)")
    down = (wide(total) + F.lit(SMOOTH) * wide(kinds)).cast("decimal(38,0)")
    return F.lit(1).cast("long") + F.call_function("div", up, down)


def counted(docs: DataFrame) -> DataFrame:
    """docs(text, lang, source, ...): (lang, source, term, n, docs): how often a group's documents have a term, and how many of
    them have it. The term '' only tells that there is such a group."""
    text, lang, source = (F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source"))
    low = F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    rows = docs.select(lang, source, F.split(low, BETWEEN).alias("terms")).withColumn("kinds", F.array_distinct("terms"))
    # Each text's different terms, then all its terms.
    each = rows.select("lang", "source", F.size("kinds").alias("size"), F.posexplode(F.concat("kinds", "terms")).alias("k", "term"))
    again = (F.col("k") >= F.col("size")).cast("long")
    return each.groupBy("lang", "source", "term").agg(F.sum(again).alias("n"), F.sum(1 - again).alias("docs"))


def audit(spark: SparkSession, docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """docs(text, lang, source, ...): (lang, source, part, item, value, rank).

    Part 'pair': item is another source of the language, value the summed difference of the shares of all kept terms. Part
    'term': item is a kept term of which the group has a larger share than its language, value the difference, ranks to
    `top`. Rank is by value, descending, then item by its UTF-8 bytes. Null text, lang and source count as ''. A group
    without terms has shares by smoothing alone; a language that keeps no term has pairs of value 0 and no terms. Repeated
    rows count as often as they stand. Other columns are ignored. An empty table gives an empty result.
    """
    s = Scratch(spark)
    counts = s.table(counted(docs), "counts")
    groups = counts.select("lang", "source").distinct()
    vocabulary = s.table(counts.where("term <> ''").groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("lang_n")).where(F.col("docs") >= min_docs), "vocabulary")
    sizes = vocabulary.groupBy("lang").agg(F.count(F.lit(1)).alias("kinds"), F.sum("lang_n").alias("lang_total"))
    kept = counts.join(vocabulary.select("lang", "term"), ["lang", "term"])
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = groups.join(sizes, "lang", "left").join(totals, ["lang", "source"], "left").select("lang", "source", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("kinds", "lang_total", "total")))
    groups = s.table(groups, "groups")
    # A language's groups and terms meet in as many tasks as there are partitions, not in one.
    salts = partitions(spark)
    salted = vocabulary.select("lang", "term", "lang_n", F.pmod(F.xxhash64("term"), F.lit(salts)).cast("int").alias("salt"))
    dense = groups.where("kinds > 0").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))).join(salted, ["lang", "salt"]).drop("salt")
    dense = dense.join(kept, ["lang", "source", "term"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    dense = dense.select("lang", "source", "term", "n", share(F.col("n"), F.col("total"), F.col("kinds")).alias("p"), share(F.col("lang_n"), F.col("lang_total"), F.col("kinds")).alias("q"))
    dense = s.table(dense, "dense")
    one, two = dense.select("lang", "term", "source", "p"), dense.select("lang", "term", F.col("source").alias("item"), F.col("p").alias("other"))
    # A pair is summed once and read both ways.
    summed = one.join(two, ["lang", "term"]).where("source < item").groupBy("lang", "source", "item").agg(F.sum(F.abs(F.col("p") - F.col("other"))).alias("value"))
    summed = s.table(summed, "pairs")
    bare = groups.where("kinds = 0").select("lang", "source")  # no term is kept, so nothing is summed
    zero = bare.join(bare.select("lang", F.col("source").alias("item")), "lang").where("source <> item").select("lang", "source", "item", F.lit(0).cast("long").alias("value"))
    pairs = summed.union(summed.select("lang", "item", "source", "value")).union(zero).withColumn("part", F.lit("pair"))
    terms = dense.where("n > 0 and p > q").select("lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"), F.lit("term").alias("part"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pairs.withColumn("rank", F.row_number().over(order))
    terms = terms.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    s.keep("pairs", "dense", "groups")
    return pairs.unionByName(terms).select("lang", "source", "part", "item", "value", "rank")
