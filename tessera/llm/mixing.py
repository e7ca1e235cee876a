"""Mixing sources to target weights by systematic sampling.

Each document of a source expects the same number of copies, target / size of the source. The expectations are summed
along the source, one random offset is added, and a document is emitted once for each integer boundary that its stretch
crosses. The documents lie in the order of their sizes, so the words taken differ from the target by little more than the
largest document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, numbered

#: By source in the order of code points, null last, repeating.
WEIGHTS = (5.0, 2.0, 1.0)
#: A source gives at most so many times its size.
MOST = 3.0
#: Rows of a small table, one for each source and part, that may be broadcast; a larger one is joined by a shuffle.
BROADCAST_ROWS = 100_000
WORD_GAP = r"[^\x20\x09-\x0D]+"


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_GAP)), F.lit(0)).cast("long")


def targets(s: Scratch, sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, total: float = 1.0, most: float = MOST) -> DataFrame:
    """sizes(source, source_size) with target: `total` of all sizes by weight, at most `most` times the source's size; the
    excess is dealt to the others by weight until none is above.

    The sources stay on the executors, however many they are. Each round finds the share of a weight at which more sources
    come to their limit; a round is an aggregate, and there are as many as there are steps in which sources fill up.
    """
    laid, parts = numbered(s, sizes.withColumn("_none", F.col("source").isNull()), ["_none", "source"], "sources")
    order = F.pmod(F.col("_at") + F.col("_before"), F.lit(len(weights))).cast("int")
    weighted = laid.join(F.broadcast(parts), "_part").select("source", "source_size", F.get(F.array(*map(F.lit, weights)), order).alias("w"), (F.col("source_size") * float(most)).alias("cap"))
    weighted = s.table(weighted, "weighted")
    share, full = 0.0, -1
    while True:
        over = F.col("w") * share > F.col("cap")
        r = weighted.agg(F.sum("source_size").alias("all"), F.sum(F.when(over, F.col("cap"))).alias("taken"), F.sum(F.when(~over, F.col("w"))).alias("w"), F.count_if(over).alias("full")).first()
        if r["full"] == full or not r["w"]:
            break
        share, full = (total * r["all"] - (r["taken"] or 0.0)) / r["w"], r["full"]
    target = F.when(F.col("w") * share > F.col("cap"), F.col("cap")).otherwise(F.col("w") * share)
    return weighted.select("source", "source_size", target.alias("target"))


def offset(source: Column, seed: int) -> Column:
    """A number from 0 to 1 for each source, from a hash."""
    name = F.when(source.isNull(), f"{seed}:n").otherwise(F.concat(F.lit(f"{seed}:s"), source))
    return F.conv(F.substring(F.sha2(name, 256), 1, 12), 16, 10).cast("double") / 2**48


def placed(spark: SparkSession, rows: DataFrame, seed: int, weights: tuple[float, ...], total: float) -> DataFrame:
    """rows(doc_id, source, size, _t, ...) with source_size, target and copies.

    The rows are dealt by range and numbered within each part, in a table in the shared folder; the parts' counts, a row
    for each part and source, are summed. A source that holds most rows thus lies over many tasks.
    """
    s = Scratch(spark)
    laid, _ = numbered(s, rows.withColumn("_h", F.xxhash64("doc_id")), ["source", "size", "_h", "doc_id", "_t"], "laid")
    laid = laid.drop("_h", "_t")
    counts = laid.groupBy("source", "_part").agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("n"), F.min("_at").alias("first"))
    counts = s.table(counts, "counts")
    sizes = s.table(counts.groupBy("source").agg(F.sum("words").alias("source_size")), "sizes")
    mix = targets(s, sizes, weights, total)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    mix = mix.select("source", "source_size", "target", rate.alias("_rate"), offset(F.col("source"), seed).alias("_offset"))
    before = F.sum("n").over(Window.partitionBy("source").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select("source", "_part", (F.coalesce(before, F.lit(0)) - F.col("first")).alias("_shift"))
    starts = s.table(starts.join(mix, starts["source"].eqNullSafe(mix["source"])).drop(mix["source"]), "starts")
    s.keep("laid", "starts")
    if starts.count() <= BROADCAST_ROWS:
        starts = F.broadcast(starts)
    out = laid.join(starts, laid["source"].eqNullSafe(starts["source"]) & (laid["_part"] == starts["_part"])).drop(starts["source"], starts["_part"])
    place = F.col("_at") + F.col("_shift")
    crossed = F.floor((place + 1) * F.col("_rate") + F.col("_offset")) - F.floor(place * F.col("_rate") + F.col("_offset"))
    # Rounding may let one document of a source at the limit cross one boundary more.
    return out.withColumn("copies", F.least(crossed, F.lit(int(MOST))).cast("long")).drop("_at", "_part", "_shift", "_rate", "_offset")


def report(spark: SparkSession, docs: DataFrame, seed: int = 7, weights: tuple[float, ...] = WEIGHTS, total: float = 1.0) -> DataFrame:
    """docs(doc_id, text, source, ...): a row for each row of docs: (doc_id, size, source_size, target, taken, copies).

    size: words in the text; a null text has none. Null is a source of its own, after the others. Repeated rows are each
    dealt with. Equal sizes are in the order of a hash of doc_id, then doc_id, then a hash of the text, so reruns agree.
    Sources without words have a target of 0. Other columns are ignored. An empty table gives an empty result.
    """
    rows = docs.select(F.col("doc_id").alias("doc_id"), F.col("source").cast("string").alias("source"), size_of(F.col("text")).alias("size"), F.xxhash64("text").alias("_t"))
    rows = Scratch(spark).table(rows, "sized")  # dealing by range reads its input twice; words are counted once
    return placed(spark, rows, seed, weights, total).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


def mix(spark: SparkSession, docs: DataFrame, seed: int = 7, weights: tuple[float, ...] = WEIGHTS, total: float = 1.0) -> DataFrame:
    """The rows of docs, each as often as the mix takes it, in docs' columns, which may have any names; cases as above."""
    rows = docs.select(docs["doc_id"].alias("doc_id"), docs["source"].cast("string").alias("source"), size_of(docs["text"]).alias("size"), F.xxhash64(docs["text"]).alias("_t"), F.struct(*(docs[c] for c in docs.columns)).alias("_doc"))
    out = placed(spark, rows, seed, weights, total).where("copies > 0").select("_doc", "copies")
    return out.select("_doc", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("_doc.*")
