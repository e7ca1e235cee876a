"""Metrics of boundaries and chunks: joins, two-level aggregates, comparisons."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ranges import stab


def greedy_matches(pred):
    """pred: a document's positions in order, each with lo and hi, the number of gold positions before its reach and up to its
    end. How many find an unused gold one in reach: each takes the first that is left. A fold whose state is the next free
    place in gold."""
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit(0).cast("long").alias("n"))

    def step(a, p):
        at = F.greatest(a["at"], p["lo"])
        return F.when(at < p["hi"], F.struct((at + 1).alias("at"), (a["n"] + 1).alias("n"))).otherwise(F.struct(at.alias("at"), a["n"].alias("n")))

    return F.aggregate(pred, start, step, lambda a: a["n"])


def boundary_prf(pred: DataFrame, gold: DataFrame, docs: DataFrame, tol: int = 3) -> DataFrame:
    """pred(doc_id, pos), gold(doc_id, pos): precision, recall and F1 of each document of docs. Both empty: 1; one: 0."""
    marks = pred.select("doc_id", F.col("pos").cast("long").alias("pos"), F.lit(False).alias("gold")).union(gold.select("doc_id", F.col("pos").cast("long"), F.lit(True))).distinct()
    w = Window.partitionBy("doc_id").orderBy("pos")
    upto = lambda k: F.count_if("gold").over(w.rangeBetween(Window.unboundedPreceding, k))
    marks = marks.withColumns({"lo": upto(-tol - 1), "hi": upto(tol)})
    tally = marks.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.when(~F.col("gold"), F.struct("pos", "lo", "hi")))).alias("p"), F.count_if("gold").alias("n_gold"))
    df = docs.select("doc_id").join(tally, "doc_id", "left")
    df = df.select("doc_id", F.coalesce(F.when(F.col("p").isNotNull(), F.size("p")), F.lit(0)).cast("long").alias("n_pred"), F.coalesce("n_gold", F.lit(0)).alias("n_gold"), F.coalesce(greedy_matches(F.col("p")), F.lit(0)).alias("tp"))
    both = (F.col("n_pred") == 0) & (F.col("n_gold") == 0)
    ratio = lambda n: F.when(both, 1.0).otherwise(F.coalesce(F.try_divide("tp", n), F.lit(0.0)))
    df = df.withColumns({"precision": ratio("n_pred"), "recall": ratio("n_gold")})
    total = F.col("precision") + F.col("recall")
    return df.withColumn("f1", F.when(total > 0, 2 * F.col("precision") * F.col("recall") / total).otherwise(0.0))


def doc_metrics(chunks: DataFrame, least: int = 100, most: int = 2500) -> DataFrame:
    """chunks(doc_id, chunk_no, text): counts and sizes of each document's chunks. frag: the share of later chunks that start
    in lower case and are longer than 2."""
    n = F.length("text")
    low = F.substring("text", 1, 1).rlike(r"\p{javaLowerCase}") & (n > 2)
    return chunks.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n_chunks"),
        F.percentile(n, F.lit(0.5)).alias("median"),
        F.percentile(n, F.lit(0.95)).alias("p95"),
        F.coalesce(F.avg(F.when(F.col("chunk_no") > 0, low.cast("double"))), F.lit(0.0)).alias("frag"),
        F.avg((n > most).cast("double")).alias("over"),
        F.avg((n < least).cast("double")).alias("tiny"),
    )


def bucket_metrics(per_doc: DataFrame, bucket: str) -> DataFrame:
    """Means over the documents of a bucket; NaN counts as no value."""
    cols = [c for c in ("f1", "precision", "recall", "median", "p95", "frag", "over", "tiny") if c in per_doc.columns]
    means = [F.avg(F.when(~F.isnan(c), F.col(c))).alias(c) for c in cols]
    return per_doc.groupBy(bucket).agg(*means, F.count(F.lit(1)).alias("docs"), F.sum("n_chunks").alias("chunks"))


def macro(buckets: DataFrame) -> DataFrame:
    """One row: the mean over buckets."""
    cols = [c for c in ("f1", "frag", "over") if c in buckets.columns]
    return buckets.agg(*(F.avg(c).alias(f"macro_{c}") for c in cols), F.count(F.lit(1)).alias("buckets"))


def compare(before: DataFrame, now: DataFrame, bucket: str, metric: str, worst: int = 12, drop: float = -0.02) -> DataFrame:
    """The buckets whose metric fell most, and whether it fell by more than `drop`."""
    a, b = before.select(bucket, F.col(metric).alias("before")), now.select(bucket, F.col(metric).alias("now"))
    df = a.join(b, bucket).withColumn("delta", F.col("now") - F.col("before"))
    return df.withColumn("flagged", F.col("delta") < drop).orderBy("delta", bucket).limit(worst)


def containment(chunks: DataFrame, frags: DataFrame) -> DataFrame:
    """chunks(doc_id, chunk_no, start, end), frags(doc_id, fs, fe): of each fragment the first chunk that holds it whole."""
    frags = frags.select("doc_id", "fs", "fe").distinct()
    # Kept, since their levels are counted before they are joined: chunks may be dear to make, their places are few bytes.
    places = chunks.select("doc_id", "chunk_no", "start", "end").persist()
    met = stab(frags, "fs", places, "start", "end").where(F.col("end") >= F.col("fe"))
    best = met.groupBy("doc_id", "fs", "fe").agg(F.min_by(F.struct("chunk_no", (F.col("end") - F.col("start")).alias("size")), "chunk_no").alias("c"))
    held = frags.join(best, ["doc_id", "fs", "fe"], "left")
    return held.select("doc_id", "fs", "fe", F.col("c.chunk_no").alias("chunk_no"), (F.col("c.size") / (F.col("fe") - F.col("fs"))).alias("noise"))


def sample_per_group(df: DataFrame, group: str, key: str, limit: int, seed: int = 0) -> DataFrame:
    """Up to `limit` rows of each group, by a hash of key."""
    w = Window.partitionBy(group).orderBy(F.xxhash64(F.col(key), F.lit(seed)), key)
    return df.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= limit).drop("_k")


def threshold_scan(scores: DataFrame, labels: DataFrame, steps: list[float]) -> DataFrame:
    """scores(doc_id, pos, score), labels(doc_id, pos): F1 at each threshold, from one pass over the joined rows."""
    df = scores.join(labels.withColumn("y", F.lit(True)), ["doc_id", "pos"], "left").withColumn("y", F.coalesce("y", F.lit(False)))
    parts = [F.struct(F.lit(t).alias("t"), F.count_if((F.col("score") >= t) & F.col("y")).alias("tp"), F.count_if(F.col("score") >= t).alias("p"), F.count_if(F.col("y")).alias("g")) for t in steps]
    rows = df.agg(F.array(*parts).alias("a")).select(F.explode("a").alias("r")).select("r.*")
    return rows.select("t", F.when(F.col("p") + F.col("g") > 0, 2 * F.col("tp") / (F.col("p") + F.col("g"))).otherwise(0.0).alias("f1"))


def by_method(methods: dict[str, DataFrame], gold: DataFrame, docs: DataFrame, tol: int = 3) -> DataFrame:
    """methods: name to (doc_id, pos). Mean precision, recall and F1 of each over docs."""
    out = None
    for name, pred in methods.items():
        part = boundary_prf(pred, gold, docs, tol).agg(F.avg("f1").alias("f1"), F.avg("precision").alias("precision"), F.avg("recall").alias("recall"), F.sum("n_pred").alias("n_pred")).withColumn("method", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


def held_out_offsets(chunks: DataFrame) -> DataFrame:
    """chunks(doc_id, end): (doc_id, pos), where each chunk ends, the last one's end included."""
    return chunks.select("doc_id", F.col("end").cast("long").alias("pos"))


def containment_by_method(methods: dict[str, DataFrame], frags: DataFrame) -> DataFrame:
    """methods: name to chunks(doc_id, chunk_no, start, end). Of each: the share of fragments that no chunk holds whole, and
    the median and 90th percentile of chunk length over fragment length."""
    out = None
    for name, chunks in methods.items():
        part = containment(chunks, frags).agg(F.avg(F.col("chunk_no").isNull().cast("double")).alias("split"), F.percentile("noise", F.lit(0.5)).alias("p50"), F.percentile("noise", F.lit(0.9)).alias("p90")).withColumn("method", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


def char_prf(scores: DataFrame, labels: DataFrame, steps: tuple[float, ...] = (0.5, 0.7)) -> DataFrame:
    """scores(doc_id, pos, score), labels(doc_id, pos): precision, recall and F1 of single characters at each threshold."""
    df = scores.join(labels.select("doc_id", "pos").distinct().withColumn("y", F.lit(True)), ["doc_id", "pos"], "left").withColumn("y", F.coalesce("y", F.lit(False)))
    rows = df.select("score", "y", F.explode(F.array(*map(F.lit, steps))).alias("t")).groupBy("t").agg(F.count_if((F.col("score") >= F.col("t")) & F.col("y")).alias("tp"), F.count_if(F.col("score") >= F.col("t")).alias("p"), F.count_if("y").alias("g"))
    ratio = lambda n: F.coalesce(F.try_divide("tp", n), F.lit(0.0))
    return rows.select("t", ratio("p").alias("precision"), ratio("g").alias("recall"), F.coalesce(F.try_divide(2 * F.col("tp"), F.col("p") + F.col("g")), F.lit(0.0)).alias("f1"))


def exploded_fragments(queries: DataFrame) -> DataFrame:
    """queries(url, starts array, ends array): (url, fs, fe), a row for each fragment."""
    rows = queries.select("url", F.explode(F.arrays_zip("starts", "ends")).alias("f"))
    return rows.select("url", F.col("f.starts").cast("long").alias("fs"), F.col("f.ends").cast("long").alias("fe"))


def weakest(per_bucket: DataFrame, metric: str = "f1", k: int = 6) -> DataFrame:
    """A top-k report: the k buckets with the lowest metric."""
    return per_bucket.orderBy(metric, per_bucket.columns[0]).limit(k)
