"""Sources and sinks: text, directories, JSON lines, parquet, weights; chunk and boundary outputs."""

from __future__ import annotations

import sys

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.textnorm import strip

#: Records of every kind; fields that a file lacks are null.
RECORD = "doc_id long, lang string, source string, text string, boundaries array<long>, big_logp array<double>, small_logp array<double>, cont_logp array<double>, transforms array<string>"


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """Whole text files, also of folders within, as (doc_id, name, path, text), in the order of their paths, without white space
    at their ends; blank ones are left out. doc_id is a hash of the whole path, by which a caller who needs an order can sort."""
    df = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True)
    df = df.select(F.col("_metadata.file_name").alias("name"), F.col("_metadata.file_path").alias("path"), strip(F.col("value")).alias("text"))
    return df.where(F.col("text") != "").select(F.xxhash64("path").alias("doc_id"), "name", "path", "text")


def read_stdin(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(0, "-", sys.stdin.read())], "doc_id long, path string, text string")


def read_jsonl(spark: SparkSession, *paths: str, lang: str = "pt", source: str = "?") -> DataFrame:
    """JSON lines of records with the default language and source; paths that don't exist are left out."""
    there = [p for p in paths if exists(spark, p)]
    if not there:
        return spark.createDataFrame([], RECORD)
    df = spark.read.schema(RECORD).json(there)
    return df.withColumns({"lang": F.coalesce("lang", F.lit(lang)), "source": F.coalesce("source", F.lit(source))})


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def read_parquet(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    return spark.read.parquet(path).select(*columns)


def write_jsonl(df: DataFrame, path: str) -> None:
    """Records with doc_id given anew, as their place in the order of the old ones. The places come from the sizes of
    range partitions, so no task sees all rows."""
    parts = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    laid = df.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id").withColumn("_at", F.monotonically_increasing_id())
    laid = laid.withColumns({"_part": F.shiftright("_at", 33), "_i": F.col("_at").bitwiseAND((1 << 33) - 1)}).checkpoint()
    counts = laid.groupBy("_part").agg(F.count(F.lit(1)).alias("n"))
    shift = counts.select("_part", F.coalesce(F.sum("n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_s"))
    laid.join(F.broadcast(shift), "_part").withColumn("doc_id", F.col("_i") + F.col("_s")).drop("_at", "_part", "_i", "_s").write.json(path)


def as_json_array(chunks: DataFrame, pretty: bool = False) -> DataFrame:
    """(doc_id, json): each document's chunks as a JSON array of strings, on lines of their own if pretty."""
    rows = F.transform(F.array_sort(F.collect_list(F.struct("chunk_no", "text"))), lambda r: r["text"])
    return chunks.groupBy("doc_id").agg(F.to_json(rows, {"pretty": str(pretty).lower()}).alias("json"))


def as_separated(chunks: DataFrame, separator: str = "\n---\n") -> DataFrame:
    """(doc_id, text): each document's chunks, the separator after each."""
    rows = F.transform(F.array_sort(F.collect_list(F.struct("chunk_no", "text"))), lambda r: F.concat(r["text"], F.lit(separator)))
    return chunks.groupBy("doc_id").agg(F.array_join(rows, "").alias("text"))


def quoted(text: Column) -> Column:
    """A text as a Python literal: in single quotes, or in double ones if it has single ones only; backslashes and white space
    that breaks or moves lines written out."""
    t = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for c, name in (("\n", "n"), ("\r", "r"), ("\t", "t"), ("\x0b", "x0b"), ("\x0c", "x0c"), ("\xa0", "xa0"), ("\u2028", "u2028"), ("\u2029", "u2029"), ("\u200b", "u200b"), ("\ufeff", "ufeff")):
        t = F.replace(t, F.lit(c), F.lit("\\" + name))
    double = F.contains(t, F.lit("'")) & ~F.contains(t, F.lit('"'))
    return F.when(double, F.concat(F.lit('"'), t, F.lit('"'))).otherwise(F.concat(F.lit("'"), F.replace(t, F.lit("'"), F.lit("\\'")), F.lit("'")))


def as_boundary_lines(boundaries: DataFrame, docs: DataFrame, back: int = 30, ahead: int = 10) -> DataFrame:
    """(doc_id, pos, line): kind, position and the text around it as a literal, tab-separated."""
    df = boundaries.join(docs.select("doc_id", "text"), "doc_id")  # the context is found by the id, which must be unique
    start = F.greatest(F.col("pos") - back, F.lit(0)).cast("int")
    around = F.substr("text", start + 1, (F.col("pos") + ahead).cast("int") - start)
    return df.select("doc_id", "pos", F.concat_ws("\t", "kind", "pos", quoted(around)).alias("line"))


def write_chunk_dump(chunks: DataFrame, path: str) -> None:
    """A folder for each document, its chunks under a heading with number and size."""
    rows = F.transform(F.array_sort(F.collect_list(F.struct("chunk_no", "n_chars", "text"))), lambda r: F.format_string("CHUNK %s (%s chars)\n%s\n", r["chunk_no"], r["n_chars"], r["text"]))
    chunks.groupBy("doc_id").agg(F.array_join(rows, "\n").alias("value")).write.partitionBy("doc_id").text(path)


def save_metrics(rows: DataFrame, path: str) -> None:
    """A table of metrics, a row for each bucket, as JSON lines to compare() a later run with."""
    rows.coalesce(1).write.mode("overwrite").json(path)


def load_metrics(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path)
