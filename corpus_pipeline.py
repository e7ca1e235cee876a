"""A corpus pipeline: quality rules, near duplicates, benchmark decontamination, mixing, token files.

Each stage takes documents (doc_id, text, source and any other columns) and returns rows in the same columns, the last one
those of the token files. Null, empty and short texts go in the first stage. Rows are told apart by doc_id and text: rows
that share an id, or have none, are each judged, and of rows that repeat both one stays. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontam, jaccard, mixing, quality, tokenfile
from tessera.llm.common import drop_path, drop_scratch, new_path, scratch_mark
from tessera.llm.queries import WORD_BPE, table, tokenizer_path


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the base rules and the cascade keep."""
    return quality.keep_good(spark, docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near duplicates: that with the smallest doc_id, null last, then a hash of the text."""
    return jaccard.one_of_each(spark, docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that hold no window of a benchmark item."""
    return decontam.clean(spark, docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, up to three times."""
    return mixing.mix(spark, docs)


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str, folder: str | None = None) -> DataFrame:
    """Writes the token files to folder, or to one of a new name in the shared folder, and returns their documents as read
    back, each with the name of its file; a document taken twice has two rows."""
    manifest = tokenfile.write(spark, docs, tokenizer_path(WORD_BPE), folder=folder)
    files = manifest.select("part", F.col("path").alias("file"))
    return tokenfile.read(spark, manifest).join(F.broadcast(files), "part").drop("part")


STAGES = [("quality", quality_rules), ("near_duplicates", near_duplicates), ("decontamination", decontaminate), ("mixing", mix_sources), ("token_files", token_files)]

#: Mixing draws with a hash that SQL lacks, and the last stage needs a tokenizer: tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str, folder: str | None = None) -> DataFrame:
    """The stages over documents, each result written and read again; what a stage keeps in the shared folder goes once it
    is written. The column `file` of the result names the token files, in folder if it is given."""
    docs, last = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path, mark = new_path(spark, f"stage-{name}"), scratch_mark()
        out = stage(spark, docs, sf_dir, folder) if stage is token_files else stage(spark, docs, sf_dir)
        out.write.parquet(path)
        drop_scratch(spark, mark)
        docs = spark.read.parquet(path)
        if last is not None:
            drop_path(spark, last)
        last = path
    return docs
