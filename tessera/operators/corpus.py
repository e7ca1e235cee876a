"""Corpus building: cleaning, sections, quotas, deduplication, pairing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.textnorm import collapse_space, fold_breaks, strip

from .packing import openings, packs

__all__ = ["clean", "clean_legal", "collapse_space", "sections", "quota", "dedupe", "titled", "group_counts", "question_answer", "rebuild"]


def clean(text: Column) -> Column:
    """LF line ends, no blanks at line ends, one blank line at most between paragraphs, none at the ends."""
    t = F.regexp_replace(fold_breaks(text), r"(?<![ \t])[ \t]++\n", "\n")
    return strip(F.regexp_replace(t, r"\n{3,}", "\n\n"))


def clean_legal(text: Column) -> Column:
    t = F.regexp_replace(fold_breaks(text), r"[ \t]+", " ")
    return strip(F.regexp_replace(t, r"\n{3,}", "\n\n"))


def sections(docs: DataFrame, short: int = 40, full: int = 900, least: int = 350, most: int = 2500) -> DataFrame:
    """docs(doc_id, text): paragraphs of `short` or more, packed in order until a section has more than `full`; sections of
    `least` to `most` stay. (doc_id, section_no, text)."""
    parts = F.filter(F.transform(F.split("text", r"\n\s*\n"), strip), lambda p: F.length(p) >= short)

    def step(held, n):
        opens = held < 0
        now = F.when(opens, n).otherwise(held + n + 2)
        return opens, F.when(now > full, -1).otherwise(now)

    rows = docs.select("doc_id", parts.alias("_p")).withColumn("_n", F.transform("_p", F.length)).withColumn("_o", openings(F.col("_n"), step))
    rows = rows.select("doc_id", F.posexplode(packs(F.col("_p"), F.col("_o"), "\n\n")).alias("section_no", "text"))
    return rows.where(F.length("text").between(least, most))


def legal_sections(docs: DataFrame, short: int = 60, full: int = 1900, least: int = 400, most: int = 2600) -> DataFrame:
    """As sections(), for statutes; a document without a section of fair length stays whole, as section 0."""
    found = sections(docs, short + 1, full, least, most)
    none = docs.join(found.select("doc_id").distinct(), "doc_id", "left_anti")
    return found.union(none.select("doc_id", F.lit(0), "text"))


def fair_sample(docs: DataFrame, low: int, high: int, most: int) -> DataFrame:
    """A sampling operator: `most` documents of `low` to `high` characters, chosen by arithmetic on doc_id."""
    return docs.where(F.length("text").between(low, high)).orderBy(F.pmod(F.col("doc_id") * 7919, F.lit(10_007)), "doc_id").limit(most)


def grouped(pairs: DataFrame, text: Column, low: int = 3, high: int = 5) -> DataFrame:
    """pairs(pair_id, ...): their texts, `low` to `high` a document by turns, as (doc, text, boundaries)."""
    from .labels import join_units

    cycle = (low + high) * (high - low + 1) // 2
    ends = [sum(range(low, low + k + 1)) for k in range(high - low + 1)]
    place = F.pmod("pair_id", F.lit(cycle))
    turn = sum(((place >= e).cast("int") for e in ends), F.lit(0))
    doc = (F.floor(F.col("pair_id") / cycle) * len(ends) + turn).cast("long")
    return join_units(pairs.select(doc.alias("doc_id"), F.col("pair_id").alias("unit_no"), F.concat(text, F.lit("\n\n")).alias("text"))).withColumnRenamed("doc_id", "doc")


def quota(docs: DataFrame, group: str, limit: int, order: str = "doc_id") -> DataFrame:
    """The first `limit` documents of each group."""
    w = Window.partitionBy(group).orderBy(order)
    return docs.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= limit).drop("_r")


def dedupe(docs: DataFrame) -> DataFrame:
    """Of equal texts the document with the smallest doc_id: an aggregate on a 256-bit digest, so no text is shuffled."""
    return docs.join(docs.groupBy(F.sha2("text", 256).alias("_h")).agg(F.min("doc_id").alias("doc_id")).select("doc_id"), "doc_id", "left_semi")


def titled(title: Column, text: Column) -> Column:
    return F.concat(title, F.lit("\n\n"), text)


def group_counts(docs: DataFrame, group: str) -> DataFrame:
    return docs.groupBy(group).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), group)


def question_answer(pairs: DataFrame, size: int = 5, low: int = 120, high: int = 500) -> DataFrame:
    """pairs(pair_id, anchor, positive): questions with an answer of fair length, `size` pairs a document."""
    ask = F.col("anchor").rlike(r"\?\s*$")
    good = pairs.where(ask & F.length("positive").between(low, high))
    good = good.withColumn("doc", F.floor(F.col("pair_id") / size))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pair_id", F.concat("anchor", F.lit("\n"), "positive").alias("t")))), lambda x: x["t"]), "\n\n")
    return good.groupBy("doc").agg(body.alias("text"))


def rebuild(tiles: DataFrame, key: str, order: str, piece: str, sep: str = "") -> DataFrame:
    """Documents from their tiles, in order."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct(order, piece))), lambda x: x[piece])
    return tiles.groupBy(key).agg(F.array_join(parts, sep).alias("text"))
