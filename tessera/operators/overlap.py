"""Long documents in overlapping sections, and what is found in the sections put together again.

Scores and marks come in as tables, from whatever model read the sections.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .packing import openings

#: The score of a place before the first one that has any.
NONE = -100.0


def sections(docs: DataFrame, size: int = 2400, overlap: int = 400) -> DataFrame:
    """docs(doc_id, text): (doc_id, section_no, start, end, text), each section but the first beginning `overlap` before the end of
    the one before, the last ending with the text; one section for a text of up to `size`. Null and empty texts have none.
    overlap is half of size at most. The text is cut into stretches once; a section is one and the front of the next."""
    if not 0 <= 2 * overlap <= size:
        raise ValueError("overlap is half of size at most")
    n, step = F.length("text").cast("long"), size - overlap
    last = F.when(n <= size, 0).otherwise(F.ceil((n - size) / step)).cast("int")
    rows = docs.where(n > 0).select("doc_id", last.alias("_last"), F.regexp_extract_all("text", F.lit(rf"(?s).{{1,{step}}}"), F.lit(0)).alias("_b"))
    texts = F.transform(F.sequence(F.lit(0), F.col("_last")), lambda k: F.concat(F.get("_b", k), F.coalesce(F.substring(F.get("_b", k + 1), 1, overlap), F.lit(""))))
    rows = rows.select("doc_id", F.posexplode(texts).alias("section_no", "text")).withColumn("start", F.col("section_no").cast("long") * step)
    return rows.select("doc_id", F.col("section_no").cast("long").alias("section_no"), "start", (F.col("start") + F.length("text")).alias("end"), "text")


def latest(scores: DataFrame) -> DataFrame:
    """scores(doc_id, section_no, k, pos, score): (doc_id, pos, score): of each place the score of the last section that has one,
    of several in it that of the last token k."""
    return scores.groupBy("doc_id", "pos").agg(F.max_by("score", F.struct("section_no", "k")).alias("score"))


def filled(scores: DataFrame, docs: DataFrame) -> DataFrame:
    """scores(doc_id, pos, score), docs(doc_id, text): (doc_id, start, end, score): the runs of places that have one score, each
    place without one taking that of the last place before it that has, NONE without any. An as-of fill that needs a row for
    each score, not for each character."""
    n = docs.where(F.length("text") > 0).select("doc_id", F.length("text").cast("long").alias("_n"))
    marks = scores.select("doc_id", F.col("pos").cast("long").alias("pos"), F.col("score").cast("double").alias("score"))
    marks = marks.union(n.select("doc_id", F.lit(-1).cast("long"), F.lit(NONE)))
    rows = marks.withColumn("_next", F.lead("pos").over(Window.partitionBy("doc_id").orderBy("pos"))).join(n, "doc_id")
    rows = rows.select("doc_id", F.greatest("pos", F.lit(0)).alias("start"), F.least(F.coalesce("_next", "_n"), "_n").alias("end"), "score")
    return rows.where("start < end")


def merged_sections(sections_: DataFrame, margin: int = 150, apart: int = 5) -> DataFrame:
    """sections(doc_id, section_no, start, end, marks array<long>): (doc_id, pos). In documents of several sections marks nearer
    than `margin` to either end of their section go, and of those left each that lies within `apart` of the last one that
    stayed. What is dealt by document is a row for each section, not for each mark."""
    far = F.filter("marks", lambda p: (p >= F.col("start") + margin) & (p < F.col("end") - margin))
    rows = sections_.select("doc_id", F.struct(F.col("marks").alias("all"), far.alias("far")).alias("_s"))
    own = rows.groupBy("doc_id").agg(F.collect_list("_s").alias("_s")).withColumn("_many", F.size("_s") > 1)
    places = F.when(F.col("_many"), F.flatten(F.transform("_s", lambda x: x["far"]))).otherwise(F.flatten(F.transform("_s", lambda x: x["all"])))
    own = own.select("doc_id", "_many", F.sort_array(F.array_distinct(places)).alias("_p"))
    gaps = F.transform("_p", lambda p, i: p - F.get("_p", i - 1))

    def step(held, gap):
        opens = (held < 0) | (held + gap > apart)
        return opens, F.when(opens, 0).otherwise(held + gap)

    own = own.withColumn("_g", F.transform(gaps, lambda g: F.coalesce(g, F.lit(0)))).withColumn("_o", openings(F.col("_g"), step))
    stay = F.when(F.col("_many"), F.transform("_o", lambda i: F.get("_p", i))).otherwise(F.col("_p"))
    return own.select("doc_id", F.explode(stay).alias("pos"))


def merged_marks(marks: DataFrame, sizes: DataFrame, margin: int = 150, apart: int = 5) -> DataFrame:
    """merged_sections() of marks(doc_id, section_no, pos) in a table of their own, of sections(doc_id, section_no, start, end)."""
    lists = marks.groupBy("doc_id", "section_no").agg(F.collect_list(F.col("pos").cast("long")).alias("marks"))
    rows = sizes.select("doc_id", "section_no", "start", "end").join(lists, ["doc_id", "section_no"], "left")
    return merged_sections(rows.withColumn("marks", F.coalesce("marks", F.array().cast("array<bigint>"))), margin, apart)
