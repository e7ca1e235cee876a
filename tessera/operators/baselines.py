"""Plain splitters to compare with, and chunks from positions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.textnorm import normalize

from .lines import by_line, split_lines, with_row
from .packing import openings, packs


def fixed_chunks(docs: DataFrame, size: int = 512) -> DataFrame:
    """(doc_id, chunk_no, start, end, text): pieces of `size` code points."""
    n = F.length("text")
    starts = F.when(n > 0, F.sequence(F.lit(0), n - 1, F.lit(size))).otherwise(F.array().cast("array<int>"))
    rows = docs.select("doc_id", "text", F.posexplode(starts).alias("chunk_no", "start"))
    return rows.select("doc_id", "chunk_no", "start", F.least(F.col("start") + size, F.length("text")).alias("end"), F.substring("text", F.col("start") + 1, F.lit(size)).alias("text"))


def paragraph_boundaries(docs: DataFrame) -> DataFrame:
    """(doc_id, pos): the line break before each line that follows a blank one."""
    lines = split_lines(docs)
    before = F.lag("st").over(by_line())
    return lines.withColumn("_b", before).where("st <> '' and _b = '' and start > 0").select("doc_id", (F.col("start") - 1).alias("pos"))


def paragraph_chunks(docs: DataFrame, size: int = 800) -> DataFrame:
    """(doc_id, chunk_no, text): paragraphs packed in order, a new chunk when the next one would exceed `size`."""
    paragraphs = F.filter(F.split(normalize(F.col("text")), r"\n[ \t]*\n[ \t\n]*"), lambda p: F.trim(p) != "")
    rows = docs.select("doc_id", paragraphs.alias("_p")).withColumn("_n", F.transform("_p", F.length))

    def step(held, n):
        opens = (held < 0) | (held + n + 2 > size)
        return opens, F.when(opens, n).otherwise(held + n + 2)

    rows = rows.withColumn("_o", openings(F.col("_n"), step))
    return rows.select("doc_id", F.posexplode(packs(F.col("_p"), F.col("_o"), "\n\n")).alias("chunk_no", "text"))


def paragraph_spans(docs: DataFrame, size: int = 800) -> DataFrame:
    """(doc_id, chunk_no, start, end): where paragraph_chunks() lie in the normalised text, from the first paragraph's start to the
    last one's end."""
    pieces = F.regexp_extract_all(normalize(F.col("text")), F.lit(r"(?s).+?(?:\n[ \t]*\n[ \t\n]*|\z)"), F.lit(0))
    bare = F.transform("_p", lambda p: F.length(F.regexp_replace(p, r"\n[ \t]*\n[ \t\n]*\z", "")))
    rows = with_row(docs).select("doc_row", "doc_id", pieces.alias("_p")).withColumn("_n", bare)
    rows = rows.select("doc_row", "doc_id", F.posexplode(F.arrays_zip("_p", "_n")).alias("k", "x"))
    w = Window.partitionBy("doc_row").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("start", F.coalesce(F.sum(F.length("x._p").cast("long")).over(w), F.lit(0))).where(F.trim("x._p") != "")
    own = rows.groupBy("doc_row", "doc_id").agg(F.sort_array(F.collect_list(F.struct("start", F.col("x._n").alias("n")))).alias("_s"))

    def step(held, n):
        opens = (held < 0) | (held + n + 2 > size)
        return opens, F.when(opens, n).otherwise(held + n + 2)

    own = own.withColumn("_o", openings(F.transform("_s", lambda s: s["n"]), step))
    last = lambda i: F.get("_s", F.coalesce(F.get("_o", i + 1), F.size("_s")) - 1)
    spans = F.transform("_o", lambda a, i: F.struct(F.get("_s", a)["start"].alias("start"), (last(i)["start"] + last(i)["n"]).alias("end")))
    return own.select("doc_id", F.posexplode(spans).alias("chunk_no", "c")).select("doc_id", "chunk_no", "c.start", "c.end")


def spans_of(chunks: DataFrame) -> DataFrame:
    """chunks(doc_id, chunk_no, text) that cover their document: (doc_id, chunk_no, start, end)."""
    w = Window.partitionBy("doc_id").orderBy("chunk_no").rowsBetween(Window.unboundedPreceding, 0)
    rows = chunks.withColumn("end", F.sum(F.length("text").cast("long")).over(w))
    return rows.select("doc_id", "chunk_no", (F.col("end") - F.length("text")).alias("start"), "end")


def sentence_ends(docs: DataFrame) -> DataFrame:
    """(doc_id, pos): the place after each sentence end: a terminator before a space, break, closing bracket or quote."""
    # Tied to the end of the last one: else what follows the last end would be walked anew from each of its characters.
    parts = F.regexp_extract_all(normalize(F.col("text")), F.lit("(?s)\\G.*?[.!?](?=[ \\t\\n)\\]}»\"'])"), F.lit(0))
    rows = with_row(docs).select("doc_row", "doc_id", F.posexplode(parts).alias("k", "part"))
    w = Window.partitionBy("doc_row").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    return rows.select("doc_id", F.col("k").alias("sent_no"), F.sum(F.length("part")).over(w).alias("pos"), F.length("part").cast("long").alias("sent_len"))


def sentence_chunks(docs: DataFrame, size: int = 500) -> DataFrame:
    """(doc_id, chunk_no, text): each chunk ends at the last sentence end within `size`, else at `size`."""
    pattern = rf"(?s).{{1,{size}}}(?<=[.!?])(?=\s|$)|.{{1,{size}}}"
    return docs.select("doc_id", F.posexplode(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(pattern), F.lit(0))).alias("chunk_no", "text"))
