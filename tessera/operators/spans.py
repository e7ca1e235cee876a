"""Spans that no boundary may cut: fenced code and tables, as gaps-and-islands over lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.predicates import fires

from .lines import after, before, by_line, in_code, nearest
from .ranges import stab


def with_spans(lines: DataFrame) -> DataFrame:
    """lines(doc_row, line_no, start, seg, st, fence, nf, ...) with `span`, (kind, s, e), on the first line of each span.

    A fence opens at an even number of earlier fence lines and closes at an odd one; unclosed, it lasts to the end. Outside
    of fences, lines in a row that look like table rows are one table; it ends where the next other line starts. A table
    stays open through a fence that follows it.
    """
    size = F.max(F.col("start") + F.length("seg")).over(Window.partitionBy("doc_row"))
    free = ~F.col("fence") & (F.col("nf") % 2 == 0)
    opens, closes = F.col("fence") & (F.col("nf") % 2 == 0), F.col("fence") & (F.col("nf") % 2 == 1)
    df = lines.withColumns({"_table": F.when(free, fires("table_row")), "_next": F.lead("start").over(by_line())})
    df = df.withColumns({"_size": size, "_open": nearest(F.col("_table"), before())})
    df = df.withColumn("_next", F.coalesce("_next", "_size"))
    df = df.withColumns({"_closed": nearest(F.when(closes, F.col("_next")), after()), "_left": nearest(F.when(~F.col("_table"), F.col("start")), after())})
    starts = F.col("_table") & ~F.coalesce("_open", F.lit(False))
    span = lambda kind, e: F.struct(F.lit(kind).alias("kind"), F.col("start").alias("s"), F.coalesce(e, "_size").alias("e"))
    df = df.withColumn("span", F.when(opens, span("fence", "_closed")).when(starts, span("table", "_left")))
    return df.withColumn("span", F.when(F.col("span.e") - F.col("span.s") > 1, F.col("span"))).drop("_table", "_next", "_size", "_open", "_closed", "_left")


def protected_spans(lines: DataFrame) -> DataFrame:
    """lines(doc_row, doc_id, line_no, start, seg, st) as (doc_row, doc_id, kind, s, e), half-open."""
    return with_spans(in_code(lines)).where("span is not null").select("doc_row", "doc_id", "span.*")


def veto(points: DataFrame, spans: DataFrame) -> DataFrame:
    """points(doc_id, pos, ...) without those strictly inside a span."""
    within = spans.select("doc_id", (F.col("s") + 1).alias("_lo"), (F.col("e") - 1).alias("_hi"))
    hit = stab(points.select("doc_id", "pos"), "pos", within, "_lo", "_hi").select("doc_id", "pos").distinct()
    return points.join(hit, ["doc_id", "pos"], "left_anti")
