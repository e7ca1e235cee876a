"""Joins of points and intervals within documents, by a grid of cells whose sizes double.

An interval goes to the level whose cells are as long as it or up to twice so, where it lies in two cells at most; a point
looks up the one cell of each level that has intervals. So the join is on equal keys (document, level, cell), spread over
all tasks even within one document, and where intervals hardly overlap a point meets a few at each level, however many
there are in the document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEYS = ["_level", "_cell"]


def level_of(length: Column) -> Column:
    """The smallest k with length <= 2**k."""
    return F.when(length <= 1, 0).otherwise(F.length(F.bin(length.cast("long") - 1))).cast("int")


def spread(intervals: DataFrame, lo: str, hi: str) -> DataFrame:
    """intervals, both ends within, with the level and each of the cells that they lie in; those with lo > hi hold nothing."""
    level = level_of(F.col(hi) - F.col(lo))
    cells = F.sequence(F.expr(f"shiftright(cast({lo} as bigint), _level)"), F.expr(f"shiftright(cast({hi} as bigint), _level)"))
    return intervals.where(F.col(lo) <= F.col(hi)).withColumn("_level", level).withColumn("_cell", F.explode(cells))


def levels_of(spread_: DataFrame) -> list[int]:
    """The levels that there are: 64 at most, however many intervals."""
    return sorted(r[0] for r in spread_.select("_level").distinct().collect())


def probing(points: DataFrame, pos: str, levels: list[int]) -> DataFrame:
    """points with a row for each level."""
    at = F.array(*(F.struct(F.lit(k).alias("level"), F.shiftright(F.col(pos).cast("long"), k).alias("cell")) for k in levels))
    rows = points.withColumn("_at", F.explode(at if levels else F.array().cast("array<struct<level:int,cell:bigint>>")))
    return rows.withColumns({"_level": F.col("_at.level"), "_cell": F.col("_at.cell")}).drop("_at")


def stab(points: DataFrame, pos: str, intervals: DataFrame, lo: str, hi: str, key: str = "doc_id", levels: list[int] | None = None) -> DataFrame:
    """The pairs of a point and an interval of one key with lo <= pos <= hi, each once, in the columns of both. levels:
    those of the intervals, where they are known; else they are counted first."""
    cells = spread(intervals, lo, hi)
    levels = levels_of(cells) if levels is None else levels
    return probing(points, pos, levels).join(cells, [key, *KEYS]).where(F.col(pos).between(F.col(lo), F.col(hi))).drop(*KEYS)
