"""The library in SQL: functions over lines and texts, and views of chunks."""

from __future__ import annotations

import re

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from tessera.functions.predicates import ALL
from tessera.functions.textnorm import collapse_space, first_word, line_shape, normalize, strip

from .segment import SegmentEngine

#: Functions of one text.
TEXT = {"normalize_text": normalize, "strip_text": strip, "collapse_space": collapse_space, "line_shape": line_shape, "first_word": first_word}


def sql_of(spark: SparkSession, expression: Column, names: tuple[str, ...]) -> str:
    """An expression over string columns of these names as Spark's SQL."""
    df = spark.createDataFrame([], ", ".join(f"{n} string" for n in names)).select(expression.alias("x"))
    out = df._jdf.queryExecution().analyzed().expressions().apply(0).child().sql()
    return re.sub(r"\w+\.(\w+)\.(?=(?:" + "|".join(names) + r")\b)", "", out)


def register(spark: SparkSession) -> list[str]:
    """Makes temporary functions of the session: those in TEXT, and line_is_<predicate>(line) for each predicate; returns their
    names. They are SQL, so the optimiser sees through them."""
    made = []
    for name, f in TEXT.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(t STRING) RETURNS STRING RETURN {sql_of(spark, f(F.col('t')), ('t',))}")
        made.append(name)
    for name, p in ALL.items():
        test = re.sub(r"\bst\b", "strip_text(seg)", sql_of(spark, p.spark(), ("seg", "st")))
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION line_is_{name}(seg STRING) RETURNS BOOLEAN RETURN {test}")
        made.append(f"line_is_{name}")
    return made


def chunk_view(spark: SparkSession, source: str, name: str, engine: SegmentEngine | None = None) -> None:
    """A temporary view `name` of the chunks of the table or view `source`(doc_id, text, ...)."""
    (engine or SegmentEngine()).chunk(spark.table(source).select("doc_id", "text")).createOrReplaceTempView(name)
