"""A grid of settings over one scoring: features and scores are computed once, each document is assembled for every setting."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import replace
from itertools import product

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.operators import assemble, chars, lines, metrics, scoring, spans
from tessera.plans.segment import SPANS, SegmentEngine
from tessera.session import small_batches

#: Thresholds of a boundary, least lengths of a chunk, shares of the second score.
GRID = ((0.35, 0.5, 0.65, 0.8), (40, 100), (0.0, 0.15, 0.3))
SCORES = "array<struct<start:bigint,line:double,beside:double>>"


def settings_of(grid=GRID) -> list[tuple[float, int, float]]:
    return list(product(*grid))


def gathered(engine: SegmentEngine, docs: DataFrame, beside: scoring.LinearScorer | None = None) -> DataFrame:
    """docs(doc_id, text) as (doc_row, doc_id, text, spans, scores): of each line that isn't empty its start, the scorer's score
    and a second one: that of the engine's network of characters, of `beside`, or the same."""
    rows = lines.features(docs, carry=True)
    if engine.char_scorer:
        found = engine.char_scores(chars.features(docs, lines=rows.drop("text")))
        scores = engine.scorer.score(found.where((F.col("pos") == F.col("start")) & (F.col("ch") != "\n"))).withColumn("beside", F.col("big"))
    else:
        scores = engine.scorer.score(chars.line_starts(rows.drop("text")) if engine.of_characters() else rows)
        first = scores.withColumnRenamed("score", "_first")
        scores = (beside.score(first).withColumnRenamed("score", "beside") if beside else first.withColumn("beside", F.col("_first"))).withColumnRenamed("_first", "score")
    score = F.when(F.col("seg") != "", F.struct("start", F.col("score").alias("line"), "beside"))
    scores = scores.groupBy("doc_row").agg(F.sort_array(F.collect_list(score)).alias("scores"))
    span = F.when(F.col("span").isNotNull(), F.struct(F.col("span.s").alias("s"), F.col("span.e").alias("e")))
    whole = spans.with_spans(rows).groupBy("doc_row", "doc_id").agg(F.first("text", ignorenulls=True).alias("text"), F.sort_array(F.collect_list(span)).cast(SPANS).alias("spans"))
    return whole.join(scores, "doc_row", "left").withColumn("scores", F.coalesce("scores", F.array().cast(SCORES)))


def points_of(scores: list[dict], big: float, blend: float, steps: tuple[float, ...], min_lines: int = 3) -> list[int]:
    """The starts of lines that reach the threshold, or, in a document of more than min_lines lines where none does, the first
    lower step that any reaches; as scoring.flagged()."""
    mixed = [(x["start"], (1 - blend) * x["line"] + blend * x["beside"]) for x in scores]
    top = max((s for _, s in mixed), default=0.0)
    used = big
    if top < big and len(mixed) > min_lines:
        used = next((t for t in steps if top >= t), big)
    return [p for p, s in mixed if p > 0 and s >= used]


def boundaries(engine: SegmentEngine, docs: DataFrame, grid=GRID, beside: scoring.LinearScorer | None = None) -> DataFrame:
    """(setting, doc_row, doc_id, bounds): where each chunk but the first starts, for each setting, a number in settings_of(grid).
    A document is treated whole, however long."""
    configs = [(b, f, replace(engine.config, big_threshold=b, small_threshold=b, min_chunk_chars=m, char_blend=f)) for b, m, f in settings_of(grid)]
    steps = scoring.DEFAULT_STEPS if engine.config.adaptive else ()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for row, doc, text, held, scores in zip(b["doc_row"], b["doc_id"], b["text"], b["spans"], b["scores"]):
                around, done, norm = [(x["s"], x["e"]) for x in held], {}, assemble.normalized(text or "")
                for k, (big, blend, cfg) in enumerate(configs):
                    key = (tuple(points_of(scores, big, blend, steps)), cfg.min_chunk_chars)
                    if key not in done:  # settings that mark the same lines
                        done[key] = [a for a, _, _ in assemble.cuts_of(text, list(key[0]), around, cfg, norm=norm)[1:]] if text else []
                    out.append((k, row, doc, done[key]))
            yield pd.DataFrame(out, columns=["setting", "doc_row", "doc_id", "bounds"])

    kind = dict(docs.dtypes)["doc_id"]
    small_batches(docs.sparkSession, 128)
    return gathered(engine, docs, beside).mapInPandas(run, f"setting int, doc_row long, doc_id {kind}, bounds array<long>")


def scored(pred: DataFrame, gold: DataFrame, tol: int = 3) -> DataFrame:
    """pred(setting, doc_id, bounds), gold(doc_id, bucket, boundaries): (setting, bucket, doc_id, f1), one plan for all settings."""
    both = pred.select("setting", "doc_id", "bounds").join(gold.select("doc_id", "bucket", "boundaries"), "doc_id").select(F.struct("setting", "bucket", "doc_id").alias("doc_id"), "bounds", "boundaries")
    rows = metrics.boundary_prf(both.select("doc_id", F.explode("bounds").alias("pos")), both.select("doc_id", F.explode("boundaries").alias("pos")), both, tol)
    return rows.select("doc_id.*", "f1")


def report(spark: SparkSession, f1: DataFrame, settings: list[tuple], names: tuple[str, ...], worst: int = 10, apart: str | None = None) -> DataFrame:
    """f1(setting, bucket, f1): a row for each setting: its values, macro_f1 (the mean over buckets but `apart`), the F1 of the
    bucket `apart`, best (the one with the highest sum of both, the first of ties), and of the best its `worst` weakest buckets."""
    buckets = f1.groupBy("setting", "bucket").agg(F.avg("f1").alias("f1"))
    own = F.col("bucket") == F.lit(apart) if apart else F.lit(False)
    weak = F.slice(F.array_sort(F.collect_list(F.struct(F.round("f1", 6).alias("f1"), "bucket"))), 1, worst)
    rows = buckets.groupBy("setting").agg(F.avg(F.when(~own, F.col("f1"))).alias("macro_f1"), F.max(F.when(own, F.col("f1"))).alias("apart_f1"), weak.alias("weakest"))
    rank = F.row_number().over(Window.orderBy(F.desc(F.round(F.col("macro_f1") + F.coalesce("apart_f1", F.lit(0.0)), 9)), "setting"))  # a row for each setting
    table = spark.createDataFrame([(k, *s) for k, s in enumerate(settings)], ["setting", *names])
    rows = rows.withColumn("best", rank == 1).withColumn("weakest", F.when(F.col("best"), F.col("weakest")))
    return table.join(rows, "setting").select("setting", *names, "macro_f1", "apart_f1", "best", "weakest")
