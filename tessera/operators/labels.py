"""Boundary labels: snapping, relabelling, training rows."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.textnorm import collapse_space, normalize

from .ranges import stab
from .scoring import LinearScorer, plateau_peaks


def snap_positions(labels: DataFrame, lines: DataFrame, reach: int = 4) -> DataFrame:
    """labels(doc_id, pos): each moved to the nearest line start within reach, the earlier one of two; else as it is."""
    labels = labels.select("doc_id", "pos").distinct()
    around = labels.withColumns({"lo": F.col("pos") - reach, "hi": F.col("pos") + reach})
    met = stab(lines.where("start > 0").select("doc_id", "start"), "start", around, "lo", "hi", levels=[max(0, (2 * reach - 1).bit_length())])
    near = met.groupBy("doc_id", "pos").agg(F.min_by("start", F.struct(F.abs(F.col("start") - F.col("pos")), "start")).alias("to"))
    moved = labels.join(near, ["doc_id", "pos"], "left")
    return moved.select("doc_id", F.coalesce("to", "pos").alias("pos")).distinct()


def text_key(text, size: int = 300):
    return F.substring(collapse_space(text), 1, size)


def relabel(records: DataFrame, better: DataFrame, size: int = 300) -> DataFrame:
    """records(doc_id, text, boundaries) with the boundaries of the record of `better` that has the same text key, if it has
    any; of several the one with the largest doc_id. `changed` tells which."""
    w = Window.partitionBy("_key").orderBy(F.desc("doc_id"))
    new = better.withColumn("_key", text_key(F.col("text"), size)).withColumn("_r", F.row_number().over(w)).where("_r = 1").select("_key", F.col("boundaries").alias("_new"))
    df = records.withColumn("_key", text_key(F.col("text"), size)).join(new, "_key", "left")
    use = F.coalesce(F.size("_new") > 0, F.lit(False))
    return df.withColumns({"boundaries": F.when(use, F.col("_new")).otherwise(F.col("boundaries")), "changed": use}).drop("_key", "_new")


def line_labels(lines: DataFrame, labels: DataFrame, back: int = 2) -> DataFrame:
    """lines with `label`: whether a label lies at the line's start or up to `back` before it. Only documents of two
    non-empty lines or more."""
    n = F.count(F.lit(1)).over(Window.partitionBy("doc_id"))
    full = lines.where("seg <> ''").withColumn("_n", n).where("_n >= 2").drop("_n")
    hit = labels.select("doc_id", F.explode(F.array(*(F.col("pos") + k for k in range(back + 1)))).alias("start")).distinct().withColumn("label", F.lit(True))
    return full.join(hit, ["doc_id", "start"], "left").withColumn("label", F.coalesce("label", F.lit(False)))


def halo_sample(points: DataFrame, reach: int = 6, keep: float = 0.06, seed: int = 0) -> DataFrame:
    """points(doc_id, pos, label 0/1): the positives, those within reach of one, and a share of the rest chosen by arithmetic
    on document and place."""
    near = F.max("label").over(Window.partitionBy("doc_id").orderBy("pos").rangeBetween(-reach, reach)) > 0
    lot = F.pmod(F.col("doc_id") * 7919 + F.col("pos") * 104_729 + seed, F.lit(10_007)) < int(10_007 * keep)
    return points.withColumn("_near", near).where(F.col("_near") | lot).drop("_near")


def first_per_group(df: DataFrame, groups: list[str], key: str = "doc_id") -> DataFrame:
    w = Window.partitionBy(*groups).orderBy(key)
    return df.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def units(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text, boundaries): (doc_id, unit_no, start, text), cut at the boundaries."""
    n = F.length("text")
    inner = F.filter(F.array_sort(F.array_distinct("boundaries")), lambda b: (b > 0) & (b < n))
    edges = F.concat(F.array(F.lit(0).cast("long")), F.transform(inner, lambda b: b.cast("long")), F.array(n.cast("long")))
    df = docs.select("doc_id", "text", edges.alias("e"))
    pieces = F.transform(F.slice("e", 1, F.size("e") - 1), lambda a, i: F.struct(a.alias("start"), F.get("e", i + 1).alias("end")))
    rows = df.select("doc_id", "text", F.posexplode(pieces).alias("unit_no", "u"))
    return rows.select("doc_id", "unit_no", F.col("u.start").alias("start"), F.substr("text", (F.col("u.start") + 1).cast("int"), (F.col("u.end") - F.col("u.start")).cast("int")).alias("text"))


def join_units(units_: DataFrame, *more) -> DataFrame:
    """(doc_id, text, boundaries, ...): a document's units one after another; boundaries are the running lengths. more:
    further aggregates over the units."""
    # The window sums and the groups gather over one shuffle by document.
    w = Window.partitionBy("doc_id").orderBy("unit_no", "text").rowsBetween(Window.unboundedPreceding, 0)
    summed = units_.withColumn("_end", F.sum(F.length("text").cast("long")).over(w))
    rows = F.array_sort(F.collect_list(F.struct("unit_no", "text", "_end")))
    df = summed.groupBy("doc_id").agg(rows.alias("_u"), *more)
    rest = [c for c in df.columns if c not in ("doc_id", "_u")]
    inner = F.slice("_u", 1, F.size("_u") - 1)
    return df.select("doc_id", F.array_join(F.transform("_u", lambda u: u["text"]), "").alias("text"), F.transform(inner, lambda u: u["_end"]).alias("boundaries"), *rest)


def peak_boundaries(logp: DataFrame, docs: DataFrame) -> DataFrame:
    """logp(doc_id, pos, score), docs(doc_id, text, boundaries): docs with the boundaries of the record itself, else those of
    the tops of its log probabilities, else none. The document's start is no boundary."""
    tops = plateau_peaks(logp).where("pos > 0").groupBy("doc_id").agg(F.array_sort(F.collect_set("pos")).alias("_tops"))
    own = F.when(F.size("boundaries") > 0, F.col("boundaries"))
    return docs.join(tops, "doc_id", "left").withColumn("boundaries", F.coalesce(own, "_tops", F.array().cast("array<bigint>"))).drop("_tops")


def char_labels(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text, boundaries): (doc_id, pos, label), a row for each character; 1 at a boundary."""
    marks = docs.select("doc_id", F.explode(F.array_distinct("boundaries")).alias("pos"), F.lit(1).alias("label"))
    places = docs.where(F.length("text") > 0).select("doc_id", F.explode(F.sequence(F.lit(0).cast("long"), F.length("text").cast("long") - 1)).alias("pos"))
    return places.join(marks, ["doc_id", "pos"], "left").withColumn("label", F.coalesce("label", F.lit(0)))


def normalised(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text, boundaries) with the normalised text and the boundaries in it; one between CR and LF moves after
    the pair. doc_id must be unique."""
    moved = F.transform("boundaries", lambda b: F.when(F.substr("text", b.cast("int"), F.lit(2)) == "\r\n", b + 1).otherwise(b))
    return join_units(units(docs.withColumn("boundaries", moved)).withColumn("text", normalize(F.col("text"))))


def top_places(logp: DataFrame, docs: DataFrame, k: int = 15, floor: float = -8.0, around: int = 20) -> DataFrame:
    """A top-k report: of each document the k highest places at or above floor, with the text around them."""
    w = Window.partitionBy("doc_id").orderBy(F.desc("score"), "pos")
    best = logp.where(F.col("score") >= floor).withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)
    start = F.greatest(F.col("pos") - around, F.lit(0)).cast("int")
    return best.join(docs.select("doc_id", "text"), "doc_id").select("doc_id", "place", "pos", "score", F.substr("text", start + 1, F.col("pos").cast("int") - start + around).alias("context"))


def aligned_marks(docs: DataFrame, mark: str = "\u3010SPLIT\u3011") -> DataFrame:
    """docs(doc_id, text, generated): doc_id and boundaries, the places in text where a copy of it with marks has them; the
    copy may have other changes, for which the place after the last common character is taken."""

    @F.pandas_udf("array<bigint>")
    def places(text: pd.Series, generated: pd.Series) -> pd.Series:
        def one(t: str | None, g: str | None) -> list[int]:
            pieces = (g or "").split(mark)
            blocks = difflib.SequenceMatcher(None, t or "", "".join(pieces), autojunk=False).get_matching_blocks()
            out, at = set(), 0
            for p in pieces[:-1]:
                at += len(p)
                out.add(max((b.a + min(b.size, at - b.b) for b in blocks if b.b < at), default=0))
            return sorted(x for x in out if 0 < x < len(t or ""))

        return pd.Series([one(t, g) for t, g in zip(text, generated)])

    return docs.select("doc_id", places("text", "generated").alias("boundaries"))


def hash_split(docs: DataFrame, share: float = 0.08, seed: int = 0) -> DataFrame:
    """docs with `held_out`, about `share` of them, by arithmetic on doc_id."""
    return docs.withColumn("held_out", F.pmod(F.col("doc_id") * 7919 + seed * 104_729, F.lit(10_007)) < int(10_007 * share))


def fit_scorer(lines: DataFrame, names: list[str], weight: float = 12.0) -> LinearScorer:
    """lines(label, features in names, ...): the linear scorer that fits the labels best, positives weighing `weight`; fitted
    by Spark on all rows."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    df = lines.select(*(F.col(n).cast("double").alias(n) for n in names), F.col("label").cast("double").alias("label"), F.when(F.col("label"), weight).otherwise(1.0).alias("weight"))
    model = LogisticRegression(weightCol="weight", maxIter=60).fit(VectorAssembler(inputCols=names, outputCol="features").transform(df))
    return LinearScorer(dict(zip(names, map(float, model.coefficients))), float(model.intercept))
