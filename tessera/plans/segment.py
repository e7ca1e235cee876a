"""The segmentation engine: documents to chunks, as one declarative plan."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.config import ChunkerConfig
from tessera.operators import assemble, chars, lines, scoring, spans

POINTS, SPANS, PEAKS = "array<bigint>", "array<struct<s:bigint,e:bigint>>", "array<struct<pos:bigint,score:double>>"


@dataclass(frozen=True)
class SegmentEngine:
    """Lines are scored with DataFrame functions; of each piece, a document or a part of a long one, the candidates and the
    protected spans are gathered, two small arrays, beside its text. One shuffle by piece serves all of it.

    char_scorer: scores (big, small) of each character from all features. It is blended into the lines' scores, gives
    boundaries to long pieces without any, and places to cut chunks that are too long. Its plan reads the documents more
    than once, so they must be a table that gives the same rows in the same order each time.
    """

    config: ChunkerConfig = field(default_factory=ChunkerConfig)
    scorer: object = field(default_factory=scoring.LinearScorer)
    char_scorer: scoring.MlpScorer | None = None

    def of_characters(self) -> bool:
        return self.char_scorer is not None or bool(chars.OF_CHARACTERS.intersection(getattr(self.scorer, "names", ())))

    def char_scores(self, features: DataFrame) -> DataFrame:
        """chars.features() with big and small, the scores of a boundary and of a place to cut."""
        return self.char_scorer.outputs(features).withColumns({"big": F.get("outputs", F.lit(0)), "small": F.get("outputs", F.lit(1))}).drop("outputs")

    def line_scores(self, docs: DataFrame, carry: bool = False) -> DataFrame:
        """lines.features() with `score`; with a network over characters' features, those of each line's first one, which a scorer of lines alone needs no row
        for each character for."""
        rows = lines.features(docs, carry=carry)
        if not self.of_characters():
            return self.scorer.score(rows)
        if not self.char_scorer:
            return self.scorer.score(chars.line_starts(rows))
        return self.scored(self.char_scores(chars.features(docs, lines=rows))).where(F.col("seg") != "")

    def scored(self, features: DataFrame) -> DataFrame:
        """Of char_scores() the lines' first characters, with `score`."""
        rows = self.scorer.score(features.where((F.col("pos") == F.col("start")) & (F.col("ch") != "\n")))
        return rows.withColumn("score", scoring.blend(F.col("score"), F.col("big"), self.config.char_blend))

    def line_boundaries(self, docs: DataFrame, threshold: float | None = None) -> DataFrame:
        """(doc_id, pos, score): the scorer's own boundaries in the normalised text, without any assembly."""
        t = self.config.big_threshold if threshold is None else threshold
        return self.line_scores(docs).where((F.col("seg") != "") & (F.col("start") > 0) & (F.col("score") >= t)).select("doc_id", F.col("start").alias("pos"), "score")

    def windows(self, docs: DataFrame) -> DataFrame:
        """docs(doc_id, text) as (doc_id, doc, part, base, text, doc_row): each text in parts of at most window_chars, cut
        after the last line break in a part's second half, else the last white space there, or where it is full. base: the part's offset."""
        w = self.config.window_chars
        parts = F.regexp_extract_all("text", F.lit(rf"(?s).{{1,{w}}}\z|.{{{w // 2},{w - 1}}}\n|.{{{w // 2},{w - 1}}}\s|.{{1,{w}}}"), F.lit(0))
        start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<bigint>").alias("b"))
        bases = F.aggregate("_parts", start, lambda a, p: F.struct((a["at"] + F.length(p)).alias("at"), F.array_append(a["b"], a["at"]).alias("b")), lambda a: a["b"])
        df = docs.select("doc_id", F.monotonically_increasing_id().alias("doc"), parts.alias("_parts")).withColumn("_bases", bases)
        df = df.select("doc_id", "doc", F.posexplode(F.arrays_zip("_parts", "_bases")).alias("part", "p"))
        return lines.with_row(df.select("doc_id", "doc", "part", F.col("p._bases").alias("base"), F.col("p._parts").alias("text")))

    def gathered(self, pieces: DataFrame) -> DataFrame:
        """pieces(doc_row, doc_id, text, ...) as (doc_row, doc_id, text, points, spans, peaks, ...), with lines.PART if there."""
        cfg, none = self.config, lambda kind: F.array().cast(kind)
        keys = ["doc_row", "doc_id", *(c for c in lines.PART if c in pieces.columns)]
        rows = lines.features(pieces, carry=True)
        with_text = spans.with_spans(rows)
        if self.char_scorer:
            features = self.char_scores(chars.features(pieces, lines=rows.drop("text")))
            scores = self.scored(features)
        elif self.of_characters():
            scores = self.scorer.score(chars.line_starts(rows.drop("text")))
        else:
            scores = with_text = self.scorer.score(with_text)
        steps = scoring.DEFAULT_STEPS if cfg.adaptive else ()
        # Candidates as flags on the lines that they come from: no join brings them together with the text.
        flagged = scoring.flagged(scores, cfg.big_threshold, steps)
        point = F.when(F.col("candidate") & (F.col("start") > 0), F.col("start"))
        span = F.when(F.col("span").isNotNull(), F.struct(F.col("span.s").alias("s"), F.col("span.e").alias("e")))
        whole = [F.first("text", ignorenulls=True).alias("text"), F.sort_array(F.collect_list(span)).alias("spans")]
        points = F.sort_array(F.collect_list(point)).alias("points")
        if not self.of_characters():
            return flagged.groupBy(*keys).agg(*whole, points).withColumn("peaks", none(PEAKS))
        out = with_text.groupBy(*keys).agg(*whole, F.max(F.col("start") + F.length("seg")).alias("_n"))
        out = out.join(flagged.groupBy("doc_row").agg(points), "doc_row", "left").withColumn("points", F.coalesce("points", none(POINTS)))
        if not self.char_scorer:
            return out.drop("_n").withColumn("peaks", none(PEAKS))
        small = scoring.local_maxima(features.select("doc_row", "pos", F.col("small").alias("score")), cfg.small_threshold).groupBy("doc_row").agg(F.sort_array(F.collect_list(F.struct("pos", "score"))).alias("peaks"))
        big = scoring.local_maxima(features.select("doc_row", "pos", F.col("big").alias("score")), cfg.big_threshold).groupBy("doc_row").agg(F.sort_array(F.collect_list("pos")).alias("_big"))
        out = out.join(small, "doc_row", "left").join(big, "doc_row", "left")
        bare = (F.size("points") == 0) & (F.col("_n") > cfg.max_chunk_chars) & F.col("_big").isNotNull()
        return out.withColumns({"points": F.when(bare, F.col("_big")).otherwise(F.col("points")), "peaks": F.coalesce("peaks", none(PEAKS))}).drop("_n", "_big")

    def cuts(self, docs: DataFrame, slices: bool = True) -> DataFrame:
        """docs(doc_id, text): (doc_id, base, before, cuts) of each piece: its chunks, in offsets of the piece and with their
        slices of it, the piece's offset, and the number of chunks of the document's pieces before it."""
        size = F.coalesce(F.length("text"), F.lit(0))
        # Rows are numbered before the filter, which thus reads the text that a plan makes instead of making it once more.
        docs = lines.with_row(docs.select("doc_id", "text"))
        short = self.gathered(docs.where(size <= self.config.window_chars)).withColumn("first", F.lit("start"))
        short = assemble.assemble(short.drop("doc_row"), self.config, slices).select("doc_id", F.lit(0).cast("long").alias("base"), F.lit(0).cast("long").alias("before"), "cuts")
        # Long documents have a plan of their own, since only they need their parts counted: a second, small shuffle.
        pieces = self.windows(docs.where(size > self.config.window_chars))
        long = self.gathered(pieces).withColumn("first", F.when(F.col("part") == 0, "start").otherwise("big"))
        long = assemble.assemble(long.drop("doc_row"), self.config, slices)
        earlier = F.sum(F.size("cuts").cast("long")).over(Window.partitionBy("doc").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
        return short.union(long.select("doc_id", "base", F.coalesce(earlier, F.lit(0)).alias("before"), "cuts"))

    def rows(self, docs: DataFrame, slices: bool = True) -> DataFrame:
        """(doc_id, chunk_no, base, s, e, kind, text) of each chunk; text is its own, if asked for."""
        rows = self.cuts(docs, slices).select("doc_id", "base", "before", F.posexplode("cuts").alias("k", "c"))
        return rows.select("doc_id", (F.col("before") + F.col("k")).cast("int").alias("chunk_no"), "base", F.col("c.start").alias("s"), F.col("c.end").alias("e"), F.col("c.kind").alias("kind"), *([F.col("c.text").alias("text")] if slices else []))

    def chunk(self, docs: DataFrame) -> DataFrame:
        """docs(doc_id, text): (doc_id, chunk_no, start, end, kind, text, n_chars). Each text is an exact slice of the
        original without white space at its ends; a null or blank document has no chunk. Repeated rows, and rows without an
        id, are chunked each for itself."""
        size = F.col("e") - F.col("s")
        return self.rows(docs).select("doc_id", "chunk_no", (F.col("base") + F.col("s")).cast("int").alias("start"), (F.col("base") + F.col("e")).cast("int").alias("end"), "kind", "text", size.alias("n_chars"))

    def places(self, docs: DataFrame) -> DataFrame:
        """(doc_id, chunk_no, start, end) of each chunk, without its text."""
        rows = self.rows(docs, slices=False)
        return rows.select("doc_id", "chunk_no", (F.col("base") + F.col("s")).cast("int").alias("start"), (F.col("base") + F.col("e")).cast("int").alias("end"))

    def boundaries(self, docs: DataFrame) -> DataFrame:
        """(doc_id, pos, kind): where each chunk but the first starts, in the original text."""
        return self.rows(docs, slices=False).where("chunk_no > 0").select("doc_id", (F.col("base") + F.col("s")).cast("long").alias("pos"), "kind")


def engine_of(config: ChunkerConfig | None = None, line_weights: str | None = None, char_weights: str | None = None) -> SegmentEngine:
    """An engine from files of weights that were made for all features (chars.NAMES); without any, the linear scorer."""
    scorer = scoring.published(line_weights) if line_weights else scoring.LinearScorer()
    return SegmentEngine(config or ChunkerConfig(), scorer, scoring.published(char_weights) if char_weights else None)


def chunk(docs: DataFrame, config: ChunkerConfig | None = None, line_weights: str | None = None, char_weights: str | None = None) -> DataFrame:
    return engine_of(config, line_weights, char_weights).chunk(docs)
