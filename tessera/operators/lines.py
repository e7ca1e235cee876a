"""Lines of documents and their features. A document costs a row for each line.

Rows of one document are told by doc_row, a number of the input row, so that repeated and null ids do no harm. All windows
are dealt by it, in the order of lines or against it, so one shuffle serves all features.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.predicates import ALL, CAPS_TOKEN, fires
from tessera.functions.textnorm import DIGIT, first_word, line_shape, normalize, share, strip


#: Columns of a part of a long document, which its lines keep: the document's row, the part's number and offset.
PART = ("doc", "part", "base")


def with_row(docs: DataFrame) -> DataFrame:
    """docs with doc_row, a number for each row, unless there is one."""
    return docs if "doc_row" in docs.columns else docs.withColumn("doc_row", F.monotonically_increasing_id())


def split_lines(docs: DataFrame, text: str = "text", carry: bool = False) -> DataFrame:
    """docs(doc_id, text) as (doc_row, doc_id, line_no, start, seg, st): a row for each line of the normalised text.

    start: the offset of the line's first character in code points, a running sum over the document's lines. A document
    that ends with a line break has an empty last line; a null text has no line. Repeated rows, and rows without an id, are
    documents of their own. carry: the first line has the document's text in the column `text`.
    """
    also = [c for c in PART if c in docs.columns]
    parts = with_row(docs).select("doc_row", "doc_id", *also, F.col(text).alias("_text"), F.split(normalize(F.col(text)), "\n").alias("_segs"))
    # Not posexplode(): Spark would put a filter on its array before it, and normalise the text anew for that.
    rows = parts.select("doc_row", "doc_id", *also, "_text", F.posexplode_outer("_segs").alias("line_no", "seg")).where("seg is not null")
    before = F.sum(F.length("seg") + 1).over(by_line().rowsBetween(Window.unboundedPreceding, -1))
    own = [F.when(F.col("line_no") == 0, F.col("_text")).alias("text")] if carry else []
    rows = rows.select("doc_row", "doc_id", *also, "line_no", "seg", *own)
    return rows.select("doc_row", "doc_id", *also, "line_no", F.coalesce(before, F.lit(0)).cast("long").alias("start"), "seg", strip(F.col("seg")).alias("st"), *(["text"] if carry else []))


def by_line():
    return Window.partitionBy("doc_row").orderBy("line_no")


def before():
    return by_line().rowsBetween(Window.unboundedPreceding, -1)


def after():
    """The lines after, the nearest last: the order is turned, since a frame that runs to the end is summed up anew for
    each row."""
    return Window.partitionBy("doc_row").orderBy(F.desc("line_no")).rowsBetween(Window.unboundedPreceding, -1)


def nearest(value: Column, frame) -> Column:
    return F.last(value, ignorenulls=True).over(frame)


def in_code(lines: DataFrame) -> DataFrame:
    """lines with fence, nf (earlier fence lines) and in_code: a fence line, or one between an opening and its closing."""
    lines = lines.withColumn("fence", fires("fence"))
    earlier = F.coalesce(F.sum(F.col("fence").cast("int")).over(before()), F.lit(0))
    return lines.withColumn("nf", earlier.cast("long")).withColumn("in_code", F.col("fence") | (F.col("nf") % 2 == 1))


def with_predicates(lines: DataFrame) -> DataFrame:
    """lines with a column line_<name> for each predicate and for what is put together of some, false on blank and fence
    lines."""
    plain = (F.col("st") != "") & ~F.col("fence")
    flags = {name: p.spark() for name, p in ALL.items() if name != "fence"}
    n, words = F.length("st"), F.filter(F.split("st", r"(?U)[\s\x1c-\x1f]+"), lambda w: w != "")
    caps = F.regexp_extract_all("seg", F.lit(CAPS_TOKEN), F.lit(0))
    capital = F.size(F.filter(words, lambda w: w.rlike(r"^\p{javaUpperCase}")))
    flags |= {
        "date": flags["date"] | flags["month"] | (flags["year"] & flags["year_context"]),
        "ends_sent": flags["ends_sent"] | flags["ends_q"],
        "table": (n - F.length(F.replace("st", F.lit("|"))) >= 2) | flags["table_sep"],
        "allcaps": (F.size(caps) >= 2) & (F.length(F.array_join(caps, "")) > 0.55 * n),
        "indent": F.substring("seg", 1, 1).isin(" ", "\t"),
        "has_q": F.col("st").contains("?") | F.col("st").contains("¿"),
        "short_caps": n.between(2, 60) & ~F.col("st").rlike("[.!?;:,]$") & (2 * capital >= F.size(words)),
        "starts_lower": F.col("st").rlike(r"^\p{javaLowerCase}"),
        "ends_hyphen": F.col("st").endswith("-"),
        "ends_comma": F.col("st").endswith(","),
    }
    return lines.withColumns({f"line_{name}": plain & F.coalesce(c, F.lit(False)) for name, c in flags.items()})


def with_counts(lines: DataFrame) -> DataFrame:
    """Letter, digit, upper-case and punctuation counts of each line, without exploding it."""
    count = lambda pattern: F.regexp_count(F.col("seg"), F.lit(pattern)).cast("long")
    lines = lines.withColumns({"n_alpha": count(r"\p{L}"), "n_digit": count(DIGIT), "n_upper": count(r"\p{Lu}"), "n_space": count(r"[ \t]")})
    lines = lines.withColumn("n_punct", F.length("seg").cast("long") - F.col("n_alpha") - F.col("n_digit") - F.col("n_space"))
    size = F.greatest(F.length("st"), F.lit(1))
    plain = (F.col("st") != "") & ~F.col("fence")
    return lines.withColumns(
        {
            "line_digit_frac": F.col("n_digit") / size,
            "line_upper_frac": F.col("n_upper") / F.greatest(F.col("n_alpha"), F.lit(1)),
            "line_punct_frac": F.col("n_punct") / size,
            "line_all_lower": (F.col("n_alpha") > 0) & (F.col("n_upper") == 0),
            "line_no_alpha": F.col("n_alpha") == 0,
            "line_word_count": F.when(plain, F.least(F.size(F.split("st", r"(?U)[\s\x1c-\x1f]+")) / 40, F.lit(1.0))).otherwise(0.0),
            "line_indent_depth": F.when(plain, F.least((F.length("seg") - F.length(F.regexp_replace("seg", r"^[ \t]+", ""))) / 8, F.lit(1.0))).otherwise(0.0),
            "line_len": F.least(F.length("st") / 300, F.lit(1.0)),
        }
    )


def clip(c: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))


def with_neighbours(lines: DataFrame) -> DataFrame:
    """What a line owes to its neighbours: blank runs, and the previous and next line that isn't blank."""
    full = F.col("st") != ""
    facts = {
        "no": F.col("line_no"), "n": F.length("st"), "shape": line_shape(F.col("seg")), "word": first_word(F.col("seg")), "ends": F.col("line_ends_sent"),
        "open": F.col("st").rlike(r"[\p{javaLowerCase},;-]$"), "lower": F.col("line_starts_lower"), "setext": F.col("line_setext"),
    }
    # A column for each, so that those that no feature asks for aren't computed.
    lines = lines.withColumns({f"_f_{k}": F.when(full, v) for k, v in facts.items()} | {"_blank": ~full})
    lines = lines.withColumns({f"_p_{k}": nearest(F.col(f"_f_{k}"), before()) for k in facts} | {"_lag": F.lag("_blank").over(by_line())})
    lines = lines.withColumns({f"_n_{k}": nearest(F.col(f"_f_{k}"), after()) for k in facts})
    both = lambda side, fact: F.coalesce(F.col(f"_f_{fact}") == F.col(f"{side}_{fact}"), F.lit(False))
    delta = lambda side: F.when(F.col(f"{side}_n").isNotNull(), clip((F.length("st") - F.col(f"{side}_n")) / 80, -1.0, 1.0)).otherwise(0.0)
    out = lines.withColumns(
        {
            "line_blank": ~full,
            "line_after_blank": F.coalesce("_lag", F.lit(False)),
            "prev_line_ends_sent": F.coalesce(F.col("_p_ends"), F.lit(False)),
            "prev_line_ends_open": F.coalesce(F.col("_p_open"), F.lit(False)),
            "next_line_starts_lower": F.coalesce(F.col("_n_lower"), F.lit(False)),
            "line_has_setext_under": full & F.coalesce(F.col("_n_setext") & (F.col("_n_no") == F.col("line_no") + 1), F.lit(False)),
            "line_repeat_prev": both("_p", "shape"),
            "line_repeat_next": both("_n", "shape"),
            "line_same_firstword_prev": both("_p", "word"),
            "line_len_delta_prev": delta("_p"),
            "line_len_delta_next": delta("_n"),
            "line_blank_run": F.least((F.col("line_no") - F.coalesce(F.col("_p_no"), F.lit(-1)) - 1) / 3, F.lit(1.0)),
        }
    )
    return out.drop("_lag", "_blank", *(f"_{side}_{k}" for side in "fpn" for k in facts))


def with_document(lines: DataFrame) -> DataFrame:
    """What a line owes to its document: its place, and its length against the mean."""
    w = Window.partitionBy("doc_row")
    full = F.col("st") != ""
    lines = lines.withColumns({"n_lines": F.count(F.lit(1)).over(w), "n_blank": F.sum((~full).cast("long")).over(w), "mean_len": F.coalesce(F.avg(F.when(full, F.length("st"))).over(w), F.lit(0.0))})
    return lines.withColumns(
        {
            "line_idx_frac": F.col("line_no") / F.greatest(F.col("n_lines") - 1, F.lit(1)),
            "line_len_ratio": clip(F.length("st") / F.greatest(F.col("mean_len"), F.lit(1.0)) / 2, 0.0, 1.0),
            "doc_n_lines": F.least(F.log1p("n_lines") / 8, F.lit(1.0)),
            "doc_blank_frac": share(F.col("n_blank"), F.col("n_lines")),
            "doc_mean_line_len": F.least(F.col("mean_len") / 120, F.lit(1.0)),
        }
    )


def features(docs: DataFrame, text: str = "text", carry: bool = False) -> DataFrame:
    """All line features of docs, in one pass over lines dealt by document; columns that aren't used cost nothing."""
    df = with_document(with_neighbours(with_counts(with_predicates(in_code(split_lines(docs, text, carry))))))
    return df.withColumns({"line_fence": F.col("fence"), "line_in_code": F.col("in_code")})
