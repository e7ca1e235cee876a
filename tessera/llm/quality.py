"""Quality rules as a short-circuit cascade, in DataFrame functions only.

The cost of each rule and the share of documents that it rejects are estimated on a sample; the rules then run in the
order of rejection per cost, and a document that one rejects is not looked at by those after it. All rules must hold, so
the verdict is the same in any order; only the work differs.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch

SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]"
#: Documents in the random sample on which cost and selectivity are estimated, about; code points that a rule is timed
#: over, for which the sample is gone through several times, up to MOST_TURNS; and how often. They decide the order only,
#: never a verdict.
SAMPLE_ROWS = 1000
TIMED_CHARS = 6_000_000
MOST_TURNS = 32
TIMED_RUNS = 2


@dataclass(frozen=True)
class Rule:
    """fails: true for a document that the rule rejects; null counts as false."""

    name: str
    fails: Column


def full_lines(doc: Column) -> Column:
    return F.filter(F.split(doc, "\n"), lambda x: x.rlike(WORD))


def base_counts(doc: Column, lines: Column) -> dict[str, Column]:
    """Counts that no base rule reads, from the text, its lines with a word, and _words, its words."""
    return {
        "word_chars": F.length(F.array_join("_words", "")).cast("long"),
        "n_symbols": F.regexp_count(doc, F.lit(r"[#*$%&|<>]")).cast("long"),
        "n_lines": F.size(lines).cast("long"),
        "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
    }


def with_base(df: DataFrame, text: str = "text") -> DataFrame:
    """df with n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words and base_failed; _words holds the words.

    word_chars: code points in words. n_symbols: characters of #*$%&|<>. n_lines: \\n-split lines with a word; n_dup_lines:
    those equal to an earlier one. n_repeat_words: words in 5-word windows found twice or more in the text, the first time
    included; windows are told apart by 64-bit hashes. A null or empty text has 0 of each, and fails.
    """
    doc = F.coalesce(F.col(text), F.lit(""))
    df = df.withColumns({"_words": F.filter(F.split(doc, SPACE + "+"), lambda w: w != ""), "_lines": full_lines(doc)})
    n = F.size("_words")
    windows = F.transform(F.sequence(F.lit(0), n - 5), lambda i: F.xxhash64(*(F.get("_words", i + k) for k in range(5))))
    df = df.withColumn("_windows", F.when(n >= 6, windows))
    repeats = F.size(F.array_distinct("_windows")) < F.size("_windows")
    df = df.withColumn("_pairs", F.when(repeats, F.sort_array(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    found = F.filter("_pairs", lambda x, k: F.coalesce(F.when(k > 0, F.get("_pairs", k - 1)["h"] == x["h"]), F.lit(False)) | F.coalesce(F.get("_pairs", k + 1)["h"] == x["h"], F.lit(False)))
    df = df.withColumn("_spots", F.sort_array(F.transform(found, lambda x: x["i"])))
    start = F.struct(F.lit(0).alias("n"), F.lit(-1).alias("to"))
    words = F.aggregate("_spots", start, lambda a, i: F.struct((a["n"] + F.least(F.lit(5), i + 4 - a["to"])).alias("n"), (i + 4).alias("to")), lambda a: a["n"])
    df = df.withColumns({"n_words": n.cast("long"), **base_counts(doc, F.col("_lines")), "n_repeat_words": F.coalesce(words, F.lit(0)).cast("long")})
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return df.drop("_lines", "_windows", "_pairs", "_spots").withColumn("base_failed", failed)


def default_rules(text: str = "text", counted: bool = True) -> list[Rule]:
    """counted: the counts of with_base() are computed for every document anyway; else a rule computes what it needs, and
    only for the documents that come to it."""
    doc, n = F.coalesce(F.col(text), F.lit("")), F.col("n_words")
    count = {k: F.col(k) if counted else c for k, c in base_counts(doc, full_lines(doc)).items()}
    letters = F.regexp_count(doc, F.lit(r"\p{L}"))
    stutter = F.size(F.filter("_words", lambda w, i: (i > 0) & (w == F.get("_words", i - 1))))
    return [
        Rule("symbols", count["n_symbols"] > 0.25 * n),
        Rule("duplicate_lines", count["n_dup_lines"] > 0.5 * count["n_lines"]),
        Rule("word_length", (count["word_chars"] < 2 * n) | (count["word_chars"] > 25 * n)),
        Rule("shouting", F.regexp_count(doc, F.lit("!")) > 0.5 * n),
        Rule("capitals", F.regexp_count(doc, F.lit(r"\p{Lu}")) > 0.7 * letters),
        Rule("stutter", stutter > 0.5 * n),
    ]


def order_rules(spark: SparkSession, docs: DataFrame, rules: list[Rule], text: str = "text") -> list[Rule]:
    """The rules by rejection per cost, as measured on a random sample of the documents that pass the base rules, which are
    those that the cascade sees; rules that reject nothing come last, the cheapest first.

    Cost is the time beyond that of a run without a rule, the least of TIMED_RUNS, over so much text that a job's own time
    doesn't decide; differences of a twentieth of that time count as none.
    """
    s = Scratch(spark)
    rows = docs.count()
    part = docs.sample(min(1.0, 2 * SAMPLE_ROWS / rows), 7) if rows else docs
    sample = s.table(with_base(part, text).withColumn("_ok", held(~F.col("base_failed"))).where("_ok"), "rules")
    size = sample.agg(F.count(F.lit(1)).alias("n"), F.sum(F.length(text)).alias("chars")).first()
    turns = max(1, min(MOST_TURNS, -(-TIMED_CHARS // max(size["chars"] or 0, 1))))
    rejected = sample.agg(*(F.count_if(r.fails).alias(f"r{k}") for k, r in enumerate(rules))).first()
    over = sample.withColumn("_turn", F.explode(F.sequence(F.lit(1), F.lit(turns))))

    def took(*tests: Column) -> float:
        best = float("inf")
        for _ in range(TIMED_RUNS):
            began = time.monotonic()
            over.agg(F.count(F.lit(1)), *(F.count_if(t) for t in tests)).collect()
            best = min(best, time.monotonic() - began)
        return best

    idle = took()
    rated = []
    for k, r in enumerate(rules):
        cost = max(took(r.fails) - idle, 0.05 * idle)
        rated.append((-rejected[f"r{k}"] / cost, cost, k, r))
    s.drop("rules")
    return [r for *_, r in sorted(rated, key=lambda x: x[:3])]


def cascade(rules: list[Rule]) -> Column:
    """The name of the first rule that rejects, else null. A rule after it isn't evaluated."""
    first = F.lit(None).cast("string")
    for r in reversed(rules):
        first = F.when(r.fails, r.name).otherwise(first)
    return first


def held(test: Column) -> Column:
    """test, as a value that filters aren't pushed below. Pushed down, a filter would write out the expressions of the
    columns it reads once for each use, within loops over words too; a row number in the projection prevents it."""
    return test & (F.monotonically_increasing_id() >= 0)


def judge(spark: SparkSession, docs: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """docs(doc_id, text, ...): a row for each row of docs with doc_id, the base counts, base_failed and kept.

    kept: false if base_failed, else whether no rule rejects. Null and empty texts have counts of 0 and aren't kept.
    Repeated rows are each judged; other columns are ignored; an empty table gives an empty result.
    """
    rows = docs.select(F.col("doc_id").alias("doc_id"), F.col("text").alias("text"))
    ordered = order_rules(spark, rows, rules or default_rules())
    df = with_base(rows)
    kept = F.when(F.col("base_failed"), False).otherwise(cascade(ordered).isNull())
    return df.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", held(F.col("base_failed")).alias("base_failed"), held(kept).alias("kept"))


def keep_good(spark: SparkSession, docs: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """The rows of docs that judge() keeps, in docs' columns, which may have any names."""
    ordered = order_rules(spark, docs.select(docs["text"].alias("_text")), rules or default_rules("_text", counted=False), "_text")
    df = with_base(docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("_doc"), docs["text"].alias("_text")), "_text")
    return df.withColumn("_kept", held(~F.col("base_failed") & cascade(ordered).isNull())).where("_kept").select("_doc.*")
