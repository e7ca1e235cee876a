"""Text augmentation: scalar transforms, chosen by a hash of the unit; boundaries follow from the new lengths."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .labels import join_units, units

# Latin letters with and without their accents.
ACCENTED = "áàâãäéèêëíìîïóòôõöúùûüçñÁÀÂÃÄÉÈÊËÍÌÎÏÓÒÔÕÖÚÙÛÜÇÑ"
PLAIN = "aaaaaeeeeiiiiooooouuuucnAAAAAEEEEIIIIOOOOOUUUUCN"
PUNCTUATION = ",;:!?\"'()[]"


def strip_accents(t: Column) -> Column:
    return F.translate(t, ACCENTED, PLAIN)


def strip_markdown(t: Column) -> Column:
    for pattern, to in ((r"\*\*|__|`", ""), (r"(?m)^\s*#{1,6}\s+", ""), (r"(?m)^(\s*)[-*•]\s+", "$1")):
        t = F.regexp_replace(t, pattern, to)
    return t


def drop_punct(t: Column) -> Column:
    return F.translate(t, PUNCTUATION, "")


def asr_style(t: Column) -> Column:
    return F.lower(F.translate(t, PUNCTUATION + ".", ""))


def unicode_punct(t: Column) -> Column:
    t = F.replace(F.replace(t, F.lit(" - "), F.lit(" – ")), F.lit("..."), F.lit("…"))
    return F.regexp_replace(t, r'"([^"\n]*)"', "“$1”")


def tabify(t: Column) -> Column:
    return F.regexp_replace(t, r"(?m)^  ", "\t")


def crlf(t: Column) -> Column:
    return F.replace(t, F.lit("\n"), F.lit("\r\n"))


def bullet_swap(t: Column, glyph: str = "•") -> Column:
    return F.regexp_replace(t, r"(?m)^(\s*)[-*•▸‣](\s)", f"$1{glyph}$2")


def header_upper(t: Column) -> Column:
    """The first line in capitals if it is a Markdown heading."""
    rest = F.regexp_replace(t, r"^[^\n]*", "")
    line = F.regexp_extract(t, r"^[^\n]*", 0)
    return F.when(line.rlike(r"^#{1,6}\s"), F.concat(F.upper(F.regexp_replace(line, r"^#{1,6}\s+", "")), rest)).otherwise(t)


def squeeze_blanks(t: Column) -> Column:
    return F.regexp_replace(t, r"\n{2,}", "\n")


def pad_blanks(t: Column) -> Column:
    return F.regexp_replace(t, r"\n\n", "\n\n\n")


def trailing_spaces(t: Column) -> Column:
    return F.replace(t, F.lit("\n"), F.lit("  \n"))


def nbsp(t: Column) -> Column:
    """Every seventh space as U+00A0."""
    return F.regexp_replace(t, r"((?:[^ ]* ){6}[^ ]*) ", "$1 ")


def rewrap(t: Column, width: int = 60) -> Column:
    """Lines of at most `width`, broken at spaces; a longer word has a line of its own."""
    return F.regexp_replace(t, rf"([^\n]{{1,{width}}}|[^\s]+)(?: +|(?=\n)|$)", "$1\n")


def one_to_one(t: Column, f: Callable[[Column], Column]) -> Column:
    """f of the text; where that changes its length, of each character that f makes one of, the others staying as they are."""
    each = F.transform(F.split(t, ""), lambda c: F.when(F.length(f(c)) == F.length(c), f(c)).otherwise(c))
    return F.when(F.length(f(t)) == F.length(t), f(t)).otherwise(F.array_join(each, ""))


def to_upper(t: Column) -> Column:
    return one_to_one(t, F.upper)


def to_lower(t: Column) -> Column:
    return one_to_one(t, F.lower)


def mangle_words(t: Column) -> Column:
    """A space into the fourth place of each tenth word of seven letters or more, as a scanner does."""
    return F.regexp_replace(t, r"((?:\S+\s+){9})(\p{L}{3})\p{L}(\p{L}{3,})", "$1$2 $3")


#: Name, transform, share of units in 1/100.
TRANSFORMS: list[tuple[str, Callable[[Column], Column], int]] = [
    ("strip_accents", strip_accents, 16), ("to_upper", to_upper, 5), ("to_lower", to_lower, 6), ("strip_markdown", strip_markdown, 16),
    ("drop_punct", drop_punct, 6), ("asr_style", asr_style, 6), ("unicode_punct", unicode_punct, 12), ("tabify", tabify, 6), ("bullet_swap", bullet_swap, 10),
    ("header_upper", header_upper, 14), ("rewrap", rewrap, 16), ("squeeze_blanks", squeeze_blanks, 8), ("pad_blanks", pad_blanks, 6),
    ("trailing_spaces", trailing_spaces, 10), ("nbsp", nbsp, 6),
]


def renumber(t: Column, u: Column) -> Column:
    """The number of each enumerated line replaced by the unit's place."""
    number = F.concat(F.lit("$1"), (u + 1).cast("string"), F.lit("$2"))
    return F.regexp_replace(t, F.lit(r"(?m)^(\s*)\d+([.)]\s)"), number)


def header_styles(t: Column, style: Column) -> Column:
    """A first line that is a Markdown heading as plain text, underlined, in capitals or numbered: style 0 to 3."""
    line, rest = F.regexp_extract(t, r"^[^\n]*", 0), F.regexp_replace(t, r"^[^\n]*", "")
    bare = F.regexp_replace(line, r"^#{1,6}\s+", "")
    new = F.when(style == 0, bare).when(style == 1, F.concat(bare, F.lit("\n"), F.repeat(F.lit("="), F.length(bare)))).when(style == 2, F.upper(bare)).otherwise(F.concat(F.lit("1. "), bare))
    return F.when(line.rlike(r"^#{1,6}\s"), F.concat(new, rest)).otherwise(t)


def noisy_wrap(t: Column, width: int = 48) -> Column:
    """Lines of at most `width`; where a word would not fit, its first letters stay on the line before, as in a bad scan. No
    character but white space is lost or made."""
    return F.regexp_replace(F.regexp_replace(t, r"[ \n]+", " "), rf"(.{{{width // 2},{width}}})", "$1\n")


def augment(docs: DataFrame, seed: int = 0, least: int = 80, transforms: list[tuple[str, Callable[[Column], Column], int]] = TRANSFORMS, most: int = 3) -> DataFrame:
    """docs(doc_id, text, boundaries): each unit through the transforms that arithmetic on its document's and its own number
    draws, up to `most`; documents that end up shorter than `least` go. Returns (doc_id, text, boundaries, transforms)."""
    df = units(docs).withColumn("names", F.array().cast("array<string>"))
    for k, (name, f, part) in enumerate(transforms):
        drawn = (F.pmod(F.col("doc_id") * 31 + F.col("unit_no") * 17 + (k + 1) * (seed + 7) * 13, F.lit(100)) < part) & (F.size("names") < most)
        df = df.withColumns({"_d": drawn}).withColumns({"text": F.when(F.col("_d"), f(F.col("text"))).otherwise(F.col("text")), "names": F.when(F.col("_d"), F.array_append("names", F.lit(name))).otherwise(F.col("names"))})
    used = F.array_sort(F.array_distinct(F.flatten(F.collect_list("names"))))
    return join_units(df, used.alias("transforms")).where(F.length("text") >= least)


def noisy_pages(docs: DataFrame, page: int = 1000) -> DataFrame:
    """docs(doc_id, text): a running page number and a form feed after the line break that ends each page of about `page`."""
    parts = F.regexp_extract_all("text", F.lit(rf"(?s:.{{1,{page}}})[^\n]*(?:\n|\z)"), F.lit(0))
    numbered = F.transform("_parts", lambda p, k: F.when(p.endswith("\n"), F.concat(p, F.lit("\n- "), (k + 1).cast("string"), F.lit(" -\n\f\n"))).otherwise(p))
    return docs.withColumn("_parts", parts).withColumn("text", F.array_join(numbered, "")).drop("_parts")
