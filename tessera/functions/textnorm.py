"""Text normalisation that keeps code-point offsets: every fold is one character to one; only the CR of CRLF goes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What each group of characters is folded to.
SPACES = "".join(map(chr, [0x00A0, *range(0x2000, 0x200B), 0x202F, 0x205F, 0x3000, 0x200B, 0x200C, 0x200D, 0xFEFF, 0x2060]))
SINGLE_QUOTES = "\u2018\u2019\u201a\u201b\u2032"
DOUBLE_QUOTES = "\u201c\u201d\u201e\u201f\u2033"
DASHES = "\u2013\u2014\u2015\u2212\u00ad"
BULLETS = "\u2023\u25cf\u25aa\u25e6\u2043\u00b7\u2219"
ELLIPSIS = "\u2026"
BREAKS = "\x0c\x0b\u2028\u2029"

FOLDS = [(SPACES, " "), (SINGLE_QUOTES, "'"), (DOUBLE_QUOTES, '"'), (DASHES, "-"), (BULLETS, "•"), (ELLIPSIS, "."), (BREAKS, "\n")]
FOLD_FROM = "".join(chars for chars, _ in FOLDS)
FOLD_TO = "".join(to * len(chars) for chars, to in FOLDS)

# Digits that are no decimal numbers (superscript, subscript, circled and so on).
MORE_DIGITS = r"²³¹\u1369-\u1371\u19da⁰⁴-⁹₀-₉①-⑨⑴-⑼⒈-⒐⓪⓵-⓽⓿❶-❾➀-➈➊-➒"
DIGIT = rf"[\p{{Nd}}{MORE_DIGITS}]"

#: The look-behind has a run of white space within the text walked once. Java's Unicode white space lacks the four separators that Python's strip() also takes.
STRIP = r"(?U)^[\s\x1c-\x1f]++|(?<![\s\x1c-\x1f])[\s\x1c-\x1f]++$"


def fold_breaks(text: Column) -> Column:
    """CRLF and lone CR as LF."""
    return F.regexp_replace(text, "\r\n?", "\n")


def normalize(text: Column) -> Column:
    return F.translate(fold_breaks(text), FOLD_FROM, FOLD_TO)


def strip(text: Column) -> Column:
    """Without white space at either end, in the Unicode sense."""
    return F.when(text.rlike(r"(?U)^[\s\x1c-\x1f]|[\s\x1c-\x1f]$"), F.regexp_replace(text, STRIP, "")).otherwise(text)


def collapse_space(text: Column) -> Column:
    return strip(F.regexp_replace(text, r"(?U)[\s\x1c-\x1f]+", " "))


def line_shape(seg: Column) -> Column:
    """The layout of a line's first six characters: A upper, a lower, 9 digit, _ space or tab, others as they are."""
    out = F.substring(seg, 1, 6)
    for pattern, to in ((r"\p{javaUpperCase}", "A"), (r"\p{javaLowerCase}", "a"), (DIGIT, "9"), (r"[ \t]", "_")):
        out = F.regexp_replace(out, pattern, to)
    return out


def first_word(seg: Column) -> Column:
    return F.regexp_extract(seg, r"^\s*(\S+)", 1)


def share(part: Column, whole: Column) -> Column:
    """part / whole, and 0 where whole is 0."""
    return F.coalesce(F.try_divide(part, whole), F.lit(0.0))
