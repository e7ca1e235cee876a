"""Features of every character. Lines carry their own and are exploded to characters, so lines and characters need no join
and one shuffle by document serves both."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.textnorm import DIGIT
from tessera.session import small_batches

from . import places
from .lines import after, before, by_line, clip, features as line_features, nearest

# The features in the order in which networks take them.
NAMES = tuple(
    """L D SP NL PUNC UPP TERM EOSC QUOTE LBRACK RBRACK ACC prev_L next_L prev_SP next_SP prev_NL next_NL prev_TERM next_TERM
    prev_UPP next_UPP prev_D next_D eos_here prev_eos next_eos eos_peak nl_end para_start para_end line_after_blank line_blank
    line_enum line_bullet line_hash line_dash line_upper_word line_allcaps line_title line_indent line_colon line_ends_q
    line_has_q line_qword line_ends_sent prev_line_ends_sent line_date line_time line_field line_short_caps line_bold_field
    line_starts_lower line_ends_hyphen line_ends_comma prev_line_ends_open next_line_starts_lower line_table line_fence
    line_in_code line_bquote line_setext line_has_setext_under line_hr line_page_num line_url line_speaker line_legal
    line_roman_enum line_ref line_two_col line_kv line_all_lower line_no_alpha line_repeat_prev line_repeat_next
    line_same_firstword_prev line_indent_depth line_digit_frac line_upper_frac line_punct_frac line_word_count line_len_ratio
    line_len_delta_prev line_len_delta_next line_blank_run line_idx_frac chars_since_nl line_len is_line_end chars_since_sent
    sent_len at_sent_start dist_to_term word_len_cur in_word open_paren doc_pos near_end doc_n_lines doc_blank_frac
    doc_mean_line_len""".split()
)
#: Those that a line doesn't have of itself.
OF_CHARACTERS = frozenset(n for n in NAMES if not n.startswith(("line_", "prev_line_", "next_line_", "doc_")) or n == "doc_pos")
# Accented letters.
ACCENTS = "áàâãéêíóôõúüçÁÀÂÃÉÊÍÓÔÕÚÜÇñÑ"
#: Each class as a pattern of one character.
CLASSES = {
    "L": r"\p{L}", "D": DIGIT, "SP": r"[ \t]", "NL": r"\n", "UPP": r"\p{Lu}", "TERM": r"[.!?;:]", "EOSC": r"[.!?]", "QUOTE": r"[\"']",
    "LBRACK": r"[(\[{«]", "RBRACK": r"[)\]}»]", "ACC": f"[{ACCENTS}]",
}


def schema_digest() -> str:
    """What weights carry to say which features they were made for."""
    return hashlib.sha1("|".join(NAMES).encode()).hexdigest()[:12]


#: What stands for each character that is neither ASCII, nor accented, nor a bracket: one of its own class, "#" for the rest.
PLAIN = rf"\x00-\x7F{ACCENTS}"
STANDS = [(rf"[[^{PLAIN}]&&\p{{Lu}}]", "A"), (rf"[[^{PLAIN}]&&\p{{L}}]", "a"), (rf"[[^{PLAIN}]&&{DIGIT}]", "9"), (rf"[^{PLAIN}«»]", "#")]
#: The bits of a character's classes, and of those of the one before and the two after it in one number.
BITS = {name: k for k, name in enumerate([*CLASSES, "PUNC"])}
SIDES = {"": 0, "prev": 1, "next": 2, "later": 3}


def class_bits() -> list[int]:
    """The bits of each code below 256, as far as characters that stand for others go."""
    out = []
    for c in map(chr, range(256)):
        known = c in ACCENTS or c in "«»" or c < "\x80"
        is_of = {
            "L": c.isalpha(), "D": c.isdigit(), "SP": c in " \t", "NL": c == "\n", "UPP": c.isupper(), "TERM": c in ".!?;:", "EOSC": c in ".!?", "QUOTE": c in "\"'",
            "LBRACK": c in "([{«", "RBRACK": c in ")]}»", "ACC": c in ACCENTS, "PUNC": not (c.isalpha() or c.isdigit() or c in " \t\n"),
        }
        out.append(sum(known and is_of[name] << k for name, k in BITS.items()))
    return out


def bit(name: str, side: str = "") -> Column:
    """Of _m whether the character at a side is of a class."""
    return F.col("_m").bitwiseAND(F.lit(1 << (len(BITS) * SIDES[side] + BITS[name]))) != 0


def ends_sentence(at: str, then: str) -> Column:
    return bit("EOSC", at) & (bit("SP", then) | bit("NL", then) | bit("RBRACK", then) | bit("QUOTE", then))


def explode(lines: DataFrame, with_places: bool = False) -> DataFrame:
    """lines with pos, ch, _k (its place in the line), _c (its classes) and _m (those of its neighbours too): a row for each
    character. A line break belongs to the line that it opens. A character's neighbours come from its line, whose own are two
    windows over lines, so characters need none. Lines are dealt to more tasks than shuffles have, since characters take far
    more room than Spark can tell from lines. with_places: lines of with_size(), and the characters have places.NAMES too."""
    tasks = 4 * int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    w, inner = by_line(), F.col("line_no") > 0
    beside = {"_before": F.lag(F.when(F.col("seg") != "", F.right("seg", F.lit(1))).when(inner, "\n")).over(w), "_first": F.lead(F.substring("seg", 1, 1)).over(w), "_more": F.lead("line_no", 2).over(w).isNotNull()}
    rows = lines.repartition(tasks, "doc_row").withColumns(beside)
    after = F.when(F.col("_first").isNull(), "##").otherwise(F.concat(F.lit("\n"), F.when(F.col("_first") != "", F.col("_first")).when(F.col("_more"), "\n").otherwise("#")))
    rows = rows.withColumns({"_own": own(), "_wide": F.concat(F.coalesce("_before", F.lit("#")), own(), after)}).drop(*beside)
    if with_places:
        rows = with_carried(rows)
    rows = rows.where("_own <> ''")
    plain = F.col("_wide")
    for pattern, to in STANDS:
        plain = F.regexp_replace(plain, pattern, to)
    rows = rows.withColumn("_codes", F.split(F.when(F.col("_wide").rlike(rf"[^{PLAIN}]"), plain).otherwise(F.col("_wide")), ""))
    n = F.size("_codes") - 3
    if with_places:
        rows = rows.withColumn("_places", of_places(places.values))
    also = [F.col("_places").alias("place")] if with_places else []
    each = F.arrays_zip(F.split("_own", "").alias("ch"), F.slice("_codes", F.lit(1), n).alias("prev"), F.slice("_codes", F.lit(2), n).alias("own"), F.slice("_codes", F.lit(3), n).alias("next"), F.slice("_codes", F.lit(4), n).alias("later"), *also)
    rows = rows.select(*lines.columns, F.posexplode(each).alias("_k", "_x"))
    table = F.lit(class_bits())
    bits = lambda side: F.get(table, F.ascii(F.col(f"_x.{side or 'own'}"))).cast("long")
    mask = bits("")
    for side, k in SIDES.items():
        mask = mask if not k else mask.bitwiseOR(F.shiftleft(bits(side), len(BITS) * k))
    return rows.select(*lines.columns, (F.col("start") - F.when(inner, 1).otherwise(0) + F.col("_k")).alias("pos"), F.col("_x.ch").alias("ch"), "_k", bits("").alias("_c"), mask.alias("_m"), *(["_x.place.*"] if with_places else []))


def with_classes(chars: DataFrame) -> DataFrame:
    return chars.withColumns({name: F.col("_c").bitwiseAND(F.lit(1 << k)) != 0 for name, k in BITS.items()})


def with_shifts(chars: DataFrame) -> DataFrame:
    """Classes of the characters beside, and sentence, line and paragraph breaks. A sentence ends at . ! ? before white
    space, a closing bracket or a quote; one at the very end of a text doesn't count."""
    out = {f"{side}_{c}": bit(c, side) for c in ("L", "SP", "NL", "TERM", "UPP", "D") for side in ("prev", "next")}
    out |= {"eos_here": ends_sentence("", "next"), "prev_eos": ends_sentence("prev", ""), "next_eos": ends_sentence("next", "later"), "eos_peak": ends_sentence("", "next") & ~bit("EOSC", "next")}
    out |= {"nl_end": bit("NL") & ~bit("NL", "next"), "para_start": bit("NL") & bit("NL", "next"), "para_end": bit("NL", "prev") & bit("NL")}
    return chars.withColumns(out)


def features(docs: DataFrame, text: str = "text", lines: DataFrame | None = None) -> DataFrame:
    """docs(doc_id, text): a row for each character of the normalised text: doc_row, doc_id, pos, ch, start (of its line),
    the line's columns, and all of NAMES. An empty or null text has no row."""
    lines = line_features(docs, text) if lines is None else lines
    small_batches(lines.sparkSession, 128)
    return with_shifts(with_classes(explode(with_size(lines), with_places=True))).drop("_k", "_c", "_m")


#: What makes of . ! ? a sentence's end, but for a line break; where a sentence starts within a line: after an end, without
#: the blanks between.
CLOSE = r"[ \t)\]}»\"']"
LAST_START = rf"(?s)^(.*[.!?](?={CLOSE})[ \t]*+)[^ \t]"
FIRST_START = rf"(?s)^(.*?[.!?](?={CLOSE})[ \t]*+)[^ \t]"


#: Columns of with_carried().
CARRIED = ("_balance", "_stops", "_lead", "_end", "_in1", "_in2", "_open", "_lead_start", "_last", "_first", "_before", "_after", "_end_after")


def with_carried(rows: DataFrame) -> DataFrame:
    """Lines with n_chars, and what windows over their document's lines carry on: the brackets open
    before a line, whether its first character that is no blank starts a sentence, and where the last sentence before it
    starts, and the first one after it starts and ends. A line is summed up for it by where sentences start and end in it, and
    by its brackets."""
    count = lambda name: F.regexp_count("seg", F.lit(CLASSES[name]))
    part = lambda pattern, group: F.regexp_extract("seg", pattern, group)
    goes_on, right = F.col("start") + F.length("seg") < F.col("n_chars"), F.right("seg", F.lit(1))
    # Columns of their own, so that no pattern is looked for twice.
    rows = rows.withColumns(
        {
            "_brackets": F.when(F.col("seg").rlike(r"[(\[{«)\]}»]"), count("LBRACK") - count("RBRACK")).otherwise(0),
            "_bare": F.when(right.isin(" ", "\t"), part(r"([^ \t])[ \t]*+\z", 1)).otherwise(right),
            "_blanks": F.when(F.substring("seg", 1, 1).isin(" ", "\t"), F.length(part(r"^[ \t]*+", 0))).otherwise(0),
            # An end counts at the line's end too, unless the text ends there.
            "_to_end": F.length(F.when(goes_on, part(rf"(?s)^(.*?)[.!?](?={CLOSE}|\z)", 0)).otherwise(part(rf"(?s)^(.*?)[.!?](?={CLOSE})", 0))),
            "_to_first": F.length(part(FIRST_START, 1)),
            "_to_last": F.length(part(LAST_START, 1)),
        }
    )
    some, place = F.col("_bare") != "", lambda c, off: F.when(F.col(c) > 0, F.col("start") + F.col(c) - off)
    rows = rows.withColumns(
        {
            "_balance": F.col("_brackets").cast("long"), "_stops": F.when(some, F.col("_bare").isin(*".!?")), "_lead": F.when(some, F.col("_blanks").cast("long")), "_end": place("_to_end", 1),
            "_in1": place("_to_first", 0), "_in2": place("_to_last", 0),
        }
    ).drop("_brackets", "_bare", "_blanks", "_to_end", "_to_first", "_to_last")
    # Whether the last character before the line that is no blank ends a sentence: then the line's first such one starts one.
    carried = F.coalesce(nearest(F.col("_stops"), before()), F.lit(False))
    rows = rows.withColumns({"_open": F.coalesce(F.sum("_balance").over(before()), F.lit(0)), "_lead_start": F.when(carried & F.col("_lead").isNotNull(), F.col("start") + F.col("_lead"))})
    rows = rows.withColumns({"_last": F.coalesce("_in2", "_lead_start", F.when(F.col("line_no") == 0, 0)), "_first": F.coalesce("_lead_start", "_in1")})
    return rows.withColumns({"_before": nearest(F.col("_last"), before()), "_after": nearest(F.col("_first"), after()), "_end_after": nearest(F.col("_end"), after())})


def with_size(lines: DataFrame) -> DataFrame:
    """lines with n_chars, the document's length."""
    return lines.withColumn("n_chars", F.max(F.col("start") + F.length("seg")).over(Window.partitionBy("doc_row")))


def own() -> Column:
    """A line with the line break that opens it."""
    return F.when(F.col("line_no") > 0, F.concat(F.lit("\n"), "seg")).otherwise(F.col("seg"))


def of_places(function) -> Column:
    """places.values() or places.sums() of with_carried() with _own, which isn't empty."""
    first = F.col("start") - F.when(F.col("line_no") > 0, 1).otherwise(0)
    since, to, stop = (F.coalesce(c, other).cast("long") for c, other in (("_before", F.lit(0)), ("_after", F.col("n_chars")), ("_end_after", F.col("n_chars"))))
    return function("_own", first, "n_chars", "_open", since, to, stop, F.col("_lead_start").isNotNull())


def place_sums(lines: DataFrame) -> DataFrame:
    """lines(doc_row, doc_id, line_no, start, seg): (doc_row, doc_id, places.NAMES), sums over the characters of each line that
    has any, fractions in millionths: the places of features(), without a row for each character."""
    small_batches(lines.sparkSession)
    rows = with_carried(with_size(lines)).withColumn("_own", own()).where("_own <> ''")
    return rows.select("doc_row", "doc_id", of_places(places.sums).alias("_sums")).select("doc_row", "doc_id", "_sums.*")


def line_starts(lines: DataFrame) -> DataFrame:
    """lines.features(): of each line that isn't empty the features of its first character: the rows of features() at line
    starts, without a row for each character. A line is summed up by its first characters, where sentences start and end in
    it, its words and brackets; windows over the document's lines carry sentences and brackets on."""
    n = F.max(F.col("start") + F.length("seg")).over(Window.partitionBy("doc_row"))
    rows = lines.withColumns({"n_chars": n, "pos": F.col("start"), "_more": F.lead("line_no").over(by_line()).isNotNull(), "ch": F.substring("seg", 1, 1)})
    # The three characters from the line's first on; a line break is what comes after a line that isn't the last.
    whole = F.concat(F.substring("seg", 1, 3), F.when(F.col("_more"), "\n").otherwise(""))
    rows = rows.withColumns({"_c2": F.substring(whole, 2, 1), "_c3": F.substring(whole, 3, 1)})
    test = lambda c, name: F.col(c).rlike(f"^{CLASSES[name]}$" if name != "NL" else r"^\n\z")
    ends = lambda c, then: test(c, "EOSC") & (test(then, "SP") | test(then, "NL") | test(then, "RBRACK") | test(then, "QUOTE"))
    out = {name: test("ch", name) for name in CLASSES} | {f"prev_{c}": (F.col("line_no") > 0) if c == "NL" else F.lit(False) for c in ("L", "SP", "NL", "TERM", "UPP", "D")}
    out |= {f"next_{c}": test("_c2", c) for c in ("L", "SP", "NL", "TERM", "UPP", "D")}
    out |= {"eos_here": ends("ch", "_c2"), "next_eos": ends("_c2", "_c3"), "prev_eos": F.lit(False), "nl_end": F.lit(False), "para_start": F.lit(False), "para_end": F.lit(False)}
    rows = rows.withColumns(out)
    rows = rows.withColumns({"PUNC": ~(F.col("L") | F.col("D") | F.col("SP") | F.col("NL")), "eos_peak": F.col("eos_here") & ~test("_c2", "EOSC")})
    rows = with_carried(rows)
    gap, pos, size = F.col("SP") | F.col("NL"), F.col("pos"), F.col("n_chars")
    inside = lambda c, most: clip(c / most, 0.0, 1.0)
    rows = rows.withColumn("at_sent_start", (pos == 0) | F.coalesce(F.col("_lead_start") == pos, F.lit(False)))
    since = F.when(F.col("at_sent_start"), pos).otherwise(F.col("_before"))
    to = F.coalesce(F.when(F.col("_lead_start") > pos, F.col("_lead_start")), "_in1", "_after", size)
    rows = rows.withColumns(
        {
            "chars_since_nl": inside(F.when(F.col("line_no") > 0, 1).otherwise(0), 200),
            "is_line_end": F.col("next_NL") | (pos == size - 1),
            "chars_since_sent": inside(pos - since, 300),
            "sent_len": inside(to - since, 400),
            "dist_to_term": inside(F.coalesce("_end", "_end_after", size) - pos, 200),
            "word_len_cur": inside(F.when(gap, 0).otherwise(F.length(F.regexp_extract("seg", r"^[^ \t]*+", 0)) + 1), 30),
            "in_word": ~gap,
            "open_paren": F.col("_open") + F.col("LBRACK").cast("int") - F.col("RBRACK").cast("int") > 0,
            "doc_pos": pos / size,
            "near_end": pos > size - 8,
        }
    )
    return rows.where("seg <> ''").drop("_more", "_c2", "_c3", *CARRIED)


def matrix(chars: DataFrame, names: tuple[str, ...] = NAMES) -> Column:
    return F.array(*(F.col(n).cast("float") for n in names))


def extract_features(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_row, doc_id, pos, features array<float>), in the order of NAMES."""
    chars = features(docs, text)
    return chars.select("doc_row", "doc_id", "pos", matrix(chars).alias("features"))
