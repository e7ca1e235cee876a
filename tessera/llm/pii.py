"""Personal data: regular expressions propose spans, checksums confirm them, nearby words adjust the score.

DataFrame functions only. Offsets are code points: a text is split at the matches, and the lengths of the pieces and of
the matches add up. Patterns start with a look-behind or the end of the last match, and repeat possessively, so that a
long run of one character class is walked once; and what surrounds a match is read from the pieces, not from the text, so
that a text of very many matches is walked once too.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
#: How many code points before and after a span are searched for context words, as far as no other match of the kind lies
#: there.
NEAR = 40
#: A list that grows in a fold is kept in lists of so many entries.
FOLD = 256
#: Code points in the blocks from which a redacted text is put together.
BLOCK = 4096
#: How many code points from its head on a match may have: 34 with spaces between, and one that ends it.
REACH = 80
#: The length of an IBAN by its country's code.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
    23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "AO CV GW LY MZ PT ST", 26: "DZ IR IS TR",
    27: "BI CF CG CM DJ FR GA GQ GR IT KM MC MG MR SM TD", 28: "AL AZ BF BJ BY CI CY DO GT HN HU LB MA ML NE NI PL SN SV TG", 29: "BR EG PS QA UA",
    30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}


@dataclass(frozen=True)
class Kind:
    """hint: a pattern found in any text that has a match; it spares the others the full search. confirms: of a match,
    whether it holds. score: of a confirmed match; plus 0.3 with a context word near. context: a pattern of such words.
    whole: if set, pattern finds a match's head only, its first group holds the REACH code points from there on, and the
    match is what `whole` finds in these."""

    name: str
    pattern: str
    hint: str
    confirms: object
    score: float
    context: str
    whole: str = ""


def digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def octets(m: Column) -> Column:
    return m.rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$")


def luhn(m: Column) -> Column:
    d = digits(m)
    return F.length(d).between(16, 19) & F.call_function("luhn_check", d)



def mod97(m: Column) -> Column:
    """IBAN: the first four characters go last, letters count 10 to 35, and the number leaves 1 modulo 97."""
    bare = F.upper(F.regexp_replace(m, " ", ""))
    turned = F.concat(F.substring(bare, 5, 40), F.substring(bare, 1, 4))
    value = lambda c: F.when(c.rlike("[0-9]"), c.cast("int")).otherwise(F.ascii(c) - 55)
    rest = F.aggregate(F.split(turned, ""), F.lit(0), lambda r, c: F.when(c == "", r).otherwise(F.pmod(F.when(value(c) > 9, r * 100).otherwise(r * 10) + value(c), F.lit(97))))
    return F.length(bare).between(15, 34) & (rest == 1)


def iban_form() -> str:
    """A listed country's IBAN has its length, whatever follows after a space; of another code the whole run is taken."""
    listed = [f"(?:{'|'.join(codes.split())})[0-9]{{2}}(?: ?[A-Z0-9]){{{n - 4}}}" for n, codes in IBAN_LENGTHS.items()]
    known = "|".join("|".join(codes.split()) for codes in IBAN_LENGTHS.values())
    return rf"^(?:{'|'.join(listed)}|(?!{known})[A-Z]{{2}}[0-9]{{2}}(?: ?[A-Z0-9]){{11,30}})(?![A-Za-z0-9])"


#: The base kinds, in their order; a match counts if it is confirmed, at any score.
BASE = [
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", lambda m: F.lit(True), 0.9, r"(?i)mail|contact|write"),
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", r"[0-9]\.[0-9]", octets, 0.6, r"(?i)\bip\b|host|server|address"),
    Kind("card", r"[0-9](?:[ -]?[0-9])++", r"[0-9](?:[ -]?[0-9]){15}", luhn, 0.8, r"(?i)card|visa|credit|payment"),
    Kind("phone", r"\+[0-9][ ().0-9-]+[0-9]", r"\+[0-9]", lambda m: F.length(digits(m)).between(8, 15), 0.7, r"(?i)phone|call|tel|mobile|fax"),
]
#: What the method adds; a match counts if it is confirmed and its score reaches THRESHOLD.
ADDED = [
    Kind("iban", rf"(?<![A-Za-z0-9])(?=([\s\S]{{0,{REACH}}}))[A-Z]{{2}}[0-9]{{2}}(?=(?: ?[A-Z0-9]){{11}})", r"[A-Z]{2}[0-9]{2}", mod97, 0.8, r"(?i)iban|account|bank|konto", iban_form()),
    Kind("ssn", r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])", r"[0-9]{3}-[0-9]{2}-", lambda m: F.lit(True), 0.4, r"(?i)ssn|social|security|tax"),
    Kind("secret", r"(?<![A-Za-z0-9])[A-Fa-f0-9]{32,64}(?![A-Za-z0-9])", r"[A-Fa-f0-9]{32}", lambda m: F.lit(True), 0.3, r"(?i)token|secret|passw|api.?key|bearer"),
]
THRESHOLD = 0.6
SPAN = "array<struct<start:int,end:int,score:double>>"


def folded(items: Column, state: dict[str, Column], step, kind: str) -> Column:
    """A list of `kind` that a fold over items makes: step(state, item) gives the next state and the entry to add, or null
    for none. The list grows in pieces of FOLD entries, so that adding one copies few."""
    none = F.array().cast(f"array<{kind}>")
    start = F.struct(*(v.alias(k) for k, v in state.items()), none.alias("_cur"), F.array().cast(f"array<array<{kind}>>").alias("_done"))

    def add(a: Column, x: Column) -> Column:
        after, entry = step(a, x)
        grown, full = F.array_append(a["_cur"], entry), F.size(a["_cur"]) >= FOLD - 1
        cur = F.when(entry.isNull(), a["_cur"]).when(full, none).otherwise(grown)
        done = F.when(entry.isNotNull() & full, F.array_append(a["_done"], grown)).otherwise(a["_done"])
        return F.struct(*(v.alias(k) for k, v in after.items()), cur.alias("_cur"), done.alias("_done"))

    return F.aggregate(items, start, add, lambda a: F.flatten(F.array_append(a["_done"], a["_cur"])))


def with_kind(df: DataFrame, text: str, kind: Kind, base: bool) -> DataFrame:
    """df with a column kind.name: the spans that hold, in order; an empty array if none."""
    doc, name = F.col(text), kind.name
    has = doc.rlike(kind.hint)
    df = df.withColumn("_m", F.when(has, F.regexp_extract_all(doc, F.lit(kind.pattern), F.lit(0))))
    df = df.withColumn("_p", F.when(F.size("_m") > 0, F.split(doc, kind.pattern)))
    # Lengths are zipped for the fold: a column that only a lambda reads might be computed anew for each of its steps.
    lengths = F.arrays_zip(F.transform("_p", lambda p: F.length(p)).alias("gap"), F.transform("_m", lambda m: F.length(m)).alias("own"))
    lengths = F.slice(lengths, F.lit(1), F.size("_m"))

    def place(a: Column, x: Column) -> tuple[dict[str, Column], Column]:
        at = a["at"] + x["gap"]
        return {"at": at + x["own"]}, at

    df = df.withColumn("_at", F.when(F.size("_m") > 0, folded(lengths, {"at": F.lit(0)}, place, "int")))
    after = lambda m, i: F.left(F.get("_p", i + 1), F.lit(NEAR))
    if kind.whole:
        df = df.withColumn("_w", F.when(F.size("_m") > 0, F.regexp_extract_all(doc, F.lit(kind.pattern), F.lit(1))))
        df = df.withColumn("_m", F.transform("_w", lambda w: F.regexp_extract(w, kind.whole, 0)))
        after = lambda m, i: F.substr(F.get("_w", i), F.length(m) + 1, F.lit(NEAR))
    near = lambda m, i: F.concat(F.right(F.get("_p", i), F.lit(NEAR)), F.lit(" "), after(m, i))
    spans = F.transform("_m", lambda m, i: F.when(kind.confirms(m), F.struct(F.get("_at", i).alias("start"), (F.get("_at", i) + F.length(m)).alias("end"), (F.lit(kind.score) + F.when(near(m, i).rlike(kind.context), 0.3).otherwise(0.0)).alias("score"))))
    least = 0.0 if base else THRESHOLD
    spans = F.filter(spans, lambda x: x.isNotNull() & (x["score"] >= least))
    return df.withColumn(name, F.coalesce(F.when(F.size("_m") > 0, spans), F.array().cast(SPAN))).drop("_m", "_p", "_w", "_at")


def searched(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) as (doc_id, _raw, _text) and the spans of each kind."""
    df = docs.select(F.col("doc_id").alias("doc_id"), F.col("text").alias("_raw"), F.coalesce(F.col("text"), F.lit("")).alias("_text"))
    for kind in BASE:
        df = with_kind(df, "_text", kind, True)
    for kind in ADDED:
        df = with_kind(df, "_text", kind, False)
    return df


def find(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text, ...): a row for each row of docs with doc_id and a column of spans for each kind.

    A null text counts as empty, and an empty one has no span. Repeated rows are each searched. Other columns are ignored,
    so their names can't clash. An empty table gives an empty result. Equal starts can't occur within a kind; kinds may
    overlap each other, and so may two IBANs.
    """
    return searched(docs).drop("_raw", "_text")


def joined(kinds: list[Kind]) -> Column:
    def named(kind: Kind) -> Column:
        return F.transform(kind.name, lambda s: F.concat_ws(":", F.lit(kind.name), s["start"], s["end"]))

    return F.array_join(F.concat(*map(named, kinds)), ",")


def report(found: DataFrame) -> DataFrame:
    """find()'s rows as counts and lists: kind:start:end by kind, then start; n_spans counts those of all kinds."""
    counts = [F.size(k.name).cast("long").alias(f"n_{k.name}") for k in BASE]
    return found.select("doc_id", *counts, F.sha2(joined(BASE), 256).alias("base_sha256"), joined(BASE + ADDED).alias("spans"), sum(F.size(k.name) for k in BASE + ADDED).cast("long").alias("n_spans"))


def redact(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text, ...): a row for each row of docs: doc_id and text with each span replaced by its kind in brackets.

    Of overlapping spans the one that starts first is replaced, of those that start together the longest. A null text stays
    null. Repeated rows and rows without doc_id each keep their row. An empty table gives an empty result.
    """

    def keyed(kind: Kind) -> Column:
        return F.transform(kind.name, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("end"), F.lit(kind.name).alias("kind")))

    def choose(a: Column, s: Column) -> tuple[dict[str, Column], Column]:
        free = s["start"] >= a["at"]
        return {"at": F.when(free, s["end"]).otherwise(a["at"])}, F.when(free, s["i"])

    df = searched(docs).withColumn("_all", F.sort_array(F.flatten(F.array(*map(keyed, BASE + ADDED)))))
    items = F.transform("_all", lambda s, i: F.struct(s["start"].alias("start"), (-s["end"]).alias("end"), i.alias("i")))
    df = df.withColumn("_keep", folded(items, {"at": F.lit(0)}, choose, "int"))
    df = df.withColumn("_s", F.transform("_keep", lambda i: F.struct(F.get("_all", i)["start"].alias("start"), (-F.get("_all", i)["end"]).alias("end"), F.get("_all", i)["kind"].alias("kind"))))
    df = df.withColumns({"_n": F.length("_text"), "_b": F.regexp_extract_all("_text", F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))})

    def part(a: Column, b: Column) -> Column:
        """The code points from a to b."""
        i, j = F.floor(a / BLOCK).cast("int"), F.floor(b / BLOCK).cast("int")
        block = lambda k: F.coalesce(F.get("_b", k), F.lit(""))
        apart = F.concat(F.substr(block(i), a - i * BLOCK + 1), F.array_join(F.slice("_b", i + 2, j - i - 1), ""), F.left(block(j), b - j * BLOCK))
        return F.when(i == j, F.substr(block(i), a - i * BLOCK + 1, b - a)).otherwise(apart)

    before = lambda i: F.when(i == 0, 0).otherwise(F.get("_s", i - 1)["end"])
    pieces = F.transform("_s", lambda s, i: F.concat(part(before(i), s["start"]), F.lit("["), s["kind"], F.lit("]")))
    whole = F.concat(F.array_join(pieces, ""), part(before(F.size("_s")), F.col("_n")))
    return df.select("doc_id", F.when(F.col("_raw").isNull(), None).when(F.size("_s") == 0, F.col("_raw")).otherwise(whole).alias("text"))
