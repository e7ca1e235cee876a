"""Edits of labelled texts, and labels that move with them.

An edit (pos, lost, added, stays) takes `lost` characters away from pos on and puts `added` there. Edits of a document don't
overlap. They are a table with a doc_id, or an array beside the text that they were made from, which needs no shuffle. A
boundary moves by the running sum of what the edits before it added and lost. A text in which noise is made thus keeps exact
labels, wherever in a unit the noise lies.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.session import small_batches

from .corpus import quota
from .labels import hash_split

EDITS = "array<struct<pos:bigint,lost:bigint,added:string,stays:boolean>>"


def moved(bounds: list[int], edits: list[dict]) -> list[int]:
    """Where boundaries lie after the edits. One within what is lost moves to the end of what is added; one at an edit's place
    stays before what is added if the edit says that it stays, and moves behind it otherwise."""
    # In the order of places: what ends before a boundary counts in full, then the boundary, then what it stays before.
    rows = sorted((e["pos"], 2 if e["stays"] else 0, e["pos"] + e["lost"], len(e["added"]) - e["lost"]) for e in edits)
    shifts = [0, *accumulate(grows for *_, grows in rows)]
    out = set()
    for p in bounds:
        k = bisect_left(rows, (p, 1))
        inside = k > 0 and rows[k - 1][0] < p < rows[k - 1][2]
        out.add((rows[k - 1][2] if inside else p) + shifts[k])
    return sorted(out)


def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts with their edits made, slices in a row, and the boundaries moved."""
    for b in batches:
        texts, labels = [], []
        for text, bounds, edits in zip(b.column("text").to_pylist(), b.column("boundaries").to_pylist(), b.column("edits").to_pylist()):
            parts, at = [], 0
            for e in edits or ():
                parts += [text[at : e["pos"]], e["added"]]
                at = e["pos"] + e["lost"]
            new = None if text is None else "".join([*parts, text[at:]])
            texts.append(new)
            labels.append([p for p in moved([p for p in bounds or () if p is not None], edits or ()) if 0 < p < len(new or "")])
        names = b.schema.names
        b = b.set_column(names.index("text"), "text", pa.array(texts, pa.string()))
        yield b.set_column(names.index("boundaries"), "boundaries", pa.array(labels, pa.list_(pa.int64()))).drop_columns(["edits"])


def written(docs: DataFrame) -> DataFrame:
    """docs(text, boundaries, edits, ...) with the edits, in order, made in text and the boundaries moved; those that fall at
    either end of the text go."""
    small_batches(docs.sparkSession, 128)
    kinds = ", ".join(f"`{c}` {'array<bigint>' if c == 'boundaries' else t}" for c, t in docs.drop("edits").dtypes)
    return docs.mapInArrow(rewrite, kinds)


def apply(docs: DataFrame, edits: DataFrame) -> DataFrame:
    """docs(doc_id, text, boundaries, ...) with the edits(doc_id, pos, lost, added, stays) made. doc_id must be unique."""
    one = F.struct(F.col("pos").cast("long").alias("pos"), F.col("lost").cast("long").alias("lost"), "added", "stays")
    own = edits.groupBy("doc_id").agg(F.sort_array(F.collect_list(one)).alias("edits"))
    return written(docs.join(own, "doc_id", "left")).select(*docs.columns)


def table_of(docs: DataFrame, edits: Column) -> DataFrame:
    return docs.select("doc_id", F.explode(edits).alias("e")).select("doc_id", "e.*")


def lot(doc: Column, place: Column, of: int) -> Column:
    """A number below `of` by arithmetic on document and place, so that draws can be checked by SQL."""
    return F.pmod(doc * 7919 + place * 104_729, F.lit(of))


def words_in(blank: np.ndarray, opens: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words between blanks; opens: places where a word is cut."""
    before, after = np.ones(len(blank), bool), np.ones(len(blank), bool)
    before[1:], after[:-1] = blank[:-1], blank[1:]
    if opens is not None:
        before[opens], after[opens[opens > 0] - 1] = True, True
    return np.flatnonzero(~blank & before), np.flatnonzero(~blank & after) + 1


def breaks_in(blank: np.ndarray, bounds: list[int], width: int) -> list[tuple[int, int]]:
    """(pos, lost) of the white space before each word of a unit that would pass `width`. A line is as many words as fit, one
    at least."""
    opens = np.array([0, *sorted({p for p in bounds if p is not None and 0 < p < len(blank)})])
    starts, ends = words_in(blank, opens)
    unit = np.searchsorted(opens, starts, "right") - 1
    gaps = np.maximum(np.append(0, ends[:-1]), opens[unit]).tolist() if len(ends) else []
    last = np.searchsorted(unit, unit, "right").tolist()
    starts, ends, out, k = starts.tolist(), ends.tolist(), [], 0
    while k < len(ends):
        stop = last[k]
        k = max(k + 1, bisect_right(ends, gaps[k] + width, k, stop))
        if k < stop:
            out.append((gaps[k], starts[k] - gaps[k]))
    return out


def pages_in(codes: np.ndarray, page: int, breaks: list[tuple[int, int]]) -> list[tuple[int, int, bool]]:
    """(pos, page, within) of the first line that starts on each page but the first; within: strictly inside what a break takes."""
    at = np.flatnonzero(codes == 10) + 1
    no = at // page
    first = (no > 0) & (np.diff(no, prepend=0) > 0)
    at, no = at[first], no[first]
    pos, end = np.array([(-1, -1), *((p, p + n) for p, n in breaks)]).T
    return list(zip(at.tolist(), no.tolist(), (at < end[np.searchsorted(pos, at, "left") - 1]).tolist()))


FOUND = {"breaks": "array<struct<pos:bigint,lost:bigint>>", "words": "array<struct<pos:bigint,piece:string>>", "pages": "array<struct<pos:bigint,no:bigint,within:boolean>>"}


def found(docs: DataFrame, what: tuple[str, ...], width: int = 60, page: int = 1000, least: int = 7) -> DataFrame:
    """docs(text, boundaries, ...) with arrays of the places where edits are made: breaks, words of `least` characters or more, pages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = {name: [] for name in what}
            for text, bounds in zip(b.column("text").to_pylist(), b.column("boundaries").to_pylist()):
                codes = np.frombuffer((text or "").encode("utf-32-le"), np.uint32)
                blank = (codes == 32) | ((codes >= 9) & (codes <= 13))
                breaks = breaks_in(blank, bounds, width) if text and bounds is not None and "breaks" in what else []
                if "breaks" in what:
                    out["breaks"].append([{"pos": p, "lost": n} for p, n in breaks])
                if "words" in what:
                    starts, ends = words_in(blank)
                    long = ends - starts >= least
                    out["words"].append([{"pos": p, "piece": text[p:q]} for p, q in zip(starts[long].tolist(), ends[long].tolist())])
                if "pages" in what:
                    out["pages"].append([{"pos": p, "no": n, "within": w} for p, n, w in pages_in(codes, page, breaks)])
            kinds = {"breaks": [("pos", pa.int64()), ("lost", pa.int64())], "words": [("pos", pa.int64()), ("piece", pa.string())], "pages": [("pos", pa.int64()), ("no", pa.int64()), ("within", pa.bool_())]}
            for name, rows in out.items():
                b = b.append_column(name, pa.array(rows, pa.list_(pa.struct(kinds[name]))))
            yield b

    small_batches(docs.sparkSession, 128)
    return docs.mapInArrow(run, ", ".join([*(f"`{c}` {t}" for c, t in docs.dtypes), *(f"{n} {FOUND[n]}" for n in what)]))


def edit(pos: Column, lost: Column, added: Column, stays: bool = False) -> Column:
    return F.struct(pos.cast("long").alias("pos"), lost.cast("long").alias("lost"), added.alias("added"), F.lit(stays).alias("stays"))


def page_edits(pages: Column) -> Column:
    return F.transform(pages, lambda m: edit(m["pos"], F.lit(0), F.concat(F.lit("- "), m["no"].cast("string"), F.lit(" -\n\f\n"))))


def page_marks(docs: DataFrame, page: int = 1000) -> DataFrame:
    """Edits that put a page's number and a form feed before the first line that starts on the next page of `page` characters."""
    rows = docs.select("doc_id", "text", F.array().cast("array<bigint>").alias("boundaries"))
    return table_of(found(rows, ("pages",), page=page), page_edits(F.col("pages")))


def stray_edits(part: int = 30) -> Column:
    number = lambda p: lot(F.col("doc_id"), p + 1, 40) + 1
    ends = F.filter(F.array_distinct("boundaries"), lambda p: lot(F.col("doc_id"), p, 100) < part)
    return F.transform(ends, lambda p: edit(p, F.lit(0), F.concat(F.lit(" "), number(p).cast("string"))))


def stray_numbers(docs: DataFrame, part: int = 30) -> DataFrame:
    """Edits that put a number behind the end of about `part` of 100 units."""
    return table_of(docs, stray_edits(part))


def word_edits(words: Column, each: int = 10, least: int = 7) -> Column:
    drawn = F.filter(words, lambda w: (lot(F.col("doc_id"), w["pos"], each) == 0) & w["piece"].rlike(rf"^\p{{L}}{{{least},}}\z"))
    return F.transform(drawn, lambda w: edit(w["pos"] + 3, F.lit(1), F.lit(" ")))


def mangled_words(docs: DataFrame, each: int = 10, least: int = 7) -> DataFrame:
    """Edits that put a space for the fourth letter of about one in `each` words of `least` letters or more, as a scanner does."""
    rows = docs.select("doc_id", "text", F.array().cast("array<bigint>").alias("boundaries"))
    return table_of(found(rows, ("words",), least=least), word_edits(F.col("words"), each, least))


def break_edits(breaks: Column) -> Column:
    return F.transform(breaks, lambda x: edit(x["pos"], x["lost"], F.lit("\n"), True))


def wrapped(docs: DataFrame, width: int = 60) -> DataFrame:
    """Edits that break each unit's lines where the next word would pass `width`: the white space before it becomes a break.
    White space at the ends of units stays."""
    return table_of(found(docs.select("doc_id", "text", "boundaries"), ("breaks",), width), break_edits(F.col("breaks")))


def noisy_corpus(docs: DataFrame, least: int = 200, share: float = 0.2, most: int | None = None) -> DataFrame:
    """docs(doc_id, text, boundaries, source): documents of `least` characters or more as a scanner would give them (wrapped, words
    mangled, stray numbers, page marks: one array of edits), with their boundaries, source prefixed, and held_out, about `share` of them; those
    without a boundary go. most: a sample, the first so many documents of each source."""
    docs = docs.where(F.length("text") >= least).select("doc_id", "text", "boundaries", F.concat(F.lit("noisy_"), "source").alias("source"))
    docs = docs if most is None else quota(docs, "source", most)
    # A page's mark that would fall into white space which becomes a break is left out; no other edits meet.
    marks = page_edits(F.filter("pages", lambda m: ~m["within"]))
    made = F.concat(break_edits(F.col("breaks")), word_edits(F.col("words")), F.coalesce(stray_edits(), F.array().cast(EDITS)), marks)
    rows = found(docs, ("breaks", "words", "pages")).withColumn("edits", F.sort_array(made)).drop("breaks", "words", "pages")
    return hash_split(written(rows).where(F.size("boundaries") > 0), share)
