"""From candidate boundaries to chunks: merge, split, offset map and slices.

Merging and splitting go through a piece's boundaries in order, each step on the state that the last one left; that is a
fold, done for each piece of at most window_chars in Arrow batches. All else is DataFrame functions.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.config import ChunkerConfig
from tessera.functions.predicates import PATTERNS
from tessera.functions.textnorm import FOLD_FROM, FOLD_TO
from tessera.session import small_batches

HEADING = re.compile(PATTERNS["headerish"])
FOLD = dict(zip(FOLD_FROM, FOLD_TO))
FOLDED = re.compile(f"[{re.escape(FOLD_FROM)}]")
#: Where to cut a piece that is too long, the best kind first: after a blank line, a sentence, a line, a word.
CUTS = [re.compile(p) for p in (r"\n[ \t]*\n", r"[.!?][)\]}»\"']*(?=\s)", r"\n", r"\s")]


def announces(piece: str) -> bool:
    """Whether a piece is one line that names what follows: marked as a heading, or a few words from a capital on that no
    sentence mark ends."""
    line = piece.strip()
    words = line.split()
    if not words or "\n" in line or len(line) > 90:
        return False
    return HEADING.match(line) is not None or (words[0][0].isupper() and len(words) <= 12 and line[-1] not in ".!?")


def merge(text: str, cuts: list[int], least: int) -> list[int]:
    """The cuts that stay, found in one walk that builds chunks from the left. A piece that is blank, goes on in lower case
    or is too short joins the chunk before it, but one that announces what follows opens a chunk. A chunk that is still too
    short takes the next piece, and at the end joins the one before."""
    opened: list[int] = []
    hungry = True
    for a, b in zip([0, *cuts], [*cuts, len(text)]):
        piece = text[a:b].strip()
        goes_on = len(piece) > 2 and piece[0].islower()
        short = len(piece) < least
        if opened and (hungry or not piece or goes_on or (short and not announces(piece))):
            hungry = hungry and len(text[opened[-1] : b].strip()) < least
        else:
            opened.append(a)
            hungry = short
    if len(opened) > 1 and hungry:
        opened.pop()
    return opened[1:]


def holds(text: str, a: int, most: int) -> int:
    """How far a chunk from a on may reach. A line break counts two, so that chunks are the same, and within `most`, however
    line breaks are written."""
    b = min(len(text), a + most)
    while (over := b - a + text.count("\n", a, b) - most) > 0:
        b -= max(1, over // 2)
    return b


def word_start(text: str, p: int) -> int:
    """p, or the start of the word that it would cut."""
    if 0 < p < len(text) and text[p].isalnum():
        while p > 0 and text[p - 1].isalnum():
            p -= 1
    return p


class Spans:
    """Protected spans in order, and whether a place lies strictly inside one."""

    def __init__(self, spans: list[tuple[int, int]]):
        self.spans = sorted(spans)
        self.starts = [s for s, _ in self.spans]

    def around(self, p: int) -> tuple[int, int] | None:
        k = bisect_left(self.starts, p) - 1
        return self.spans[k] if k >= 0 and p < self.spans[k][1] else None


def split(text: str, a: int, b: int, most: int, least: int, spans: Spans, peaks: list[tuple[int, float]]) -> list[tuple[int, str]]:
    """Cuts that bring text[a:b] under `most`, each in the second half of what may be held: at the highest small peak, else
    at the last place of the best kind, outside of protected spans; else before the span, else at a line's or word's end in
    it, or in the last half of `most`; else as far as may be. What is left is no shorter than `least`."""
    out = []
    end = a + len(text[a:b].rstrip())
    while (high := holds(text, a, most)) < b:
        if a + (high - a) // 2 < end - least - 1:
            high = min(high, end - least - 1)
        low = max(a + (high - a) // 2, a + min(least, high - a - 1))
        near = peaks[bisect_right(peaks, (low, float("inf"))) : bisect_right(peaks, (high, float("inf")))]
        near = [(score, p) for p, score in near if not spans.around(p)]
        found, kind = (max(near)[1], "small") if near else (None, "hard")
        for cut in CUTS:
            if found is not None:
                break
            found = max((m.end() for m in cut.finditer(text, low, high) if m.end() > low and not spans.around(m.end())), default=None)
        if found is None:
            around = spans.around(high)
            if around and low < around[0]:
                found = around[0]
            near = max(a + 1, high - most // 2)
            for cut in CUTS[2:]:
                found = found or max((m.end() for m in cut.finditer(text, near, high) if m.end() > near), default=None)
            found = found or high
        out.append((found, kind))
        a = found
    return out


def normalized(text: str) -> str:
    """As textnorm.normalize(). A table of all folds would look up each character."""
    return FOLDED.sub(lambda m: FOLD[m.group()], text.replace("\r\n", "\n").replace("\r", "\n"))


def cuts_of(text: str, points: list[int], spans: list[tuple[int, int]], cfg: ChunkerConfig, peaks: list[tuple[int, float]] = (), first: str = "start", norm: str | None = None) -> list[tuple[int, int, str]]:
    """(start, end, kind of the opening boundary) of each chunk in offsets of the text, blank ones left out. points, spans
    and peaks are offsets of the normalised text; norm: that text, if it is at hand."""
    norm = normalized(text) if norm is None else norm
    held = Spans(spans)
    free = sorted({q for p in points if 0 < p < len(norm) and not held.around(p) and 0 < (q := word_start(norm, p))})
    edges = [(0, first), *((c, "big") for c in merge(norm, free, cfg.min_chunk_chars)), (len(norm), "end")]
    marks = []
    for (a, kind), (b, _) in zip(edges, edges[1:]):
        marks += [(a, kind), *split(norm, a, b, cfg.max_chunk_chars, cfg.min_chunk_chars, held, sorted(peaks))]
    back = [m.start() for m in re.finditer("\r\n", text)]  # each pair lost a character
    ends, k, shifted = [*marks, (len(norm), "end")], 0, []
    for p, kind in ends:
        while k < len(back) and back[k] - k < p:
            k += 1
        shifted.append((p + k, kind))
    out = []
    for (a, kind), (b, _) in zip(shifted, shifted[1:]):
        piece = text[a:b]
        lead = len(piece) - len(piece.lstrip())
        if piece.strip():
            out.append((a + lead, a + len(piece.rstrip()), kind))
    return out


def assemble(pieces: DataFrame, cfg: ChunkerConfig, slices: bool = True) -> DataFrame:
    """pieces(..., text, first, points array<long>, spans array<struct<s,e>>, peaks array<struct<pos,score>>) with `cuts` in
    place of the last four and text, which each cut has its slice of if asked for: so no chunk's row holds the whole text."""
    rest = [c for c in pieces.columns if c not in ("text", "first", "points", "spans", "peaks")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for t, f, p, s, k in zip(b["text"], b["first"], b["points"], b["spans"], b["peaks"]):
                found = cuts_of(t, list(p), [(x["s"], x["e"]) for x in s], cfg, [(x["pos"], x["score"]) for x in k], f) if t else []
                rows.append([{"start": a, "end": e, "kind": k} | ({"text": t[a:e]} if slices else {}) for a, e, k in found])
            yield b[rest].assign(cuts=pd.Series(rows, dtype=object, index=b.index))

    small_batches(pieces.sparkSession, 128)
    kinds = ", ".join(f"{c} {t}" for c, t in pieces.select(*rest).dtypes)
    return pieces.mapInPandas(run, f"{kinds}, cuts array<struct<start:int,end:int,kind:string{',text:string' if slices else ''}>>")
