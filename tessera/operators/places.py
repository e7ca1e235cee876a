"""Places of characters within the line, the sentence, the word and the document, by numpy over a batch of lines: what a line
needs of others comes beside it, so characters are neither rows nor sorted."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The features, and of fractions the number that they are shares of, None for the document's length; the others are flags.
NAMES = {
    "chars_since_nl": 200, "is_line_end": 0, "chars_since_sent": 300, "sent_len": 400, "at_sent_start": 0, "dist_to_term": 200, "word_len_cur": 30, "in_word": 0, "open_paren": 0, "doc_pos": None,
    "near_end": 0,
}
GAP, BREAK, STOP, CLOSE, OPENS, SHUTS = (1 << k for k in range(6))
#: What each code below 256 is; 255 stands for all above.
KINDS = np.zeros(256, np.uint8)
for kind, of in ((GAP, " \t\n"), (BREAK, "\n"), (STOP, ".!?"), (CLOSE, " \t\n)]}»\"'"), (OPENS, "([{«"), (SHUTS, ")]}»")):
    KINDS[[ord(c) for c in of]] |= kind
#: About how many characters are in memory at once, a line at least.
AT_ONCE = 1 << 16


def places(text: str, size: np.ndarray, first: np.ndarray, n: np.ndarray, opened: np.ndarray, before: np.ndarray, after: np.ndarray, stop_after: np.ndarray, carried: np.ndarray) -> dict[str, np.ndarray]:
    """NAMES of each character of some lines, which text has one after another, each from its line break on; of shares the
    counts up to their number, doc_pos as it is.

    Of each line size is its length, first its place in the document of n characters, opened the brackets open before it,
    before and after the places of the last sentence start before it and the first one after it, stop_after that of the first
    sentence end after it, and carried whether its first character that is no blank starts a sentence."""
    many, begin, rows = len(text), np.cumsum(size) - size, np.arange(len(size))
    last = begin + size - 1
    spread = lambda of_line: np.repeat(of_line, size)
    line, k = spread(rows), np.arange(many) - spread(begin)
    pos, total = k + spread(first), spread(n)
    kinds = KINDS[np.minimum(np.frombuffer(text.encode("utf-32-le"), "<u4"), 255)]
    then = np.append(kinds[1:], np.uint8(0))
    then[last] = np.where(first + size < n, KINDS[ord("\n")], 0)
    gap, stop = kinds & GAP > 0, (kinds & STOP > 0) & (then & CLOSE > 0)
    opens, closes, starts = np.zeros((3, many), bool)
    opens[begin] = closes[last] = True
    # Sentences start where a document does, and at the next character that is no blank after an end in the line or before it.
    ended = np.flatnonzero(stop)
    full = np.append(np.flatnonzero(~gap), many)
    owner = np.append(line, -1)
    for at, row in ((full[np.searchsorted(full, ended, "right")], line[ended]), (full[np.searchsorted(full, begin[carried])], rows[carried])):
        starts[at[owner[at] == row]] = True
    starts[begin[first == 0]] = True

    def runs(marks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where runs open, at a mark or a line's start, how long they are, and the place of the line's next mark, else -1."""
        at = np.flatnonzero(marks | opens)
        to = np.where(line[at[1:]] == line[at[:-1]], pos[at[1:]], -1)
        return at, np.diff(at, append=many), np.append(to, -1)

    at, long, to = runs(starts)
    since = np.where(starts[at], pos[at], before[line[at]])
    until = np.where(to < 0, after[line[at]], to)
    of_word, long_word, to_word = runs(gap)
    word = np.where(to_word < 0, (first + size)[line[of_word]], to_word) - np.where(gap[of_word], pos[of_word], -1)
    ends = np.flatnonzero(stop | closes)
    stops = np.repeat(np.where(stop[ends], pos[ends], stop_after[line[ends]]), np.diff(ends, prepend=-1))
    weight = (kinds & OPENS > 0).astype(np.int8) - (kinds & SHUTS > 0)
    bracket = np.flatnonzero((weight != 0) | opens)
    balance = np.cumsum(weight[bracket], dtype=np.int64)
    heads = np.flatnonzero(opens[bracket])
    balance += np.repeat(opened - np.append(0, balance)[heads], np.diff(heads, append=len(bracket)))
    upto = lambda name, x: np.minimum(x, NAMES[name])
    return {
        "chars_since_nl": upto("chars_since_nl", k),
        "is_line_end": (kinds & BREAK > 0) | (then & BREAK > 0) | (pos == total - 1),
        "chars_since_sent": upto("chars_since_sent", pos - np.repeat(since, long)),
        "sent_len": np.repeat(upto("sent_len", until - since), long),
        "at_sent_start": starts,
        "dist_to_term": upto("dist_to_term", stops - pos),
        "word_len_cur": np.repeat(upto("word_len_cur", word), long_word) * ~gap,
        "in_word": ~gap,
        "open_paren": np.repeat(balance > 0, np.diff(bracket, append=many)),
        "doc_pos": pos / total,
        "near_end": pos > total - 8,
    }


def groups(own: pa.Array, *facts: pa.Array) -> Iterator[tuple[np.ndarray, dict[str, np.ndarray]]]:
    """The lengths and places() of lines, some lines at a time."""
    texts = own.to_pylist()
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    facts = [x.to_numpy(zero_copy_only=False) for x in facts]
    group = np.cumsum(size) // AT_ONCE
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1), len(texts)]
    for a, b in zip(cuts, cuts[1:]):
        if a < b:
            yield size[a:b], places("".join(texts[a:b]), size[a:b], *(x[a:b] for x in facts))


def millionths(x: np.ndarray) -> np.ndarray:
    """Rounded half up, as Spark and SQL do."""
    x = x * 1_000_000
    whole = np.floor(x)
    return (whole + (x - whole >= 0.5)).astype(np.int64)


#: The millionths of each count of a share.
SHARES = {name: millionths(np.arange(most + 1) / most) for name, most in NAMES.items() if most}


def whole(name: str, x: np.ndarray) -> np.ndarray:
    return SHARES[name][x] if name in SHARES else millionths(x) if NAMES[name] is None else x.astype(np.int64)


def _values(own: pa.Array, first: pa.Array, n: pa.Array, opened: pa.Array, before: pa.Array, after: pa.Array, stop_after: pa.Array, carried: pa.Array) -> pa.Array:
    found = list(groups(own, first, n, opened, before, after, stop_after, carried))
    own_type = lambda most, x: x / most if most else x
    columns = [pa.array(np.concatenate([np.zeros(0, bool if most == 0 else float), *(own_type(most, v[name]) for _, v in found)])) for name, most in NAMES.items()]
    offsets = np.cumsum(np.concatenate([np.zeros(1, np.int64), *(s for s, _ in found)]))
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(columns, list(NAMES)))


def _sums(own: pa.Array, first: pa.Array, n: pa.Array, opened: pa.Array, before: pa.Array, after: pa.Array, stop_after: pa.Array, carried: pa.Array) -> pa.Array:
    found = [{name: np.zeros(0, np.int64) for name in NAMES}]
    for size, v in groups(own, first, n, opened, before, after, stop_after, carried):
        found.append({name: np.add.reduceat(whole(name, x), np.cumsum(size) - size) for name, x in v.items()})
    return pa.StructArray.from_arrays([pa.array(np.concatenate([x[name] for x in found])) for name in NAMES], list(NAMES))


def values(*line: Column | str) -> Column:
    """The places of each character of a line as in places(); a line mustn't be empty."""
    return F.arrow_udf(_values, "array<struct<" + ",".join(f"{name}:{'boolean' if most == 0 else 'double'}" for name, most in NAMES.items()) + ">>")(*line)


def sums(*line: Column | str) -> Column:
    """The sums of values(), of fractions in millionths."""
    return F.arrow_udf(_sums, "struct<" + ",".join(f"{name}:bigint" for name in NAMES) + ">")(*line)
