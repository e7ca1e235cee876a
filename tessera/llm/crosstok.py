"""Alignment of two tokenizers: groups of tokens between common ends, linked tokens, and how widely each link is seen.

An event is the end of a token, in bytes of the text; events of one side travel packed, as the ids of a run of tokens whose
lengths the vocabulary knows, from the offset of the run on. The events of both sides are united, dealt out by document and
sorted by offset; a sweep with the state of one document (counters and a running digest) emits groups and links. A run ends
where tokens of both sides do, so the sweep carries no token over.

The different id pairs of a document go to a chunk's list; the chunks' lists are summed by pair, a pair's count comes back
to each chunk once, and the documents add up their links.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, give_back, partitions, small_batches, texts
from .tokenfile import put

#: Tokens of a run, about; tokens that are swept at once; and entries of a chunk, of which it has one for each document and pair.
RUN = 1 << 14
SWEEP = 1 << 19
CHUNK = 1 << 21
#: Units of text that a worker knows, and their bytes.
KNOWN_UNITS = 700_000
KNOWN_BYTES = 32 << 20

#: ASCII white space, with the separators that some take for it; what of it a piece may hold; white space beyond ASCII.
SPACE, INNER = rb"\x09-\x0d\x1c-\x20", rb"\x09\x0b-\x0d\x1c-\x1f"
#: A unit: white space and what follows up to the next space or line feed. No token of either side crosses its ends.
UNIT = re.compile(rb"[%b]+[^%b]*(?:[%b][%b]*[^%b]*)*" % (SPACE, SPACE, INNER, SPACE, SPACE))
ODD = re.compile("[\x85\xa0 ᠎ -‍    　﻿]")


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: printable bytes for themselves, the others, in order,
    from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Numbers(dict):
    """Numbers units as they come; new ones are listed."""

    def __init__(self):
        super().__init__()
        self.new: list[bytes] = []

    def __missing__(self, unit: bytes) -> int:
        self.new.append(unit)
        self[unit] = k = len(self)
        return k


class Pair:
    """Both tokenizers, the bytes of their tokens, and the ids of the units met so far."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        letters = byte_letters()
        self.bytes_a = [b""] * (max(self.a.get_vocab().values()) + 1)
        for piece, i in self.a.get_vocab().items():
            self.bytes_a[i] = bytes(letters[c] for c in piece) if set(piece) <= letters.keys() else piece.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.len_a, self.len_b = (np.fromiter(map(len, x), np.int64, len(x)) for x in (self.bytes_a, self.bytes_b))
        self.space = self.b.piece_to_id("▁")
        # Units are right only if no piece has a space behind anything else, or a line feed beside anything.
        self.by_unit = not any(re.search("[^▁]▁", p) or ("\n" in p and len(p) > 1) for p in pieces)
        self.clear()

    def clear(self) -> None:
        self.at = Numbers()
        self.held, self.used_a, self.used_b = 0, 0, 0
        self.n_a, self.n_b, self.start_a, self.start_b = (np.empty(1 << 14, np.int64) for _ in range(4))
        self.good, self.ids_a, self.ids_b = np.empty(1 << 14, bool), np.empty(1 << 16, np.int32), np.empty(1 << 16, np.int32)

    def encode_b(self, units: list[bytes]) -> list[list[int]]:
        """The tokenizer sets a space before a text: one is taken off each unit, or the token of the added one, which joins nothing."""
        bare = [u[1:].decode() if u[:1] == b" " else u.decode() for u in units]
        out = self.b.encode(bare, num_threads=1)
        return [[self.space] if u == b" " else ids if u[:1] == b" " else ids[1:] for u, ids in zip(units, out)]

    def learn(self) -> None:
        """The ids of the units that were numbered last."""
        units, self.at.new = self.at.new, []
        k = len(self.at) - len(units)
        for lo in range(0, len(units), 4096):
            some = units[lo : lo + 4096]
            size = np.fromiter(map(len, some), np.int64, len(some))
            a = [e.ids for e in self.a.encode_batch_fast([u.decode() for u in some], add_special_tokens=False)]
            good_a, n_a, ids_a = self.back(some, size, a, self.bytes_a, self.len_a)
            good_b, n_b, ids_b = self.back(some, size, self.encode_b(some), self.bytes_b, self.len_b)
            self.n_a, self.n_b, self.good = put(self.n_a, k + lo, n_a), put(self.n_b, k + lo, n_b), put(self.good, k + lo, good_a & good_b)
            self.start_a, self.start_b = put(self.start_a, k + lo, self.used_a + np.cumsum(n_a) - n_a), put(self.start_b, k + lo, self.used_b + np.cumsum(n_b) - n_b)
            self.ids_a, self.ids_b = put(self.ids_a, self.used_a, ids_a), put(self.ids_b, self.used_b, ids_b)
            self.used_a, self.used_b = self.used_a + len(ids_a), self.used_b + len(ids_b)
            self.held += int(size.sum())

    @staticmethod
    def back(units: list[bytes], size: np.ndarray, ids: list[list[int]], pieces: list[bytes], lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Whether the tokens of each unit give it back, how many they are, and all of them in a row."""
        n, flat = np.fromiter(map(len, ids), np.int64, len(ids)), list(chain.from_iterable(ids))
        array = np.array(flat, np.int32)
        ends = np.concatenate(([0], np.cumsum(lengths[array])))[np.concatenate(([0], np.cumsum(n)))]
        if (np.diff(ends) == size).all() and b"".join(map(pieces.__getitem__, flat)) == b"".join(units):
            return np.ones(len(units), bool), n, array
        return np.array([b"".join(map(pieces.__getitem__, x)) == u for u, x in zip(units, ids)], bool), n, array

    def units(self, text: bytes) -> list[bytes]:
        """The units of a space and the text; a text with white space beyond ASCII is one."""
        if not text:
            return []
        if not self.by_unit or (not text.isascii() and ODD.search(text.decode())):
            return [b" " + text]
        return UNIT.findall(b" " + text)

    def numbers(self, units: list[bytes]) -> np.ndarray:
        if len(self.at) > KNOWN_UNITS or self.held > KNOWN_BYTES:
            self.clear()
        out = np.fromiter(map(self.at.__getitem__, units), np.int64, len(units))
        if self.at.new:
            self.learn()
        return out


def gathered(ids: np.ndarray, start: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The stretches of ids one after another, and where each ends."""
    ends = np.cumsum(n)
    return ids[np.repeat(start - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)], ends


#: The tokenizers that this worker has loaded.
_pairs: dict[tuple[str, str], Pair] = {}


def pair_for(paths: tuple[str, str]) -> Pair:
    if paths not in _pairs:
        _pairs.clear()
        _pairs[paths] = Pair(*paths)
    return _pairs[paths]


def packed(ids: np.ndarray, squeeze) -> bytes:
    """Ids by planes of bytes, compressed."""
    return squeeze(np.ascontiguousarray(ids.astype("<i4").view(np.uint8).reshape(-1, 4).T).tobytes())


def unpacked(data: bytes, expand) -> np.ndarray:
    raw = np.frombuffer(expand(data), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(raw.T).view("<i4").ravel()


EVENTS = ["row", "doc_id", "at", "side", "n", "ids"]


def tokenizer(paths: tuple[str, str], run: int):
    def tokenize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, squeeze = pair_for(paths), zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            units = [pair.units(t) for t in texts(batch.column("text"))]
            n_units = np.fromiter(map(len, units), np.int64, len(units))
            flat = [u for x in units for u in x]
            k = pair.numbers(flat)
            size = np.fromiter(map(len, flat), np.int64, len(flat))
            a, end_a = gathered(pair.ids_a, pair.start_a[k], pair.n_a[k])
            b, end_b = gathered(pair.ids_b, pair.start_b[k], pair.n_b[k])
            end_a, end_b, end = (np.concatenate(([0], x)) for x in (end_a, end_b, np.cumsum(size)))
            bad = np.concatenate(([0], np.cumsum(~pair.good[k])))
            rows: list[tuple] = []
            last = np.cumsum(n_units)
            for doc, (lo, hi) in enumerate(zip((last - n_units).tolist(), last.tolist())):
                if lo == hi or bad[hi] > bad[lo]:
                    rows += [(doc, 0, side, 0, b"") for side in (0, 1)]
                    continue
                # Units up to each multiple of `run` tokens.
                most = np.maximum(end_a[lo : hi + 1] - end_a[lo], end_b[lo : hi + 1] - end_b[lo])
                cut = np.unique(np.append(lo + np.searchsorted(most, np.arange(run, int(most[-1]), run)), (lo, hi))).tolist()
                for x, y in zip(cut, cut[1:]):
                    for side, ids, ends in ((0, a, end_a), (1, b, end_b)):
                        part = ids[ends[x] : ends[y]]
                        rows.append((doc, int(end[x] - end[lo]), side, len(part), packed(part, squeeze)))
            doc, at, side, n, ids = zip(*rows) if rows else ((),) * 5
            take = pa.array(doc, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("row").take(take), batch.column("doc_id").take(take), pa.array(at, pa.int64()), pa.array(side, pa.int8()), pa.array(n, pa.int32()), pa.array(ids, pa.binary())], EVENTS)
        give_back()

    return tokenize


def digit_rows(most: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each number below most its decimal digits, from the left, with room for a mark behind; and how many they are."""
    texts_of = [str(i).encode() for i in range(most)]
    width = max(map(len, texts_of), default=1) + 1
    return np.frombuffer(b"".join(t.ljust(width) for t in texts_of), np.uint8).reshape(most, width), np.fromiter(map(len, texts_of), np.int64, most)


class Sweep:
    """The sweep over many runs at once: all A ids, all B ids, in order of document and offset."""

    def __init__(self, pair: Pair):
        self.len_a, self.len_b = pair.len_a, pair.len_b
        self.shift = max(1, (len(self.len_b) - 1).bit_length())
        self.digits, self.n_digits = digit_rows(max(len(self.len_a), len(self.len_b)))

    def groups(self, a: np.ndarray, b: np.ndarray, last_a: np.ndarray, last_b: np.ndarray) -> tuple[bytes, np.ndarray]:
        """`a1,a2|b1;` for each group, and where each group's text ends; last_a and last_b: whether a token ends its group."""
        before_a, before_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
        many_a, many_b = np.bincount(before_a), np.bincount(before_b)
        place_a = np.arange(len(a)) + (np.cumsum(many_b) - many_b)[before_a]
        place_b = np.arange(len(b)) + np.cumsum(many_a)[before_b]
        ids, mark = np.empty(len(a) + len(b), np.int64), np.full(len(a) + len(b), ord(","), np.uint8)
        ids[place_a], ids[place_b] = a, b
        mark[place_a[last_a]], mark[place_b[last_b]] = ord("|"), ord(";")
        rows, n = self.digits[ids], self.n_digits[ids]
        rows[np.arange(len(ids)), n] = mark
        text = rows[np.arange(rows.shape[1]) <= n[:, None]].tobytes()
        return text, np.cumsum(n + 1)[place_b[last_b]]

    def __call__(self, a: np.ndarray, b: np.ndarray, doc_a: np.ndarray) -> dict:
        """doc_a: how many A tokens are in each document. Of each document: n_b, n_groups, n_links, its group text, and its
        different pairs with how often they are linked."""
        ends_a, ends_b = np.cumsum(self.len_a[a]), np.cumsum(self.len_b[b])
        all_ends = np.union1d(ends_a, ends_b)
        # Between two ends in a row lies one token of each side: they are linked, and no other way.
        link_a, link_b = np.searchsorted(ends_a, all_ends), np.searchsorted(ends_b, all_ends)
        last_a, last_b = ends_b[np.searchsorted(ends_b, ends_a)] == ends_a, ends_a[np.searchsorted(ends_a, ends_b)] == ends_b
        text, text_ends = self.groups(a, b, last_a, last_b)
        stop_a = np.cumsum(doc_a)
        stop = np.concatenate(([0], ends_a))[stop_a]  # in bytes
        doc_of = np.repeat(np.arange(len(doc_a)), np.diff(np.concatenate(([0], np.searchsorted(all_ends, stop, side="right")))))
        group_stop = np.concatenate(([0], np.cumsum(last_a)))[stop_a]
        bits = self.shift + max(1, (len(self.len_a) - 1).bit_length())
        code = np.sort((doc_of.astype(np.int64) << bits) | (a[link_a].astype(np.int64) << self.shift) | b[link_b])
        first = np.flatnonzero(np.concatenate((np.ones(min(1, len(code)), bool), code[1:] != code[:-1])))
        kinds = code[first]
        each = lambda x: np.diff(np.concatenate(([0], x)))
        return {
            "n_b": each(np.searchsorted(ends_b, stop, side="right")),
            "n_groups": each(group_stop),
            "n_links": np.bincount(doc_of, minlength=len(doc_a)),
            "text": text,
            "text_stop": np.concatenate(([0], text_ends))[group_stop],
            "codes": kinds & ((1 << bits) - 1),
            "times": np.diff(np.append(first, len(code))),
            "code_stop": np.searchsorted(kinds >> bits, np.arange(len(doc_a)), side="right"),
        }


class Chunk:
    """Documents and their pairs, until they are as many as a row should hold."""

    COUNTS = ("n_a", "n_b", "n_groups", "n_links")
    FIELDS = ("chunk", "doc_id", *COUNTS, "groups_sha256", "n_pairs", "entries", "codes", "docs")

    def __init__(self):
        self.doc_id, self.sha, self.counts, self.codes, self.times = [], [], [], [], []
        self.size = 0

    def add(self, doc_id, counts: list[int], sha: str, codes: np.ndarray, times: np.ndarray) -> None:
        self.doc_id.append(doc_id)
        self.counts.append(counts)
        self.sha.append(sha)
        self.codes.append(codes)
        self.times.append(times)
        self.size += len(codes) + 16

    def row(self, number: int, kind: pa.DataType) -> pa.RecordBatch:
        squeeze = zstandard.ZstdCompressor(level=1).compress
        sizes = np.fromiter(map(len, self.codes), np.int32, len(self.codes))
        codes, place, docs = np.unique(np.concatenate(self.codes), return_inverse=True, return_counts=True)
        # Places ascend in a document, so steps between them are small.
        step = np.diff(place, prepend=0)
        step[(np.cumsum(sizes) - sizes)[sizes > 0]] = place[(np.cumsum(sizes) - sizes)[sizes > 0]]
        a, b = packed(step, squeeze), packed(np.concatenate(self.times), squeeze)
        one = lambda x, t: pa.array([x], pa.list_(t))
        counts = np.array(self.counts, np.int64).reshape(-1, 4)
        cols = [pa.array([number], pa.int64()), one(self.doc_id, kind), *(one(counts[:, k], pa.int64()) for k in range(4)), one(self.sha, pa.string()), one(sizes, pa.int32())]
        cols += [pa.array([len(a).to_bytes(8, "little") + a + b], pa.binary()), one(codes, pa.int64()), one(docs, pa.int64())]
        return pa.RecordBatch.from_arrays(cols, list(self.FIELDS))


def sweeper(paths: tuple[str, str], kind: pa.DataType, at_once: int, most: int):
    def sweep_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = pair_for(paths)
        pair.clear()  # what its units take isn't needed here
        sweep, expand = Sweep(pair), zstandard.ZstdDecompressor().decompress
        ctx = TaskContext.get()
        number = (ctx.partitionId() if ctx else 0) << 32
        chunk, state = Chunk(), None
        docs: list[list] = []  # row, doc_id, A tokens: the documents whose runs are held
        a, b, size = [], [], 0

        def close() -> None:
            row, doc_id, counts, digest, codes, times = state
            if codes:
                kinds, back = np.unique(np.concatenate(codes), return_inverse=True) if len(codes) > 1 else (codes[0], None)
                times = np.bincount(back, np.concatenate(times)).astype(np.int64) if back is not None else times[0]
            else:
                kinds, times = np.empty(0, np.int64), np.empty(0, np.int64)
            chunk.add(doc_id, counts, digest.hexdigest() if counts[0] else "", kinds, times)

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal state, chunk, number, size
            out = sweep(np.concatenate([*a, np.empty(0, np.int32)]), np.concatenate([*b, np.empty(0, np.int32)]), np.array([d[2] for d in docs], np.int64))
            text_at = code_at = 0
            for k, (row, doc_id, n_a) in enumerate(docs):
                if state is None or state[0] != row:
                    if state is not None:
                        close()
                        if chunk.size >= most:
                            yield chunk.row(number, kind)
                            number, chunk = number + 1, Chunk()
                    state = (row, doc_id, [0, 0, 0, 0], hashlib.sha256(), [], [])
                if n_a:
                    for j, n in enumerate((n_a, out["n_b"][k], out["n_groups"][k], out["n_links"][k])):
                        state[2][j] += int(n)
                    stop = int(out["text_stop"][k])
                    state[3].update((b";" if state[4] else b"") + out["text"][text_at : stop - 1])
                    text_at, hi = stop, int(out["code_stop"][k])
                    state[4].append(out["codes"][code_at:hi])
                    state[5].append(out["times"][code_at:hi])
                    code_at = hi
            docs.clear()
            a.clear()
            b.clear()
            size = 0

        for batch in batches:
            cols = [batch.column(c).to_pylist() for c in EVENTS]
            for row, doc_id, _, side, n, ids in zip(*cols):
                if side == 0:
                    if size >= at_once:  # both runs of an offset have come
                        yield from flush()
                    if not docs or docs[-1][0] != row:
                        docs.append([row, doc_id, 0])
                    docs[-1][2] += n
                if n:
                    (a, b)[side].append(unpacked(ids, expand))
                    size += n
        if docs:
            yield from flush()
        if state is not None:
            close()
            yield chunk.row(number, kind)
        give_back()

    return sweep_rows


def adder(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks with their pairs' counts: a row for each document."""
    expand = zstandard.ZstdDecompressor().decompress
    for batch in batches:
        for k in range(batch.num_rows):
            one = lambda c: batch.column(c)[k].values  # noqa: B023, E731
            entries = batch.column("entries")[k].as_py()
            cut = 8 + int.from_bytes(entries[:8], "little")
            step, times = unpacked(entries[8:cut], expand).astype(np.int64), unpacked(entries[cut:], expand).astype(np.int64)
            sizes = one("n_pairs").to_numpy(zero_copy_only=False).astype(np.int64)
            ends = np.cumsum(sizes)
            place = np.cumsum(step)
            place -= np.repeat(np.concatenate(([0], place))[ends - sizes], sizes)  # each document starts anew
            known = one("counts") if batch.column("counts")[k].is_valid else None
            total, best = np.zeros(0, np.int64), np.zeros(0, np.int64)
            if known is not None:
                order = np.argsort(known.field("code").to_numpy(), kind="stable")
                total, best = known.field("total").to_numpy()[order], known.field("best").to_numpy(zero_copy_only=False)[order].astype(np.int64)
            sums = [np.diff(np.concatenate(([0], np.cumsum(x)))[np.concatenate(([0], ends))]) for x in (times * best[place], times * total[place])]
            own = [one(c) for c in ("doc_id", *Chunk.COUNTS)]
            yield pa.RecordBatch.from_arrays([*own, *(pa.array(x, pa.int64()) for x in sums), one("groups_sha256")], ["doc_id", *Chunk.COUNTS, "n_best", "count_sum", "groups_sha256"])


def events(spark: SparkSession, docs: DataFrame, paths: tuple[str, str]) -> DataFrame:
    """docs(doc_id, text, ...): the end events of both sides: (row, doc_id, at, side, n, ids), a row for each run."""
    small_batches(spark, 256)
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").alias("doc_id"), F.col("text").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(tokenizer(paths, RUN), f"row long, doc_id {kind}, at long, side byte, n int, ids binary")


def align(spark: SparkSession, docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """docs(doc_id, text, ...), a byte-level tokenizer's JSON file A and a sentencepiece model B: a row for each row of docs:
    (doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256).

    A encodes a space and the text, B the text, before which it sets the space itself; special tokens' strings in a text are
    plain text. Byte offsets where tokens of both end cut them into groups; tokens whose bytes overlap are linked. A pair's
    count is the number of rows of docs that have it linked; n_best: links whose count is the highest of their A id, ties
    included; count_sum: the counts of all links. groups_sha256: of `a1,a2|b1;a3|b2,b3`, ids in order. Texts that are null,
    empty, or that the tokens of either side don't give back byte by byte, have no tokens: zeros and ''. Repeated rows are
    documents of their own. Other columns are ignored. An empty table gives an empty result. A text with white space beyond
    ASCII is encoded as a whole.
    """
    s, paths = Scratch(spark), (path_a, path_b)
    found = events(spark, docs, paths).repartition(partitions(spark), "row").sortWithinPartitions("row", "at", "side")
    kind = found.schema["doc_id"].dataType.simpleString()
    arrow_kind = pa_type(found)
    schema = f"chunk long, doc_id array<{kind}>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, groups_sha256 array<string>, n_pairs array<int>, entries binary, codes array<long>, docs array<long>"
    linked = s.table(found.mapInArrow(sweeper(paths, arrow_kind, SWEEP, CHUNK), schema), "linked")
    shift = Sweep(pair_for(paths)).shift
    each = linked.select("chunk", F.explode(F.arrays_zip("codes", "docs")).alias("x")).select("chunk", F.col("x.codes").alias("code"), F.col("x.docs").alias("docs"))
    # A pair's lists stand beside its count, so that each list gets it back once and without a join.
    pairs = s.table(each.groupBy("code").agg(F.sum("docs").alias("total"), F.collect_list("chunk").alias("chunks")).withColumn("a", F.shiftright("code", shift)), "pairs")
    # There are no more rows of these than A has ids.
    highest = pairs.groupBy("a").agg(F.max("total").alias("most"))
    counts = pairs.join(F.broadcast(highest), "a").select(F.struct("code", "total", (F.col("total") == F.col("most")).alias("best")).alias("count"), "chunks")
    back = counts.select("count", F.explode("chunks").alias("chunk")).groupBy("chunk").agg(F.collect_list("count").alias("counts"))
    whole = linked.drop("codes", "docs").join(back.hint("shuffle_hash"), "chunk", "left")
    return whole.mapInArrow(adder, f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")


def pa_type(df: DataFrame) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(df.schema["doc_id"].dataType)
