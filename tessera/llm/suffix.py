"""Removal of repeated strings of bytes by suffix order: longest-previous-factor arrays over what can repeat at all.

A suffix array of the whole corpus would have to be built in one place. Here suffixes meet only where they can be equal.
Of each window of `length` bytes the leftmost of the smallest hashes of its GRAM-byte strings is its anchor, so equal
windows have equal anchors at equal places in them, and consecutive windows mostly share one: they are a span. Spans are
told apart by the anchor's hash (key) and a digest of their bytes (ctx), and counted. A key with one span that stands
once is unique; a span that stands twice or more repeats whole. What is left are keys with several different spans,
which may overlap in part: their bytes are fetched once each, and groups of whole keys are put into suffix order by
doubling. For each window the previous and next smaller positions in that order give its longest previous factor, and
the greater ones its longest next factor; a factor of `length` bytes is an earlier, or a later, match.

A key with more than CROWD different spans isn't put into one task: its spans are cut into cells of fewer windows at fixed
distances from the anchor, keyed by the bytes that all windows of the cell would share, and judged in the same way. A cell
of one window has no different spans, so this ends.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, give_back, partitions, small_batches, texts
from .wordhash import MIX, stir

#: Bytes of a string of which the removed text consists.
LENGTH = 400
#: Bytes whose hash may be an anchor.
GRAM = 32
#: Different spans of a key that are put into suffix order in one task.
CROWD = 200
#: Windows of a cell, step by step.
CELLS = (64, 8, 1)
#: Bytes that are hashed, and bytes that are put into suffix order, at once.
PIECE = 1 << 19
BATCH = 1 << 17
#: In the array of anchors the low bits hold the place, the others the hash.
PLACE = np.uint64((1 << 24) - 1)

RUN = "array<struct<lo:int,hi:int>>"
RUN_TYPE = pa.list_(pa.struct({"lo": pa.int32(), "hi": pa.int32()}))


def gram_hashes(data: np.ndarray, seed: int) -> np.ndarray:
    """The hash of the GRAM bytes from each place on, by doubling."""
    table = stir(np.arange(1, 257, dtype=np.uint64) * MIX + np.uint64(seed))
    h, size = table[data], 1
    while size < GRAM:
        h = stir(h[:-size] * MIX + h[size:])
        size *= 2
    return h


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while 2 * size <= width:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return np.minimum(x[: len(x) - (width - size)], x[width - size :]) if width > size else x


def spans_of(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, length: int, seed: int) -> tuple[np.ndarray, ...]:
    """Texts lie from starts to ends in data. Of each span the first window, the number of windows, the anchor's place and
    its hash."""
    h = gram_hashes(data, seed)
    best = sliding_min((h & ~PLACE) | np.arange(len(h), dtype=np.uint64), length - GRAM + 1)
    edge = np.zeros(len(data) + 1, np.int8)
    np.add.at(edge, starts, 1)
    np.add.at(edge, np.maximum(ends - length + 1, starts), -1)
    at = np.flatnonzero(np.cumsum(edge)[: len(best)] > 0)
    anchor = (best[at] & PLACE).astype(np.int64)
    first = np.flatnonzero(np.concatenate((np.ones(min(1, len(at)), bool), (anchor[1:] != anchor[:-1]) | (at[1:] != at[:-1] + 1))))
    count = np.diff(np.append(first, len(at)))
    return at[first], count, anchor[first], h[anchor[first]]


def pieces(held: list[bytes], length: int, piece: int) -> Iterator[list[tuple[int, int, bytes]]]:
    """(number of the text, place in it, bytes): texts of about `piece` bytes at once, long texts in parts that share length - 1 bytes."""
    out, size = [], 0
    for k, text in enumerate(held):
        for at in range(0, max(1, len(text) - length + 1), piece):
            part = text[at : at + piece + length - 1] if len(text) > piece else text
            if len(part) >= length:
                out.append((k, at, part))
                size += len(part)
            if size >= piece:
                yield out
                out, size = [], 0
    if out:
        yield out


def cutter(length: int, seed: int, piece: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        secret = seed.to_bytes(8, "little")
        for batch in batches:
            held = texts(batch.column("text"))
            for group in pieces(held, length, piece):
                data = b"".join(p for _, _, p in group)
                ends = np.cumsum([len(p) for _, _, p in group])
                starts = ends - [len(p) for _, _, p in group]
                first, count, anchor, key = spans_of(np.frombuffer(data, np.uint8), starts, ends, length, seed)
                which = np.searchsorted(ends, first, side="right")
                ctx = [blake2b(data[a : a + n + length - 1], digest_size=16, key=secret).digest() for a, n in zip(first.tolist(), count.tolist())]
                row = np.array([k for k, _, _ in group])[which]
                pos = first - starts[which] + np.array([at for _, at, _ in group])[which]
                own = [batch.column(c).take(pa.array(row)) for c in ("doc_id", "a", "b")]
                rest = [pa.array(pos), pa.array(count.astype(np.int32)), pa.array((anchor - first).astype(np.int32)), pa.array(key.view(np.int64)), pa.array(ctx, pa.binary())]
                yield pa.RecordBatch.from_arrays([*own, *rest], ["doc_id", "a", "b", "pos", "n_win", "lead", "key", "ctx"])
        give_back()

    return cut


def block_ranks(data: np.ndarray, length: int) -> dict[int, np.ndarray]:
    """By size, 8 and its doubles to `length`: the rank of the block of so many bytes at each place, where equal blocks have
    equal ranks. Behind the end lie zeros."""
    padded = np.concatenate((data, np.zeros(length + 8, np.uint8)))
    keys = np.ndarray(len(data) + length, ">u8", padded, strides=(1,)).astype(np.uint64)
    out, size = {}, 8
    while True:
        order = np.argsort(keys)
        held = keys[order]
        rank = np.empty(len(keys), np.int32)
        rank[order] = np.cumsum(np.concatenate(([0], held[1:] != held[:-1])))
        out[size] = rank
        if 2 * size > length:
            return out
        after = np.concatenate((rank[size:], np.zeros(size, np.int32)))
        keys = (rank.astype(np.uint64) << np.uint64(32)) | after.astype(np.uint64)
        size *= 2


def nearest_smaller(x: np.ndarray) -> np.ndarray:
    """Of each place the last place before it with a smaller value, or -1: pointers that jump over what is greater."""
    back = np.arange(-1, len(x) - 1)
    left = np.arange(len(x))
    while len(left):
        j = back[left]
        left = left[(j >= 0) & (x[j] > x[left])]
        back[left] = back[back[left]]
    return back


def common_prefix(ranks: dict[int, np.ndarray], data: np.ndarray, a: np.ndarray, b: np.ndarray, length: int) -> np.ndarray:
    """How many bytes are equal from a and from b on, up to length; 0 where a is -1."""
    top = max(ranks)
    out = np.zeros(len(a), np.int64)
    full = (a >= 0) & (ranks[top][a] == ranks[top][b]) & (ranks[top][a + (length - top)] == ranks[top][b + (length - top)])
    out[full] = length
    part = np.flatnonzero(~full & (a >= 0))
    a, b, done = a[part], b[part], np.zeros(len(part), np.int64)
    for size in sorted(ranks, reverse=True):
        live = done + size <= length
        done += size * (live & (ranks[size][a + done * live] == ranks[size][b + done * live]))
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    for _ in range(8):  # what is shorter than the smallest block
        done += (done < length) & (padded[a + done] == padded[b + done]) & (np.maximum(a, b) + done < len(data))
    out[part] = done
    return out


def factors(data: np.ndarray, at: np.ndarray, length: int, later: bool) -> tuple[np.ndarray, np.ndarray]:
    """Longest previous and, if asked, next factors, up to length, of the suffixes that start at the given places, ascending,
    each of which has length bytes: their longest common prefixes with the suffixes at the previous and next smaller, or
    greater, places in suffix order."""
    ranks = block_ranks(data, length)
    top = max(ranks)
    # Suffixes with equal first blocks are put in order by the block that ends at length, which overlaps the first.
    place = np.lexsort((at, ranks[top][at + length - top], ranks[top][at]))
    order = at[place]

    def longest(value: np.ndarray) -> np.ndarray:
        before = nearest_smaller(value)
        after = len(value) - 1 - nearest_smaller(value[::-1])[::-1]
        both = [common_prefix(ranks, data, np.where((j >= 0) & (j < len(order)), order[np.clip(j, 0, len(order) - 1)], -1), order, length) for j in (before, after)]
        out = np.empty(len(order), np.int64)
        out[place] = np.maximum(*both)
        return out

    return longest(order), longest(-order) if later else np.zeros(len(at), np.int64)


def runs_of(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.flatnonzero(np.diff(np.concatenate(([False], flags, [False])).astype(np.int8)))
    return edge[::2], edge[1::2]


def comparer(length: int, first_stays: bool, at_once: int):
    """Rows (key, ctx, body, ...), keys together, in order of their first places: rows (key, ctx, runs) of the windows of each body
    that stand in an earlier one, or, if the first doesn't stay, in any other."""

    def judge(keys: list, ctxs: list, bodies: list[bytes]) -> pa.RecordBatch:
        data = np.frombuffer(b"".join(bodies), np.uint8)
        ends = np.cumsum([len(b) for b in bodies])
        starts = ends - [len(b) for b in bodies]
        n = ends - starts - length + 1
        row = np.repeat(np.arange(len(bodies)), n)
        offset = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        before, after = factors(data, starts[row] + offset, length, not first_stays)
        hit = (before >= length) | (after >= length)
        out = []
        for k, stop in enumerate(np.cumsum(n).tolist()):
            lo, hi = runs_of(hit[stop - int(n[k]) : stop])
            out.append([{"lo": x, "hi": y} for x, y in zip(lo.tolist(), hi.tolist())])
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(ctxs, pa.binary()), pa.array(out, RUN_TYPE)], ["key", "ctx", "runs"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, ctxs, bodies, size, seen = [], [], [], 0, set()
        for batch in batches:
            for key, ctx, body in zip(batch.column("key").to_pylist(), batch.column("ctx").to_pylist(), batch.column("body").to_pylist()):
                if not keys or key != keys[-1]:
                    seen.clear()
                    if size >= at_once:
                        yield judge(keys, ctxs, bodies)
                        keys, ctxs, bodies, size = [], [], [], 0
                if ctx in seen:  # fetched from each of several equal rows
                    continue
                seen.add(ctx)
                keys.append(key)
                ctxs.append(ctx)
                bodies.append(body)
                size += len(body)
        if keys:
            yield judge(keys, ctxs, bodies)
        del keys, ctxs, bodies
        give_back()

    return compare


def celler(length: int, width: int, seed: int):
    """Cuts spans into cells of `width` windows at fixed distances from the anchor. A cell's key is of the bytes that lie in all
    windows at its distances, whether the span has them or not."""

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        secret = seed.to_bytes(8, "little")
        for batch in batches:
            rows: dict[str, list] = {c: [] for c in ("take", "off", "key", "ctx", "lead", "n_win", "body")}
            for k, (key, lead, body) in enumerate(zip(batch.column("key").to_pylist(), batch.column("lead").to_pylist(), batch.column("body").to_pylist())):
                n, off = len(body) - length + 1, 0
                while off < n:
                    distance = lead - off  # of the anchor from the first window of the cell
                    cell = distance // width
                    stop = min(n, lead - cell * width + 1)
                    low, high = lead - cell * width, lead - cell * width - width + 1 + length
                    part = body[off : stop + length - 1]
                    rows["take"].append(k)
                    rows["off"].append(off)
                    rows["key"].append(int.from_bytes(blake2b(b"%d %d %d " % (key, width, cell) + body[low:high], digest_size=8, key=secret).digest(), "little", signed=True))
                    rows["ctx"].append(blake2b(part, digest_size=16, key=secret).digest())
                    rows["lead"].append(distance)
                    rows["n_win"].append(stop - off)
                    rows["body"].append(part)
                    off = stop
            take = pa.array(rows["take"], pa.int64())
            own = [batch.column(c).take(take) for c in ("key", "ctx", "n", "first")]
            rest = [pa.array(rows[c], t) for c, t in (("off", pa.int32()), ("key", pa.int64()), ("ctx", pa.binary()), ("lead", pa.int32()), ("n_win", pa.int32()), ("body", pa.binary()))]
            yield pa.RecordBatch.from_arrays([*own, *rest], ["up_key", "up_ctx", "n", "first", "off", "key", "ctx", "lead", "n_win", "body"])

    return cells


def several(s: Scratch, spans: DataFrame, name: str) -> DataFrame:
    """spans(key, ctx, n, ...), a table: those that stand twice or more, or have a key with another span; kinds is the number of
    the key's spans. The keys are a table too, so that a key of very many spans can be split in the join."""
    keys = spans.groupBy("key").agg(F.count(F.lit(1)).alias("kinds"), F.sum("n").alias("total")).where("total > 1").select("key", "kinds")
    found = s.table(spans.join(s.table(keys, f"{name}_keys"), "key"), name)
    s.drop(f"{name}_keys")
    return found


def marks(spans: DataFrame, verdicts: DataFrame, first: Column, first_stays: bool) -> DataFrame:
    """spans with runs, the windows that go: of a span that stands elsewhere (or, if the first stays, before) all, of another
    those that its verdict names."""
    whole = (first > F.col("v.first")) if first_stays else (F.col("v.n") > 1)
    all_of_it = F.array(F.struct(F.lit(0).alias("lo"), F.col("x.n_win").alias("hi"))).cast(RUN)
    joined = spans.alias("x").join(verdicts.alias("v"), ["key", "ctx"])
    return joined.withColumn("gone", F.when(whole, all_of_it).otherwise(F.col("v.runs"))).where("size(gone) > 0")


def settle(s: Scratch, bodies: DataFrame, length: int, first_stays: bool, seed: int, level: int = 0) -> DataFrame:
    """bodies(key, ctx, n, kinds, lead, first, body): (key, ctx, runs), the windows of each that stand in others."""
    few = bodies.where(F.col("kinds") <= CROWD).select("key", "ctx", "first", "body")
    few = few.repartition(partitions(s.spark), "key").sortWithinPartitions("key", "first", "ctx").select("key", "ctx", "body")
    out = s.table(few.mapInArrow(comparer(length, first_stays, BATCH), f"key long, ctx binary, runs {RUN}").where("size(runs) > 0"), f"runs{level}")
    many = bodies.where(F.col("kinds") > CROWD)
    if level == len(CELLS) or many.isEmpty():
        return out
    kind = bodies.schema["first"].dataType.simpleString()
    cells = many.select("key", "ctx", "n", "first", "lead", "body").mapInArrow(celler(length, CELLS[level], seed), f"up_key long, up_ctx binary, n long, first {kind}, off int, key long, ctx binary, lead int, n_win int, body binary")
    cells = s.table(cells, f"cells{level}")
    known = cells.groupBy("key", "ctx").agg(F.sum("n").alias("n"), F.min("first").alias("first"), F.first("lead").alias("lead"), F.first("body").alias("body"))
    known = several(s, s.table(known, f"kinds{level}"), f"known{level}")
    inner = settle(s, known.where("kinds > 1"), length, first_stays, seed, level + 1)
    verdicts = known.select("key", "ctx", "n", "first").join(inner, ["key", "ctx"], "left")
    found = marks(cells, verdicts, F.col("x.first"), first_stays).select(F.col("up_key").alias("key"), F.col("up_ctx").alias("ctx"), F.explode(F.transform("gone", lambda r: F.struct((r["lo"] + F.col("off")).alias("lo"), (r["hi"] + F.col("off")).alias("hi")))).alias("run"))
    found = s.table(found.groupBy("key", "ctx").agg(F.collect_set("run").cast(RUN).alias("runs")), f"found{level}")
    s.drop(f"cells{level}", f"kinds{level}", f"known{level}")
    return out.union(found)


def fetcher(length: int):
    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            want = batch.column("want")
            held, off = texts(batch.column("text")), want.offsets.to_numpy()
            flat = want.flatten()
            rows = np.repeat(np.arange(len(held)), np.diff(off))
            pos, n = flat.field("pos").to_numpy().tolist(), flat.field("n_win").to_numpy().tolist()
            for lo in range(0, len(rows), 4096):
                hi = min(len(rows), lo + 4096)
                body = [held[r][p : p + m + length - 1] for r, p, m in zip(rows[lo:hi].tolist(), pos[lo:hi], n[lo:hi])]
                part = flat.slice(lo, hi - lo)
                names = ["key", "ctx", "n", "kinds", "lead", "first"]
                yield pa.RecordBatch.from_arrays([*(part.field(c) for c in names), pa.array(body, pa.binary())], [*names, "body"])
        give_back()

    return fetch


def remover(length: int):
    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cut, kept, sizes = [], [], []
            gone = batch.column("gone")
            for k, text in enumerate(texts(batch.column("text"))):
                runs: list[list[int]] = []
                if gone[k].is_valid:
                    flat = gone[k].values
                    lo, hi = flat.field("lo").to_numpy(), flat.field("hi").to_numpy() + length - 1
                    order = np.argsort(lo, kind="stable")
                    lo, hi = lo[order], np.maximum.accumulate(hi[order])
                    new = np.concatenate(([True], lo[1:] > hi[:-1]))
                    last = np.append(np.flatnonzero(new)[1:], len(lo)) - 1
                    runs = list(zip(lo[new].tolist(), hi[last].tolist()))
                edge = [0, *(x for r in runs for x in r), len(text)]
                kept.append(b"".join(text[a:b] for a, b in zip(edge[::2], edge[1::2])))
                cut.append([{"start": a, "end": b} for a, b in runs])
                sizes.append(len(text))
            kind = pa.list_(pa.struct({"start": pa.int64(), "end": pa.int64()}))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(cut, kind), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "removed", "kept"])
        give_back()

    return remove


def dedup(spark: SparkSession, docs: DataFrame, length: int = LENGTH, keep: str = "none") -> DataFrame:
    """docs(doc_id, text, ...): a row for each row of docs: (doc_id, n_bytes, removed, kept). removed: the maximal runs of bytes
    that are covered by a string of `length` bytes that also starts elsewhere, in this document or another, or, with keep =
    'first', earlier: at a smaller doc_id (null first), then a smaller digest of the text, then a smaller place. Overlapping
    places count; strings are judged on the input. kept: the other bytes.

    Texts are taken as UTF-8 bytes, null as empty, and matches never cross documents; a text shorter than length stays whole.
    Repeated rows are documents of their own; with keep = 'first', rows that share doc_id and text each keep what the first
    keeps. Other columns are ignored. An empty table gives an empty result. length is at least 2 * GRAM.
    """
    if length < 2 * GRAM or keep not in ("none", "first"):
        raise ValueError(f"length is at least {2 * GRAM}, keep is none or first")
    small_batches(spark)
    s = Scratch(spark)
    seed, first_stays = int.from_bytes(os.urandom(8), "little"), keep == "first"
    rows = docs.select(F.col("doc_id").alias("doc_id"), F.xxhash64("doc_id").alias("a"), F.substring(F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)), 1, 16).alias("b"), F.col("text").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    long = rows.where(F.octet_length("text") >= length)
    spans = s.table(long.mapInArrow(cutter(length, seed, PIECE), f"doc_id {kind}, a long, b binary, pos long, n_win int, lead int, key long, ctx binary"), "spans")
    place = F.struct("doc_id", "b", "pos", "a").alias("first")
    known = spans.groupBy("key", "ctx").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("first"), F.first("n_win").alias("n_win"), F.first("lead").alias("lead"))
    known = several(s, s.table(known, "kinds"), "known")
    s.drop("kinds")
    # The bytes of each different span, from the place where it stands first.
    wanted = known.where("kinds > 1").select(F.col("first.a").alias("a"), F.col("first.b").alias("b"), F.struct(F.col("first.pos").alias("pos"), "n_win", "key", "ctx", "n", "kinds", "lead", "first").alias("w"))
    wanted = wanted.groupBy("a", "b").agg(F.collect_list("w").alias("want"))
    first_kind = known.schema["first"].dataType.simpleString()
    bodies = long.select("a", "b", "text").join(wanted.hint("shuffle_hash"), ["a", "b"]).select("text", "want").mapInArrow(fetcher(length), f"key long, ctx binary, n long, kinds long, lead int, first {first_kind}, body binary")
    bodies = s.table(bodies, "bodies")
    runs = settle(s, bodies, length, first_stays, seed)
    # A span of few other spans and one of a crowd are of different keys: there is one verdict for each.
    verdicts = s.table(known.select("key", "ctx", "n", "first").join(runs, ["key", "ctx"], "left").where("n > 1 or runs is not null"), "verdicts")
    found = marks(spans, verdicts, F.struct("x.doc_id", "x.b", "x.pos", "x.a"), first_stays)
    found = found.select("a", "b", F.explode(F.transform("gone", lambda r: F.struct((r["lo"] + F.col("pos")).alias("lo"), (r["hi"] + F.col("pos")).alias("hi")))).alias("run"))
    found = s.table(found.groupBy("a", "b").agg(F.collect_set("run").alias("gone")), "found")
    s.keep("found")
    out = rows.join(found.hint("shuffle_hash"), ["a", "b"], "left").select("doc_id", "text", "gone")
    return out.mapInArrow(remover(length), f"doc_id {kind}, n_bytes long, removed array<struct<start:long,end:long>>, kept binary")


def report(found: DataFrame) -> DataFrame:
    """dedup()'s rows with the counts and the digest of what is kept."""
    size = F.aggregate("removed", F.lit(0).cast("long"), lambda n, r: n + r["end"] - r["start"])
    return found.select("doc_id", "n_bytes", size.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
