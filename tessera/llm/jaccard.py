"""N-gram Jaccard join with token-combination prefixes.

A document is the set of its five-word shingles ("tokens" here). Two documents link at a Jaccard similarity of 0.8 or
more. Documents with equal sets are one class from the start. Of a set of n tokens at most d = n - ceil(0.8 n) can be
missing in a partner, so if tokens are put into one order for all documents, d + 1 tokens from the front (the prefix)
must hold one that both have. Order: tokens of a single class first, which need no index at all; then rare tokens; then
frequent ones, on more than RARE classes. Rare tokens are indexed singly. Frequent ones are dealt to buckets by hash,
and pairs of a bucket's tokens are indexed; the prefix is extended until, with d tokens missing, some rare token or some
bucket's pair still remains: u + rare + sum over buckets of max(0, tokens - 1) >= d + 1.

To learn which tokens are rare, each chunk of documents deals its tokens to ranges of their hashes. A range holds a
bounded number of tokens; where that takes more than 2^COARSE ranges, tokens are dealt in two steps, the second of which
packs the rows of many chunks anew, so that rows stay long. Either step takes out the tokens that it meets often: they
are frequent anyway, and no token's postings can fill a range.

Each index entry links its members to one hub, which is verified, and the classes that this joins are contracted. Only
members of an entry that then lie in different components are looked at again: in small entries pair by pair, but for
pairs that sizes and lone tokens rule out; in large ones by blocks, with matrix products. No link between components is
lost, so components are exact.
"""

from __future__ import annotations

import math
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, give_back, partitions, small_batches, utf8
from .components import connected_components
from .wordhash import FACTORS, MIX, PIECE, stir, word_hashes, word_spans

SHINGLE = 5
#: A token on more classes than this is frequent.
RARE = 32
#: Postings of a token that more than so many classes of a chunk have are not sent: it is frequent anyway.
LOCAL = 64
#: Text bytes whose tokens are sorted together in a task, and tokens that are when they are dealt a second time.
CHUNK_BYTES = 8 << 20
CHUNK_TOKENS = 1 << 20
#: Sets, and bytes of their tokens, in a block of a crowd.
BLOCK_SETS = 512
BLOCK_BYTES = 1 << 21
#: Tokens that a range of hashes should hold on average; log2 of the ranges to which documents' chunks deal them.
RANGE_TOKENS = 1_000_000
COARSE = 12


def token_sets(data: np.ndarray, off: np.ndarray, seed: int) -> Iterator[np.ndarray]:
    """Of each text its tokens' hashes, sorted and distinct. Fewer words than five are one token, none are no token."""
    first, last, counts = word_spans(data, off)
    words = word_hashes(data, first, last, seed)
    at = np.concatenate(([0], np.cumsum(counts)))
    if len(words) >= SHINGLE:
        k = len(words) - SHINGLE + 1
        grams = words[:k] * FACTORS[0]
        for i in range(1, SHINGLE):
            grams = grams + words[i : k + i] * FACTORS[i]
        grams = stir(grams + np.uint64(SHINGLE))
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        if b - a >= SHINGLE:
            yield np.unique(grams[a : b - SHINGLE + 1])
        elif b > a:
            yield stir((words[a:b] * FACTORS[: b - a]).sum(keepdims=True) + np.uint64(b - a))
        else:
            yield np.empty(0, np.uint64)


def set_key(tokens: np.ndarray) -> int:
    """A 64-bit name of a set, as a signed number."""
    return int(stir(stir(tokens + MIX).sum(keepdims=True) + np.uint64(len(tokens)))[0].view(np.int64))


def other_key(tokens: np.ndarray) -> int:
    """A second name, for sets that share the first: 64 bits more, by which they are told apart."""
    return int(stir(stir(tokens ^ FACTORS[2]).sum(keepdims=True) ^ np.uint64(len(tokens)))[0].view(np.int64))


def name_of(tokens: np.ndarray, shared: frozenset[int]) -> int:
    key = set_key(tokens)
    return other_key(tokens) if key in shared else key


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, np.ndarray, np.ndarray]]:
    """(doc_ids, bytes, offsets) in slices of about PIECE bytes, or of one long text."""
    for batch in batches:
        data, off = utf8(batch.column("text"))
        ids = batch.column("doc_id").to_pylist()
        a = 0
        while a < len(ids):
            b = max(a + 1, int(np.searchsorted(off, off[a] + PIECE, "right")) - 1)
            yield ids[a:b], data[off[a] : off[b]], off[a : b + 1] - off[a]
            a = b


def keyed(seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(len(t), set_key(t), other_key(t)) if len(t) else (0, None, None) for _, data, off in slices([batch]) for t in token_sets(data, off, seed)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("h"), *(pa.array([f[k] for f in found], pa.int64()) for k in range(3))], ["doc_id", "h", "n", "key", "also"])

    return run


def u64(b: bytes) -> np.ndarray:
    return np.frombuffer(b, np.uint64)


def pack(tokens: np.ndarray) -> bytes:
    """Sorted numbers as their differences, byte plane by byte plane: what differs little compresses well."""
    return np.concatenate((tokens[:1], np.diff(tokens))).view(np.uint8).reshape(-1, 8).T.tobytes()


def unpack(b: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(8, -1).T).view(np.uint64).ravel().cumsum(dtype=np.uint64)


def range_of(tokens: np.ndarray, bits: int) -> np.ndarray:
    return (tokens >> np.uint64(64 - bits) if bits else np.zeros(len(tokens), np.uint64)).astype(np.int64)


POSTED = {"key": pa.int64(), "n": pa.int64(), "rng": pa.int32(), "tok": pa.binary(), "doc": pa.binary(), "docs": pa.binary(), "hot": pa.binary()}


class Dealer:
    """Deals postings to ranges: gathers rows (POSTED) and hands them on in batches."""

    def __init__(self, bits: int, local: int):
        self.bits, self.local = bits, local
        self.rows: list[dict] = []

    def batch(self) -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array([r.get(c) for r in self.rows], t) for c, t in POSTED.items()], list(POSTED))
        self.rows = []
        return out

    def deal(self, tokens: np.ndarray, doc: np.ndarray, keys: np.ndarray, sizes: np.ndarray | None, hot_tokens: np.ndarray) -> Iterator[pa.RecordBatch]:
        """tokens in order, and for each the place in keys of a class that has it. A row for each class, with its size and
        its hot tokens (without sizes, only where it has some), and one for each range that gets any."""
        head = np.flatnonzero(np.concatenate(([True], tokens[1:] != tokens[:-1]))) if len(tokens) else np.empty(0, np.int64)
        count = np.diff(np.append(head, len(tokens)))
        often = (count > self.local) | np.isin(tokens[head], hot_tokens)
        hot_tokens = np.union1d(hot_tokens, tokens[head[often]])
        hot = np.repeat(often, count)
        by = np.argsort(doc[hot], kind="stable")
        hd, ht = doc[hot][by], tokens[hot][by]
        cut = np.searchsorted(hd, np.arange(len(keys) + 1))
        for k in range(len(keys)) if sizes is not None else np.flatnonzero(np.diff(cut)).tolist():
            self.rows.append({"key": int(keys[k]), "n": None if sizes is None else int(sizes[k]), "hot": ht[cut[k] : cut[k + 1]].tobytes()})
        tokens, doc = tokens[~hot], doc[~hot]
        rng, hot_rng = range_of(tokens, self.bits), range_of(hot_tokens, self.bits)
        used = np.union1d(rng, hot_rng)
        at = [np.searchsorted(x, used, side) for x in (rng, hot_rng) for side in ("left", "right")]
        for r, a, b, c, d in zip(used.tolist(), *at):
            some, place = np.unique(doc[a:b], return_inverse=True)
            place = place.astype(np.uint16 if len(some) <= 1 << 16 else np.uint32)
            self.rows.append({"rng": r, "tok": pack(tokens[a:b]), "doc": place.tobytes(), "docs": keys[some].tobytes(), "hot": hot_tokens[c:d].tobytes()})
            if len(self.rows) >= 64:
                yield self.batch()
        if self.rows:
            yield self.batch()


def poster(seed: int, bits: int, local: int, chunk_bytes: int, shared: frozenset[int] = frozenset()):
    """Deals the tokens of each chunk of documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dealer, held, size = Dealer(bits, local), {}, 0

        def flush() -> Iterator[pa.RecordBatch]:
            if held:
                sizes = np.array([len(t) for t in held.values()])
                tokens = np.concatenate(list(held.values()))
                order = np.argsort(tokens, kind="stable")
                doc = np.repeat(np.arange(len(held), dtype=np.uint32), sizes)
                yield from dealer.deal(tokens[order], doc[order], np.fromiter(held, np.int64, len(held)), sizes, np.empty(0, np.uint64))

        for _, data, off in slices(batches):
            for t in token_sets(data, off, seed):
                if len(t):
                    held.setdefault(name_of(t, shared), t)
            size += len(data)
            if size >= chunk_bytes:
                yield from flush()
                held, size = {}, 0
        yield from flush()
        held.clear()
        give_back()

    return run


def postings(tok: bytes, doc: bytes, docs: bytes) -> tuple[np.ndarray, np.ndarray]:
    """A row's tokens, and the class of each."""
    names = np.frombuffer(docs, np.int64)
    return unpack(tok), names[np.frombuffer(doc, np.uint16 if len(names) <= 1 << 16 else np.uint32)]


def merged(toks: list[np.ndarray], keys: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Postings in order, each once: copies of a document lie in several chunks."""
    tok, key = np.concatenate(toks), np.concatenate(keys)
    order = np.lexsort((key, tok))
    tok, key = tok[order], key[order]
    new = np.ones(len(tok), bool)
    new[1:] = (tok[1:] != tok[:-1]) | (key[1:] != key[:-1])
    return tok[new], key[new]


def redealer(bits: int, local: int, chunk_tokens: int):
    """Deals rows of coarse ranges, of which a task has some, to fine ones; the classes' own rows pass through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dealer = Dealer(bits, local)
        held: dict[int, list] = {}

        def flush(r: int) -> Iterator[pa.RecordBatch]:
            toks, keys, hots, _ = held.pop(r)
            tok, key = merged(toks, keys)
            names, doc = np.unique(key, return_inverse=True)
            yield from dealer.deal(tok, doc.astype(np.uint32), names, None, np.unique(np.concatenate(hots)))

        for b in batches:
            own = pc.is_null(b.column("rng"))
            if pc.any(own).as_py():
                yield b.filter(own)
            for r, *row, hot in zip(*(b.column(c).to_pylist() for c in ("rng", "tok", "doc", "docs", "hot"))):
                if r is not None:
                    t, k = postings(*row)
                    x = held.setdefault(r, [[], [], [], 0])
                    x[0].append(t)
                    x[1].append(k)
                    x[2].append(u64(hot))
                    x[3] += len(t)
                    if x[3] >= chunk_tokens:
                        yield from flush(r)
        for r in list(held):
            yield from flush(r)

    return run


def shared_tokens(table: pa.Table, rare_most: int) -> pa.Table:
    """A range's postings: for each class its tokens that another class has too, and whether each is frequent."""
    if table.column("rng")[0].as_py() is None:  # classes' own rows pass through, and those with hot tokens only
        size = table.column("n")
        whole = pc.is_valid(size)
        none = pa.nulls(len(table), pa.binary())
        empty = pa.array([b""] * len(table), pa.binary())
        hot = table.column("hot")
        return pa.table({"key": table.column("key"), "n": size, "hot": pc.if_else(whole, hot, none), "rare": pc.if_else(whole, none, empty), "freq": pc.if_else(whole, none, hot)})
    rows = [postings(*r) for r in zip(*(table.column(c).to_pylist() for c in ("tok", "doc", "docs")))]
    tok, key = merged([t for t, _ in rows], [k for _, k in rows])
    hot = np.unique(np.concatenate([u64(h) for h in table.column("hot").to_pylist()]))
    head = np.flatnonzero(np.concatenate(([True], tok[1:] != tok[:-1]))) if len(tok) else np.empty(0, np.int64)
    count = np.diff(np.append(head, len(tok)))
    often = np.repeat((count > rare_most) | np.isin(tok[head], hot), count)
    use = often | (np.repeat(count, count) > 1)
    tok, key, often = tok[use], key[use], often[use]
    order = np.argsort(key, kind="stable")
    tok, key, often = tok[order], key[order], often[order]
    cut = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.empty(0, np.int64)
    ends = np.append(cut[1:], len(key))
    rare = [tok[a:b][~often[a:b]].tobytes() for a, b in zip(cut, ends)]
    freq = [tok[a:b][often[a:b]].tobytes() for a, b in zip(cut, ends)]
    give_back()
    return pa.table({"key": pa.array(key[cut] if len(cut) else [], pa.int64()), "n": pa.nulls(len(cut), pa.int64()), "hot": pa.nulls(len(cut), pa.binary()), "rare": pa.array(rare, pa.binary()), "freq": pa.array(freq, pa.binary())})


def missing(n: int) -> int:
    """How many of n tokens a partner may lack: n - ceil(0.8 n)."""
    return n - -(-4 * n // 5)


def signatures(n: int, lone: int, rare: np.ndarray, freq: np.ndarray) -> np.ndarray:
    """The index entries of a set of n tokens, of which `lone` are in no other class."""
    need = missing(n) + 1 - lone
    if need <= 0:
        return np.empty(0, np.uint64)
    rare = rare[np.argsort(stir(rare), kind="stable")]
    out = [stir(rare[:need] + MIX)]
    need -= len(rare)
    if need > 0 and len(freq):
        freq = freq[np.argsort(stir(freq), kind="stable")]
        level = n.bit_length() - 1
        for l in [level, level + 1] if 5 * n >= 4 << (level + 1) else [level]:
            buckets = max(1, (1 << l) // 4)
            place = (stir(freq ^ MIX) % np.uint64(buckets)).astype(np.int64)
            seen = np.zeros(len(freq), bool)
            seen[np.unique(place, return_index=True)[1]] = True
            take = int(np.searchsorted(np.cumsum(~seen), need)) + 1  # as few as give `need` beyond each bucket's first
            f, p = freq[:take], place[:take]
            order = np.argsort(p, kind="stable")
            f, p = f[order], p[order]
            start = np.searchsorted(p, p)  # the first of each token's bucket
            rank = np.arange(len(p)) - start
            second = np.repeat(np.arange(len(p)), rank)
            first = np.repeat(start, rank) + (np.arange(len(second)) - np.repeat(np.cumsum(rank) - rank, rank))
            x, y = np.minimum(f[first], f[second]), np.maximum(f[first], f[second])
            out.append(stir(stir(x) + y * FACTORS[1] + np.uint64(l + 1)))
    return np.unique(np.concatenate(out))


def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each class: its entries in the index, and all its shared tokens."""
    for b in batches:
        cols: dict[str, list] = {"sigs": [], "tokens": [], "lone": []}
        for n, hot, parts in zip(*(b.column(c).to_pylist() for c in ("n", "hot", "parts"))):
            rare = u64(b"".join(p["rare"] for p in parts))
            freq = np.union1d(u64(b"".join(p["freq"] for p in parts)), u64(hot or b""))
            rare = np.setdiff1d(rare, freq)
            lone = n - (len(rare) + len(freq))
            s = signatures(n, lone, rare, freq)
            cols["sigs"].append(s.view(np.int64))
            cols["tokens"].append(np.union1d(rare, freq).tobytes() if len(s) else b"")
            cols["lone"].append(lone)
        yield pa.RecordBatch.from_arrays([b.column("key"), b.column("n"), pa.array(cols["lone"], pa.int64()), pa.array(cols["sigs"], pa.list_(pa.int64())), pa.array(cols["tokens"], pa.binary())], ["key", "n", "lone", "sigs", "tokens"])


def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs (a, b) whose sets link."""
    for b in batches:
        good = []
        for na, nb, ta, tb in zip(*(b.column(c).to_pylist() for c in ("na", "nb", "ta", "tb"))):
            both = len(np.intersect1d(u64(ta), u64(tb), assume_unique=True))
            good.append(100 * both >= 80 * (na + nb - both))
        yield b.select(["a", "b"]).filter(pa.array(good, pa.bool_()))


def could_link(na, nb, la, lb):
    """Whether sizes and numbers of lone tokens let two sets link: the intersection is at most `both`."""
    both = F.least(na - la, nb - lb)
    return 100 * both >= 80 * (na + nb - both)


def links(spark: SparkSession, pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) of classes that link; sets(key, n, tokens) holds the tokens that more than one class has."""
    left = pairs.join(sets.select(F.col("key").alias("a"), F.col("n").alias("na"), F.col("tokens").alias("ta")), "a")
    return left.join(sets.select(F.col("key").alias("b"), F.col("n").alias("nb"), F.col("tokens").alias("tb")), "b").mapInArrow(verify, "a long, b long")


def blocks_of(s: Scratch, member: DataFrame) -> DataFrame:
    """member(key, cluster, other, size, place, n, tokens, ...) with `block`, a number: sets of one size class and place lie
    together, a place of many is cut by the sets' names, and small ones share a block, so that blocks are of bounded size."""
    many = lambda sets, size: F.greatest(F.ceil(sets / BLOCK_SETS), F.ceil(size / BLOCK_BYTES))
    cell, pack_ = ["cluster", "other", "size", "place"], ["cluster", "other", "size"]
    cells = member.groupBy(*cell).agg(F.count(F.lit(1)).alias("sets"), F.sum(F.length("tokens")).alias("bytes"))
    cells = s.table(cells.withColumn("cut", many(F.col("sets"), F.col("bytes"))), "cells")
    packs = cells.where("cut = 1").groupBy(*pack_).agg(many(F.sum("sets"), F.sum("bytes")).alias("packs"))
    cells = cells.select(*cell, "cut").join(packs, pack_, "left")
    block = F.when(F.col("cut") > 1, F.xxhash64("size", "place", F.pmod(F.xxhash64("key"), F.col("cut")))).otherwise(F.xxhash64("size", F.pmod(F.xxhash64("place"), F.col("packs"))))
    return member.join(cells, cell).withColumn("block", block).drop("cut", "packs")


def size_class(n: Column) -> Column:
    """Sets that link differ by a factor of 1.25 at most, hence by one class, whatever the rounding."""
    return F.floor(F.log(n.cast("double")) / math.log(1.25 * (1 + 1e-9))).cast("int")


def block_pairs(s: Scratch, crowd: DataFrame, member: DataFrame) -> DataFrame:
    """(cluster, i, o, j): each block i of others with the blocks that may have a partner of its sets, those of its size class
    or one beside it that share an entry. Where entries overlap so much that listing them costs more, all blocks of these
    size classes."""
    beside = lambda df: df.withColumn("size", F.explode(F.array(*(F.col("size") + k for k in (-1, 0, 1)))))
    here = s.table(crowd.select("sig", "key").join(member.select("key", "cluster", "other", "size", "block"), "key").select("cluster", "sig", "other", "size", "block").distinct(), "entry_blocks")
    tally = lambda df, by: df.groupBy("cluster", *by, "size").agg(F.count(F.lit(1)).alias("b"), F.count_if("other").alias("o"))
    # How many pairs either way would list.
    pairs_of = lambda df, by, name: tally(df, by).select("cluster", *by, "size", "o").join(beside(tally(df, by).select("cluster", *by, "size", "b")), ["cluster", *by, "size"]).groupBy("cluster").agg(F.sum(F.col("o") * F.col("b")).alias(name))
    ids = s.table(here.select("cluster", "other", "size", "block").distinct(), "block_ids")
    cost = s.table(pairs_of(here, ["sig"], "listed").join(pairs_of(ids, [], "all"), "cluster"), "cost")

    def pairs(df: DataFrame, by: list[str]) -> DataFrame:
        left = df.where("other").select("cluster", *by, "size", F.col("block").alias("i"))
        right = beside(df).select("cluster", *by, "size", F.col("other").alias("o"), F.col("block").alias("j"))
        return left.join(right, ["cluster", *by, "size"]).where("not o or j >= i").select("cluster", "i", "o", "j")

    some = pairs(here.join(cost.where("listed < all").select("cluster"), "cluster"), ["sig"]).distinct()
    return some.union(pairs(ids.join(cost.where("listed >= all").select("cluster"), "cluster"), []))


def crowd_links(spark: SparkSession, s: Scratch, crowd: DataFrame, sets: DataFrame) -> DataFrame:
    """Links between components among the members of large entries: crowd(sig, key, hub, comp).

    Entries that overlap make a crowd. Its members are dealt to blocks of bounded size by the smallest of their entries,
    those of its largest component and the others apart. Each block of others is compared by matrix products with the
    blocks of like sizes that share an entry with it. So the rows are blocks and links, not pairs, and pairs within the largest component
    aren't looked at.
    """
    cluster = connected_components(spark, crowd.select(F.col("key").alias("a"), F.col("hub").alias("b")).distinct()).toDF("key", "cluster")
    member = s.table(crowd.groupBy("key").agg(F.min("sig").alias("place"), F.min("comp").alias("comp")).join(cluster, "key"), "member")
    most = member.groupBy("cluster", "comp").count().groupBy("cluster").agg(F.max_by("comp", F.struct("count", "comp")).alias("main"))
    member = member.join(s.table(most, "main"), "cluster").withColumn("other", F.col("comp") != F.col("main")).drop("main")
    member = s.table(member.join(sets.select("key", "n", "tokens"), "key").withColumn("size", size_class(F.col("n"))), "sets")
    member = s.table(blocks_of(s, member), "dealt")
    both = s.table(block_pairs(s, crowd, member), "block_pairs")
    blocks = s.table(member.groupBy("cluster", "other", "block").agg(F.collect_list(F.struct("key", "n", "comp", "tokens")).alias("sets")), "blocks")
    held = blocks.select(F.col("cluster"), F.col("block").alias("i"), F.col("sets").alias("left")).where("other")
    met = both.join(held, ["cluster", "i"]).join(blocks.select("cluster", F.col("other").alias("o"), F.col("block").alias("j"), F.col("sets").alias("right")), ["cluster", "o", "j"])
    return s.table(met.select("left", "right").mapInArrow(compare_blocks, "a long, b long"), "crowd_links")


def compare_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of two blocks of sets the links between components: of each set on the left one with each component on the right."""
    for b in batches:
        for x, y in zip(b.column("left"), b.column("right")):
            found = block_links(x.as_py(), y.as_py())
            yield pa.RecordBatch.from_pydict({"a": pa.array([p for p, _ in found], pa.int64()), "b": pa.array([q for _, q in found], pa.int64())})


def block_links(x: list[dict], y: list[dict]) -> list[tuple[int, int]]:
    def unrolled(sets: list[dict]) -> tuple[np.ndarray, np.ndarray]:
        tokens = [u64(r["tokens"]) for r in sets]
        return np.concatenate(tokens), np.repeat(np.arange(len(sets)), [len(t) for t in tokens])

    (tx, rx), (ty, ry) = unrolled(x), unrolled(y)
    shared = np.intersect1d(tx, ty)
    both = np.zeros((len(x), len(y)), np.float32)
    for a in range(0, len(shared), 2048):
        some = shared[a : a + 2048]
        dense = []
        for t, r, n in ((tx, rx, len(x)), (ty, ry, len(y))):
            at = np.minimum(np.searchsorted(some, t), len(some) - 1)
            use = some[at] == t
            m = np.zeros((n, len(some)), np.float32)
            m[r[use], at[use]] = 1
            dense.append(m)
        both += dense[0] @ dense[1].T
    both = both.astype(np.int64)
    size = np.array([r["n"] for r in x])[:, None] + np.array([r["n"] for r in y])[None, :]
    link = (100 * both >= 80 * (size - both)) & (np.array([r["comp"] for r in x])[:, None] != np.array([r["comp"] for r in y])[None, :])
    out = {}
    for i, j in zip(*np.nonzero(link)):
        out[x[i]["key"], y[j]["comp"]] = (x[i]["key"], y[j]["key"])
    return list(out.values())


def names_of_several(known: DataFrame) -> frozenset[int]:
    """The names that different sets share: of n different sets about n * n / 2**65, hence none up to some 10^9, and
    hundreds at 10^11."""
    same = known.where("key is not null").groupBy("key").agg(F.min("also").alias("a"), F.max("also").alias("b")).where("a <> b")
    return frozenset(r["key"] for r in same.select("key").collect())


def classes(spark: SparkSession, docs: DataFrame, s: Scratch, rare: int, local: int, chunk_bytes: int, bits: int | None, coarse: int, chunk_tokens: int) -> tuple[DataFrame, DataFrame]:
    """Two tables of s: known(doc_id, h, n, key), a row for each row of docs(doc_id, h, text) with its class, null without
    words; and comp(key, comp), a row for each class."""
    small_batches(spark)
    seed = int.from_bytes(os.urandom(8), "little")  # components don't depend on it, but whoever writes texts can't foresee collisions
    known = s.table(docs.mapInArrow(keyed(seed), "doc_id long, h long, n long, key long, also long"), "known")
    shared = names_of_several(known)
    known = known.withColumn("key", F.when(F.col("key").isin(*shared), F.col("also")).otherwise(F.col("key"))).drop("also") if shared else known.drop("also")
    total = known.agg(F.sum("n").alias("n")).first()["n"] or 0
    if bits is None:
        bits = max(0, (total // RANGE_TOKENS).bit_length())
    first = min(bits, coarse)
    form = ", ".join(f"{c} {'long' if t == pa.int64() else 'int' if t == pa.int32() else 'binary'}" for c, t in POSTED.items())
    posted = docs.select("doc_id", "text").mapInArrow(poster(seed, first, local, chunk_bytes, shared), form)
    # One shuffle deals both kinds of rows: postings by range, and the classes' own rows by class.
    group = lambda b: F.coalesce(F.col("rng").cast("long"), F.pmod("key", F.lit(1 << b)) - (1 << b)).alias("g")

    def dealt(rows: DataFrame, b: int) -> DataFrame:
        """rows in partitions by range or class: where ranges are few, each partition has one of them."""
        n = max(partitions(spark), min(1 << b, 4 * partitions(spark)))
        return rows.select("*", group(b)).withColumn("p", F.pmod("g", F.lit(n)).cast("int")).repartitionById(n, F.col("p"))

    if bits > first:
        posted = dealt(posted, first).select(*POSTED).mapInArrow(redealer(bits, local, chunk_tokens), form)
    shared = dealt(posted, bits).groupBy("p", "g").applyInArrow(lambda t: shared_tokens(t, rare), "key long, n long, hot binary, rare binary, freq binary")
    shared = s.table(shared, "shared")
    own = shared.where("n is not null").groupBy("key").agg(F.max("n").alias("n"), F.max("hot").alias("hot"))
    parts_ = shared.where("n is null").groupBy("key").agg(F.collect_list(F.struct("rare", "freq")).alias("parts"))
    joined = own.join(parts_, "key", "left").where("parts is not null or length(hot) > 0").withColumn("parts", F.coalesce("parts", F.array().cast("array<struct<rare:binary,freq:binary>>")))
    indexed = s.table(joined.mapInArrow(index, "key long, n long, lone long, sigs array<bigint>, tokens binary").where(F.size("sigs") > 0), "indexed")
    s.drop("shared")
    entries = indexed.select("key", "n", "lone", F.explode("sigs").alias("sig"))
    # The hub of an entry: the class with the smallest share of lone tokens, the likeliest original of its copies.
    rank = F.struct((-F.col("lone") / F.col("n")).alias("r"), (-F.col("key")).alias("k"))
    hubs = entries.groupBy("sig").agg(F.max_by(F.struct("key", "n", "lone"), rank).alias("hub"), F.count(F.lit(1)).alias("m")).where("m > 1")
    hubs = s.table(hubs.select("sig", "m", F.col("hub.key").alias("hub"), F.col("hub.n").alias("hub_n"), F.col("hub.lone").alias("hub_lone")), "hubs")
    met = s.table(entries.join(hubs, "sig"), "met")
    star = met.where("key <> hub").where(could_link(F.col("n"), F.col("hub_n"), F.col("lone"), F.col("hub_lone"))).select(F.col("key").alias("a"), F.col("hub").alias("b")).distinct()
    star = s.table(star, "star")
    linked = s.table(links(spark, star, indexed), "linked")
    comp = connected_components(spark, linked)
    # Entries whose members still lie in several components.
    where = met.join(comp.withColumnRenamed("node", "key"), "key", "left").withColumn("comp", F.coalesce("comp", "key"))
    where = s.table(where, "where")
    s.drop("hubs", "met")
    open_ = where.groupBy("sig").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1")).where("c0 <> c1").select("sig")
    rest = s.table(where.join(s.table(open_, "open"), "sig"), "rest")
    s.drop("where")
    # Of small entries, the pairs between components, but for those that sizes and lone tokens rule out or that were seen.
    few = rest.where(F.col("m") <= rare)
    other = few.select("sig", *(F.col(c).alias(f"{c}2") for c in ("key", "n", "lone", "comp")))
    pairs = few.join(other, "sig").where("key < key2 and comp <> comp2").where(could_link(F.col("n"), F.col("n2"), F.col("lone"), F.col("lone2"))).select(F.col("key").alias("a"), F.col("key2").alias("b")).distinct()
    seen = star.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    more = s.table(links(spark, pairs.join(seen, ["a", "b"], "left_anti"), indexed), "more")
    crowd = s.table(rest.where(F.col("m") > rare).select("sig", "key", "hub", "comp"), "crowd")
    if not crowd.isEmpty():
        more = more.union(crowd_links(spark, s, crowd, indexed))
    if not more.isEmpty():
        comp = connected_components(spark, linked.union(more))
    names = known.where("key is not null").select("key").distinct().join(comp.withColumnRenamed("node", "key"), "key", "left")
    names = s.table(names.withColumn("comp", F.coalesce("comp", "key")), "names")
    s.keep("known", "names")
    return known, names


def components(spark: SparkSession, docs: DataFrame, rare: int = RARE, local: int = LOCAL, chunk_bytes: int = CHUNK_BYTES, bits: int | None = None, coarse: int = COARSE, chunk_tokens: int = CHUNK_TOKENS) -> DataFrame:
    """docs(doc_id, text, ...): a row for each row of docs: (doc_id, n_shingles, component_id).

    n_shingles: distinct five-word shingles, A-Z in lower case; fewer words are one shingle. component_id: the smallest
    doc_id reachable by links, the document's own included. A null, empty or blank text has 0 shingles, links with nothing
    and is its own component. Repeated rows each keep their row and link. A row without doc_id gets its class's id, or
    null. Other columns are ignored. An empty table gives an empty result. Shingles are told apart by 64-bit hashes under a
    seed that each run draws, also where pairs are verified; sets by 64 bits, and by 64 more where two share those. doc_id must
    be a whole number, or null.

    rare, local, chunk_bytes, bits, coarse and chunk_tokens shape the work, not the result.
    """
    s = Scratch(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(0).cast("long").alias("h"), F.col("text").alias("text"))
    known, names = classes(spark, rows, s, rare, local, chunk_bytes, bits, coarse, chunk_tokens)
    # From classes to documents: the smallest doc_id of all classes of a component.
    placed = s.table(known.where("key is not null").groupBy("key").agg(F.min("doc_id").alias("first")).join(names, "key"), "placed")
    least = s.table(placed.groupBy("comp").agg(F.min("first").alias("component_id")), "least")
    names = s.table(placed.join(least, "comp").select("key", "component_id"), "least_names")
    s.keep("known", "least_names")
    return known.join(names, "key", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def one_of_each(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """One row of docs of each component, in docs' columns, which may have any names: that with the smallest doc_id (null
    comes last), of several with that id the one whose text has the smallest hash, of several with that text too the first by
    the other columns, written as JSON. The result is the same however the rows are dealt.

    Texts without words are components of their own and stay. Rows are told apart by doc_id and text, so different texts
    under one doc_id, or none, are judged each for itself; of rows that repeat both, one stays.
    """
    s = Scratch(spark)
    same = lambda a, b: a["_id"].eqNullSafe(b["_id2"]) & (a["_h"] == b["_h2"])
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.xxhash64(docs["text"]).alias("h"), docs["text"].alias("text"))
    known, names = classes(spark, rows, s, RARE, LOCAL, CHUNK_BYTES, None, COARSE, CHUNK_TOKENS)
    known = known.where("key is not null")
    name = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h")
    first = s.table(known.groupBy("key").agg(F.min(name).alias("first")).join(names, "key"), "firsts")
    least = s.table(first.groupBy("comp").agg(F.min("first").alias("first")).select("comp", F.col("first.doc_id").alias("d"), F.col("first.h").alias("hh")), "least")
    stays = s.table(first.select("key", "comp").join(least, "comp").select("key", "d", "hh"), "stays")
    found = s.table(known.join(stays, "key"), "found")
    gone = found.where(~(F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("h") == F.col("hh")))).select(F.col("doc_id").alias("_id2"), F.col("h").alias("_h2")).distinct()
    gone = s.table(gone, "gone")
    twice = found.where(F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("h") == F.col("hh"))).groupBy(F.col("doc_id").alias("_id2"), F.col("h").alias("_h2")).count().where("count > 1").drop("count")
    twice = s.table(twice, "twice")
    s.keep("gone", "twice")
    docs = docs.select(docs["doc_id"].cast("long").alias("_id"), F.xxhash64(docs["text"]).alias("_h"), F.struct(*(docs[c] for c in docs.columns)).alias("_doc"))
    kept = docs.join(gone.hint("shuffle_hash"), same(docs, gone), "left_anti")
    if not twice.isEmpty():
        mark = kept.join(twice.withColumn("_many", F.lit(True)), same(kept, twice), "left")
        one = mark.where("_many").groupBy("_id", "_h").agg(F.min_by("_doc", F.to_json("_doc")).alias("_doc"))
        kept = one.select("_doc").union(mark.where("_many is null").select("_doc"))
    return kept.select("_doc.*")
