"""Token ids in binary files: bit-plane shuffled, compressed plane by plane, with a chunk index.

File: MAGIC, then chunks, then the footer as JSON, its length in 8 bytes, MAGIC. A chunk is up to `block` ids: each id is
`width` bytes; the ids' bits are transposed so that bit k of all ids lies together, and each of the 8 * width planes is a
zstandard frame. The footer has the chunk index (offset in the file, ids, bytes of each plane) and is followed in no
other place by data, so a reader seeks to any chunk. The documents of a file are in a side table of the same layout: the
ids and lengths that the writer returns as rows, and at the end of the file as two zstandard frames.
"""

from __future__ import annotations

import json
import os
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, give_back, new_path, open_fs, partitions, small_batches, utf8
from .wordhash import FRONT, LONG, LOWER, word_hashes, word_spans

MAGIC = b"TSRTOK01"
BLOCK = 1 << 17
END_ID = 1
#: Entries of a worker's tables of known words and stems, and the bytes of a word in them at most; one is emptied when it is
#: full, and a text with a longer word is encoded whole.
KNOWN_WORDS = 1_500_000
KNOWN_STEMS = 200_000
KNOWN_BYTES = LONG


def splits_at_space(config: dict) -> bool:
    """Whether a tokenizer lowers its text, drops white space and never looks across it, so that a text's ids are its lower
    words' ids in a row."""
    normal = [n.get("type") for n in (config.get("normalizer") or {}).get("normalizers", [])]
    first = ((config.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[0]
    return normal == ["NFC", "Replace", "Lowercase"] and first.get("type") == "Split" and first.get("behavior") == "Removed" and first.get("invert") is True


class Words:
    """The ids of texts. Where the tokenizer splits at white space, those of known words are looked up: by a hash of the
    word, whose bytes are then compared, eight at a time. Texts that hold an added token, a very long word or one that has
    another's hash, and all texts of another tokenizer, are encoded whole."""

    #: A word and the marks after it, which never join, since the tokenizer splits letters and digits from symbols; or a word
    #: that isn't of this form. Words stand on lines.
    STEM = re.compile(rb"^(?:((?:[a-z0-9]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+)([!#$%&()*+,\-./:;=?@\[\]^_`{}~|]*)|([^\n]*))$", re.M)
    #: Words of these letters are one piece to the tokenizer, whose last token alone bears an end mark; or others.
    PLAIN = re.compile(rb"^(?:((?:[a-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+)|([^\n]*))$", re.M)
    JOINED = 64

    def __init__(self, path: str, dtype: np.dtype):
        from tokenizers import Tokenizer

        self.tok, self.dtype = Tokenizer.from_file(path), dtype
        config = json.loads(self.tok.to_str())
        self.by_word = splits_at_space(config)
        self.added = [t["content"].encode() for t in config.get("added_tokens") or []]
        self.ends = np.zeros(self.tok.get_vocab_size() + 1, bool)
        self.ends[[i for piece, i in self.tok.get_vocab().items() if piece.endswith("</w>")]] = True
        self.seed = int.from_bytes(os.urandom(8), "little")
        self.stems: dict[bytes, bytes] = {}
        self.clear()

    def clear(self) -> None:
        self.known, self.place = np.empty(0, np.uint64), np.empty(0, np.int64)  # hashes in order, and their words' places
        # Of each word, by place: where its ids and its bytes start, and how many they are.
        self.start, self.size, self.at, self.length = (np.empty(1 << 16, np.int64) for _ in range(4))
        self.ids, self.used = np.empty(1 << 18, self.dtype), 0
        self.lanes, self.filled = np.empty(1 << 17, np.uint64), 0

    def whole(self, words: list[bytes]) -> list[bytes]:
        out = self.tok.encode_batch_fast([w.decode() for w in words], add_special_tokens=False)
        return [np.array(e.ids, self.dtype).tobytes() for e in out]

    def learn_stems(self, stems: list[bytes]) -> None:
        """Many plain words are encoded in one text and told apart by the end marks."""
        found = self.PLAIN.findall(b"\n".join(stems))
        plain, rest = [w for w, _ in found if w], [w for _, w in found if w]
        rows = [plain[i : i + self.JOINED] for i in range(0, len(plain), self.JOINED)]
        width = self.dtype.itemsize
        for row, e in zip(rows, self.tok.encode_batch_fast([b" ".join(r).decode() for r in rows], add_special_tokens=False)):
            ids = np.array(e.ids, self.dtype)
            cut = ((np.flatnonzero(self.ends[ids]) + 1) * width).tolist()
            if len(cut) != len(row):
                rest += row
                continue
            data, a = ids.tobytes(), 0
            for w, b in zip(row, cut):
                self.stems[w] = data[a:b]
                a = b
        self.stems.update(zip(rest, self.whole(rest)))

    def learn(self, words: list[bytes]) -> list[bytes]:
        """The ids of new words: of a stem and the marks after it, or of the whole."""
        if len(self.stems) > KNOWN_STEMS:
            self.stems.clear()
        parts = self.STEM.findall(b"\n".join(words))
        need = {a for a, _, _ in parts}
        need.update({b for _, b, _ in parts})
        need.discard(b"")
        self.learn_stems(list(need.difference(self.stems)))
        alone = iter(self.whole([w for _, _, w in parts if w]))
        self.stems[b""] = b""
        get = self.stems.__getitem__
        return [get(a) + get(b) if a else next(alone) for a, b, _ in parts]

    def add(self, hashes: np.ndarray, spot: np.ndarray, words: list[bytes]) -> None:
        """New words, in the order of their hashes, and where these go among the known ones."""
        ids = self.learn(words)
        k, n = len(self.known), len(words)
        sizes = np.fromiter(map(len, ids), np.int64, n) // self.dtype.itemsize
        lengths = np.fromiter(map(len, words), np.int64, n)
        lanes = -(-lengths // 8)
        self.ids = put(self.ids, self.used, np.frombuffer(b"".join(ids), self.dtype))
        self.lanes = put(self.lanes, self.filled, np.frombuffer(b"".join([w + bytes(-len(w) % 8) for w in words]), np.uint64))
        self.start, self.size = put(self.start, k, self.used + np.cumsum(sizes) - sizes), put(self.size, k, sizes)
        self.at, self.length = put(self.at, k, self.filled + np.cumsum(lanes) - lanes), put(self.length, k, lengths)
        self.used, self.filled = self.used + int(sizes.sum()), self.filled + int(lanes.sum())
        self.known, self.place = np.insert(self.known, spot, hashes), np.insert(self.place, spot, np.arange(k, k + n))

    def same(self, low: np.ndarray, first: np.ndarray, size: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Of each word, of lower bytes `low`, whether it is the known word at its place."""
        good = self.length[place] == size
        lanes = np.ndarray(len(low) - 7, "<u8", low, strides=(1,))
        left, k = np.flatnonzero(good), 0
        while len(left):
            equal = lanes[first[left] + 8 * k] & FRONT[np.minimum(size[left] - 8 * k, 8)] == self.lanes[self.at[place[left]] + k]
            good[left[~equal]] = False
            k += 1
            left = left[equal & (size[left] > 8 * k)]
        return good

    def encode(self, data: np.ndarray, off: np.ndarray) -> list[bytes]:
        """The ids of each text; the texts lie one after another in data."""
        raw, bounds = data.tobytes(), off.tolist()
        held = [raw[a:b] for a, b in zip(bounds, bounds[1:])]
        if not self.by_word:
            return self.whole(held)
        first, last, counts = word_spans(data, off)
        size = last - first
        apart = np.array([any(a in t for a in self.added) for t in held], bool) if any(a in raw for a in self.added) else np.zeros(len(held), bool)
        row = np.repeat(np.arange(len(held)), counts)
        apart[row[size > KNOWN_BYTES]] = True
        use = ~apart[row]
        first, last, size, row = first[use], last[use], size[use], row[use]
        hashes, at, back = np.unique(word_hashes(data, first, last, self.seed), return_index=True, return_inverse=True)
        if len(self.known) + len(hashes) > KNOWN_WORDS:
            self.clear()
        spot = np.searchsorted(self.known, hashes)
        new = np.ones(len(hashes), bool)
        inside = spot < len(self.known)
        new[inside] = self.known[spot[inside]] != hashes[inside]
        if new.any():
            self.add(hashes[new], spot[new], [raw[a:b].lower() for a, b in zip(first[at[new]].tolist(), last[at[new]].tolist())])
        place = self.place[np.searchsorted(self.known, hashes)][back]
        apart[row[~self.same(np.concatenate((LOWER[data], np.zeros(8, np.uint8))), first, size, place)]] = True
        n, start = self.size[place], self.start[place]
        ends = np.concatenate(([0], np.cumsum(n)))
        ids = self.ids[np.repeat(start - ends[:-1], n) + np.arange(ends[-1])].tobytes()
        edge = (ends[np.searchsorted(row, np.arange(len(held) + 1))] * self.dtype.itemsize).tolist()
        out = [ids[a:b] for a, b in zip(edge, edge[1:])]
        again = np.flatnonzero(apart).tolist()
        for k, x in zip(again, self.whole([held[k] for k in again])):
            out[k] = x
        return out


#: The words that this worker knows, by tokenizer; later tasks use them again.
_words: dict[tuple[str, str], Words] = {}


def words_for(path: str, dtype: np.dtype) -> Words:
    if (path, dtype.str) not in _words:
        _words.clear()
        _words[path, dtype.str] = Words(path, dtype)
    return _words[path, dtype.str]


def put(held: np.ndarray, at: int, new: np.ndarray) -> np.ndarray:
    """held with new at a place; it is doubled until there is room."""
    while at + len(new) > len(held):
        held = np.concatenate((held, np.empty_like(held)))
    held[at : at + len(new)] = new
    return held


def pack(ids: np.ndarray, width: int, level: int) -> list[bytes]:
    """The compressed bit planes of a chunk, the lowest bit first."""
    x = ids.view(f"<u{width}")
    c = zstandard.ZstdCompressor(level=level)
    return [c.compress(np.packbits((x >> k).astype(np.uint8) & 1).tobytes()) for k in range(8 * width)]


def unpack(planes: list[bytes], n: int, width: int) -> np.ndarray:
    d = zstandard.ZstdDecompressor()
    out = np.zeros(n, f"<u{width}")
    for k, p in enumerate(planes):
        plane = d.decompress(p, max_output_size=-(-n // 8))
        out |= np.unpackbits(np.frombuffer(plane, np.uint8), count=n).astype(out.dtype) << out.dtype.type(k)
    return out


class Writer:
    def __init__(self, out, width: int, block: int = BLOCK, level: int = 1):
        self.out, self.width, self.block, self.level = out, width, block, level
        self.held, self.n_held, self.index, self.at = [], 0, [], len(MAGIC)
        self.ids, self.lengths = [], []
        out.write(MAGIC)

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.ids.append(doc_id)
        self.lengths.append(len(ids) // self.width)
        self.held.append(ids)
        self.n_held += len(ids) // self.width
        if self.n_held >= self.block:
            data = b"".join(self.held)
            size = self.block * self.width
            whole = len(data) - len(data) % size
            for a in range(0, whole, size):
                self.chunk(data[a : a + size])
            self.held, self.n_held = [data[whole:]], (len(data) - whole) // self.width

    def chunk(self, data: bytes) -> None:
        planes = pack(np.frombuffer(data, np.uint8), self.width, self.level)
        self.index.append([self.at, len(data) // self.width, [len(p) for p in planes]])
        for p in planes:
            self.out.write(p)
            self.at += len(p)

    def close(self) -> None:
        if data := b"".join(self.held):
            self.chunk(data)
        c = zstandard.ZstdCompressor(level=3)
        known = np.array([i is not None for i in self.ids], np.uint8)
        side = [c.compress(np.array([i or 0 for i in self.ids], "<i8").tobytes()), c.compress(known.tobytes()), c.compress(np.array(self.lengths, "<i8").tobytes())]
        for p in side:
            self.out.write(p)
        foot = json.dumps({"width": self.width, "docs": len(self.ids), "side": [self.at, [len(p) for p in side]], "chunks": self.index}).encode()
        self.out.write(foot + len(foot).to_bytes(8, "little") + MAGIC)


class Reader:
    """A random-access reader; it holds one chunk at a time."""

    def __init__(self, file):
        self.file = file
        end = file.size()
        file.seek(end - 16)
        tail = file.read(16)
        if tail[8:] != MAGIC:
            raise ValueError("not a token file, or one that was cut off")
        n = int.from_bytes(tail[:8], "little")
        file.seek(end - 16 - n)
        self.foot = json.loads(file.read(n))
        self.width = self.foot["width"]

    def docs(self) -> tuple[list[int | None], np.ndarray]:
        at, sizes = self.foot["side"]
        self.file.seek(at)
        d = zstandard.ZstdDecompressor()
        n = self.foot["docs"]
        ids, known, lengths = (d.decompress(self.file.read(s), max_output_size=max(8 * n, 1)) for s in sizes)
        ids, known = np.frombuffer(ids, "<i8").tolist(), np.frombuffer(known, np.uint8)
        return [i if k else None for i, k in zip(ids, known)], np.frombuffer(lengths, "<i8")

    def chunk(self, k: int) -> np.ndarray:
        at, n, sizes = self.foot["chunks"][k]
        self.file.seek(at)
        return unpack([self.file.read(s) for s in sizes], n, self.width)

    def each_doc(self) -> Iterator[tuple[int | None, Iterator[np.ndarray]]]:
        """Of each document its id and its ids, piece by piece; the pieces that aren't taken are skipped."""
        ids, lengths = self.docs()
        k, held, pos = -1, np.empty(0, np.uint8), 0

        def pieces(n: int) -> Iterator[np.ndarray]:
            nonlocal k, held, pos
            while n:
                if pos == len(held):
                    k, pos = k + 1, 0
                    held = self.chunk(k)
                a = pos
                take = min(n, len(held) - a)
                pos, n = a + take, n - take
                yield held[a : a + take]

        for doc_id, n in zip(ids, lengths.tolist()):
            own = pieces(n)
            yield doc_id, own
            for _ in own:
                pass


def write(spark: SparkSession, docs: DataFrame, tokenizer: str, vocabulary: int = 49_408, folder: str | None = None, parts: int | None = None) -> DataFrame:
    """docs(doc_id, text, ...): writes each text's ids and END_ID, in ascending doc_id order (null first), to files in the
    shared folder, and returns their manifest (part, path, n_docs, n_tokens), kept as a table there.

    A null text counts as empty and gives END_ID alone. Rows with the same doc_id, or none, are all written, by a hash of the
    text, then the text, and may lie in several files.
    A task writes a file of its own name, so the files of failed or repeated attempts are in no manifest. Other columns
    are ignored. An empty table gives no file.
    """
    small_batches(spark)
    folder = folder or new_path(spark, "tokens")
    dtype = np.dtype("<u2" if max(vocabulary, END_ID + 1) <= 1 << 16 else "<u4")
    end = np.array([END_ID], dtype).tobytes()
    fs, at = open_fs(folder)
    fs.create_dir(at, recursive=True)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        words, writer, file, n_docs, n = None, None, None, 0, 0
        name = f"{folder}/part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.tok"
        for batch in batches:
            if writer is None:
                fs, path = open_fs(name)
                fs.create_dir(path.rpartition("/")[0], recursive=True)
                file = fs.open_output_stream(path, compression=None)
                words, writer = words_for(tokenizer, dtype), Writer(file, dtype.itemsize)
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), words.encode(*utf8(batch.column("text")))):
                writer.add(doc_id, ids + end)
                n_docs, n = n_docs + 1, n + len(ids) // dtype.itemsize + 1
        if writer is not None:
            writer.close()
            file.close()
            words = writer = None
            give_back()
            yield pa.RecordBatch.from_pydict({"part": pa.array([TaskContext.get().partitionId()], pa.int32()), "path": [name], "n_docs": [n_docs], "n_tokens": [n]})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"), F.xxhash64("text").alias("_h"))
    rows = rows.repartitionByRange(parts or partitions(spark), "doc_id", "_h").sortWithinPartitions("doc_id", "_h", "text").drop("_h")
    return Scratch(spark).table(rows.mapInArrow(encode, "part int, path string, n_docs long, n_tokens long"), "manifest")


def read(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """The documents of a manifest's files, read back: (doc_id, start, n_tokens, ids_crc32, part).

    start: the ids of all documents before it. ids_crc32: of the ids as little-endian unsigned 32-bit integers.
    """

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, name in zip(batch.column("part").to_pylist(), batch.column("path").to_pylist()):
                fs, path = open_fs(name)
                cols: dict[str, list] = {"doc_id": [], "start": [], "n_tokens": [], "ids_crc32": []}
                with fs.open_input_file(path) as file:
                    start = 0
                    for doc_id, pieces in Reader(file).each_doc():
                        crc, n = 0, 0
                        for p in pieces:
                            crc, n = zlib.crc32(p.astype("<u4").tobytes(), crc), n + len(p)
                        for c, v in zip(cols, (doc_id, start, n, crc)):
                            cols[c].append(v)
                        start += n
                        if len(cols["doc_id"]) >= 20_000:
                            yield rows(part, cols)
                            cols = {c: [] for c in cols}
                yield rows(part, cols)

    def rows(part: int, cols: dict[str, list]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([part] * len(cols["doc_id"]), pa.int32()), *(pa.array(v, pa.int64()) for v in cols.values())], ["part", *cols])

    # The manifest has a row for each file, so a window over it stays small.
    before = F.sum("n_tokens").over(Window.orderBy("part", "path").rowsBetween(Window.unboundedPreceding, -1))
    shifts = manifest.select("part", F.coalesce(before, F.lit(0)).alias("shift"))
    files = manifest.select("part", "path").repartition(max(1, manifest.count()), "path")
    docs = files.mapInArrow(decode, "part int, doc_id long, start long, n_tokens long, ids_crc32 long")
    return docs.join(F.broadcast(shifts), "part").select("doc_id", (F.col("start") + F.col("shift")).alias("start"), "n_tokens", "ids_crc32", "part")
