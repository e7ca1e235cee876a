"""Benchmark decontamination: one Aho-Corasick automaton over the windows of all benchmark items, one scan of each text.

The automaton's symbols are word numbers, so its matches are places in a text's words. The items lie in a table in the
shared folder, from which each Python worker builds the automaton once.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, open_fs, small_batches, texts

#: Symbols of all windows, of which each word of an item is in up to ten, that one automaton should hold: at about 50 bytes
#: a symbol, 200 MB at most. A larger benchmark is dealt by item to several automatons, each of which scans the texts, and
#: their results are merged.
MAX_SYMBOLS = 4_000_000
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Normalisation, byte by byte: A-Z to lower case; all other ASCII but letters and digits to a space; UTF-8 bytes stay.
NORMAL = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
FOUND = "n_words long, words array<int>, items array<string>, spans array<struct<start:int,end:int,item_id:string>>"
TYPES = {"n_words": pa.int64(), "words": pa.list_(pa.int32()), "items": pa.list_(pa.string()), "spans": pa.list_(pa.struct({"start": pa.int32(), "end": pa.int32(), "item_id": pa.string()}))}


def words_of(text: bytes) -> list[bytes]:
    return text.translate(NORMAL).split()


def windows_of(words: list, size: int) -> list[tuple]:
    return [tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))] if words else []


class Windows:
    """The automaton over the windows of items: each maps to its number of words and the items that have it."""

    def __init__(self, items: list[tuple[str, bytes]], size: int):
        self.number: dict[bytes, int] = {}
        owners: dict[tuple, set[str]] = {}
        for item, text in items:
            for w in windows_of([self.number.setdefault(w, len(self.number) + 1) for w in words_of(text)], size):
                owners.setdefault(w, set()).add(item)
        self.auto = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for w, ids in owners.items():
            self.auto.add_word(w, (len(w), tuple(sorted(ids))))
        if owners:
            self.auto.make_automaton()
        #: As many words of items in a row as the shortest window has.
        self.least = b"\1" * min(map(len, owners), default=1)

    def scan(self, text: bytes) -> tuple[int, list[tuple[int, int, tuple[str, ...]]]]:
        """The number of words, and of each occurrence of a window: its first word, its number of words, its items."""
        words = words_of(text)
        # A text without so many words of items in a row has no window: most need no walk through the automaton.
        if self.least not in bytes(map(self.number.__contains__, words)):
            return len(words), []
        return len(words), [(end - k + 1, k, ids) for end, (k, ids) in self.auto.iter(tuple(map(self.number.get, words, repeat(0))))]


#: The automaton that this worker built last, by the path of its items.
_built: dict[tuple[str, int], Windows] = {}


def windows_at(path: str, size: int) -> Windows:
    if (path, size) not in _built:
        _built.clear()
        fs, at = open_fs(path)
        rows = pq.read_table(at, filesystem=fs, columns=["id", "text"]).to_pydict()
        _built[path, size] = Windows([(i, t.encode()) for i, t in zip(rows["id"], rows["text"])], size)
    return _built[path, size]


def word_offsets(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each word in code points of the original text."""
    raw = np.frombuffer(text, np.uint8)
    inside = np.concatenate(([False], np.frombuffer(text.translate(NORMAL), np.uint8) != 32, [False]))
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    points = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))
    return points[edge[::2]], points[edge[1::2]]


def merged(hits: list[tuple[int, int, tuple[str, ...]]]) -> list[int]:
    """The words inside any hit."""
    out, done = [], -1
    for first, k, _ in sorted(hits, key=lambda h: h[:2]):
        out += range(max(first, done + 1), first + k)
        done = max(done, first + k - 1)
    return out


def shards_of(s: Scratch, benchmark: DataFrame, window: int) -> list[str]:
    """Paths of tables (id, text) with the benchmark's items, each for an automaton."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    words = items.agg(F.sum(F.regexp_count("text", F.lit(WORD))).alias("n")).first()["n"] or 0
    n = max(1, -(-words * window // MAX_SYMBOLS))
    for k in range(n):
        s.table(items if n == 1 else items.where(F.pmod(F.xxhash64("id"), F.lit(n)) == k), f"items{k}")
    return [s.paths[f"items{k}"] for k in range(n)]


def find(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """docs(doc_id, text, ...), benchmark(item_id, text): a row for each row of docs, in columns
    (doc_id, n_words, words, items, spans).

    words: indexes of the words inside any occurrence of a window of `window` consecutive words of an item (a shorter item
    is one window). items: ids as strings, sorted as strings. spans: the occurrences, in code points of the original text,
    by start, end and item. Null and wordless texts have no words and no hits; wordless items have no window; a null item_id
    is the string "null". Repeated rows are each scanned. Other columns are ignored. Empty tables give no rows or no hits.
    """
    small_batches(spark)
    s = Scratch(spark)
    rows = docs.select(F.col("doc_id").alias("doc_id"), F.lit(0).cast("long").alias("_row"), F.col("text").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    shards = shards_of(s, benchmark, window)
    if len(shards) == 1:
        return rows.mapInArrow(finder(shards[0], window), f"doc_id {kind}, _row long, {FOUND}").drop("_row")
    rows = s.table(rows.withColumn("_row", F.monotonically_increasing_id()), "rows")  # numbered once: each shard reads the same rows
    out = None
    for path in shards:
        part = rows.mapInArrow(finder(path, window), f"doc_id {kind}, _row long, {FOUND}")
        out = part if out is None else out.unionByName(part)
    out = out.groupBy("_row").agg(F.first("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"), *(F.flatten(F.collect_list(c)).alias(c) for c in ("words", "items", "spans")))
    return out.select("doc_id", "n_words", F.array_sort(F.array_distinct("words")).alias("words"), F.array_sort(F.array_distinct("items")).alias("items"), F.array_sort("spans").alias("spans"))


def finder(path: str, window: int):
    def scan_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = windows_at(path, window)
        for batch in batches:
            cols: dict[str, list] = {c: [] for c in TYPES}
            for text in texts(batch.column("text")):
                n, hits = held.scan(text)
                spans = []
                if hits:
                    start, end = word_offsets(text)
                    spans = [{"start": a, "end": b, "item_id": i} for a, b, i in sorted((int(start[f]), int(end[f + k - 1]), i) for f, k, ids in hits for i in ids)]
                for c, v in zip(TYPES, (n, merged(hits), sorted({i for _, _, ids in hits for i in ids}), spans)):
                    cols[c].append(v)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("_row"), *(pa.array(v, TYPES[c]) for c, v in cols.items())], ["doc_id", "_row", *cols])

    return scan_batches


def report(found: DataFrame) -> DataFrame:
    """find()'s rows with the counts and the digest of the items."""
    n = F.size("words").cast("long")
    return found.select("doc_id", "n_words", n.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n > 0).alias("contaminated"))


def clean(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """The rows of docs without a hit, in docs' columns; cases as in find(). Texts are scanned in place: no shuffle."""
    small_batches(spark)
    s = Scratch(spark)
    shards = shards_of(s, benchmark, window)
    for k, path in enumerate(shards):

        def keep(batches: Iterator[pa.RecordBatch], path=path) -> Iterator[pa.RecordBatch]:
            held = windows_at(path, window)
            for batch in batches:
                column = batch.column(batch.schema.names.index("text"))
                yield batch.filter(pa.array([not held.scan(t)[1] for t in texts(column)], pa.bool_()))

        docs = docs.mapInArrow(keep, docs.schema)
        if k + 1 < len(shards):  # one automaton in memory at a time
            docs = s.table(docs, f"clean{k}")
    return docs
