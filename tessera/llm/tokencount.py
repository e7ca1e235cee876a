"""Token counts of a unigram tokenizer by a Viterbi search that keeps no pieces.

An Aho-Corasick automaton lists every vocabulary match in a word; dynamic programming over the word's positions carries
the best score and the number of pieces only. Ties are decided as the tokenizer decides them: at each end, candidates
are met from the earliest start on, and a later one replaces an earlier one only if its score is strictly higher. A
character that no single-character piece covers costs the lowest score less 10, as one unknown piece; unknown pieces in
a row are one.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, texts

START = "▁"
UNKNOWN_PENALTY = 10.0
#: A worker's table of counted words has so many entries at most, of so many bytes each; longer words are counted each time.
KNOWN_WORDS = 400_000
KNOWN_BYTES = 64


def vocabulary(model_file: str) -> list[tuple[str, float]]:
    """A unigram vocabulary from a piece file: its ordinary pieces in their order, each with the log of a Zipf share of
    its rank. The file's own scores are merge ranks, which aren't log probabilities."""
    from sentencepiece import SentencePieceProcessor

    p = SentencePieceProcessor(model_file=model_file)
    pieces = [p.id_to_piece(i) for i in range(p.get_piece_size()) if not (p.is_control(i) or p.is_unknown(i) or p.is_byte(i) or p.is_unused(i))]
    norm = math.log(sum(1 / (r + 2) for r in range(len(pieces))))
    return [(piece, -math.log(r + 2) - norm) for r, piece in enumerate(pieces)]


class Counter(dict):
    """The number of pieces of each word seen; a table of bounded size that is emptied when it is full."""

    def __init__(self, pieces: list[tuple[str, float]]):
        super().__init__()
        self.auto = ahocorasick.Automaton()
        for piece, score in pieces:
            self.auto.add_word(piece, (len(piece), score))
        self.auto.make_automaton()
        self.unknown = min(score for _, score in pieces) - UNKNOWN_PENALTY
        self.ring = max(len(piece) for piece, _ in pieces) + 1

    def count(self, word: str) -> int:
        # Of the last ends, as far back as a piece may reach: the best score, its number of pieces, and whether it ends in
        # an unknown piece.
        ring, unknown = self.ring, self.unknown
        best: list[tuple[float, int, bool]] = [(0.0, 0, False)] * ring
        matches = self.auto.iter(word)
        last, match = next(matches, (-1, None))
        before = best[0]
        for end in range(len(word)):
            top, single = None, False
            found = []
            while last == end:
                found.append(match)
                last, match = next(matches, (-1, None))
            if len(found) > 1:
                found.sort(reverse=True)
            for size, score in found:
                start = best[(end + 1 - size) % ring]
                single |= size == 1
                if top is None or start[0] + score > top[0]:
                    top = (start[0] + score, start[1] + 1, False)
            if not single and (top is None or before[0] + unknown > top[0]):
                top = (before[0] + unknown, before[1] + (not before[2]), True)
            before = best[(end + 1) % ring] = top
        return before[1]

    def __missing__(self, word: bytes) -> int:
        n = self.count(START + word.decode())
        if len(word) <= KNOWN_BYTES:
            if len(self) >= KNOWN_WORDS:
                self.clear()
            self[word] = n
        return n


def count(spark: SparkSession, docs: DataFrame, pieces: list[tuple[str, float]]) -> DataFrame:
    """docs(doc_id, text, ...): a row for each row of docs: (doc_id, n_words, n_tokens).

    Words are what lies between ASCII white space; each is counted with a word-start mark before it. Null, empty and blank
    texts have 0 of both. Repeated rows are each counted. Other columns are ignored. An empty table gives an empty result.
    The vocabulary is broadcast; its size is that of the tokenizer's file, whatever the input.
    """
    small_batches(spark)
    held = spark.sparkContext.broadcast(pieces)
    rows = docs.select(F.col("doc_id").alias("doc_id"), F.col("text").alias("text"))

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = None
        for batch in it:
            known = known if known is not None else Counter(held.value)
            get = known.__getitem__
            words = [t.split() for t in texts(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(w) for w in words], pa.int64()), pa.array([sum(map(get, w)) for w in words], pa.int64())], ["doc_id", "n_words", "n_tokens"])

    return rows.mapInArrow(batches, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_words long, n_tokens long")
