"""Settings of the segmentation engine."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class ChunkerConfig:
    """big_threshold: the least score of a boundary. max_chunk_chars holds for every chunk, also where that cuts a fence
    or a word; min_chunk_chars: shorter pieces are merged where they may be. adaptive: lower thresholds for documents
    without any boundary. window_chars: documents beyond it are cut at line ends, and each part is treated alone: a fence
    that is open at the end of a part isn't in the next, and features of the document, its adaptive threshold among them, are
    those of the part.

    With a scorer of characters: char_blend is its share in a line's score, small_threshold the least score of a place where
    a chunk that is too long may be cut."""

    big_threshold: float = 0.5
    small_threshold: float = 0.5
    max_chunk_chars: int = 2500
    min_chunk_chars: int = 100
    char_blend: float = 0.15
    adaptive: bool = True
    window_chars: int = 200_000
