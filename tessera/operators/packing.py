"""Packing of a text's pieces in order, and running sums, in time linear in their number."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Pieces of a block. An array grows by a copy, so what a fold appends is kept short: a block's results, then the blocks'.
BLOCK = 512


def openings(sizes: Column, step: Callable[[Column, Column], tuple[Column, Column]]) -> Column:
    """The places of the pieces that open a pack. step(held, size): whether a piece of this size opens one, given the length
    that is held before it (-1: nothing), and the length that is held then. A fold over blocks of pieces, in each a fold."""

    def in_block(b: Column, held: Column) -> Column:
        def add(a: Column, i: Column) -> Column:
            size = F.get(sizes, i)
            opens, then = step(a["held"], size)
            return F.struct(then.cast("long").alias("held"), F.when(opens, F.array_append(a["out"], i)).otherwise(a["out"]).alias("out"))

        places = F.sequence(b, F.least(b + BLOCK, F.size(sizes)) - 1)
        return F.aggregate(places, F.struct(held.alias("held"), F.array().cast("array<int>").alias("out")), add)

    def over_blocks(a: Column, b: Column) -> Column:
        done = F.array(in_block(b, a["held"]))  # named by the lambda, so that it is computed once
        return F.get(F.transform(done, lambda x: F.struct(x["held"].alias("held"), F.array_append(a["out"], x["out"]).alias("out"))), F.lit(0))

    start = F.struct(F.lit(-1).cast("long").alias("held"), F.array().cast("array<array<int>>").alias("out"))
    blocks = F.sequence(F.lit(0), F.size(sizes) - 1, F.lit(BLOCK))
    return F.when(F.size(sizes) > 0, F.aggregate(blocks, start, over_blocks, lambda a: F.flatten(a["out"]))).otherwise(F.array().cast("array<int>"))


def packs(pieces: Column, opens: Column, between: str) -> Column:
    """The texts of the packs that open at these places."""
    stop = lambda k: F.coalesce(F.get(opens, k + 1), F.size(pieces))
    return F.transform(opens, lambda a, k: F.array_join(F.slice(pieces, a + 1, stop(k) - a), between))
