"""spark-submit entry: chunk a file, a folder, or what comes in."""

from __future__ import annotations

import argparse

from tessera.config import ChunkerConfig
from tessera.plans.segment import engine_of
from tessera.session import ship
from tessera.sources import readers


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="tessera", description="Split documents into chunks.")
    p.add_argument("path", nargs="?", default="-", help="text file or folder; - for what comes in")
    p.add_argument("--big-threshold", type=float, default=ChunkerConfig.big_threshold)
    p.add_argument("--small-threshold", type=float, default=ChunkerConfig.small_threshold)
    p.add_argument("--max-chunk-chars", type=int, default=ChunkerConfig.max_chunk_chars)
    p.add_argument("--min-chunk-chars", type=int, default=ChunkerConfig.min_chunk_chars)
    p.add_argument("--char-blend", type=float, default=ChunkerConfig.char_blend)
    p.add_argument("--line-weights", help="npz file of a network over lines")
    p.add_argument("--char-weights", help="npz file of a network over characters; --char-blend and --small-threshold need it")
    p.add_argument("--json", action="store_true")
    p.add_argument("--pretty", action="store_true", help="with --json: each chunk on a line of its own")
    p.add_argument("--show-boundaries", action="store_true")
    p.add_argument("--separator", default="\n---\n")
    p.add_argument("--out", help="folder for the result; without it, it is printed")
    a = p.parse_args(argv)
    if not a.char_weights and (a.char_blend, a.small_threshold) != (ChunkerConfig.char_blend, ChunkerConfig.small_threshold):
        p.error("--char-blend and --small-threshold need --char-weights")

    from pyspark.sql import SparkSession

    spark = ship(SparkSession.builder.appName("tessera").getOrCreate())
    docs = readers.read_stdin(spark) if a.path == "-" else readers.read_text(spark, a.path)
    cfg = ChunkerConfig(a.big_threshold, a.small_threshold, a.max_chunk_chars, a.min_chunk_chars, a.char_blend)
    engine = engine_of(cfg, a.line_weights, a.char_weights)
    if a.show_boundaries:
        out, order = readers.as_boundary_lines(engine.boundaries(docs), docs), ["pos"]
    else:
        chunks = engine.chunk(docs)
        out, order = readers.as_json_array(chunks, pretty=a.pretty) if a.json else readers.as_separated(chunks, a.separator), []
    # In the order of the files' paths.
    out = out.join(docs.select("doc_id", "path"), "doc_id").orderBy("path", *order).select("line" if a.show_boundaries else "json" if a.json else "text")
    if a.out:
        out.write.mode("overwrite").text(a.out)
    else:
        for row in out.toLocalIterator():
            print(row[0], end="" if not (a.json or a.show_boundaries) else "\n")


if __name__ == "__main__":
    main()
