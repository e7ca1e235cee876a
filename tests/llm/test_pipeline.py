"""The pipeline against a plain restatement of its stages; which documents the mix draws is taken from the mixing operator."""

import os
from collections import Counter

import brute
import corpus_pipeline
import regex
from pyspark.sql import functions as F

from tessera.llm import mixing, queries


def good(text):
    t = text or ""
    n, chars, symbols, dup, _, failed = brute.quality(t)
    w = brute.SPACE_WORD.findall(t)
    lines = sum(bool(brute.SPACE_WORD.search(x)) for x in t.split("\n"))
    capitals, letters = (len(regex.findall(p, t)) for p in (r"\p{Lu}", r"\p{L}"))
    stutter = sum(a == b for a, b in zip(w, w[1:]))
    rules = (symbols > 0.25 * n, dup > 0.5 * lines, chars < 2 * n, chars > 25 * n, t.count("!") > 0.5 * n, capitals > 0.7 * letters, stutter > 0.5 * n)
    return not (failed or any(rules))


def test_pipeline(spark, tiny):
    df = queries.table(spark, tiny, "documents")
    bench = [(r["item_id"], r["text"]) for r in queries.table(spark, tiny, "benchmark").collect()]
    docs = [(r["doc_id"], r["text"]) for r in df.collect()]
    kept = [x for x in docs if good(x[1])]
    assert 0 < len(kept) < len(docs)
    first = {d for d, _, c in brute.jaccard(kept) if d == c}
    alone = [x for x in kept if x[0] in first]
    hit = {r[0] for r in brute.decontam(alone, bench) if r[-1]}
    clean = {d: t for d, t in alone if d not in hit}
    assert len(clean) < len(alone) < len(kept)
    left = df.where(df["doc_id"].isin(list(clean)))
    copies = {r["doc_id"]: r["copies"] for r in mixing.report(spark, left).collect()}
    assert copies.keys() == clean.keys() and max(copies.values()) <= 3
    mixed = [(d, clean[d]) for d, n in copies.items() for _ in range(n)]
    want = brute.tokens(mixed, queries.tokenizer_path(queries.WORD_BPE))
    got = corpus_pipeline.run(spark, tiny).select("doc_id", "start", "n_tokens", "ids_crc32").collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_pipeline_edges(spark, tmp_path):
    """Null, empty and repeated rows, different texts under one id, columns with the names that operators use."""
    base = [" ".join(f"{c}{k}" for k in range(40)) for c in "abcdefgh"]
    leak = "one two three four five six seven eight nine ten eleven"
    rows = [(1, base[0], "x"), (1, base[0], "x"), (2, base[0] + " end", "y"), (2, base[1], "y"), (None, base[2], None), (None, base[2], None), (None, base[3], "x"), (3, None, "x"), (4, "", None), (5, "few words", "x")]
    rows += [(6, f"{base[4]} {leak} {base[5]}", "y"), (7, base[6], None), (8, "same line\n" * 60, "x"), (9, base[7].upper(), "z"), (10, base[7], "z")]
    df = spark.createDataFrame([(d, t, "en", s, -1, "clash", "k", 7) for d, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long, words string, key string, copies int")
    df.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, leak), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = [(r["doc_id"], r["text"], r["source"], (r["h"], r["doc_id"] is not None, r["doc_id"] or 0, r["t"])) for r in df.select("*", F.xxhash64("doc_id").alias("h"), F.xxhash64("text").alias("t")).collect()]
    kept = [x for x in docs if good(x[1])]
    groups = {}
    for k, _, c in brute.jaccard([(k, x[1]) for k, x in enumerate(kept)]):
        groups.setdefault(c, []).append(kept[k])
    alone = [min(g, key=lambda x: (x[0] is None, x[0] or 0, x[3][3])) for g in groups.values()]
    hit = {r[0] for r in brute.decontam([(k, x[1]) for k, x in enumerate(alone)], [(1, leak), (2, None)]) if r[-1]}
    clean = [x for k, x in enumerate(alone) if k not in hit]
    assert 0 < len(clean) < len(alone) < len(kept) < len(docs)
    copies = brute.draws([(k, x[2], len(x[1].split()), x[3]) for k, x in enumerate(clean)])
    want = Counter((x[0], n, crc) for k, x in enumerate(clean) for _ in range(copies[k]) for _, _, n, crc in brute.tokens([(0, x[1])], queries.tokenizer_path(queries.WORD_BPE)))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == want
    at = 0
    for r in sorted(got, key=lambda r: r["start"]):
        assert r["start"] == at
        at += r["n_tokens"]
    stage = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, f in corpus_pipeline.STAGES[:-1]:
        assert f(spark, stage, str(tmp_path)).columns == df.columns


def test_pipeline_tells_its_files_and_drops_its_scratch(spark, tiny, tmp_path):
    from tessera.llm import common, tokenfile

    shared = common.shared_dir(spark).removeprefix("file://")
    before = set(os.listdir(shared))
    out = corpus_pipeline.run(spark, tiny, f"file://{tmp_path}/tokens").collect()
    left = set(os.listdir(shared)) - before
    assert len(left) == 1 and "stage-token_files" in left.pop()
    held = {}
    for name in {r["file"] for r in out}:
        fs, path = common.open_fs(name)
        with fs.open_input_file(path) as file:
            held[name] = tokenfile.Reader(file).docs()[0]
    assert Counter(d for ids in held.values() for d in ids) == Counter(r["doc_id"] for r in out)
    assert all(name.startswith(f"file://{tmp_path}/tokens/") for name in held)


def test_pipeline_of_nothing(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
