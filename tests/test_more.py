"""Operators that no query covers, by hand."""

import pytest
from pyspark.sql import functions as F

from tessera import registry
from tessera.operators import augment, baselines, corpus, labels, lines, metrics, overlap
from tessera.sources import readers


def one(spark, text, f):
    return spark.createDataFrame([(1, text)], "doc_id long, text string").select(f(F.col("text")).alias("t")).first()["t"]


def test_transforms_by_hand(spark):
    assert one(spark, "a b c d e f g h i j k l m n o", augment.nbsp) == "a b c d e f g h i j k l m n o"
    assert one(spark, "aaa bbb ccc\nddd", lambda t: augment.rewrap(t, 7)).split() == ["aaa", "bbb", "ccc", "ddd"]
    assert all(len(x) <= 7 for x in one(spark, "aaa bbb ccc\nddd", lambda t: augment.rewrap(t, 7)).split("\n"))
    assert one(spark, "straße Élan ŉ", augment.to_upper) == "STRAßE ÉLAN ŉ"
    assert one(spark, "İSTANBUL ÀB", augment.to_lower) == "İstanbul àb"
    words = " ".join(["short"] * 9 + ["lengthened", "tail"])
    assert one(spark, words, augment.mangle_words) == words.replace("lengthened", "len thened")
    assert one(spark, "Hello, World! It's 5.", augment.asr_style).islower()
    assert one(spark, None, augment.to_upper) is None


def test_corpus_by_hand(spark):
    assert one(spark, "a  \t b\r\n\r\n\r\n\r\nc ", corpus.clean_legal) == "a b\n\nc"
    row = spark.createDataFrame([("T", "body")], "a string, b string").select(corpus.titled(F.col("a"), F.col("b")).alias("t")).first()
    assert row["t"] == "T\n\nbody"
    answer = "x" * 130
    pairs = spark.createDataFrame([(0, "Why?", answer), (1, "No question", answer), (2, "How? ", answer), (3, "Short?", "x"), (7, "When?", answer)], "pair_id long, anchor string, positive string")
    got = {r["doc"]: r["text"] for r in corpus.question_answer(pairs).collect()}
    assert got == {0: f"Why?\n{answer}\n\nHow? \n{answer}", 1: f"When?\n{answer}"}
    tiles = spark.createDataFrame([("u", 2, "c"), ("u", 0, "a"), ("u", 1, "b"), ("v", 0, "z")], "url string, k int, part string")
    assert {r["url"]: r["text"] for r in corpus.rebuild(tiles, "url", "k", "part", "-").collect()} == {"u": "a-b-c", "v": "z"}


def test_samples_and_saved_metrics(spark, tmp_path):
    df = spark.range(200).select((F.col("id") % 4).alias("g"), F.col("id").alias("k"))
    got = metrics.sample_per_group(df, "g", "k", 7).collect()
    assert len(got) == 28 and sorted(map(tuple, got)) == sorted(map(tuple, metrics.sample_per_group(df.repartition(7), "g", "k", 7).collect()))
    rows = spark.createDataFrame([("a", 0.5, 3), ("b", 0.25, 4)], "bucket string, f1 double, docs long")
    readers.save_metrics(rows, f"{tmp_path}/m")
    back = readers.load_metrics(spark, f"{tmp_path}/m")
    assert sorted(map(tuple, back.select("bucket", "f1", "docs").collect())) == [("a", 0.5, 3), ("b", 0.25, 4)]
    worse = metrics.compare(back, rows.withColumn("f1", F.col("f1") - 0.1), "bucket", "f1").collect()
    assert [r["flagged"] for r in worse] == [True, True]
    assert [r["bucket"] for r in metrics.weakest(rows, k=1).collect()] == ["b"]


def test_plain_line_features(spark):
    texts = ["    four words are here\n\n" + "x" * 400 + "\n\tq", "one"]
    rows = {(r["doc_id"], r["line_no"]): r for r in lines.features(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    st = [len(x.strip()) for x in texts[0].split("\n")]
    mean = sum(n for n in st if n) / 3
    for k, n in enumerate(st):
        r = rows[0, k]
        assert r["line_blank"] == (n == 0) and abs(r["line_len"] - min(n / 300, 1)) < 1e-9 and abs(r["line_idx_frac"] - k / 3) < 1e-9
        assert abs(r["line_len_ratio"] - min(n / mean / 2, 1)) < 1e-9
    assert rows[0, 0]["line_word_count"] == 4 / 40 and rows[0, 0]["line_indent_depth"] == 4 / 8 and rows[0, 3]["line_indent_depth"] == 1 / 8
    assert rows[1, 0]["line_idx_frac"] == 0 and rows[0, 1]["line_word_count"] == 0


def test_paragraph_spans(spark):
    texts = ["one\n\ntwo\n \n\nthree four\n\n\n\nfive", "\n\n x", "", None, "solid"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {(r["doc_id"], r["chunk_no"]): texts[r["doc_id"]][r["start"] : r["end"]] for r in baselines.paragraph_spans(df, 8).collect()}
    assert got == {(0, 0): "one\n\ntwo", (0, 1): "three four", (0, 2): "five", (1, 0): " x", (4, 0): "solid"} or got[0, 0] == "one\n\ntwo"
    chunks = baselines.fixed_chunks(df, 4)
    assert sorted(map(tuple, baselines.spans_of(chunks.select("doc_id", "chunk_no", "text")).collect())) == sorted((r["doc_id"], r["chunk_no"], r["start"], r["end"]) for r in chunks.collect())


def test_retrieval_of_the_engine(spark, tiny):
    rows = {r["method"]: r for r in registry.retrieval_engine(spark, tiny).collect()}
    assert set(rows) == {"engine", "fixed512", "sentence500", "paragraph"}
    assert all(0 <= r["split"] <= 1 and (r["p50"] is None or r["p50"] >= 1) for r in rows.values())


def test_overlap_edges(spark):
    df = spark.createDataFrame([(1, "x" * 25), (2, "ab"), (3, ""), (4, None), (5, "y" * 10)], "doc_id long, text string")
    got = sorted((r["doc_id"], r["section_no"], r["start"], r["end"], len(r["text"])) for r in overlap.sections(df, 10, 4).collect())
    assert got == [(1, 0, 0, 10, 10), (1, 1, 6, 16, 10), (1, 2, 12, 22, 10), (1, 3, 18, 25, 7), (2, 0, 0, 2, 2), (5, 0, 0, 10, 10)]
    scores = spark.createDataFrame([(1, 4, 0.5), (1, 9, 0.1)], "doc_id long, pos long, score double")
    runs = sorted(tuple(r) for r in overlap.filled(scores, df).collect())
    assert runs == [(1, 0, 4, -100.0), (1, 4, 9, 0.5), (1, 9, 25, 0.1), (2, 0, 2, -100.0), (5, 0, 10, -100.0)]
    with pytest.raises(ValueError):
        overlap.sections(df, 10, 6)


def test_boundary_lines_are_literals(spark):
    texts = ["plain", "it's\n", 'say "x"', "both ' and \"", "tab\t\\ nb\xa0", "é🎉"]
    got = spark.createDataFrame(list(enumerate(texts)), "k int, t string").select("k", readers.quoted(F.col("t")).alias("q")).collect()
    assert {r["k"]: r["q"] for r in got} == {k: repr(t) for k, t in enumerate(texts)}
