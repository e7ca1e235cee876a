"""Work that must stay near linear within one document, and the operators that it rests on."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from tessera.operators import baselines, corpus, labels, lines, metrics, packing, ranges, spans
from tessera.sources import readers


def seconds(df):
    began = time.monotonic()
    df.write.format("noop").mode("overwrite").save()
    return time.monotonic() - began


def test_stab_meets_each_pair_once(spark):
    r = random.Random(5)
    ivs = [(d, k, *sorted((r.randint(-50, 400), r.randint(-50, 400)))) for d in (1, 2) for k in range(60)] + [(1, 99, 7, 7), (1, 98, 9, 3), (None, 97, 0, 400), (2, 96, -(1 << 40), 1 << 40)]
    pts = [(r.choice([1, 2, 3, None]), r.randint(-60, 420)) for _ in range(150)]
    a = spark.createDataFrame(list(enumerate(pts)), "id int, p struct<doc_id:long,pos:long>").select("id", "p.*")
    b = spark.createDataFrame(ivs, "doc_id long, k int, lo long, hi long")
    got = sorted(map(tuple, ranges.stab(a, "pos", b, "lo", "hi").select("id", "k").collect()))
    assert got == sorted((i, k) for i, (d, p) in enumerate(pts) for e, k, lo, hi in ivs if d is not None and d == e and lo <= p <= hi)
    assert ranges.stab(a, "pos", b.limit(0), "lo", "hi").count() == 0


def test_within_document_joins_by_hand(spark):
    chunks = spark.createDataFrame([(1, 0, 0, 10), (1, 1, 10, 20), (1, 2, 5, 40), (2, 0, 0, 5)], "doc_id long, chunk_no int, start int, end int")
    frags = spark.createDataFrame([(1, 0, 10), (1, 10, 12), (1, 6, 30), (1, 30, 41), (2, 4, 5), (3, 0, 1), (None, 0, 1), (1, 0, 10)], "doc_id long, fs long, fe long")
    got = {(x["doc_id"], x["fs"], x["fe"]): x["chunk_no"] for x in metrics.containment(chunks, frags).collect()}
    assert got == {(1, 0, 10): 0, (1, 10, 12): 1, (1, 6, 30): 2, (1, 30, 41): None, (2, 4, 5): 0, (3, 0, 1): None, (None, 0, 1): None}
    points = spark.createDataFrame([(1, p) for p in range(8)] + [(None, 4), (2, 4)], "doc_id long, pos long")
    held = spark.createDataFrame([(1, 2, 6), (1, 0, 1)], "doc_id long, s long, e long")
    assert sorted(map(tuple, spans.veto(points, held).collect()), key=repr) == sorted([(1, 0), (1, 1), (1, 2), (1, 6), (1, 7), (None, 4), (2, 4)], key=repr)
    rows = spark.createDataFrame([(1, "a\nbcdefgh\nx", "")], "doc_id long, text string, s string")
    marks = spark.createDataFrame([(1, 3), (1, 6), (1, 8), (1, 20), (1, 6)], "doc_id long, pos long")
    assert sorted(map(tuple, labels.snap_positions(marks, lines.split_lines(rows)).collect())) == [(1, 2), (1, 10), (1, 20)]


def test_a_million_fragments_of_one_document(spark):
    n = 1_000_000
    frags = spark.range(n).select(F.lit(1).cast("long").alias("doc_id"), (F.col("id") * 3).alias("fs"), (F.col("id") * 3 + 2).alias("fe"))
    chunks = spark.range(n).select(F.lit(1).cast("long").alias("doc_id"), F.col("id").cast("int").alias("chunk_no"), (F.col("id") * 4).alias("start"), (F.col("id") * 4 + 4).alias("end"))
    assert seconds(metrics.containment(chunks, frags)) < 120
    points = frags.select("doc_id", F.col("fs").alias("pos"))
    assert seconds(spans.veto(points, chunks.select("doc_id", F.col("start").alias("s"), F.col("end").alias("e")))) < 120


def greedy(sizes, step):
    held, out = -1, []
    for i, n in enumerate(sizes):
        opens, held = step(held, n)
        out += [i] * opens
    return out


@pytest.mark.parametrize("block", [1, 3, 512])
def test_packing_equals_the_plain_walk(spark, monkeypatch, block):
    monkeypatch.setattr(packing, "BLOCK", block)
    r = random.Random(block)
    rows = [[r.randint(1, 30) for _ in range(k)] for k in (0, 1, 2, 3, 4, 7, 40, 700)]
    df = spark.createDataFrame([(x,) for x in rows], "n array<int>")
    step = lambda held, n: ((held < 0) | (held + n + 2 > 50), F.when((held < 0) | (held + n + 2 > 50), n).otherwise(held + n + 2))
    plain = lambda held, n: (True, n) if held < 0 or held + n + 2 > 50 else (False, held + n + 2)
    got = df.select(packing.openings(F.col("n"), step).alias("o")).collect()
    assert [x["o"] for x in got] == [greedy(x, plain) for x in rows]


def test_many_paragraphs_of_one_text(spark):
    text = "\n\n".join(f"paragraph {k} of many, with a few more words to fill it up" for k in range(300_000))
    df = spark.createDataFrame([(1, text)], "doc_id long, text string").cache()
    df.count()
    assert seconds(baselines.paragraph_chunks(df)) < 60
    assert seconds(corpus.sections(df)) < 60
    out = baselines.paragraph_chunks(df).select("text").collect()
    assert "\n\n".join(r["text"] for r in out) == text and max(len(r["text"]) for r in out) <= 800
    units = spark.range(200_000).selectExpr("1L as doc_id", "id as unit_no", "concat('unit ', id) as text")
    assert seconds(labels.join_units(units)) < 60
    df.unpersist()


def test_folder_of_files_of_one_name(spark, tmp_path):
    for k, body in (("a", " one\n"), ("b", "two"), ("c", "three "), ("d", " \n\t　")):
        (tmp_path / "in" / k).mkdir(parents=True)
        (tmp_path / "in" / k / "x.txt").write_text(body)
    rows = readers.read_text(spark, f"{tmp_path}/in").orderBy("path").collect()
    assert [r["text"] for r in rows] == ["one", "two", "three"] and len({r["doc_id"] for r in rows}) == 3
    assert {r["name"] for r in rows} == {"x.txt"}


def test_fractions_of_odd_digits_and_capitals(spark):
    texts = ["x² ½ Ⅷ A", "٣ ① ⅷ ǅ", "ªº Ⓐ", "ABC 123", "..."]
    rows = lines.features(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    for r in rows:
        t = texts[r["doc_id"]]
        alpha, digit, upper = sum(map(str.isalpha, t)), sum(map(str.isdigit, t)), sum(c.isupper() and c.isalpha() for c in t)
        punct = sum(not (c.isalpha() or c.isdigit() or c in " \t") for c in t)
        assert (r["n_alpha"], r["n_digit"], r["n_upper"], r["n_punct"]) == (alpha, digit, upper, punct)
        assert abs(r["line_digit_frac"] - digit / len(t)) < 1e-9 and abs(r["line_upper_frac"] - upper / max(alpha, 1)) < 1e-9
        assert abs(r["line_punct_frac"] - punct / len(t)) < 1e-9 and r["line_all_lower"] == (alpha > 0 and upper == 0)
        assert r["line_no_alpha"] == (alpha == 0)


ODD_LINES = [
    "One (two. Three! \"Four?\" five\n\n\n  six² ½ 7.5 É.\n) x", " lead. \n\tnext", ".", "a.\nb", "a.", "x. y! z?\n\n. ! ?\n  ", "\n\nfirst", "((\n)\n]\n a) b. (c", "q.)b \"end.\" Then.\n'And' so", " \n \n.\n x", "A", "A\n", "no end at all\nstill none\n\nDone. ", "tab\tgap\n\t.\t\nx.\t \ny",
]


def test_line_starts_equal_the_characters_there(spark):
    from tessera.operators import chars

    r = random.Random(2)
    made = ["".join(r.choice("aB1 .!?()\n\n\t\"'é²") for _ in range(r.randint(1, 120))) for _ in range(150)]
    df = spark.createDataFrame(list(enumerate([*ODD_LINES, *made, "", None])), "doc_id long, text string")
    cols = ["doc_id", "pos", *(F.round(F.col(n).cast("double"), 9).alias(n) for n in chars.NAMES)]
    rows = lines.features(df)
    want = chars.features(df, lines=rows).where("pos = start and ch <> '\n'").select(*cols).collect()
    have = chars.line_starts(rows).select(*cols).collect()
    assert len(have) == len(want) > 400
    key = lambda x: (x["doc_id"], x["pos"])
    for a, b in zip(sorted(have, key=key), sorted(want, key=key)):
        assert a == b, [(n, a[n], b[n]) for n in chars.NAMES if a[n] != b[n]]


def test_a_long_text_after_its_last_sentence(spark, tmp_path):
    from tessera import registry

    texts = ["One. Two! (Three?) four.five. " + "and so on, " * 60_000, "no end at all " * 60_000, "A.", ". . ?!\n"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    assert seconds(registry.series(spark, str(tmp_path))) < 20
    assert seconds(baselines.sentence_ends(df)) < 20
    got = sorted((r["doc_id"], r["pos"], round(r["score"] * 100)) for r in registry.series(spark, str(tmp_path)).collect())
    want = [(d, k, min(len(m), 100)) for d, t in enumerate(texts) for k, m in enumerate(re.findall("(?s).*?[.!?][ \\t\\n)\\]}»\"']", t[:200]))]
    assert got == want
    ends = sorted((r["doc_id"], r["pos"]) for r in baselines.sentence_ends(df).collect())
    assert ends == [(d, m.end()) for d, t in enumerate(texts) for m in re.finditer("[.!?](?=[ \\t\\n)\\]}»\"'])", t[:200])]


def test_workers_get_few_texts_at_once(spark):
    from tessera.operators import edits
    from tessera.plans.segment import SegmentEngine

    docs = spark.range(3000).selectExpr("id as doc_id", "'One line.\nAnother one.' as text", "array(10L) as boundaries")
    for run in (lambda: SegmentEngine().chunk(docs), lambda: edits.apply(docs, edits.page_marks(docs))):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
        assert run().count() == 3000
        assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 256


def test_classes_and_shifts_need_no_window_over_characters(spark):
    from tessera.operators import chars

    every = [chr(c) for c in [*range(0x3000), *range(0xFB00, 0x10000), 0x1D400, 0x1D7CE, 0x1F600] if chr(c) not in "\n\r"]
    text = "".join(every)
    rows = lines.split_lines(spark.createDataFrame([(1, text)], "doc_id long, text string"))
    found = chars.with_shifts(chars.with_classes(chars.explode(rows)))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan[: plan.index("Generate posexplode(arrays_zip")]
    wrong = found.where(" or ".join(f"`{n}` <> (ch rlike '^{p}$')" for n, p in ((n, p.replace("\\", "\\\\").replace("'", "\\'")) for n, p in chars.CLASSES.items() if n != "NL")))
    assert wrong.select("pos", "ch").collect() == [] and found.count() == len(text)


def test_long_pieces_keep_words_and_leave_no_fragments(spark, tmp_path):
    from tessera import registry

    words = " ".join(f"word{k}" for k in range(700))
    texts = [
        "```\n" + " ".join(f"word{k}" for k in range(3000)),  # a fence that is never closed
        "\n\n".join("# Heading\n" + words[:2500 + k] for k in range(0, 90, 15)),  # pieces that pass the limit by a little
        "a b\n" * 70 + "x" * 1200 + " " + "y" * 1150 + " " + words,  # a word before which only earlier places are
        "word" + " " * 6000 + "end",
        "word " * 50_001 + "end",  # longer than a window, without a line break
    ]
    spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = registry.chunk_invariants(spark, str(tmp_path)).collect()
    assert sorted((r["doc_id"], r["mid_word"], r["least"]) for r in rows) == [(k, 0, True) for k in range(len(texts))]


def test_a_line_costs_what_its_features_ask_for(spark):
    """Texts are normalised once for their lines, and facts of neighbours that the scorer has no weight for aren't computed."""
    from tessera.plans.segment import SegmentEngine

    docs = spark.createDataFrame([(1, "a\nb"), (2, None), (3, "")], "doc_id long, text string")
    plan = lines.split_lines(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("translate(") == 1
    plan = SegmentEngine().chunk(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert "javaUpperCase" not in plan
    assert sorted((r.doc_id, r.line_no, r.seg) for r in lines.split_lines(docs).collect()) == [(1, 0, "a"), (1, 1, "b"), (3, 0, "")]


def test_normalised_alike_in_both_engines(spark):
    from tessera.functions import textnorm
    from tessera.operators import assemble

    texts = [f"x{c}\r\ny{c}{c}\r{c}z\n" for c in textnorm.FOLD_FROM] + ["plain", "", "\r\r\n\n\r"]
    got = spark.createDataFrame(list(enumerate(texts)), "k int, text string").orderBy("k").select(textnorm.normalize(F.col("text"))).collect()
    assert [r[0] for r in got] == [assemble.normalized(t) for t in texts]


def test_marks_of_sections_are_dealt_as_lists(spark):
    """Of overlapping sections a row for each goes to its document, and a table of marks gives the same as lists of them."""
    from tessera.operators import overlap

    docs = spark.createDataFrame([(1, "x" * 9000), (2, "y" * 100), (3, "z" * 2500)], "doc_id long, text string")
    found = overlap.sections(docs, 1000, 200).withColumn("marks", F.sequence(F.col("start") + 1, F.col("end") - 1, F.lit(7).cast("long")))
    rows = found.select("doc_id", "section_no", "start", "end", "marks")
    got = overlap.merged_sections(rows)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan
    table = overlap.merged_marks(rows.select("doc_id", "section_no", F.explode("marks").alias("pos")), rows)
    want = set()
    for d, n in ((1, 9000), (2, 100), (3, 2500)):
        ends = [(r.start, r.end) for r in rows.where(F.col("doc_id") == d).collect()]
        held = None
        for p in sorted({p for a, b in ends for p in range(a + 1, b, 7) if len(ends) == 1 or a + 150 <= p < b - 150}):
            if len(ends) == 1 or held is None or p - held > 5:
                held = p
                want.add((d, p))
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in table.collect()} == want


def test_chunks_are_made_once_for_their_fragments(spark):
    """The places of chunks are kept when their levels are counted, and the join reads them instead of chunking anew."""
    from tessera.plans.segment import SegmentEngine

    docs = spark.createDataFrame([(1, "# A\n\nsome words. " * 90)], "doc_id long, text string")
    frags = spark.createDataFrame([(1, 10, 20), (1, 300, 360)], "doc_id long, fs long, fe long")
    engine = SegmentEngine()
    assert engine.places(docs).collect() == engine.chunk(docs).select("doc_id", "chunk_no", "start", "end").collect()
    plan = metrics.containment(engine.places(docs), frags)._jdf.queryExecution().optimizedPlan().toString()
    assert "InMemoryRelation" in plan


def test_content_of_blank_and_repeated_rows_is_conserved(spark, tmp_path):
    """A row each, as in the SQL: of null and blank texts, which have no chunk, of ids that repeat or are null, of a text over a window."""
    from tessera import registry

    rows = [(1, "One. Two"), (2, ""), (3, " \n\t 　"), (4, None), (5, "same id, " * 400), (5, "other text\r\nof it"), (6, "copy\n\n# A"), (6, "copy\n\n# A"), (None, "no id"), (None, "none either"), (7, "long words. " * 20_000)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    for query in (registry.chunk_content_conserved, registry.chunk_content_conserved_crlf):
        got = sorted(map(tuple, query(spark, str(tmp_path)).collect()), key=repr)
        assert got == sorted([(d, True, True) for d, _ in rows], key=repr)


def test_places_are_summed_without_a_row_for_each_character(spark, tmp_path, monkeypatch):
    """Sums of places equal those of the definitions, on odd texts and over groups of lines."""
    import pyarrow as pa
    from test_core import char_values

    from tessera import registry
    from tessera.functions import textnorm
    from tessera.operators import places

    r = random.Random(7)
    made = ["".join(r.choice("aB1 .!?()[}\n\n\t\"'é²«»🎉\x85\r\u2028日") for _ in range(r.randint(1, 90))) for _ in range(60)]
    texts = [*ODD_LINES, *made, "", None, "\n", "\n\n.", "stop.\x85\nnext", "one. «two» 🎉🎉 three! " * 20, "x" * 450 + ". " + "y" * 350]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    df = registry.char_places(spark, str(tmp_path))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "posexplode(arrays_zip" not in plan
    deco = registry.deco(spark, str(tmp_path)).select("doc_id", textnorm.normalize(F.col("text")).alias("t")).collect()
    whole = lambda name, v: int(v * 1_000_000 + 0.5) if registry.PLACES[name] else int(v)
    want = {d: {name: sum(whole(name, v[name]) for v in char_values(t)) for name in registry.PLACES} for d, t in deco if t}
    assert {x["doc_id"]: {name: x[name] for name in registry.PLACES} for x in df.collect()} == want and len(want) > 70
    lines_of = [(own, sum(len(x) for x in owns[:k]), sum(map(len, owns))) for t in texts[:14] for owns in [re.split(r"(?=\n)", t.replace("\r", "\n"))] for k, own in enumerate(owns) if own]
    args = [pa.array(x) for x in zip(*[(own, at, n, 0, 0, n, n, False) for own, at, n in lines_of])]
    held = places._sums(*args)
    monkeypatch.setattr(places, "AT_ONCE", 5)
    assert places._sums(*args) == held and len(held) == len(lines_of) and len(places._sums(*(a.slice(0, 0) for a in args))) == 0
