"""The library's queries against their SQL, and the engine's guarantees."""

import decimal

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.config import ChunkerConfig
from tessera.functions import textnorm
from tessera.operators import assemble, augment, chars, labels, lines, metrics, scoring, spans, synth
from tessera.plans.segment import SegmentEngine, engine_of
from tessera.registry import ORACLES, QUERIES
from tessera.sources import readers

PROSE = "A Plain Title\n\nThis is the first paragraph. It has two sentences.\nIt goes on here.\n\nSecond Title\n\nAnother paragraph follows, longer than the first one. It ends.\n"
QA = "What is it?\nIt is a thing.\nHow much does it cost?\nIt costs ten.\nWhen does it open?\nIt opens at nine.\n"
MARKDOWN = "## One\n\ntext of one\n\n```python\nx = 1\n\ny = 2\n```\n\n## Two\n\n| a | b |\n| --- | --- |\n| 1 | 2 |\n"
#: By class of input: nothing to say, line breaks of each kind, no place to cut, many places, marks of structure, characters
#: beyond the first plane.
BLANK = ["", "\t", "  \n \n\t", "\u3000\u00a0", "\r\r\n\n\r"]
SOLID = ["Z", "q" * 7001, "é" * 2499 + "\n" + "ü" * 2502, "9" * 2500, "-" * 3000 + " end"]
BROKEN = ["one\rtwo\r\nthree\nfour", "\r\n".join(f"row {k}" for k in range(900)), "p\n\n\n\nq", "\n" * 2600 + "deep", "\x0bA\x0cB\u2028C"]
PACKED = ["yes. " * 1500, "To be. Or not? " * 350 + "\r\n" + "Yes! " * 700, " ".join(f"item{k}" for k in range(3000))]
MARKED = ["~~~\nopen " + "x " * 3000, "| a |\n" * 900, "## A\n\n```\n" + "code line\n" * 600 + "```\n\n## B\nend", "Name: x\n" * 400, "\ufeffTop\n---\n1) a\n2) b"]
WIDE = ["🎉" * 2600, "𝒜 🎉 naïve\r\n" * 400, "ﬁńal‍\u00ad " * 500]
EDGE = [*BLANK, *SOLID, *BROKEN, *PACKED, *MARKED, *WIDE, PROSE, QA, MARKDOWN, PROSE * 300]


def plain(v):
    return float(v) if isinstance(v, decimal.Decimal) else v


@pytest.fixture(scope="session")
def duck(tiny):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels", "conversations"):
        con.sql(f"create view {t} as select * from '{tiny}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, duck, tiny, name):
    df = QUERIES[name](spark, tiny)
    cols = sorted(df.columns)
    rel = duck.sql(ORACLES[name])
    at = [rel.columns.index(c) for c in cols]
    assert sorted(rel.columns) == cols
    want = sorted((tuple(plain(r[i]) for i in at) for r in rel.fetchall()), key=repr)
    assert sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr) == want


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def chunks_of(spark, texts, **cfg):
    out = {k: [] for k in range(len(texts))}
    for r in SegmentEngine(ChunkerConfig(**cfg)).chunk(frame(spark, texts)).orderBy("doc_id", "chunk_no").collect():
        out[r["doc_id"]].append(r)
    return out


def bare(t):
    return "".join(t.split())


@pytest.fixture(scope="session")
def edge_chunks(spark):
    return chunks_of(spark, [*EDGE, None])


def test_chunks_are_slices_and_keep_everything(edge_chunks):
    for k, t in enumerate(EDGE):
        got = edge_chunks[k]
        assert all(t[r["start"] : r["end"]] == r["text"] and r["text"] == r["text"].strip() for r in got)
        assert bare("".join(r["text"] for r in got)) == bare(t)
        assert all(r["n_chars"] <= 2500 for r in got)
        assert [r["chunk_no"] for r in got] == list(range(len(got)))
    assert all(edge_chunks[k] == [] for k in [len(EDGE), *range(len(BLANK))])


def test_no_chunk_starts_within_a_word(edge_chunks):
    for t, rows in zip(EDGE[-4:], (edge_chunks[k] for k in range(len(EDGE) - 4, len(EDGE)))):
        assert all(r["start"] == 0 or not (t[r["start"] - 1].isalnum() and t[r["start"]].isalnum()) for r in rows)


def test_fence_and_short_line_stay_whole(spark, edge_chunks):
    assert any("x = 1\n\ny = 2" in r["text"] for r in edge_chunks[len(EDGE) - 2])
    assert len(chunks_of(spark, ["One short line of text."])[0]) == 1


def test_most_and_crlf(spark):
    text = "This is a sentence of some length, as they go. " * 90
    assert all(r["n_chars"] <= 600 for r in chunks_of(spark, [text], max_chunk_chars=600, min_chunk_chars=50)[0])
    for t in (PROSE, QA, MARKDOWN):
        a, b = chunks_of(spark, [t, t.replace("\n", "\r\n")]).values()
        assert [r["text"] for r in a] == [r["text"].replace("\r\n", "\n") for r in b]


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="aB .\n\r-#|`?1", max_size=400), st.lists(st.integers(0, 400), max_size=12), st.integers(5, 80))
def test_assembly_keeps_content(text, points, most):
    cfg = ChunkerConfig(max_chunk_chars=most, min_chunk_chars=3)
    got = assemble.cuts_of(text, points, [], cfg, [(p, 0.5) for p in points])
    assert bare("".join(text[a:b] for a, b, _ in got)) == bare(text)
    assert all(b - a <= most for a, b, _ in got)
    lf = text.replace("\r\n", "\n").replace("\r", "\n")
    same = lambda t: [t[a:b].replace("\r\n", "\n") for a, b, _ in assemble.cuts_of(t, points, [], cfg)]
    assert same(lf) == same(lf.replace("\n", "\r\n"))


def test_merge_rules():
    """A heading opens a chunk, what goes on in lower case or is short joins the one before, a short start the one after."""
    def chunks(*pieces, least=20):
        text = "".join(pieces)
        cuts = [len("".join(pieces[:k])) for k in range(1, len(pieces))]
        edges = [0, *assemble.merge(text, cuts, least), len(text)]
        return [text[a:b] for a, b in zip(edges, edges[1:])]

    long = ["First body, which is long enough.\n", "Second body, which is long enough.\n"]
    assert chunks(*long) == long
    assert chunks(long[0], "and it goes on in lower case here.\n", long[1]) == [long[0] + "and it goes on in lower case here.\n", long[1]]
    assert chunks(long[0], "A Heading\n", long[1]) == [long[0], "A Heading\n" + long[1]]
    assert chunks(long[0], "Short end.\n", long[1]) == [long[0] + "Short end.\n", long[1]]
    assert chunks("Hi.\n", long[0], long[1]) == ["Hi.\n" + long[0], long[1]]
    assert chunks(long[0], "A Heading\n") == [long[0] + "A Heading\n"]
    assert chunks(long[0], "\n\n", long[1]) == [long[0] + "\n\n", long[1]]


def test_long_documents_and_repeated_ids(spark):
    body = [f"## Part {k}\n\n" + f"Sentence {k} of some length stands here. " * 20 + "\n\n" for k in range(40)]
    text = "".join(body)
    rows = [(1, text), (1, text), (None, text), (None, PROSE), (1, None), (2, "x" * 9000)]
    got = {}
    for r in SegmentEngine(ChunkerConfig(window_chars=4000)).chunk(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect():
        got.setdefault(r["doc_id"], []).append(r)
    one = sorted((r["chunk_no"], r["start"], r["text"]) for r in got[1])
    assert one[::2] == one[1::2] and [n for n, *_ in one[::2]] == list(range(len(one) // 2))
    assert all(text[a : a + len(t)] == t for _, a, t in one) and bare("".join(t for *_, t in one[::2])) == bare(text)
    assert len(got[None]) == len(one) // 2 + len(chunks_of(spark, [PROSE])[0])
    assert [r["n_chars"] for r in sorted(got[2], key=lambda r: r["start"])] == [2500, 1500, 2500, 1500, 1000]
    # Parts end at line ends: with a window beyond it all headings are the same.
    whole = [r["text"] for r in chunks_of(spark, [text])[0]]
    assert sum(t.startswith("## Part") for t in whole) == 40


def test_lines_of_repeated_ids(spark):
    df = spark.createDataFrame([(1, "a\nb"), (1, "c\n\nd"), (None, "e\nf"), (None, None)], "doc_id long, text string").repartition(2)
    rows = lines.features(df).select("doc_id", "line_no", "start", "seg", "n_lines", "line_after_blank").collect()
    assert sorted(map(tuple, rows), key=repr) == sorted([(1, 0, 0, "a", 2, False), (1, 1, 2, "b", 2, False), (1, 0, 0, "c", 3, False), (1, 1, 2, "", 3, False), (1, 2, 3, "d", 3, True), (None, 0, 0, "e", 2, False), (None, 1, 2, "f", 2, False)], key=repr)


def char_values(t):
    """Some features of each character, from their definitions."""
    n, out = len(t), []
    eos = [c in ".!?" and k + 1 < n and t[k + 1] in " \t\n)]}»\"'" for k, c in enumerate(t)]
    gap = [c in " \t\n" for c in t]
    starts = [k for k in range(n) if k == 0 or (not gap[k] and any(not gap[j] and eos[j] and all(gap[j + 1 : k]) for j in range(k)))]
    for k, c in enumerate(t):
        s = max(x for x in starts if x <= k)
        e = min((x for x in starts if x > k), default=n)
        nl = max((j for j in range(k + 1) if t[j] == "\n"), default=0)
        w0, w1 = max((j for j in range(k + 1) if gap[j]), default=-1), min((j for j in range(k, n) if gap[j]), default=n)
        stop = min((j for j in range(k, n) if eos[j]), default=n)
        out.append(
            {
                "L": c.isalpha(), "D": c.isdigit(), "UPP": c.isupper(), "PUNC": not (c.isalpha() or c.isdigit() or gap[k]), "prev_D": k > 0 and t[k - 1].isdigit(), "next_UPP": k + 1 < n and t[k + 1].isupper(),
                "eos_here": eos[k], "prev_eos": k > 0 and eos[k - 1], "para_start": t[k : k + 2] == "\n\n", "para_end": k > 0 and t[k - 1 : k + 1] == "\n\n", "nl_end": c == "\n" and t[k : k + 2] != "\n\n",
                "chars_since_nl": min((k - nl) / 200, 1), "is_line_end": c == "\n" or t[k + 1 : k + 2] in ("\n", ""), "chars_since_sent": min((k - s) / 300, 1), "sent_len": min((e - s) / 400, 1), "at_sent_start": k in starts,
                "dist_to_term": min((stop - k) / 200, 1), "word_len_cur": min((w1 - w0) / 30, 1), "in_word": not gap[k], "open_paren": sum(x in "([{«" for x in t[: k + 1]) > sum(x in ")]}»" for x in t[: k + 1]), "doc_pos": k / n, "near_end": k > n - 8,
            }
        )
    return out


def test_character_features(spark):
    texts = [PROSE, QA, MARKDOWN, "One (two. Three! \"Four?\" five\n\n\n  six² ½ 7.5 É.", " ", "\n\n", "", None, "A" * 500 + ". b"]
    rows = chars.features(frame(spark, texts)).collect()
    got = {(r["doc_id"], r["pos"]): r for r in rows}
    assert len(rows) == sum(len(t or "") for t in texts) and all(n in rows[0].asDict() for n in chars.NAMES)
    for d, t in enumerate(texts):
        for k, want in enumerate(char_values(t or "")):
            for name, v in want.items():
                assert got[d, k][name] == v if isinstance(v, bool) else abs(got[d, k][name] - v) < 1e-9, (d, k, name)
    assert len(chars.NAMES) == 102 and chars.schema_digest() == "4b98cc3942b9"
    whole = {(r["doc_id"], r["pos"]): r["features"] for r in chars.extract_features(frame(spark, texts)).collect()}
    assert all(len(v) == 102 and abs(v[0] - got[k]["L"]) < 1e-6 and abs(v[97] - got[k]["doc_pos"]) < 1e-6 for k, v in whole.items())


def test_line_features_by_hand(spark):
    text = "BIG NEWS Today\n  indented\nWhat? yes\nlower end-\nComma here,\nSome Short Caps\nTitle\n===\n| a | b\non day 1999\n3 may 12\n```\nwhat is\n```"
    rows = {r["line_no"]: r for r in lines.features(frame(spark, [text])).collect()}
    on = lambda name: [k for k, r in sorted(rows.items()) if r[name]]
    assert on("line_allcaps") == [0] and on("line_indent") == [1] and on("line_has_q") == [2] and on("line_ends_hyphen") == [3] and on("line_ends_comma") == [4]
    assert on("line_starts_lower") == [1, 3, 9, 12] and on("line_has_setext_under") == [6] and on("line_table") == [8] and on("line_date") == [9, 10]
    assert on("line_short_caps") == [0, 2, 5, 6] and on("line_in_code") == [11, 12, 13] and on("line_qword") == [2, 12]


def test_networks_in_the_engine(spark, tmp_path):
    """Small random networks over all features: scores equal numpy's, and the engine takes blend, peaks and fallback."""
    import numpy as np

    r = np.random.default_rng(3)
    char, line = str(tmp_path / "c.npz"), str(tmp_path / "l.npz")
    net = lambda *sizes: [(r.normal(size=(a, b)).astype("f4") / 8, r.normal(size=b).astype("f4") / 8) for a, b in zip(sizes, sizes[1:])]
    c, l = net(102, 16, 2), net(102 * 3, 12, 1)
    scoring.save_weights(char, c)
    scoring.save_weights(line, l, CTX=1)
    engine = engine_of(ChunkerConfig(max_chunk_chars=80, min_chunk_chars=5, big_threshold=0.4, small_threshold=0.3, char_blend=0.25), line, char)

    def forward(layers, x):
        for k, (w, b) in enumerate(layers):
            x = x @ w + b if k + 1 == len(layers) else np.maximum(x @ w + b, 0)
        return 1 / (1 + np.exp(-x.astype("f8")))

    df = frame(spark, [PROSE, MARKDOWN])
    x = {(v["doc_id"], v["pos"]): np.array(v["features"], "f4") for v in chars.extract_features(df).collect()}
    got = {(v["doc_id"], v["start"]): v["score"] for v in engine.line_scores(df).collect()}
    for d, t in enumerate([PROSE, MARKDOWN]):
        starts = [k for k in range(len(t)) if (k == 0 or t[k - 1] == "\n") and t[k] != "\n"]
        feats = np.vstack([np.zeros((1, 102)), [x[d, k] for k in starts], np.zeros((1, 102))])
        want = 0.75 * forward(l, np.hstack([feats[:-2], feats[1:-1], feats[2:]]))[:, 0] + 0.25 * forward(c, feats[1:-1])[:, 0]
        assert np.allclose([got[d, k] for k in starts], want, atol=1e-5)
    rows = engine.chunk(df).collect()
    assert {v["doc_id"] for v in rows} == {0, 1} and all(v["n_chars"] <= 80 for v in rows)
    for d, t in enumerate([PROSE, MARKDOWN]):
        assert bare("".join(v["text"] for v in sorted(rows, key=lambda v: v["start"]) if v["doc_id"] == d)) == bare(t)
    with pytest.raises(ValueError, match="feature schema"):
        scoring.save_weights(line, net(204, 1))
        engine_of(line_weights=line)


def test_normalisation_keeps_length(spark):
    texts = ["plain", "a b c", "“q” ‘s’", "a — b", "wait…", "page\x0cbreak x"]
    rows = frame(spark, texts).select(textnorm.normalize(F.col("text")).alias("t")).collect()
    assert [len(r["t"]) for r in rows] == [len(t) for t in texts]
    assert [r["t"] for r in rows][1:4] == ["a b c", "\"q\" 's'", "a - b"]


def test_spans_cover_fences(spark):
    rows = spans.protected_spans(lines.split_lines(frame(spark, [MARKDOWN, "```\nopen", "| a |\n```\nx\n```\n| b |\ny"]))).collect()
    by = {k: sorted((r["kind"], r["s"], r["e"]) for r in rows if r["doc_id"] == k) for k in range(3)}
    assert [MARKDOWN[s:e] for kind, s, e in by[0] if kind == "fence"] == ["```python\nx = 1\n\ny = 2\n```\n"]
    assert by[1] == [("fence", 0, 8)]
    assert [k for k, _, _ in by[2]] == ["fence", "table"] and by[2][1][1:] == (0, 22)


def test_weights_are_checked(spark, tmp_path):
    import numpy as np

    path = str(tmp_path / "w.npz")
    np.savez(path, W1=np.ones((4, 2), "f4"), b1=np.zeros(4, "f4"), W2=np.ones((1, 4), "f4"), b2=np.zeros(1, "f4"), SCHEMA="abc")
    df = frame(spark, [QA])
    with pytest.raises(ValueError, match="feature schema"):
        scoring.MlpScorer(path, ("line_hash",)).score(lines.features(df))
    with pytest.raises(ValueError, match="feature schema"):
        scoring.MlpScorer(path, ("line_hash", "line_ends_q"), "other").score(lines.features(df))
    rows = scoring.MlpScorer(path, ("line_hash", "line_ends_q")).score(lines.features(df)).select("line_ends_q", "score").collect()
    assert all(abs(r["score"] - 1 / (1 + np.exp(-4.0 * r["line_ends_q"]))) < 1e-6 for r in rows)


def test_units_round_trip(spark):
    gold = synth.corpus(spark.range(90).withColumnRenamed("id", "doc_id"))
    back = {r["doc_id"]: (r["text"], r["boundaries"]) for r in labels.join_units(labels.units(gold)).collect()}
    assert {r["doc_id"]: (r["text"], r["boundaries"]) for r in gold.collect()} == back
    out = augment.augment(gold, seed=3).collect()
    assert out and all(0 < b < len(r["text"]) for r in out for b in r["boundaries"]) and any(r["transforms"] for r in out)


def test_synthetic_kinds(spark):
    """Each kind's units are whole in the text, in each language and format, and the boundaries are theirs."""
    heads = {}
    for r in synth.corpus(spark.range(2 * len(synth.KINDS) * synth.FORMATS).withColumnRenamed("id", "doc_id")).collect():
        edges = [0, *r["boundaries"], len(r["text"])]
        pieces = [r["text"][a:b] for a, b in zip(edges, edges[1:])]
        assert len(pieces) == 3 + r["doc_id"] % 4 and all(pieces) and "{" not in r["text"]
        d, lang = r["doc_id"], synth.LANGS.index(r["lang"])
        formats = synth.KINDS[r["source"]][lang]
        template = formats[d // (2 * len(synth.KINDS)) % len(formats)]
        heads.setdefault((r["source"], lang), set()).add(template)
        head, tail = synth.parts_of(template)[0], synth.parts_of(template)[-1]
        assert (head[1] or all(p.startswith(head[0]) for p in pieces)) and (tail[1] or all(p.endswith(tail[0]) for p in pieces))
    assert all(len(heads[k, l]) == len(f[l]) for k, f in synth.KINDS.items() for l in (0, 1)) and len(synth.KINDS) == 28
    assert synth.generate(spark, "faq", 3).count() == 3 and all(synth.FORMATS % len(f) == 0 for both in synth.KINDS.values() for f in both)


def test_label_operators(spark):
    df = spark.createDataFrame([(1, "alpha beta gamma", "alpha\u3010SPLIT\u3011 beta\u3010SPLIT\u3011 gama"), (2, "", "x"), (3, None, None)], "doc_id long, text string, generated string")
    assert {r["doc_id"]: r["boundaries"] for r in labels.aligned_marks(df).collect()} == {1: [5, 10], 2: [], 3: []}
    logp = spark.createDataFrame([(1, p, v) for p, v in enumerate([-1.0, -9.0, -2.0, -9.0, -9.0, -9.0, -1.5, -9.0])] + [(2, 0, -1.0)], "doc_id long, pos long, score double")
    docs = spark.createDataFrame([(1, "abcdefgh", []), (2, "abc", [2]), (3, "abc", None)], "doc_id long, text string, boundaries array<long>")
    assert {r["doc_id"]: r["boundaries"] for r in labels.peak_boundaries(logp, docs).collect()} == {1: [6], 2: [2], 3: []}
    crlf = spark.createDataFrame([(1, "a\r\nb\rc", [1, 2, 3, 5])], "doc_id long, text string, boundaries array<long>")
    assert labels.normalised(crlf).first()["text"] == "a\nb\nc" and labels.normalised(crlf).first()["boundaries"] == [1, 2, 4]


def test_fitted_scorer(spark):
    """Lines that open a unit are told from others by a scorer that Spark fits, on documents that it hasn't seen."""
    gold = synth.corpus(spark.range(280).withColumnRenamed("id", "doc_id"))
    marks = gold.select("doc_id", F.explode("boundaries").alias("pos"))
    rows = labels.line_labels(lines.features(gold.select("doc_id", "text")), marks, back=0)
    names = ["line_hash", "line_after_blank", "line_title", "line_enum", "line_ends_q", "prev_line_ends_sent", "line_starts_lower", "line_bullet", "in_code", "line_repeat_prev"]
    scorer = labels.fit_scorer(rows.where("doc_id < 200"), names, 2.0)
    r = scorer.score(rows.where("doc_id >= 200")).agg(F.avg(F.when(F.col("label"), F.col("score"))).alias("yes"), F.avg(F.when(~F.col("label"), F.col("score"))).alias("no")).first()
    assert r["yes"] > r["no"] + 0.25


def test_noise_and_styles(spark):
    from tessera.operators import corpus

    df = spark.createDataFrame([(1, "# Head\n3. one\n  4) two\nsome words that go on for a while and must be wrapped somewhere", 1)], "doc_id long, text string, u int")
    r = df.select(*(augment.header_styles(F.col("text"), F.lit(k)).alias(f"h{k}") for k in range(4)), augment.renumber(F.col("text"), F.lit(6)).alias("n"), augment.noisy_wrap(F.col("text"), 20).alias("w")).first()
    assert [r[f"h{k}"].split("\n")[:2] for k in range(4)] == [["Head", "3. one"], ["Head", "===="], ["HEAD", "3. one"], ["1. Head", "3. one"]]
    assert "7. one\n  7) two" in r["n"] and bare(r["w"]) == bare(df.first()["text"]) and max(map(len, r["w"].split("\n"))) <= 20
    pages = augment.noisy_pages(spark.createDataFrame([(1, "line of text\n" * 30)], "doc_id long, text string"), 100).first()["text"]
    assert pages.count("\f") == 4 and "- 1 -" in pages and "- 4 -" in pages and pages.replace("\f", "").count("line of text\n") == 30
    legal = corpus.legal_sections(spark.createDataFrame([(1, "\n\n".join(["x" * 500] * 9)), (2, "short text")], "doc_id long, text string")).collect()
    assert [(r["doc_id"], len(r["text"])) for r in sorted(legal, key=lambda r: (r["doc_id"], r["section_no"]))] == [(1, 2006), (1, 2006), (1, 500), (2, 10)]


def test_greedy_matching(spark):
    docs = frame(spark, ["a", "b", "c"])
    pts = lambda rows: spark.createDataFrame(rows, "doc_id long, pos long")
    got = {r["doc_id"]: r for r in metrics.boundary_prf(pts([(0, 10), (0, 12), (0, 50), (1, 5)]), pts([(0, 11), (0, 13), (0, 90)]), docs).collect()}
    assert (got[0]["tp"], got[1]["f1"], got[2]["f1"]) == (2, 0.0, 1.0)


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name, t in (("b.txt", QA), ("a.txt", PROSE), ("c.txt", "  ")):
        (tmp_path / "in" / name).write_text(t)
    docs = readers.read_text(spark, str(tmp_path / "in"))
    assert sorted(r["name"] for r in docs.collect()) == ["a.txt", "b.txt"]
    chunks = SegmentEngine().chunk(docs)
    assert readers.as_json_array(chunks).count() == 2 and readers.as_separated(chunks).first()["text"].endswith("\n---\n")
    readers.write_jsonl(synth.corpus(spark.range(20).withColumnRenamed("id", "doc_id")).drop("lang").withColumn("doc_id", F.col("doc_id") * 7), str(tmp_path / "out"))
    back = readers.read_jsonl(spark, str(tmp_path / "out"), str(tmp_path / "missing"))
    assert sorted(r["doc_id"] for r in back.collect()) == list(range(20)) and back.first()["lang"] == "pt"
    readers.write_chunk_dump(chunks, str(tmp_path / "dump"))
    marks = readers.as_boundary_lines(SegmentEngine().boundaries(docs), docs)
    assert marks.columns == ["doc_id", "pos", "line"]


def test_stream_gives_the_batch_rows(spark, tmp_path):
    from tessera.streaming.chunks import chunk_stream

    docs = frame(spark, [PROSE, QA, MARKDOWN])
    src, sink = str(tmp_path / "src"), str(tmp_path / "sink")
    docs.write.parquet(src)
    chunk_stream(spark, src, "doc_id long, text string", sink, str(tmp_path / "cp")).awaitTermination(120)
    a = sorted(map(tuple, spark.read.parquet(sink).select("doc_id", "chunk_no", "text").collect()))
    assert a == sorted(map(tuple, SegmentEngine().chunk(docs).select("doc_id", "chunk_no", "text").collect()))


def test_command_line(spark, tmp_path, capsys):
    from tessera.cli import main

    (tmp_path / "a.txt").write_text(QA)
    main([str(tmp_path / "a.txt"), "--min-chunk-chars", "5"])
    assert "What is it?" in capsys.readouterr().out
    main([str(tmp_path / "a.txt"), "--json"])
    assert capsys.readouterr().out.startswith("[")
