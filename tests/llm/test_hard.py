"""Rows that are large or many: each in seconds, since the work on one row grows with its length only."""

import time

import brute
import pytest
from pyspark.sql import functions as F

from tessera.llm import jaccard, linededup, pii, quality, tokencount, urlfilter, warc


@pytest.fixture
def within():
    began = time.monotonic()
    yield
    assert time.monotonic() - began < 90


def docs(spark, *texts):
    return spark.createDataFrame([(k, t, f"s{k}") for k, t in enumerate(texts)], "doc_id long, text string, source string")


def test_long_white_space_and_many_boilerplate_lines(spark, within):
    pad = " \t" * 500_000
    many = "\n".join(f"shared {k}" for k in range(100_000))
    texts = [f"x{pad}y\n{pad}shared 7{pad}\n{pad}"] + [f"own {k}\n{many}\n\nlast {k}" for k in range(5)]
    out = {r["doc_id"]: r for r in linededup.dedup(spark, docs(spark, *texts)).collect()}
    assert out[0]["text"] == f"x{pad}y\n{pad}" and (out[0]["n_lines"], out[0]["n_removed"]) == (2, 1)
    assert all(out[k + 1]["text"] == f"own {k}\n\nlast {k}" and out[k + 1]["n_removed"] == 100_000 for k in range(5))


def test_many_matches(spark, within):
    mails = " ".join(f"é🎉{k}@mail.example.com" for k in range(50_000))
    ibans = " ".join(["DE89 3704 0044 0532 0130 00"] * 20_000)
    df = docs(spark, mails, ibans)
    rows = {r["doc_id"]: r for r in pii.report(pii.find(df)).collect()}
    n_email, *_ = brute.pii(mails)[0]
    assert (rows[0]["n_email"], rows[0]["base_sha256"]) == (n_email, brute.pii(mails)[1]) and n_email == 50_000
    assert rows[1]["spans"].count("iban:") == 20_000 and rows[0]["n_spans"] == 50_000
    text = {r["doc_id"]: r["text"] for r in pii.redact(df).collect()}
    assert text[0] == " ".join(["é🎉[email]"] * 50_000) and text[1] == " ".join(["[iban]"] * 20_000)


def test_redact_keeps_rows(spark):
    rows = [(1, "a@b.cc x"), (1, "no"), (1, "a@b.cc x"), (None, "mail a@b.cc"), (2, None), (3, "")]
    out = pii.redact(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = [(1, "[email] x"), (1, "no"), (1, "[email] x"), (None, "mail [email]"), (2, None), (3, "")]
    assert sorted(map(tuple, out), key=repr) == sorted(want, key=repr)


def test_redact_across_blocks(spark, monkeypatch):
    monkeypatch.setattr(pii, "BLOCK", 7)
    monkeypatch.setattr(pii, "FOLD", 2)
    texts = ["é🎉 " * k + " ".join(f"u{j}@mail.example.com, +1 (555) 123-45{j:02d}" for j in range(k)) + "🎉" * k for k in range(9)]
    out = {r["doc_id"]: r["text"] for r in pii.redact(docs(spark, *texts)).collect()}
    assert out == {k: "é🎉 " * k + " ".join(["[email], [phone]"] * k) + "🎉" * k for k in range(9)}


def test_unbroken_text(spark, within):
    pieces = [("▁", -2.0), ("a", -3.0), ("ab", -3.5), ("b", -4.0), ("abab", -5.0)]
    texts = ["ab" * 2_000_000 + "c" * 1000, "abab" * 40 + "c", ""]
    out = {r["doc_id"]: r["n_tokens"] for r in tokencount.count(spark, docs(spark, *texts), pieces).collect()}
    assert out == {0: 1 + 1_000_000 + 1, 1: 42, 2: 0}


def test_order_of_rules(spark):
    """Rules whose costs and rejections are planted: rejection per cost decides, and what rejects nothing comes last."""
    rows = [(k, f"{'yes' if k % 2 else 'no'} " + " ".join(f"w{k}_{j}" for j in range(200))) for k in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    busy = lambda n: sum((F.regexp_count("text", F.lit(f"[{c}-z0-9_]+ w")) for c in "abcdefghijklmnop"[:n]), F.lit(0)) >= 0
    odd = F.col("text").startswith("yes")
    rules = [quality.Rule("idle", busy(12) & F.lit(False)), quality.Rule("costly", busy(12) & odd), quality.Rule("cheap", odd)]
    assert [r.name for r in quality.order_rules(spark, df, rules)] == ["cheap", "costly", "idle"]
    assert len(quality.order_rules(spark, df.limit(0), rules)) == 3


def test_sample_is_of_survivors(spark):
    """What only documents that the base rules reject would fail doesn't count."""
    rows = [(k, "short !!!" if k % 2 else " ".join(f"w{j}" for j in range(50))) for k in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    rules = [quality.Rule("bang", F.col("text").contains("!")), quality.Rule("w7", F.col("text").contains("w7"))]
    assert [r.name for r in quality.order_rules(spark, df, rules)] == ["w7", "bang"]


def test_long_urls_and_hosts(spark, within):
    rows = [(0, "http://" + "a." * 2000 + "com/en/" + "x" * 200_000, "<link " + "x" * 1_000_000), (1, "http://com/en/?" + "&utm_a=1" * 10_000, '<link rel="canonical" href="' + "../" * 5000 + 'y">')]
    out = {r["page_id"]: r["verdict"] for r in urlfilter.filter_urls(spark, spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert out == {0: "block", 1: "block"}


def test_unclosed_tags(spark, within):
    """Tags that are never closed are read up to the next one."""
    pages = [(k, f"http://h.org/{k}", "canonical refresh " + tag * (1_000_000 // len(tag)) + more) for k, (tag, more) in enumerate([("<link ", ""), ("<meta ", ""), ("<base ", ""), ("<link rel=\"", "<link rel=canonical href='http://net/de/x'>"), ("<base href=' ", "")])]
    pages.append((9, "http://example.net/de/8/a", "<p>"))
    df = spark.createDataFrame(pages, "page_id long, url string, html string").selectExpr("page_id", "url", "html", "1 as node", "2 as host", "'c' as class_id")
    out = {r["page_id"]: r["verdict"] for r in urlfilter.filter_urls(spark, df).collect()}
    assert out == {**dict.fromkeys(range(5), "allow"), 9: "block"}


def test_records_of_repeated_and_missing_ids(spark):
    """Each record's payload is put together again from its identifier and chunk numbers."""
    big = "x" * (warc.CHUNK * 2 + 5)
    rows = [(1, "u", "one"), (1, "u", "two"), (1, "u", "two"), (None, "v", "three"), (None, None, "four"), (None, None, "four"), (2, "w", big), (3, "w", big), (3, "w", big)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("page_id", "url", "html", "'a' as digest", "'b' as refers_to", "1 as record_id", "2 as path").repartition(3)
    chunks = warc.read(spark, warc.write(spark, df)).collect()
    assert len({(r["record_id"], r["chunk_no"]) for r in chunks}) == len(chunks)
    whole = {}
    for r in sorted(chunks, key=lambda r: r["chunk_no"]):
        whole.setdefault((r["record_id"], r["page_id"], r["record_type"], r["refers_to"]), []).append(bytes(r["data"]))
    assert len(whole) == len(rows)
    have = sorted(((p, kind, to, b"".join(d).decode()) for (_, p, kind, to), d in whole.items()), key=repr)
    assert have == sorted([*((p, "response", None, h) for p, _, h in rows[:7]), (3, "revisit", 2, ""), (3, "revisit", 2, "")], key=repr)


@pytest.mark.parametrize("n", [1, 4, 8])
def test_ties_stay_the_same_however_dealt(spark, n):
    text = " ".join(f"w{k}" for k in range(20))
    df = spark.createDataFrame([(5, text, s, {"k": s}) for s in "hgfedcba"], "doc_id long, text string, source string, more map<string,string>")
    assert [r["source"] for r in jaccard.one_of_each(spark, df.repartition(n)).collect()] == ["a"]


def test_names_of_several_sets(spark, monkeypatch):
    """Different sets under one name are told apart by another."""
    texts = [" ".join(f"{c}{k}" for k in range(30)) for c in "abcdef"]
    df = spark.createDataFrame([(k, t) for k, t in enumerate([*texts, texts[0], texts[1] + " x"])], "doc_id long, text string")
    keyed = jaccard.keyed

    def narrow(seed):
        import pyarrow as pa

        def run(batches):
            for b in keyed(seed)(batches):
                yield b.set_column(3, "key", pa.array([None if k is None else 7 for k in b.column("key").to_pylist()], pa.int64()))

        return run

    from tessera.llm.common import Scratch

    s = Scratch(spark)
    known = s.table(df.selectExpr("doc_id", "0L as h", "text").mapInArrow(narrow(3), "doc_id long, h long, n long, key long, also long"), "known")
    assert jaccard.names_of_several(known) == {7}
    import numpy as np

    sets = [np.array([k, k + 9], np.uint64) for k in range(50)]
    shared = frozenset(jaccard.set_key(t) for t in sets[::2])
    names = [jaccard.name_of(t, shared) for t in sets]
    assert len(set(names)) == 50 and names[1] == jaccard.set_key(sets[1]) and names[0] == jaccard.other_key(sets[0])


def test_crowd_of_many_sizes(spark, monkeypatch):
    """A crowd of one passage and tails of many lengths, in blocks: only like sizes are compared, and no link is lost."""
    monkeypatch.setattr(jaccard, "BLOCK_SETS", 4)
    common = [f"c{k}" for k in range(400)]
    rows = []
    for k in range(120):
        size = 20 + 3 * k
        rows.append((k, " ".join(common[:size] + [f"t{k}-{j}" for j in range(size // 12 + k % 5)])))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = brute.jaccard(rows)
    assert sorted(map(tuple, jaccard.components(spark, df, rare=2, local=4).collect())) == sorted(want)
