"""The audit against a plain restatement, over edge cases and ties."""

import re
from collections import Counter, defaultdict

import pytest
from test_contracts import docs_of, got, read_docs

from tessera.llm import divergence, queries

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def brute(rows, min_docs=30, top=50):
    counts, seen, groups = defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        terms = TERM.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
        groups.add((lang, source))
        counts[lang, source].update(terms)
        seen[lang].update(set(terms))
    out = []
    for lang in {g[0] for g in groups}:
        kept = sorted(t for t, n in seen[lang].items() if n >= min_docs)
        v = len(kept)
        own = sorted(s for g, s in groups if g == lang)
        share = {}
        for s in (*own, None):
            n = {t: sum(counts[lang, x][t] for x in own) if s is None else counts[lang, s][t] for t in kept}
            total = sum(n.values())
            share[s] = {t: 1 + 1_000_000_000 * (n[t] + 5) // (total + 5 * v) for t in kept}
        for s in own:
            pairs = [(sum(abs(share[s][t] - share[o][t]) for t in kept), o) for o in own if o != s]
            terms = [(share[s][t] - share[None][t], t) for t in kept if counts[lang, s][t] and share[s][t] > share[None][t]]
            for part, found, most in (("pair", pairs, len(pairs)), ("term", terms, top)):
                ranked = sorted(found, key=lambda x: (-x[0], x[1].encode()))[:most]
                out += [(lang, s, part, item, value, k + 1) for k, (value, item) in enumerate(ranked)]
    return sorted(out, key=repr)


COLS = ("lang", "source", "part", "item", "value", "rank")


def test_audit_of_edges(spark):
    words = "Apple apple ÉCLAIR éclair don't x_y foo1bar İ straße 日本 🎉 tie tied".split()
    rows = [(" ".join(words[k % 13 : k % 13 + 1 + k % 5] * (1 + k % 3)), ["en", "de", None, ""][k % 4], ["b", "a", None, "é", "Z"][k % 5]) for k in range(70)]
    rows += [(None, "en", "only null"), ("", "en", "empty"), ("123 !?", "xx", "no terms"), ("", "xx", "more"), ("rare words here", "yy", "s"), ("apple", "en", "b"), ("apple", "en", "b")]
    df = spark.createDataFrame(rows, "text string, lang string, source string").selectExpr("1L as doc_id", "*", "'t' as term", "2 as n", "3 as docs", "4 as p", "5 as rank", "6 as salt").repartition(3)
    for min_docs, top in ((2, 3), (4, 50), (1000, 5)):
        assert got(divergence.audit(spark, df, min_docs, top), *COLS) == brute(rows, min_docs, top)
    assert divergence.audit(spark, df.limit(0)).collect() == []


@pytest.mark.parametrize("edge", [True, False])
def test_query(spark, tiny, edge, monkeypatch):
    df, _ = docs_of(spark) if edge else read_docs(spark, tiny)
    monkeypatch.setattr(queries, "table", lambda *a: df)
    rows = [tuple(r) for r in df.select("text", "lang", "source").collect()]
    assert got(queries.op11_divergence(spark, tiny), *COLS) == brute(rows)


def test_shares_beyond_64_bits(spark):
    from pyspark.sql import functions as F

    big = 9 * 10**17
    df = spark.createDataFrame([(big, big + 1, 3), (0, 7, 1), (12, 10**18, 999)], "n long, total long, kinds long")
    have = [r["p"] for r in df.select(divergence.share(F.col("n"), F.col("total"), F.col("kinds")).alias("p")).collect()]
    assert have == [1 + 1_000_000_000 * (n + 5) // (t + 5 * k) for n, t, k in ((big, big + 1, 3), (0, 7, 1), (12, 10**18, 999))]
