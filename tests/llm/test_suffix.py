"""Repeated strings against all windows in a dictionary, and suffix order against sorting."""

import hashlib
import random

import numpy as np
import pytest
from test_contracts import docs_of, got, read_docs

from tessera.llm import queries, suffix


def brute(rows, length, first_stays=False):
    """rows: (doc_id, text) in order of place: (removed runs, kept) of each."""
    seen, counts = set(), {}
    raws = [(t or "").encode() for _, t in rows]
    for raw in raws:
        for i in range(len(raw) - length + 1):
            w = hash(raw[i : i + length])
            counts[w] = counts.get(w, 0) + 1
    out = []
    for raw in raws:
        cover = np.zeros(len(raw) + 1, np.int64)
        for i in range(len(raw) - length + 1):
            w = hash(raw[i : i + length])
            if (w in seen) if first_stays else counts[w] > 1:
                cover[i] += 1
                cover[i + length] -= 1
            seen.add(w)
        gone = np.cumsum(cover)[:-1] > 0
        lo, hi = suffix.runs_of(gone)
        out.append((list(zip(lo.tolist(), hi.tolist())), bytes(np.frombuffer(raw, np.uint8)[~gone])))
    return out


def compare(df, rows, length, keep="none"):
    out = suffix.dedup(df.sparkSession, df, length, keep).collect()
    have = sorted(((r["doc_id"], r["n_bytes"], [(x["start"], x["end"]) for x in r["removed"]], bytes(r["kept"])) for r in out), key=repr)
    want = sorted(((d, len((t or "").encode()), runs, kept) for (d, t), (runs, kept) in zip(rows, brute(rows, length, keep == "first"))), key=repr)
    assert have == want
    return have


def made(seed, n=120):
    """Documents with passages that many share, near copies, copies, short periods and text of their own."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(r.randint(1, 7)))
    say = lambda k: " ".join(word() for _ in range(k))
    shared = [say(k) for k in (10, 18, 25, 60, 150)]
    base = say(200)
    out = []
    for k in range(n):
        kind = r.random()
        if kind < 0.3:
            cut = base.split(" ")
            for _ in range(r.randint(0, 4)):
                cut[r.randrange(len(cut))] = word()
            out.append(" ".join(cut))
        elif kind < 0.8:
            out.append(say(r.randint(0, 40)) + r.choice(shared) + say(r.randint(0, 40)) + r.choice(shared)[r.randint(0, 20) :] + say(5))
        elif kind < 0.9:
            out.append(word() * r.randint(1, 300))
        else:
            out.append(out[r.randrange(len(out))] if out else "")
    return out


@pytest.mark.parametrize("crowd", [200, 3, 0])
@pytest.mark.parametrize("keep", ["none", "first"])
def test_repeats(spark, monkeypatch, crowd, keep):
    monkeypatch.setattr(suffix, "CROWD", crowd)
    texts = made(crowd)
    df, rows = docs_of(spark, texts)
    have = compare(df, [r[:2] for r in rows], 64, keep)
    assert any(x[2] for x in have) and any(not x[2] for x in have)


def test_long_texts_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(suffix, "PIECE", 700)
    monkeypatch.setattr(suffix, "BATCH", 500)
    r = random.Random(3)
    long = "".join(r.choice("abcdefgh ") for _ in range(9_000))
    texts = [long, "x" + long[1000:3000] + "y" + long[2500:4000], long[8000:], "a" * 5000, "ab" * 2000, long[:50], None, ""]
    df, rows = docs_of(spark, texts)
    compare(df, [r[:2] for r in rows], 100)
    compare(df, [r[:2] for r in rows], 100, "first")


def test_repeated_rows_and_nulls(spark):
    r = random.Random(4)
    one = "".join(r.choice("abcdefgh ") for _ in range(500))
    rows = [(1, one, "s"), (1, one, "s"), (None, one[:300], "t"), (2, one[400:] + one[:10], None), (2, None, None), (None, None, None), (3, "é" * 400, "u")]
    df = spark.createDataFrame(rows, "doc_id long, text string, key string").withColumnsRenamed({"key": "ctx"})
    compare(df, [x[:2] for x in rows], 80)
    assert suffix.dedup(spark, df.limit(0), 80).collect() == []
    with pytest.raises(ValueError):
        suffix.dedup(spark, df, 10)


@pytest.mark.parametrize("edge", [True, False])
def test_query(spark, tiny, edge, monkeypatch):
    df, rows = docs_of(spark) if edge else read_docs(spark, tiny)
    monkeypatch.setattr(queries, "table", lambda *a: df)
    out = queries.op12_suffix_dedup(spark, tiny)
    want = [(r[0], len((r[1] or "").encode()), sum(b - a for a, b in runs), len(runs), hashlib.sha256(kept).hexdigest()) for r, (runs, kept) in zip(rows, brute([r[:2] for r in rows], 400))]
    assert got(out, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == sorted(want, key=repr)


@pytest.mark.parametrize("length", [64, 100, 400])
def test_factors(length):
    r = random.Random(length)
    part = [r.randbytes(150) + b"\0" * 40 for _ in range(4)]
    data = b"".join(r.choice(part)[r.randrange(30) :] for _ in range(14)) + b"\0" * 500
    at = sorted(r.sample(range(len(data) - length), 600))
    before, after = suffix.factors(np.frombuffer(data, np.uint8), np.array(at), length, True)
    same = lambda i, j: next((k for k in range(length) if data[i + k] != data[j + k]), length)
    for k in range(0, 600, 7):
        assert before[k] == max((same(at[k], j) for j in at[:k]), default=0)
        assert after[k] == max((same(at[k], j) for j in at[k + 1 :]), default=0)


def test_nearest_smaller():
    r = random.Random(1)
    for values in ([], [3], list(range(50)), list(range(50, 0, -1)), r.sample(range(1000), 300)):
        want = [next((j for j in range(i - 1, -1, -1) if values[j] < v), -1) for i, v in enumerate(values)]
        assert suffix.nearest_smaller(np.array(values, np.int64)).tolist() == want
