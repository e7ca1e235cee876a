"""Edits and labels against a walk over characters that carry their labels along."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import edits


def walked(text, bounds, changes):
    """changes: (pos, lost, added, stays) in order."""
    out, marks, at = [], [], {}
    for pos, lost, added, stays in changes:
        at[pos] = (lost, added, stays)
    i = n = 0
    while i <= len(text):
        if i in at and not at[i][2]:
            lost, added, _ = at[i]
            if i in bounds:
                marks.append(n + len(added) - 0 if lost == 0 else n + len(added) - lost)
            out.append(added)
            n += len(added)
            for j in range(i + 1, i + lost):
                if j in bounds:
                    marks.append(n)
            i += lost
            if lost == 0:
                if i < len(text):
                    out.append(text[i])
                n, i = n + 1, i + 1
            continue
        if i in bounds:
            marks.append(n)
        if i in at:
            lost, added, _ = at[i]
            out.append(added)
            n += len(added)
            for j in range(i + 1, i + lost):
                if j in bounds:
                    marks.append(n)
            i += lost
            if lost:
                continue
        if i < len(text):
            out.append(text[i])
        n, i = n + 1, i + 1
    new = "".join(out)
    return new, sorted({b for b in marks if 0 < b < len(new)})


@pytest.mark.parametrize("stays", [True, False])
def test_edits_move_labels(spark, stays):
    r = random.Random(7)
    docs, rows, want = [], [], {}
    for d in range(60):
        text = "".join(r.choice("ab é\n🎉") for _ in range(r.randint(1, 50)))
        bounds = sorted(r.sample(range(len(text) + 1), r.randint(0, min(6, len(text)))))
        changes, i = [], 0
        while i < len(text) and r.random() < 0.9:
            i += r.randint(0, 6)
            if i > len(text):
                break
            lost = r.randint(0, min(3, len(text) - i)) if stays else r.choice([0, 0, 1]) * (i < len(text))
            added = "".join(r.choice("XY🎉") for _ in range(r.randint(0, 3) if not (lost == 1 and not stays) else 1))
            changes.append((i, lost, added, stays))
            i += lost + 1
        docs.append((d, text, bounds, "s"))
        rows += [(d, *c) for c in changes]
        want[d] = walked(text, set(bounds), changes)
    a = spark.createDataFrame(docs, "doc_id long, text string, boundaries array<long>, source string")
    e = spark.createDataFrame(rows, "doc_id long, pos long, lost long, added string, stays boolean")
    got = {x["doc_id"]: (x["text"], x["boundaries"]) for x in edits.apply(a.repartition(3), e).collect()}
    assert got == want


def test_wrap_keeps_words_and_units(spark):
    words = "some words of several lengths that are wrapped, with numbers 12 and long ones like characterisation".split()
    r = random.Random(1)
    units = [" ".join(r.choice(words) for _ in range(r.randint(1, 40))) + "\n\n" for _ in range(12)]
    bounds = [sum(map(len, units[: k + 1])) for k in range(11)]
    df = spark.createDataFrame([(1, "".join(units), bounds, "x"), (2, None, [], "x"), (3, "", [], "x"), (4, "one", [], "x")], "doc_id long, text string, boundaries array<long>, source string")
    out = {x["doc_id"]: x for x in edits.apply(df, edits.wrapped(df, 40)).collect()}
    text, cuts = out[1]["text"], [0, *out[1]["boundaries"], len(out[1]["text"])]
    assert [text[a:b].split() for a, b in zip(cuts, cuts[1:])] == [u.split() for u in units]
    assert max(len(x) for x in text.split("\n")) <= 41 and out[2]["text"] is None and out[4]["text"] == "one"
    noisy = {x["doc_id"]: x for x in edits.noisy_corpus(df).collect()}
    assert set(noisy) == {1} and len(noisy[1]["boundaries"]) == 11 and noisy[1]["source"] == "noisy_x"
    rest = edits.apply(df, edits.page_marks(df, 300)).where("doc_id = 1").select("text", F.size("boundaries").alias("n")).first()
    assert rest["n"] == 11 and rest["text"].count("\f") == len("".join(units)) // 300 or rest["text"].count("\f") >= 2


def test_edits_come_from_one_walk_of_a_text(spark):
    """Words cut by boundaries, white space of several kinds, nulls: breaks, marks and words as a plain walk finds them."""
    import re

    r = random.Random(3)
    docs = [(d, "".join(r.choice(["word", "überlang", "a", " ", "  ", "\n", "\t", "🎉", "characterisation"]) for _ in range(r.randint(1, 120)))) for d in range(40)]
    docs = [(d, t, sorted(r.sample(range(len(t) + 1), min(4, len(t))))) for d, t in docs]
    df = spark.createDataFrame([*docs, (98, None, [1]), (99, "some words", None)], "doc_id long, text string, boundaries array<long>")
    breaks, words, marks = set(), set(), set()
    for d, text, bounds in docs:
        cuts = [0, *(b for b in bounds if 0 < b < len(text)), len(text)]
        for a, b in zip(cuts, cuts[1:]):
            held = -1
            for m in re.finditer(r"(\s*)\S+", text[a:b]):
                n = len(m.group())
                opens = held < 0 or held + n > 20
                if opens and held >= 0:
                    breaks.add((d, a + m.start(), len(m.group(1))))
                held = n if opens else held + n
        words |= {(d, m.start() + 3) for m in re.finditer(r"\S+", text) if re.fullmatch(r"[^\W\d_]{7,}", m.group()) and (d * 7919 + m.start() * 104_729) % 2 == 0}
        pages = {}
        for m in re.finditer("\n", text):
            pages.setdefault(m.end() // 50, m.end())
        marks |= {(d, p, f"- {no} -\n\f\n") for no, p in pages.items() if no}
    assert {(x.doc_id, x.pos, x.lost) for x in edits.wrapped(df, 20).collect()} == breaks
    assert {(x.doc_id, x.pos) for x in edits.mangled_words(df, 2).collect()} == words
    assert {(x.doc_id, x.pos, x.added) for x in edits.page_marks(df, 50).collect()} == marks


def test_edits_need_no_shuffle(spark):
    """Noise is made where a text lies: nothing of a word or line is dealt out, so the work grows as the texts do."""
    df = spark.createDataFrame([(1, "some words " * 60, [300], "x")], "doc_id long, text string, boundaries array<long>, source string")
    plan = edits.noisy_corpus(df)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" not in plan
