"""Groups, links and counts of two tokenizers against a plain sweep over the libraries' own ids."""

import hashlib
from collections import Counter, defaultdict

import pytest
from test_contracts import TEXTS, docs_of, got, read_docs

from tessera.llm import crosstok, queries

ODD = [
    " lead", "tail ", "  two  spaces  ", "\nline\n\n  next\r\nlast\r", "tab\tbed\t \tx", "\n", " ", "   ", "nbsp\xa0here　and there x", "under▁score", "<s> </s> <unk> <0x41> <|endoftext|>",
    "emoji 🎉🎉 \u0000 nul \x1c fs\x85nel", "don't we'll I'm 'tis '' '", "日本語のテキスト と English", "é combining", "a" * 700 + " " + "b\n" * 50, "x = {\r\n\r\n};\r\n\t\treturn 12345678;",
]


def brute(texts):
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(queries.tokenizer_path(queries.BYTE_BPE))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=queries.tokenizer_path(queries.PIECES))
    letters = crosstok.byte_letters()
    pieces_a = {i: bytes(letters[c] for c in p) for p, i in a.get_vocab().items() if set(p) <= letters.keys()}
    docs = []
    for t in texts:
        whole = (" " + (t or "")).encode()
        ids_a, ids_b = (a.encode(" " + t, add_special_tokens=False).ids, b.encode(t)) if t else ([], [])
        bytes_a = [pieces_a[i] for i in ids_a]
        bytes_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
        if not t or b"".join(bytes_a) != whole or b"".join(bytes_b) != whole:
            docs.append(None)
            continue
        owner_a = [k for k, x in enumerate(bytes_a) for _ in x]
        owner_b = [k for k, x in enumerate(bytes_b) for _ in x]
        links = sorted(set(zip(owner_a, owner_b)))
        ends = set()
        at = 0
        for x in bytes_a:
            at += len(x)
            ends.add(at)
        groups, at, x, left = [], 0, [], list(zip(ids_a, bytes_a))
        common, at = [], 0
        for y in bytes_b:
            at += len(y)
            if at in ends:
                common.append(at)
        pos_a = pos_b = i = j = 0
        for c in common:
            ga, gb = [], []
            while pos_a < c:
                ga.append(ids_a[i])
                pos_a += len(bytes_a[i])
                i += 1
            while pos_b < c:
                gb.append(ids_b[j])
                pos_b += len(bytes_b[j])
                j += 1
            groups.append(",".join(map(str, ga)) + "|" + ",".join(map(str, gb)))
        docs.append((len(ids_a), len(ids_b), groups, [(ids_a[p], ids_b[q]) for p, q in links]))
    count = Counter(p for d in docs if d for p in set(d[3]))
    most = defaultdict(int)
    for (x, _), n in count.items():
        most[x] = max(most[x], n)
    out = []
    for d in docs:
        if d is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
        else:
            sha = hashlib.sha256(";".join(d[2]).encode()).hexdigest()
            out.append((d[0], d[1], len(d[2]), len(d[3]), sum(count[p] == most[p[0]] for p in d[3]), sum(count[p] for p in d[3]), sha))
    return out


COLS = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@pytest.mark.parametrize("edge", [True, False])
def test_alignment(spark, tiny, edge, monkeypatch):
    df, rows = docs_of(spark, [*TEXTS, *ODD, *ODD[:5]]) if edge else read_docs(spark, tiny)
    monkeypatch.setattr(queries, "table", lambda *x: df)
    want = [(r[0], *w) for r, w in zip(rows, brute([r[1] for r in rows]))]
    assert got(queries.op13_cross_tokenizer(spark, tiny), *COLS) == sorted(want, key=repr)


def test_small_runs_and_chunks(spark, tiny, monkeypatch):
    """Documents over many runs, sweeps and chunks."""
    for name, value in (("RUN", 40), ("SWEEP", 100), ("CHUNK", 300)):
        monkeypatch.setattr(crosstok, name, value)
    df, rows = docs_of(spark, [*TEXTS, *ODD])
    want = [(r[0], *w) for r, w in zip(rows, brute([r[1] for r in rows]))]
    paths = [queries.tokenizer_path(x) for x in (queries.BYTE_BPE, queries.PIECES)]
    assert got(crosstok.align(spark, df, *paths), *COLS) == sorted(want, key=repr)
    assert crosstok.align(spark, df.limit(0), *paths).collect() == []


def test_null_and_repeated_ids(spark):
    rows = [(None, "one two"), (None, "one two"), ("k", None), ("k", "one"), ("é", "")]
    df = spark.createDataFrame(rows, "doc_id string, text string").selectExpr("doc_id", "text", "1 as row", "2 as at", "'x' as codes")
    paths = [queries.tokenizer_path(x) for x in (queries.BYTE_BPE, queries.PIECES)]
    want = [(r[0], *w) for r, w in zip(rows, brute([r[1] for r in rows]))]
    assert got(crosstok.align(spark, df, *paths), *COLS) == sorted(want, key=repr)


def test_pairs_are_not_joined_by_list(spark, tiny):
    """Small lists name the same pairs many times: they get the counts back from the pair's own row, not by a join of their rows."""
    df, _ = read_docs(spark, tiny)
    paths = [queries.tokenizer_path(x) for x in (queries.BYTE_BPE, queries.PIECES)]
    plan = crosstok.align(spark, df.repartition(8), *paths)._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join " in line]
    assert joins and not any("code#" in line for line in joins)
