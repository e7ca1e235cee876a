"""Plans over the engine: the sweep against one run for each setting."""

import pytest
from pyspark.sql import functions as F
from test_core import MARKDOWN, PROSE, QA

from tessera import registry
from tessera.config import ChunkerConfig
from tessera.operators import metrics, scoring
from tessera.plans import sweep
from tessera.plans.segment import SegmentEngine


@pytest.fixture
def texts(spark):
    body = [PROSE, QA, MARKDOWN, PROSE * 9, "", None, "one\r\ntwo\r\n\r\n# three\r\n" + PROSE, "a\nb\nc\nd\ne"]
    return spark.createDataFrame(list(enumerate(body)), "doc_id long, text string")


def test_sweep_equals_single_runs(spark, texts):
    grid = ((0.3, 0.6), (40, 120), (0.0,))
    got = {(r["setting"], r["doc_id"]): r["bounds"] for r in sweep.boundaries(SegmentEngine(), texts, grid).collect()}
    for k, (big, least, _) in enumerate(sweep.settings_of(grid)):
        rows = SegmentEngine(ChunkerConfig(big, big, min_chunk_chars=least)).boundaries(texts).collect()
        want = {}
        for r in rows:
            want.setdefault(r["doc_id"], []).append(r["pos"])
        # A document's first chunk may start behind white space: boundaries() counts from the second.
        assert {d: sorted(want.get(d, [])) for (s, d) in got if s == k} == {d: b for (s, d), b in got.items() if s == k}


def test_sweep_scores_once(spark, texts):
    df = sweep.boundaries(SegmentEngine(), texts, beside=registry.SIMPLE)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInPandas") == 1
    assert df.select("setting").distinct().count() == len(sweep.settings_of()) == 24


def test_sweep_report(spark):
    f1 = spark.createDataFrame([(0, "a", 1.0), (0, "a", 0.0), (0, "b", 0.9), (1, "a", 0.7), (1, "b", 0.6), (1, "real", 0.9), (0, "real", 0.1)], "setting int, bucket string, f1 double")
    rows = {r["setting"]: r for r in sweep.report(spark, f1, [(0.1,), (0.2,)], ("big",), worst=2, apart="real").collect()}
    assert abs(rows[0]["macro_f1"] - 0.7) < 1e-9 and abs(rows[1]["macro_f1"] - 0.65) < 1e-9
    assert rows[1]["best"] and not rows[0]["best"] and rows[0]["weakest"] is None
    assert [(x["bucket"], x["f1"]) for x in rows[1]["weakest"]] == [("b", 0.6), ("a", 0.7)]


def test_functions_and_views_in_sql(spark, texts):
    from tessera.functions.predicates import ALL
    from tessera.operators import lines
    from tessera.plans import sql

    made = sql.register(spark)
    assert len(made) == len(sql.TEXT) + len(ALL)
    rows = lines.split_lines(texts)
    rows.createOrReplaceTempView("some_lines")
    want = rows.select(*(F.count_if(p.spark()).alias(n) for n, p in ALL.items()), F.md5(F.concat_ws("|", F.sort_array(F.collect_list(sql.TEXT["line_shape"](F.col("seg")))))).alias("shapes")).first()
    have = spark.sql("SELECT " + ", ".join(f"count_if(line_is_{n}(seg)) AS {n}" for n in ALL) + ", md5(concat_ws('|', sort_array(collect_list(line_shape(seg))))) AS shapes FROM some_lines").first()
    assert have == want and have["hash"] > 0 and have["ends_sent"] > 0
    texts.createOrReplaceTempView("some_texts")
    got = spark.sql("SELECT normalize_text(text) AS n, strip_text(text) AS s FROM some_texts WHERE doc_id = 6").first()
    assert "\r" not in got["n"] and got["s"].startswith("one")
    sql.chunk_view(spark, "some_texts", "some_chunks")
    rows = spark.sql("SELECT * FROM some_chunks WHERE doc_id < 3").collect()
    assert sorted(rows) == sorted(SegmentEngine().chunk(texts).where("doc_id < 3").collect()) and rows
