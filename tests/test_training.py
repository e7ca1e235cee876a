"""Training: gradients by finite differences, sums over partitions, and a network that beats the linear scorer."""

import numpy as np
from pyspark.sql import functions as F

from tessera import registry
from tessera.operators import chars, labels, lines, scoring, training
from tessera.plans.segment import engine_of


def test_gradient_by_differences():
    rng = np.random.default_rng(1)
    layers = [(w.astype(np.float64), b) for w, b in training.fresh((5, 4, 3, 1), 2)]
    x, y = rng.normal(size=(7, 5)), np.array([1, 0, 0, 1, 0, 1, 0.0])
    g, loss, n = training.gradient(layers, x, y, 3.0)
    assert n == 3 * 3 + 4
    v = training.flat(layers)
    for k in range(0, len(v), 3):
        d = np.zeros_like(v)
        d[k] = 1e-4
        up, down = (training.gradient([(w.astype(np.float64), b.astype(np.float64)) for w, b in training.shaped(v + s * d, layers)], x, y, 3.0)[1] for s in (1, -1))
        assert abs((up - down) / 2e-4 - g[k]) < 0.02 * max(1, abs(g[k]))


def test_sums_do_not_depend_on_partitions(spark):
    rng = np.random.default_rng(3)
    rows = [(rng.normal(size=6).tolist(), float(k % 3 == 0)) for k in range(200)]
    df = spark.createDataFrame(rows, "x array<float>, y double")
    layers = training.fresh((6, 5, 1))
    a, b = (training.summed(spark, df.repartition(n), layers, 2.0) for n in (1, 70))
    assert np.allclose(a[0], b[0], atol=1e-6) and abs(a[1] - b[1]) < 1e-6


def test_threshold_by_counts(spark):
    df = spark.createDataFrame([(0.9, 1.0), (0.8, 1.0), (0.7, 0.0), (0.2, 1.0), (0.1, 0.0), (1.0, 1.0)], "score double, y double")
    t, f1 = training.f1_by_threshold(df)
    assert 0.1 < t <= 0.2 and abs(f1 - 2 * 4 / (5 + 4)) < 1e-9


def test_a_network_beats_the_linear_scorer(spark, tiny, tmp_path):
    docs = labels.hash_split(registry.synthetic(spark, tiny).select("doc_id", "text", "boundaries"), 0.25)
    docs.write.parquet(f"{tmp_path}/docs")
    docs = spark.read.parquet(f"{tmp_path}/docs")
    old, new = (docs.where(c).drop("held_out") for c in ("held_out", "not held_out"))
    training.line_rows(new).write.parquet(f"{tmp_path}/new")
    training.line_rows(old).write.parquet(f"{tmp_path}/old")
    rows, held = spark.read.parquet(f"{tmp_path}/new"), spark.read.parquet(f"{tmp_path}/old")
    assert held.select("doc_id").distinct().join(rows, "doc_id").count() == 0
    done = training.train(spark, rows, held, f"{tmp_path}/dealt", epochs=6, steps=3)
    assert done.losses[-1] < 0.6 * done.losses[0]
    marks = old.select("doc_id", F.explode("boundaries").alias("pos"))
    plain = labels.line_labels(scoring.LinearScorer().score(lines.features(old)), marks).select("score", F.col("label").cast("double").alias("y"))
    assert done.f1 > training.f1_by_threshold(plain)[1] + 0.02
    done.save(f"{tmp_path}/lines.npz")
    with np.load(f"{tmp_path}/lines.npz") as z:
        assert abs(float(z["threshold"]) - done.threshold) < 1e-9 and str(z["SCHEMA"]) == chars.schema_digest()
    engine = engine_of(line_weights=f"{tmp_path}/lines.npz")
    assert engine.chunk(old.select("doc_id", "text")).count() > old.count()
