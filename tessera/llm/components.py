"""Connected components of an edge table, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch


def connected_components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """edges(a, b): of one type that Spark orders. Returns (node, comp): comp is the smallest node reachable; nodes without an
    edge to another are absent.

    Each round every node points to its smallest neighbour (an aggregate with map-side combining, so that a node with very
    many edges costs a row a task), pointers are followed to their roots by doubling, and the edges are drawn between
    roots. A root that still has edges has at least one neighbour, so each round at least halves the number of nodes.
    Every table is written to the shared folder. Null ends, loops and repeated edges are ignored; an empty table gives an
    empty result.
    """
    s = Scratch(spark)
    left = s.table(edges.where("a is not null and b is not null and a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges0")
    label, n = None, 0
    while not left.isEmpty():
        n += 1
        both = left.union(left.select("b", "a")).toDF("node", "other")
        up = both.groupBy("node").agg(F.min("other").alias("other")).select("node", F.least("node", "other").alias("up"))
        up = s.table(up, f"up{n}.0")
        step = 0
        while True:
            top = up.select(F.col("node").alias("up"), F.col("up").alias("upper"))
            jumped = up.join(top, "up").select("node", F.col("upper").alias("up"), (F.col("upper") != F.col("up")).alias("moved"))
            step += 1
            jumped = s.table(jumped, f"up{n}.{step}")
            s.drop(f"up{n}.{step - 1}")
            moved = not jumped.where("moved").isEmpty()
            up = jumped.select("node", "up")
            if not moved:
                break
        a, b = up.toDF("a", "ra"), up.toDF("b", "rb")
        nxt = left.join(a, "a").join(b, "b").where("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct()
        nxt = s.table(nxt, f"edges{n}")
        s.drop(f"edges{n - 1}")
        left = nxt
        if label is None:
            label = s.table(up.toDF("node", "comp"), f"label{n}")
        else:
            moved_label = label.join(up.toDF("comp", "top"), "comp", "left").select("node", F.coalesce("top", "comp").alias("comp"))
            label = s.table(moved_label, f"label{n}")
            s.drop(f"label{n - 1}")
        s.drop(f"up{n}.{step}")
    s.drop(f"edges{n}")
    if label is None:
        kind = edges.schema["a"].dataType.simpleString()
        return spark.createDataFrame([], f"node {kind}, comp {kind}")
    return label
