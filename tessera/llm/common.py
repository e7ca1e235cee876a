"""What the operators share: the shared folder, tables that cut lineage, files on any store, and Arrow buffers."""

from __future__ import annotations

import ctypes
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.session import small_batches  # noqa: F401


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Unset, a temporary folder of this machine where Spark
    runs in one process on it (tests), and an error elsewhere."""
    held = spark.conf.get("spark.checkpoint.dir", None)
    if not held:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir names no folder that all executors share")
        held = "file://" + tempfile.mkdtemp(prefix="tessera-shared-")
        spark.conf.set("spark.checkpoint.dir", held)
    return held.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/tessera-{name}-{uuid.uuid4().hex}"


def drop_path(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


#: The scratch tables that are kept, in the order in which they were made.
_kept: list[str] = []


def scratch_mark() -> int:
    return len(_kept)


def drop_scratch(spark: SparkSession, mark: int) -> None:
    """Drops the scratch tables made since the mark: for callers who have written what was read from them."""
    for path in _kept[mark:]:
        drop_path(spark, path)
    del _kept[mark:]


class Scratch:
    """Tables written to the shared folder. They cut lineage, survive lost executors, and count as disk until dropped."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.paths: dict[str, str] = {}

    def table(self, df: DataFrame, name: str) -> DataFrame:
        path = new_path(self.spark, name)
        schema = df.schema
        df.write.parquet(path)
        self.paths[name] = path
        _kept.append(path)
        return self.spark.read.schema(schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            path = self.paths.pop(name)
            drop_path(self.spark, path)
            _kept.remove(path)

    def keep(self, *names: str) -> None:
        """Drops all tables but these, on which a result still depends."""
        self.drop(*(set(self.paths) - set(names)))


def give_back() -> None:
    """Workers are used again by later stages: hands memory that is free back to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    """A file system for a URI, and the path on it: file, S3, GCS or HDFS."""
    if "://" not in uri:
        if uri.startswith("file:"):
            uri = uri[len("file:") :]
        return pafs.LocalFileSystem(), uri
    return pafs.FileSystem.from_uri(uri.replace("s3a://", "s3://"))


def utf8(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its row offsets, without a copy; a null row is empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("")
    wide = pa.types.is_large_string(col.type)
    _, offsets, data = col.buffers()
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw[off[0] : off[-1]] if len(off) else raw, off - (off[0] if len(off) else 0)


def numbered(s: Scratch, df: DataFrame, keys: list[str], name: str) -> tuple[DataFrame, DataFrame]:
    """A table of df's rows, dealt by range of keys and in their order, with _part and _at, the place in the part; and of each
    part _part, n and _before, the rows of all parts before it. A row for each part is small, so they may be broadcast
    and summed in one task."""
    laid = df.repartitionByRange(partitions(s.spark), *keys).sortWithinPartitions(*keys).withColumn("_id", F.monotonically_increasing_id())
    laid = s.table(laid.withColumns({"_part": F.shiftright("_id", 33), "_at": F.col("_id").bitwiseAND((1 << 33) - 1)}).drop("_id"), name)
    parts = laid.groupBy("_part").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    return laid, parts.withColumn("_before", F.coalesce(before, F.lit(0)))


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def texts(col: pa.Array) -> list[bytes]:
    """The rows of a string column as bytes; a null row is empty."""
    data, off = utf8(col)
    view = data.tobytes()
    return [view[a:b] for a, b in zip(off[:-1].tolist(), off[1:].tolist())]
