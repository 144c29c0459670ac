"""What several operators of this subpackage share: shared folders, written cuts of lineage, connected components."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a temporary one if driver and executors are one process, else an error."""
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if root is None:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = f"file://{tempfile.mkdtemp(prefix='driftglass-')}"
        sc.setCheckpointDir(root)
    return root.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder; Spark's file system deletes it when the driver ends."""
    path = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop_path)
    return path


def written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """``df`` written once as Parquet in the shared folder and read back, and its path."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back: lineage ends here, executors may come and go."""
    return written(df, name)[0]


def delete(spark: SparkSession, path: str) -> None:
    """Delete what ``shared_path`` named and nothing reads any more."""
    hadoop_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop_path, True)


def put_file(uri: str, data: bytes) -> None:
    """Write one file under ``uri``; repeated or speculative attempts replace it whole, never in part."""
    fs, path = pafs.FileSystem.from_uri(uri)
    fs.create_dir(os.path.dirname(path), recursive=True)
    attempt = f"{path}.{uuid.uuid4().hex}.tmp"
    with fs.open_output_stream(attempt) as out:
        out.write(data)
    fs.move(attempt, path)


def map_file(uri: str) -> np.ndarray:
    """The bytes of ``uri``: a memory map where the shared folder is a mounted path, else read whole. A missing file is an error."""
    fs, path = pafs.FileSystem.from_uri(uri)
    if isinstance(fs, pafs.LocalFileSystem):
        return np.memmap(path, dtype=np.uint8, mode="r")
    with fs.open_input_file(path) as remote:
        return np.frombuffer(remote.read_buffer(), np.uint8)


def slices(batch: pa.RecordBatch, text: str, rows: int = 256, size: int = 1 << 22):
    """A batch in slices of at most ``rows`` rows and, but for the last row of a slice, ``size`` bytes of ``text``, so that work on them is bounded."""
    column = batch.column(text)
    wide = np.cumsum(np.fromiter((x or 0 for x in pc.binary_length(column).to_pylist()), np.int64, batch.num_rows))
    at = done = 0
    while at < batch.num_rows:
        n = min(rows, int(np.searchsorted(wide[at : at + rows], done + size)) + 1, batch.num_rows - at)
        yield batch.slice(at, n)
        at += n
        done = int(wide[at - 1])


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (the splitmix64 constants), on unsigned arrays."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def local_roots(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """For nodes 0..n-1 linked left[i]-right[i], the smallest node of each node's component (min-label with pointer jumping)."""
    root = np.arange(n)
    while len(left):
        low = np.minimum(root[left], root[right])
        before = root.copy()
        np.minimum.at(root, root[left], low)
        np.minimum.at(root, root[right], low)
        np.minimum.at(root, left, low)
        np.minimum.at(root, right, low)
        root = root[root]
        if np.array_equal(before, root):
            break
    return root


def arrow_schema(ddl_fields: list[tuple[str, pa.DataType]]) -> pa.Schema:
    return pa.schema([pa.field(n, t) for n, t in ddl_fields])


def connected_components(edges: DataFrame, name: str = "components") -> DataFrame:
    """Components of an undirected graph by alternating large-star and small-star steps.

    ``edges`` has long columns ``u`` and ``v`` (self loops, repeats and either order are fine). Returns ``node`` and
    ``component``, the smallest node reachable, for every node that reaches a smaller one. Each round is one written table in the
    shared folder, of which two exist at a time; the loop ends when a round changes nothing, so there is no cap on a
    component's size or diameter.
    """
    spark = edges.sparkSession
    current, path = written(
        edges.where("u is not null and v is not null and u <> v")
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .distinct(),
        name,
    )
    mark = None
    while True:
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        pairs = large.join(low, "u")
        small = (
            pairs.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(low.select("u", F.col("m").alias("v")))
            .distinct()
        )
        before, (current, path) = path, written(small, name)
        delete(spark, before)
        now = current.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(now) == mark:
            break
        mark = tuple(now)
    return current.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("node"), "component")
