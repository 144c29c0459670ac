"""Session helpers."""

from __future__ import annotations

import hashlib
import os
import re
import tempfile
import uuid
from functools import cache

from pyspark.sql import DataFrame, SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def make_importable(spark: SparkSession) -> None:
    """Let Python workers on this machine import the library wherever the driver was started; clusters ship it with --py-files."""
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, env.get("PYTHONPATH", "")) if x)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@cache
def _local_folder() -> str:
    return f"file://{tempfile.mkdtemp(prefix='driftglass-')}"


def derived_path(spark: SparkSession, sf_dir: str, names: tuple[str, ...], what: str) -> str:
    """Where this application keeps a table derived from these input tables: the path changes with the inputs' files, sizes and times.

    It goes when the driver ends.
    """
    sc = spark.sparkContext
    conf, jvm = sc._jsc.hadoopConfiguration(), sc._jvm
    seen = [what]
    for name in names:
        p = jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{name}.parquet")
        files = p.getFileSystem(conf).listFiles(p, True)
        while files.hasNext():
            f = files.next()
            seen.append(f"{f.getPath()} {f.getLen()} {f.getModificationTime()}")
    path = f"{shared_root(spark)}/{what}-{sc.applicationId}-{hashlib.sha256(chr(10).join(sorted(seen)).encode()).hexdigest()[:24]}"
    _delete_on_exit(spark, path)
    return path


def _delete_on_exit(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(p)


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or, where that is unset, the warehouse, or a temporary folder if driver and executors are one process.

    A warehouse on a machine's own disk isn't shared, so on a cluster it is refused.
    """
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir", None)
    if root is None:
        if re.fullmatch(r"local(\[.*\])?", sc.master):
            return _local_folder()
        root = spark.conf.get("spark.sql.warehouse.dir")
        if re.match(r"file:|/(?!/)", root):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return root.rstrip("/")


def fresh_path(spark: SparkSession, what: str) -> str:
    """A path in the shared folder that nothing has yet; it goes when the driver ends."""
    path = f"{shared_root(spark)}/{what}-{uuid.uuid4().hex}"
    _delete_on_exit(spark, path)
    return path


def written(df: DataFrame, what: str) -> DataFrame:
    """``df`` computed once, written as Parquet to the shared folder and read back: lineage ends here. It goes when the driver ends."""
    path = fresh_path(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
