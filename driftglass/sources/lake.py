"""The Parquet lake: upserts where the latest fetch wins, snapshots by a commit log, manifest from the log, results.

``<lake>/<kind>/data/commit=<id>/symbol=<S>/tf=<tf>/`` holds files that never change; ``<lake>/<kind>/_log/<version>.json`` says which of them
a version adds and takes away, with rows, first and last time of each. A version appears by a rename that fails if it is there already, so a reader
sees all of a write or nothing, and of two writers of one version one starts again from what the other left. Every ``COMPACT``-th
version is also kept whole, so a reader opens one whole version and the changes since. The log is read on the driver: a line per file.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftglass.operators.provenance import UNAVAILABLE, latency_label, latency_rank

STORED = T.StructType([
    T.StructField("ts", T.TimestampNTZType()), *[T.StructField(c, T.DoubleType()) for c in ("open", "high", "low", "close", "volume")],
    T.StructField("source", T.StringType()), T.StructField("latency", T.StringType()), T.StructField("fetched_at", T.TimestampNTZType()),
    T.StructField("symbol", T.StringType()), T.StructField("tf", T.StringType()),
])


class DataUnavailable(LookupError):
    """Nothing is stored for this series."""


def latest_wins(existing: DataFrame, incoming: DataFrame, keys: tuple[str, ...] = ("symbol", "tf", "ts")) -> DataFrame:
    """Union of both, one row per key: the latest ``fetched_at``, on a tie the row that was there already."""
    both = existing.withColumn("__new", F.lit(0)).unionByName(incoming.withColumn("__new", F.lit(1)))
    order = [F.desc("fetched_at"), F.asc("__new"), *[F.asc(c) for c in ("source", "close") if c in existing.columns]]
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return both.withColumn("__rank", rank).where("__rank = 1").drop("__rank", "__new")


def _hadoop(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _hadoop(spark, path)
    return fs.exists(p)


COMPACT = 10


class Conflict(RuntimeError):
    """Another writer has committed this version."""


@dataclass(frozen=True)
class File:
    """A line of the log: one data file and what is in it."""

    path: str
    symbol: str
    tf: str
    rows: int
    first: str
    last: str


def _read_text(spark: SparkSession, path: str) -> str:
    fs, p = _hadoop(spark, path)
    stream = fs.open(p)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def _publish(spark: SparkSession, path: str, text: str) -> None:
    """Write a file under another name, then give it this one, which must be free."""
    jvm, sc = spark.sparkContext._jvm, spark.sparkContext
    fs, draft = _hadoop(spark, f"{path}.{uuid.uuid4().hex}.tmp")
    stream = fs.create(draft, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.makeQualified(draft).toUri(), sc._jsc.hadoopConfiguration())
    none = sc._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    none[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
    try:
        context.rename(fs.makeQualified(draft), fs.makeQualified(_hadoop(spark, path)[1]), none)
    except Exception as e:
        fs.delete(draft, False)
        if fs.exists(_hadoop(spark, path)[1]):
            raise Conflict(path) from e
        raise


def _versions(spark: SparkSession, log: str) -> tuple[list[int], list[int]]:
    """Numbers of the changes, and of the versions that are kept whole."""
    fs, p = _hadoop(spark, log)
    if not fs.exists(p):
        return [], []
    names = [f.getPath().getName() for f in fs.listStatus(p)]
    return sorted(int(n[:-5]) for n in names if n[:-5].isdigit() and n.endswith(".json")), sorted(int(n[:-6]) for n in names if n[:-6].isdigit() and n.endswith(".whole"))


def snapshot(spark: SparkSession, lake: str, kind: str = "bars", version: int | None = None) -> tuple[int, list[File]]:
    """The files of a version (the latest if none is named) and its number; 0 before the first write."""
    log = f"{lake}/{kind}/_log"
    changes, whole = _versions(spark, log)
    latest = max(changes, default=0)
    at = latest if version is None else version
    if at > latest or at < 0:
        raise DataUnavailable(f"version {at} of {kind}")
    start = max((v for v in whole if v <= at), default=0)
    live = {f["path"]: File(**f) for f in json.loads(_read_text(spark, f"{log}/{start:020d}.whole"))} if start else {}
    for v in (v for v in changes if start < v <= at):
        change = json.loads(_read_text(spark, f"{log}/{v:020d}.json"))
        for path in change["gone"]:
            live.pop(path, None)
        live |= {f["path"]: File(**f) for f in change["come"]}
    return at, sorted(live.values(), key=lambda f: (f.symbol, f.tf, f.first, f.path))


def commit(spark: SparkSession, lake: str, kind: str, base: int, come: list[File], gone: list[File]) -> int:
    """Make the version after ``base``; Conflict if it is there already. Every COMPACT-th is kept whole as well."""
    log, version = f"{lake}/{kind}/_log", base + 1
    fs, p = _hadoop(spark, log)
    fs.mkdirs(p)
    _publish(spark, f"{log}/{version:020d}.json", json.dumps({"come": [asdict(f) for f in come], "gone": [f.path for f in gone]}))
    if version % COMPACT == 0:
        try:
            _publish(spark, f"{log}/{version:020d}.whole", json.dumps([asdict(f) for f in snapshot(spark, lake, kind, version)[1]]))
        except Conflict:
            pass  # someone else has kept it
    return version


def read_files(spark: SparkSession, lake: str, kind: str, files: list[File]) -> DataFrame:
    if not files:
        return spark.createDataFrame([], STORED)
    top = f"{lake}/{kind}/data"
    return spark.read.schema(STORED).option("basePath", top).parquet(*[f"{top}/{f.path}" for f in files]).select(STORED.names)


def read_all(spark: SparkSession, lake: str, kind: str = "bars", version: int | None = None) -> DataFrame:
    """All series of a kind as of a version."""
    return read_files(spark, lake, kind, snapshot(spark, lake, kind, version)[1])


def stage(rows: DataFrame, lake: str, kind: str, rows_per_file: int) -> list[File]:
    """Write rows to files that no version names yet."""
    spark, name = rows.sparkSession, f"commit={uuid.uuid4().hex}"
    top = f"{lake}/{kind}/data"
    writer = rows.repartitionByRange("symbol", "tf", "ts").sortWithinPartitions("symbol", "tf", "ts").write
    writer.option("compression", "zstd").option("maxRecordsPerFile", rows_per_file).partitionBy("symbol", "tf").parquet(f"{top}/{name}")
    text = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")
    held = spark.read.schema(STORED).parquet(f"{top}/{name}").groupBy(F.col("_metadata.file_path").alias("path"), "symbol", "tf")
    found = held.agg(F.count("*").alias("rows"), text(F.min("ts")).alias("first"), text(F.max("ts")).alias("last")).collect()  # a row per new file
    return [File(f"{name}/{unquote(r['path']).split(f'/{name}/', 1)[1]}", r["symbol"], r["tf"], r["rows"], r["first"], r["last"]) for r in found]


def write_bars(incoming: DataFrame, lake: str, kind: str = "bars", rows_per_file: int = 5_000_000, attempts: int = 5) -> int:
    """Upsert: of the series that come in, the stored files are read and merged, and one commit exchanges them. Returns the version.

    Nothing is seen before the commit and nothing is lost by a fault before it. If another writer commits first, the merge starts again
    from what is there then. Long series are spread over files by time.
    """
    spark = incoming.sparkSession
    staged = f"{lake}/{kind}/_staged-{uuid.uuid4().hex}"
    fs, p = _hadoop(spark, staged)
    try:
        incoming.select(STORED.names).write.parquet(staged)  # read several times below, computed once
        arrived = spark.read.schema(STORED).parquet(staged)
        touched = {tuple(r) for r in arrived.select("symbol", "tf").distinct().collect()}  # a row per series
        for _ in range(attempts):
            base, files = snapshot(spark, lake, kind)
            if not touched:
                return base
            old = [f for f in files if (f.symbol, f.tf) in touched]
            new = stage(latest_wins(read_files(spark, lake, kind, old), arrived), lake, kind, rows_per_file)
            try:
                return commit(spark, lake, kind, base, new, old)
            except Conflict:
                fs.delete(_hadoop(spark, f"{lake}/{kind}/data/{new[0].path.split('/', 1)[0]}")[1], True)
        raise Conflict(f"{kind}: other writers were first {attempts} times")
    finally:
        fs.delete(p, True)


def compact(spark: SparkSession, lake: str, kind: str = "bars", rows_per_file: int = 5_000_000) -> int:
    """Rewrite series that lie in more files than they need; the rows stay the same. Returns the version."""
    base, files = snapshot(spark, lake, kind)
    series: dict[tuple[str, str], list[File]] = {}
    for f in files:
        series.setdefault((f.symbol, f.tf), []).append(f)
    old = [f for own in series.values() if len(own) > -(-sum(f.rows for f in own) // rows_per_file) for f in own]
    if not old:
        return base
    return commit(spark, lake, kind, base, stage(read_files(spark, lake, kind, old), lake, kind, rows_per_file), old)


def vacuum(spark: SparkSession, lake: str, kind: str = "bars", keep: int = 10) -> int:
    """Delete commits' folders that none of the last ``keep`` versions names; returns their number. Not while others write."""
    latest, _ = snapshot(spark, lake, kind)
    used = {f.path.split("/", 1)[0] for v in range(max(1, latest - keep + 1), latest + 1) for f in snapshot(spark, lake, kind, v)[1]}
    fs, p = _hadoop(spark, f"{lake}/{kind}/data")
    gone = [f.getPath() for f in fs.listStatus(p) if f.getPath().getName().startswith("commit=") and f.getPath().getName() not in used] if fs.exists(p) else []
    for path in gone:
        fs.delete(path, True)
    return len(gone)


def has(spark: SparkSession, lake: str, kind: str = "bars") -> bool:
    return snapshot(spark, lake, kind)[0] > 0


def read_bars(spark: SparkSession, lake: str, symbol: str, tf: str = "1d", kind: str = "bars", start: str | None = None, end: str | None = None, version: int | None = None) -> DataFrame:
    """One series sorted by time; the log says which files are read."""
    files = [f for f in snapshot(spark, lake, kind, version)[1] if (f.symbol, f.tf) == (symbol, tf) and (start is None or f.last >= start) and (end is None or f.first[: len(end)] <= end)]
    df = read_files(spark, lake, kind, files)
    if start is not None:
        df = df.where(F.col("ts") >= F.lit(start).cast("timestamp_ntz"))
    if end is not None:
        df = df.where(F.col("ts") <= F.lit(end).cast("timestamp_ntz"))
    return df.orderBy("ts")


def stored_manifest(spark: SparkSession, lake: str, kind: str = "bars", version: int | None = None) -> DataFrame:
    """Rows, first and last time per symbol and timeframe from the log alone: no data file is opened."""
    found: dict[tuple[str, str], list] = {}
    for f in snapshot(spark, lake, kind, version)[1]:
        own = found.setdefault((f.symbol, f.tf), [0, f.first, f.last, 0])
        own[:] = [own[0] + f.rows, min(own[1], f.first), max(own[2], f.last), own[3] + 1]
    listed = spark.createDataFrame([(*k, *v) for k, v in found.items()], "symbol string, tf string, n_rows long, start string, end string, n_files int")
    return listed.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start", "end")})


def series_provenance(bars: DataFrame) -> DataFrame:
    """Distinct sources, worst latency and earliest fetch of a series; no rows: UNAVAILABLE."""
    return bars.agg(F.array_sort(F.collect_set("source")).alias("sources"), F.coalesce(F.max(latency_rank(F.col("latency"))), F.lit(UNAVAILABLE)).alias("latency"), F.min("fetched_at").alias("fetched_at"), F.count("*").alias("n_rows"))


def manifest(bars: DataFrame) -> DataFrame:
    """Rows, first and last time per symbol, from the data itself."""
    return bars.groupBy("symbol").agg(F.count("*").alias("n_rows"), F.min("ts").alias("start"), F.max("ts").alias("end"))


def coverage(symbols: DataFrame, listed: DataFrame) -> DataFrame:
    """Every known symbol with what is stored; nothing stored is 0 rows and UNAVAILABLE."""
    joined = symbols.join(listed, symbols["ticker"] == listed["symbol"], "left")
    n = F.coalesce("n_rows", F.lit(0).cast("long"))
    return joined.select("ticker", n.alias("n_rows"), "start", "end", F.when(n > 0, "EOD").otherwise("UNAVAILABLE").alias("latency"))


def stats(spark: SparkSession, lake: str) -> dict[str, int]:
    """Number of files and bytes below the lake."""
    fs, p = _hadoop(spark, lake)
    if not fs.exists(p):
        return {"files": 0, "bytes": 0}
    summary = fs.getContentSummary(p)
    return {"files": summary.getFileCount(), "bytes": summary.getLength()}


def save_results(equity: DataFrame, lake: str, points: int = 500) -> str:
    """Equity curves thinned to at most ``points`` per symbol and strategy, as JSON. Results of other symbols stay as they are."""
    from driftglass.operators.slicing import downsample

    path = f"{lake}/backtests"
    keyed = equity.withColumn("__series", F.concat_ws("|", "symbol", "strategy"))
    writer = downsample(keyed, points, "__series").drop("__series").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy("symbol").json(path)
    return path


def load_results(spark: SparkSession, lake: str, symbol: str) -> DataFrame | None:
    """Stored results of a symbol, or None if there are none."""
    path = f"{lake}/backtests"
    if not exists(spark, path):
        return None
    schema = "strategy string, ts timestamp_ntz, i long, equity double, symbol string"
    found = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path).where(F.col("symbol") == symbol)
    return None if found.isEmpty() else found


def describe(bars: DataFrame) -> DataFrame:
    """Per symbol and timeframe: rows, first and last time, and the provenance of the series."""
    own = bars.groupBy("symbol", "tf").agg(
        F.count("*").alias("n_rows"), F.min("ts").alias("start"), F.max("ts").alias("end"), F.array_sort(F.collect_set("source")).alias("sources"),
        F.max(latency_rank(F.col("latency"))).alias("rank"), F.min("fetched_at").alias("fetched_at"),
    )
    return own.select("symbol", "tf", "n_rows", "start", "end", "sources", latency_label(F.coalesce("rank", F.lit(UNAVAILABLE))).alias("latency"), "fetched_at")


def to_records(bars: DataFrame, max_points: int | None = None) -> DataFrame:
    """Rows as served: ``ts`` as ISO text in UTC and the prices, each series thinned evenly to at most ``max_points``."""
    from driftglass.operators.slicing import downsample

    found = bars if not max_points else downsample(bars, max_points)
    return found.select("symbol", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'+00:00'").alias("ts"), "open", "high", "low", "close", "volume")
