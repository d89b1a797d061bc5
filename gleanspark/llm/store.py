"""Tables written to the folder that the whole cluster shares, to cut lineage and share work between jobs."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F



def _frugal() -> None:
    """Makes this process give freed memory back: workers outlive stages, and what one stage needed shouldn't stay taken in the next."""
    with contextlib.suppress(OSError, AttributeError):
        libc = ctypes.CDLL("libc.so.6")
        # fixed values of the C library: trim, map and arena settings. Mapping smaller blocks, too, costs more time than it saves memory
        for setting, value in ((-1, 64 << 20), (-3, 32 << 20), (-8, 2)):
            libc.mallopt(setting, value)
        pa.set_memory_pool(pa.system_memory_pool())


_frugal()

#: Rows that a Python worker gets at once: whole texts, some of them long.
ARROW_ROWS = 1000
_held: dict = {}


def held(name: tuple, make):
    """What ``make()`` gave under ``name``, kept in this process until another name is asked for: workers outlive stages, large models shouldn't."""
    if name not in _held:
        _held.clear()
        gc.collect()
        with contextlib.suppress(OSError, AttributeError):
            ctypes.CDLL("libc.so.6").malloc_trim(0)
        _held[name] = make()
    return _held[name]


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; where that is unset, a temporary one on a single machine, an error on a cluster."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.gleanspark.own.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the whole cluster shares")
        base = tempfile.mkdtemp(prefix="gleanspark-")
        spark.conf.set("spark.gleanspark.own.dir", base)
    return base.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def filesystem(uri: str):
    """The file system of ``uri`` for Python workers, and the path in it. Hadoop's names of object stores stand for the stores."""
    import pyarrow.fs as fs

    uri = re.sub(r"^s3[an]:", "s3:", uri)
    return fs.FileSystem.from_uri(uri if ":" in uri.partition("/")[0] else f"file://{uri}")


_tables: dict[str, list[str]] = {}


def track(spark: SparkSession, path: str) -> str:
    """Notes files that ``sweep`` may delete."""
    _tables.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def tracked(spark: SparkSession) -> set[str]:
    """The working tables of this application."""
    return set(_tables.get(spark.sparkContext.applicationId, ()))


def sweep(spark: SparkSession, but: set[str] = frozenset()) -> None:
    """Deletes this application's working tables ``but`` some; results that still read them must have been written before."""
    jvm = spark.sparkContext._jvm
    names = _tables.pop(spark.sparkContext.applicationId, [])
    _tables[spark.sparkContext.applicationId] = [x for x in names if x in but]
    for name in (x for x in names if x not in but):
        path = jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


#: Spark's setting that shuffle files go when the query ends, not when the driver happens to collect its garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: executors may be lost, its files stay. Its shuffle files go at once."""
    spark = df.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    path, before = track(spark, new_path(spark, name)), spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


#: Bytes of a table that a join may send to every executor.
BROADCAST_BYTES = 16 << 20
#: Bytes of a value in a broadcast table, about, by type; of a row besides.
_WIDTHS, _ROW = {"binary": 40, "string": 40, "boolean": 8}, 24


def small(df: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """A written table of a few narrow columns, marked for broadcast if its rows take no more than ``most`` bytes in memory; else a join shuffles it."""
    width = _ROW + sum(_WIDTHS.get(kind, 8) for _, kind in df.dtypes)
    return F.broadcast(df) if df.count() * width <= most else df


def remove(df: DataFrame) -> None:
    """Deletes the files of a table made by ``written``."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


#: Spark's type of a ``row_key``.
KEY = "binary"


def row_key(*columns: str) -> Column:
    """A 128-bit key of a row's values, null included; equal rows have equal keys."""

    def part(name: str) -> Column:
        value = F.col(f"`{name}`").cast("string").cast("binary")
        return F.when(value.isNull(), F.lit(b"\0")).otherwise(F.concat(F.octet_length(value).cast("string").cast("binary"), F.lit(b":"), value))

    return F.unhex(F.md5(F.concat(*map(part, columns))))


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, lengthened until no column of ``df`` has them."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def plain(df: DataFrame, *columns: str) -> DataFrame:
    """Just these columns, whatever else ``df`` has and however it spells their case."""
    return df.select(*(F.col(f"`{c}`").alias(c) for c in columns))


def ranked(df: DataFrame, keys: list[str], order: list[str], to: str, rows_per_bucket: int = 50_000, buckets: int | None = None) -> DataFrame:
    """Adds ``to``: each row's gapless 0-based rank among the rows of equal ``keys``.

    A key's rows are dealt over buckets by a hash of ``order``; each bucket is ranked alone and starts where the
    buckets before it end, so a key that holds most of the rows is ranked by many tasks. Rows are ordered by
    bucket, then ``order``. ``df`` must be repeatable: a written table, or derived from one.
    """
    from pyspark.sql import Window as W

    if buckets is None:
        buckets = max(1, -(-df.count() // rows_per_bucket))
    rows = df.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int"))
    w = W.partitionBy(*keys, "_bucket")
    counts = rows.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy(*keys).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    starts = counts.select(*keys, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = rows.withColumn("_rank", F.row_number().over(w.orderBy(*order)).cast("long") - 1)
    return inside.join(starts, [*keys, "_bucket"]).withColumn(to, F.col("_start") + F.col("_rank")).drop("_start", "_rank", "_bucket")


#: Edges of which a task keeps only stars that join the same nodes.
EDGES = 100_000


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    top: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := top.setdefault(x, x)) != x:
            top[x] = x = top[up]
        return x

    def out() -> pa.RecordBatch:
        rows = [(x, r) for x in list(top) if (r := root(x)) != x]
        top.clear()
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in (0, 1)], ["a", "b"])

    for batch in batches:
        for x, y in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist()):
            x, y = root(x), root(y)
            if x != y:
                top[max(x, y)] = min(x, y)
        if len(top) > 2 * EDGES:
            yield out()
    yield out()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) of the undirected graph with these long edges; root is the smallest node reachable.

    Tasks first join what their own edges connect, so that little more than an edge a node is left. Each round takes
    the smallest label among a node and its neighbours, then follows that label's own label, so labels cross a
    component in about the logarithm of its width. All steps are joins and map-side combined minima; labels are
    written to the shared folder after each round.
    """
    edges = written(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b"), "edges")
    tasks = max(1, edges.count() // EDGES)
    stars = written(edges.repartition(tasks, "a").coalesce(tasks).mapInArrow(_stars, "a long, b long"), "stars")
    remove(edges)
    both = written(stars.union(stars.select("b", "a")).distinct(), "edges")
    labels = written(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("root")).withColumnRenamed("a", "node"), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").select(F.col("a").alias("node"), "root")
        low = near.union(labels).groupBy("node").agg(F.min("root").alias("low"))
        hop = labels.select(F.col("node").alias("low"), F.col("root").alias("next"))
        new = low.join(hop, "low").join(labels.withColumnRenamed("root", "old"), "node")
        new = written(new.select("node", F.least("low", "next").alias("root"), F.col("old")), "labels")
        changed = new.where("root <> old").limit(1).count()
        remove(labels)
        labels = new.select("node", "root")
        if not changed:
            remove(both)
            return labels
