"""Shared pieces: the shared folder, written tables, connected components."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_written: list[tuple[SparkSession, str]] = []
_own_dir: list[str] = []  # temporary folders of the driver
_fallback = ""


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where that is unset and all runs in one process (as in tests), a temporary one, else ValueError."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    global _fallback
    if not _fallback:
        _fallback = tempfile.mkdtemp(prefix="veilframe-")
        _own_dir.append(_fallback)
    return f"file://{_fallback}"


def written(df: DataFrame, tag: str) -> DataFrame:
    """df, written to the shared folder and reread: short lineage, and no rows are lost with an executor.

    The table is deleted by release(), or else when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/veilframe/{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    _written.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._veil_path = path
    return out


def _delete(paths: set[str]) -> None:
    for item in [x for x in _written if x[1] in paths]:
        spark, path = item
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
        _written.remove(item)


def release(*frames: DataFrame) -> None:
    """Delete tables of written() that no later step reads."""
    _delete({df._veil_path for df in frames if hasattr(df, "_veil_path")})


def settled(make, tag: str) -> DataFrame:
    """The DataFrame that make() gives, written; the tables that were written for it are deleted."""
    before = len(_written)
    out = written(make(), tag)
    _delete({path for _, path in _written[before:-1]})
    return out


def _at_exit() -> None:
    import shutil

    for d in _own_dir:
        shutil.rmtree(d, ignore_errors=True)


atexit.register(_at_exit)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, lengthened where df has a column of that name."""
    taken = {c.lower() for c in df.columns}
    more = "_"
    while any((more + n).lower() in taken for n in names):
        more += "_"
    return [more + n for n in names]


def fits(df: DataFrame, rows: int) -> bool:
    """Whether df, read from a written table, has at most so many rows; counted in parallel."""
    return df.count() <= rows


def connected_components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """One row (node, component) for every node of an edge; component is the least node reachable.

    Alternating large-star and small-star rounds over written tables, so neither links nor
    components come to the driver. Nodes are of any orderable type; loops and repeats are fine,
    no edges give no rows, edges with a null end are ignored.
    """
    e = edges.where(F.col(u).isNotNull() & F.col(v).isNotNull() & (F.col(u) != F.col(v)))
    e = e.select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).distinct()
    e = written(e, "cc")

    def state(d: DataFrame):
        return tuple(d.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")), F.sum(F.xxhash64("v", "u").cast("decimal(20,0)"))).first())

    seen = state(e)
    while seen[0]:
        both = e.select(F.col("u").alias("a"), F.col("v").alias("b")).union(e.select("v", "u"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("u"), F.col("m").alias("v")).distinct()
        least2 = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least2, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = written(small.union(least2.select("u", F.col("m").alias("v"))).distinct(), "cc")
        now = state(new)
        release(e)
        e = new
        if now == seen:
            break
        seen = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select("v", "v").distinct())


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, whatever their search path; once for each application.

    Where the session has Spark's own size of Arrow batches, 10,000 rows, it is set to 1,000: rows
    hold whole texts here, and a worker and the JVM have several copies of a batch at once.
    """
    import os
    import zipfile

    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(size) == "10000":
        spark.conf.set(size, "1000")
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    path = os.path.join(tempfile.mkdtemp(prefix="veilframe-"), "veilframe.zip")  # the driver's own, sent from there
    _own_dir.append(os.path.dirname(path))
    with zipfile.ZipFile(path, "w") as z:
        for d, _, names in os.walk(top):
            for x in names:
                if x.endswith(".py"):
                    z.write(os.path.join(d, x), os.path.relpath(os.path.join(d, x), os.path.dirname(top)))
    spark.sparkContext.addPyFile(path)
    _shipped.add(app)
