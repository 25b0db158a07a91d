"""Numbering, batches with resume, field mappings."""

from __future__ import annotations

import tempfile
import time
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def _checkpoints(spark: SparkSession) -> None:
    """Set a checkpoint folder where none is: that of spark.checkpoint.dir, or a temporary one on a single machine."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        where = spark.conf.get("spark.checkpoint.dir", None)
        if where is None and not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(where or tempfile.mkdtemp(prefix="veilframe-checkpoints-"))


def add_sequence_id(df: DataFrame, order_by: Sequence[str] | str, name: str = "sequence_id", start: int = 1) -> DataFrame:
    """df with numbers from `start` in the order given; ties are in order of the other columns.

    Two passes instead of a window over everything: rows are sorted over range partitions and
    checkpointed, as a range partitioning that runs again may cut elsewhere; then each partition's
    first number is the count of rows before it, which is one small row for each partition.
    """
    spark = df.sparkSession
    _checkpoints(spark)
    order = [order_by] if isinstance(order_by, str) else list(order_by)
    rest = [c for c, t in df.dtypes if c not in order and not t.startswith(("map", "variant"))]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = df.repartitionByRange(parts, *order, *rest).sortWithinPartitions(*order, *rest).checkpoint().withColumn("_at", F.monotonically_increasing_id())
    part = F.shiftrightunsigned("_at", 33)
    counts = rows.groupBy(part.alias("_p")).agg(F.count("*").alias("_n"))
    # A row for each partition, so that one task and a broadcast hold it.
    firsts = counts.select("_p", (F.lit(start) + F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).alias("_first"))
    out = rows.withColumn("_p", part).join(F.broadcast(firsts), "_p")
    return out.withColumn(name, (F.col("_first") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).cast("long")).select(*df.columns, name)


def assign_batches(df: DataFrame, size: int, order_by: Sequence[str] | str, name: str = "batch") -> DataFrame:
    """df with batch numbers from 0, `size` rows each."""
    if size <= 0:
        raise ValueError("batch size must be positive")
    return add_sequence_id(df, order_by, "_seq", 0).withColumn(name, F.floor(F.col("_seq") / size).cast("long")).drop("_seq")


def _fingerprint(df: DataFrame, size: int, order_by: Sequence[str] | str) -> str:
    """Of a run's input: its size of batches, order, columns, and rows whatever their order."""
    whole = df.select(F.to_json(F.struct(*df.columns)).alias("r")).agg(F.count("*").alias("n"), F.sum(F.xxhash64("r").cast("decimal(38,0)")).alias("h"), F.sum(F.xxhash64(F.lit(1), "r").cast("decimal(38,0)")).alias("g")).first()
    return f"{size}|{order_by!r}|{df.dtypes!r}|{whole.n}|{whole.h}|{whole.g}"


def process_in_batches(
    df: DataFrame, fn: Callable[[DataFrame, int, int], DataFrame | None] | None, size: int, order_by: Sequence[str] | str, path: str, start_from: int = 0, max_batches: int | None = None,
    continue_on_error: bool = True, key: str = "batch", select: Sequence[str] | None = None, partition_by: str | None = None,
) -> list[dict]:
    """Run fn(batch, number, total) on each batch and write each to `path/batch=n`; a log with a row for each: batch, status, rows, seconds, error.

    Rows are numbered once and written by batch, so that a batch reads its own files alone. A batch
    that is written already is skipped: a run that was stopped goes on where it was. Where the input,
    the size or the order has changed since, the run begins anew; what it wrote is deleted. fn may
    return None to skip; without fn the rows are written as they are. max_batches of None is all, of
    0 none. `select` names the columns that fn gets; with `partition_by`, a column of whole numbers
    from 0 that is there already, its values are the batches.
    """
    if start_from < 0:
        raise ValueError("start_from must not be negative")
    spark = df.sparkSession
    staged, marker = f"{path}/_input", f"{path}/_of"
    now = _fingerprint(df, size, partition_by or order_by)
    if _exists(spark, f"{marker}/_SUCCESS") and spark.read.text(marker).first()[0] != now:
        _delete(spark, path)
    if not _exists(spark, f"{staged}/_SUCCESS"):
        rows = df.withColumn(key, F.col(partition_by).cast("long")) if partition_by else assign_batches(df, size, order_by, key)
        rows.write.mode("overwrite").partitionBy(key).parquet(staged)
        spark.createDataFrame([(now,)], "value string").coalesce(1).write.mode("overwrite").text(marker)
    numbers = sorted(r[0] for r in spark.read.parquet(staged).select(key).distinct().collect()) if _has_rows(spark, staged) else []
    chosen = [n for n in numbers if n >= start_from][: max_batches if max_batches is not None else None]
    log = []
    for n in chosen:
        out, began = f"{path}/{key}={n}", time.time()
        row = {"batch": n, "status": "success", "rows": 0, "seconds": 0.0, "error": None}
        log.append(row)
        try:
            if _exists(spark, f"{out}/_SUCCESS"):
                row["status"] = "done before"
            else:
                own = spark.read.parquet(staged).where(F.col(key) == n).drop(key)
                own = own.select(*select) if select else own
                got = fn(own, n, len(numbers)) if fn else own
                if got is None:
                    row["status"] = "skipped"
                else:
                    got.write.mode("overwrite").parquet(out)
            row["rows"] = 0 if row["status"] == "skipped" else spark.read.parquet(out).count()
        except Exception as e:
            row |= {"status": "failed", "error": str(e).splitlines()[0]}
            if not continue_on_error:
                raise
        finally:
            row["seconds"] = round(time.time() - began, 3)
    return log


def combined(spark: SparkSession, path: str, log: Sequence[Mapping], key: str = "batch") -> DataFrame | None:
    """The rows of all batches of a log that were written, or None without any."""
    good = [f"{path}/{key}={x['batch']}" for x in log if x["status"] in ("success", "done before")]
    return spark.read.parquet(*good) if good else None


def write_batches_table(spark: SparkSession, path: str, log: Sequence[Mapping], table: str, order_by: Sequence[str] | str | None = None, key: str = "batch") -> int:
    """Write the batches of a log as one table, in order where one is given, and say how many rows it has.

    The batches stay where they are until the table is whole, so that nothing is lost if the write fails.
    """
    rows = combined(spark, path, log, key)
    if rows is None:
        return 0
    order = [order_by] if isinstance(order_by, str) else list(order_by or ())
    (rows.orderBy(*order) if order else rows).write.mode("overwrite").saveAsTable(table)
    return spark.table(table).count()


def process_in_chunks(
    df: DataFrame, fn, chunk_size: int = 100_000, inner_size: int = 10_000, order_by: Sequence[str] | str = "call_id", path: str = "", start_chunk_number: int = 1,
    table_prefix: str | None = None, schema: str | None = None, **options,
) -> dict:
    """Batches of batches: each chunk of chunk_size rows in inner batches of its own; totals, and for each chunk its number, table, rows, seconds, status, error and inner log.

    With a table_prefix each chunk becomes a table `[schema.]prefix<number>`, numbered from
    start_chunk_number, in the order given. A chunk fails if all its inner batches do.
    """
    inner: dict[int, list[dict]] = {}
    tables: dict[int, str] = {}

    def chunk(rows: DataFrame, n: int, total: int) -> DataFrame | None:
        own = f"{path}/_chunks/{n}"
        part = inner[n] = process_in_batches(rows, fn, inner_size, order_by, own, continue_on_error=options.get("continue_on_error", True))
        if part and all(x["status"] == "failed" for x in part):
            raise RuntimeError(f"all {len(part)} inner batches failed")
        if table_prefix is not None:
            name = f"{schema + '.' if schema else ''}{table_prefix}{start_chunk_number + n}"
            if write_batches_table(rows.sparkSession, own, part, name, order_by):
                tables[n] = name
        return combined(rows.sparkSession, own, part)

    began = time.time()
    log = process_in_batches(df, chunk, chunk_size, order_by, path, **options)
    failed = sum(x["status"] == "failed" for x in log)
    details = [{"chunk": start_chunk_number + x["batch"], "table": tables.get(x["batch"]), **{k: x[k] for k in ("rows", "seconds", "status", "error")}, "inner": inner.get(x["batch"], [])} for x in log]
    return {"chunks": len(log), "successful": len(log) - failed, "failed": failed, "seconds": round(time.time() - began, 3), "chunk_details": details}


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def _has_rows(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/*=*")
    found = at.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(at)
    return found is not None and len(found) > 0


def dynamic_fields(columns: Sequence[str], config: Mapping[str, str | Sequence[str]]) -> dict[str, list[str]]:
    """The columns that each tag's prefix or list names, in order of their names."""
    return {tag: sorted(c for c in columns if (c.startswith(want) if isinstance(want, str) else c in want)) for tag, want in config.items()}


def dynamic_field_mapping(df: DataFrame, config: Mapping[str, str | Sequence[str]]) -> Column:
    """map of tag to the names of the row's columns with a value (not null, '' or 'None'); tags without any are left out."""
    pairs = []
    for tag, names in dynamic_fields(df.columns, config).items():
        valid = [F.when(F.col(c).isNotNull() & ~F.col(c).cast("string").isin("None", ""), F.lit(c)) for c in names]
        pairs.append(F.struct(F.lit(tag).alias("tag"), F.array_compact(F.array(*valid).cast("array<string>")).alias("fields")))
    return F.map_from_entries(F.filter(F.array(*pairs), lambda p: F.size(p["fields"]) > 0))
