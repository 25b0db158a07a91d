"""Sources and sinks of transcripts."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TRANSCRIPTS = "call_id string, consultant_first_name string, member_number string, member_first_name string, member_full_name string, member_mobile string, member_email string, member_address string, call_transcript string"


def read_csv(spark: SparkSession, path: str, schema: str | None = TRANSCRIPTS, multiline: bool = True) -> DataFrame:
    """Quoted CSV with a header; without a schema all columns are strings.

    Line ends inside quotes are allowed, for which a file is read whole by one task; without any, set
    multiline to False, and large files are split.
    """
    reader = spark.read.option("header", True).option("quote", '"').option("escape", '"').option("multiLine", multiline)
    return (reader.schema(schema) if schema else reader).csv(path)


def read_table(spark: SparkSession, name: str) -> DataFrame:
    return spark.table(name)


def read_frame(spark: SparkSession, frame) -> DataFrame:
    """A DataFrame as it is; a pandas one through Arrow."""
    return frame if isinstance(frame, DataFrame) else spark.createDataFrame(frame)


def write_csv(df: DataFrame, path: str, mode: str = "error") -> None:
    """Nested columns are written as JSON."""
    nested = {c: F.to_json(c) for c, t in df.dtypes if t.startswith(("array", "struct", "map"))}
    df.withColumns(nested).write.mode(mode).option("header", True).option("escape", '"').csv(path)


def write_table(df: DataFrame, name: str, append: bool = False, order_by: list[str] | None = None) -> None:
    """Create or overwrite a table, or append; sorted before the one write where an order is given."""
    out = df.orderBy(*order_by) if order_by else df
    out.write.mode("append" if append else "overwrite").saveAsTable(name)


def metric_rows(metrics: DataFrame, run_id: str) -> DataFrame:
    """One row of metrics as (run_id, metric, value) rows, numbers only."""
    names = [c for c, t in metrics.dtypes if t in ("bigint", "int", "double", "float") or t.startswith("decimal")]
    pairs = F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in names])
    return metrics.select(F.lit(run_id).alias("run_id"), F.explode(pairs).alias("x")).select("run_id", "x.*")


def log_metrics(metrics: DataFrame, run_id: str, table: str, distributions: dict[str, DataFrame] | None = None, sample: DataFrame | None = None, experiment: str = "veilframe") -> None:
    """Append a run's metrics to a table; the same to a tracking server where its client, mlflow, is installed.

    Each distribution has an item and its count in two columns, and goes to `table`_distributions
    as (run_id, distribution, item, n); five rows of the sample go to `table`_sample as JSON.
    """
    rows = metric_rows(metrics, run_id)
    rows.write.mode("append").saveAsTable(table)
    spreads = {}
    for name, df in (distributions or {}).items():
        item, n = df.columns
        own = df.select(F.lit(run_id).alias("run_id"), F.lit(name).alias("distribution"), F.col(item).cast("string").alias("item"), F.col(n).cast("long").alias("n"))
        own.write.mode("append").saveAsTable(f"{table}_distributions")
        spreads[name] = own
    few = None
    if sample is not None:
        few = sample.limit(5).select(F.to_json(F.struct("*")).alias("row")).collect()
        out = sample.sparkSession.createDataFrame([(run_id, r.row) for r in few], "run_id string, row string")
        out.write.mode("append").saveAsTable(f"{table}_sample")
    try:
        import mlflow
    except ImportError:
        return
    mlflow.set_experiment(experiment)
    with mlflow.start_run(run_name=run_id):
        mlflow.log_metrics({r.metric: r.value for r in rows.collect() if r.value is not None})
        for name, own in spreads.items():
            mlflow.log_dict({str(r["item"]): r["n"] for r in own.collect()}, f"{name}.json")  # a row for each kind
        if few is not None:
            mlflow.log_dict([json.loads(r.row) for r in few], "sample_results.json")


def summary(metrics: DataFrame) -> str:
    """A run's metrics as lines of text."""
    return "\n".join(f"{k}: {v}" for k, v in metrics.first().asDict().items())


def evaluation_summary(evaluated: DataFrame) -> str:
    """Overall metrics, counts, entity types with the best recall first, and issues, as lines of text; a few rows come to the driver."""
    from ..operators import evaluate

    m = evaluate.overall_metrics(evaluated).first()
    kinds = evaluate.by_recall(evaluate.entity_metrics(evaluated)).collect()  # a row for each type
    issues = evaluated.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("missed", "over_detections", "partial_matches")]).first()
    out = [f"precision {m.overall_precision:.3f}", f"recall {m.overall_recall:.3f}", f"F1 {m.overall_f1_score:.3f}", f"protected characters {m.avg_pii_protection_rate:.3f}"]
    out += [f"true positives {m.total_true_positives:.1f}", f"false positives {m.total_false_positives}", f"false negatives {m.total_false_negatives}"]
    out += [f"{r.entity_type}: precision {r.precision:.3f}, recall {r.recall:.3f}, F1 {r.f1_score:.3f}" for r in kinds]
    out += [f"missed {issues.missed}", f"over-detections {issues.over_detections}", f"partial matches {issues.partial_matches}"]
    return "\n".join([*out, f"recall target {'reached' if m.recall_target_achievement else 'not reached'}"])


def sample(df: DataFrame, n: int = 5) -> list[dict]:
    """The first n rows, nested values included."""
    return [r.asDict(recursive=True) for r in df.limit(n).collect()]
