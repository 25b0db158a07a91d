"""Normalise, detect and redact, sweep."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import rewrite as R
from .detect import DEFAULT, Recognizer, detect_and_redact


def process(
    df: DataFrame, text_col: str = "call_transcript", normalize: bool = True, sweep: bool = True, months: bool = True, ordinals: bool = True,
    custom: Mapping[str, Sequence[str]] | None = None, fields: Mapping[str, Sequence[str]] | None = None, recognizers: Sequence[Recognizer] = DEFAULT,
    email_username_words: int = 2, remove_fillers: bool = True,
) -> DataFrame:
    """df with original, normalized, detected, [swept] and anonymized transcripts, detections and flags.

    With custom terms the text is swept with them; with fields (placeholder to column names) it is
    then swept with the row's values; with neither, months and ordinals alone. No shuffle.
    """
    text = F.col(text_col)
    out = df.withColumn("original_transcript", text).withColumn("normalized_transcript", R.normalize_text(text, email_username_words, remove_fillers) if normalize else text)
    out = detect_and_redact(out, "normalized_transcript", recognizers).withColumnRenamed("anonymized_text", "detected_transcript")
    last = F.col("detected_transcript")
    if sweep:
        if custom:
            last = R.sweep_text(last, months, ordinals, custom)
        if fields is not None:
            last = R.sweep_text(last, months, ordinals, fields={k: [F.col(c) for c in v] for k, v in fields.items()})
        elif not custom:
            last = R.sweep_text(last, months, ordinals)
        out = out.withColumn("swept_transcript", last)
        last = F.col("swept_transcript")
    label = "normalization_detection_sweeping" if sweep else "normalization_detection"
    return out.withColumns({"anonymized_transcript": last, "workflow": F.lit(label), "normalization_applied": F.lit(normalize), "sweeping_applied": F.lit(sweep)})


def process_text(spark, text: str, **options) -> dict:
    """One text through the same expressions."""
    return process(spark.createDataFrame([(text,)], "call_transcript string"), **options).first().asDict(recursive=True)


def stage_seconds(df: DataFrame, text_col: str = "call_transcript", sweep: bool = True, **options) -> dict[str, float]:
    """Seconds of each stage over df, and their total.

    The stages are one pass, so each is timed as a run of all up to it, less the run before.
    """
    import time

    def timed(out: DataFrame) -> float:
        began = time.time()
        out.write.format("noop").mode("overwrite").save()
        return time.time() - began

    rows = df.select(text_col, *[c for c in df.columns if c != text_col])
    read = timed(rows)
    done = process(rows, text_col, sweep=sweep, **options)
    upto = [timed(done.select("normalized_transcript")), timed(done.select("normalized_transcript", "detected_transcript", "pii_detections"))]
    upto += [timed(done)] if sweep else []
    names = ("normalization_time", "detection_time", "sweeping_time")
    out = {name: round(max(b - a, 0.0), 4) for name, a, b in zip(names, [read, *upto], upto)}
    return out | {"processing_time": round(upto[-1], 4)}


def estimate(seconds) -> F.Column:
    """How long a million texts take at so many seconds each, in words."""
    s = seconds * 1_000_000
    return (
        F.when(s >= 86_400, F.format_string("%.2f days", s / 86_400))
        .when(s >= 3_600, F.format_string("%.2f hours", s / 3_600))
        .when(s >= 60, F.format_string("%.2f minutes", s / 60))
        .otherwise(F.format_string("%.4f seconds", s))
    )


def run_metrics(df: DataFrame, seconds: float = 0.0, sweep: bool = True) -> DataFrame:
    """One row: texts, detections, their mean, the stages, seconds and the estimate for a million."""
    n = F.count("*")
    each = F.when(n > 0, F.lit(float(seconds)) / n).otherwise(0.0)
    return df.agg(n.alias("total_transcripts"), F.coalesce(F.sum("pii_count"), F.lit(0)).alias("total_pii_detected"), F.bround(F.avg("pii_count"), 2).alias("avg_pii_per_transcript"), F.bround(each, 4).alias("avg_seconds"), estimate(each).alias("estimated_time_for_1m_transcripts")).withColumns(
        {"workflow_stages": F.lit("Normalization + Detection" + " + Sweeping" * sweep), "total_seconds": F.lit(float(seconds))}
    )


def type_histogram(df: DataFrame) -> DataFrame:
    """How many detections of each type; combined before the shuffle."""
    return df.select(F.explode("pii_detections.entity_type").alias("entity_type")).groupBy("entity_type").agg(F.count("*").alias("n"))
