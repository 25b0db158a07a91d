"""Diagnostic reports over evaluated rows; only bounded top-k results come to the driver."""

from __future__ import annotations

import html
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .evaluate import match_rows

METRICS = ("recall", "precision", "f1_score")
HIGH, LOW = 0.8, 0.5
THRESHOLDS = (0.3, 0.5, 0.7, 0.8, 0.9)


def worst_cases(evaluated: DataFrame, n: int = 5, metric: str = "recall", ascending: bool = True, id_col: str = "call_id") -> DataFrame:
    """The n rows of least (or highest) metric, ties by id; nulls come last."""
    if metric not in METRICS:
        raise ValueError(f"metric is one of {METRICS}")
    order = F.col(metric).asc_nulls_last() if ascending else F.col(metric).desc_nulls_last()
    return evaluated.orderBy(order, id_col).limit(n)


def with_status(evaluated: DataFrame, mode: str = "business") -> DataFrame:
    least = 0.90 if mode == "business" else 0.85
    status = F.when((F.col("recall") >= least) & (F.col("precision") >= 0.8), "Excellent Protection").when(F.col("recall") >= least - 0.1, "Good Protection").otherwise("Needs Improvement")
    return evaluated.withColumn("protection_status", status)


def context(text, start, end, wide: int = 50):
    """So many characters on either side of a span."""
    lo = F.greatest(start - wide, F.lit(0))
    return F.substring(text, lo + 1, end + wide - lo)


def missed_categories(evaluated: DataFrame) -> DataFrame:
    """By category, the highest miss rate first: missed, detected, total, miss rate, priority.

    A category that only over-detections have (its name is then the detected type) has no total, and
    null for rate and priority; it comes last.
    """
    m = match_rows(evaluated)
    kind = F.when(F.col("ground_truth_type") != "", F.col("ground_truth_type")).otherwise(F.col("detected_type"))
    out = m.groupBy(kind.alias("category")).agg(F.count_if(F.col("match_type") == "missed").alias("missed_count"), F.count_if(F.col("match_type").isin("exact", "partial")).alias("detected_count"))
    total = F.col("missed_count") + F.col("detected_count")
    out = out.withColumn("total_occurrences", total).withColumn("miss_rate", F.when(total > 0, F.col("missed_count") / total))
    out = out.withColumn("priority", F.when(F.col("miss_rate") > 0.3, "HIGH").when(F.col("miss_rate") > 0.1, "MEDIUM").when(F.col("miss_rate").isNotNull(), "LOW"))
    return out.orderBy(F.col("miss_rate").desc_nulls_last(), "category")


def category_examples(evaluated: DataFrame, missed: bool = True, text_col: str = "original_transcript", id_col: str = "call_id") -> DataFrame:
    """A row for each missed (or found) occurrence with its context."""
    kinds = ["missed"] if missed else ["exact", "partial"]
    # Outer, as in match_rows().
    rows = evaluated.select(id_col, F.col(text_col).alias("_t"), F.explode_outer("matches").alias("m")).where(F.col("m.match_type").isin(kinds))
    return rows.select(id_col, F.col("m.ground_truth_type").alias("category"), F.col("m.ground_truth_value").alias("value"), F.col("m.detected_value").alias("detected_value"), F.col("m.overlap_ratio").alias("overlap_ratio"), F.concat(F.left(F.col("_t"), F.lit(200)), F.lit("...")).alias("original_text"), context(F.col("_t"), F.col("m.start_pos"), F.col("m.end_pos")).alias("context"))


def confidence_rows(evaluated: DataFrame, id_col: str = "call_id", text_col: str | None = None, by_text: bool = False) -> DataFrame:
    """A row for each detection: confidence and whether it is correct; by_text compares the texts of matches instead of places."""
    d = evaluated.select(id_col, *([F.col(text_col).alias("_t")] if text_col else []), F.posexplode("pii_detections").alias("det_ix", "d"), "matches")
    if by_text:
        first = F.get(F.filter("matches", lambda m: m["detected_value"] == F.col("d.text")), F.lit(0))["match_type"]
        right = F.coalesce(first.isin("exact", "partial"), F.lit(False))
    else:
        right = ~F.exists("matches", lambda m: (m["match_type"] == "over_detection") & (m["start_pos"] == F.col("d.start")) & (m["end_pos"] == F.col("d.end")) & (m["detected_type"] == F.col("d.entity_type")))
    out = d.select(id_col, "det_ix", F.col("d.text").alias("detected_value"), F.col("d.entity_type").alias("detected_type"), F.col("d.score").alias("model_confidence"), right.alias("is_correct"), *([context(F.col("_t"), F.col("d.start"), F.col("d.end")).alias("context")] if text_col else []))
    return out.withColumn("bucket", F.when(F.col("model_confidence") >= HIGH, "high").when(F.col("model_confidence") <= LOW, "low"))


def confidence_buckets(rows: DataFrame) -> DataFrame:
    """The four counts, accuracies and the mean confidence; the middle band is in none."""
    def n(bucket: str, right: bool):
        return F.count_if((F.col("bucket") == bucket) & (F.col("is_correct") == right))

    out = rows.agg(n("high", True).alias("high_confidence_correct"), n("high", False).alias("high_confidence_wrong"), n("low", True).alias("low_confidence_correct"), n("low", False).alias("low_confidence_wrong"), F.count("*").alias("total_detections"), F.coalesce(F.avg("model_confidence"), F.lit(0.0)).alias("avg_confidence"))
    for b in ("high", "low"):
        right, wrong = F.col(f"{b}_confidence_correct"), F.col(f"{b}_confidence_wrong")
        out = out.withColumn(f"{b}_conf_accuracy", F.when(right + wrong > 0, right / (right + wrong)).otherwise(0.0))
    return out


def confidence_thresholds(rows: DataFrame, thresholds: Sequence[float] = THRESHOLDS) -> DataFrame:
    """By threshold: how many are at or above it, below it, and the percentage; one pass."""
    counts = rows.agg(F.count("model_confidence").alias("n"), *[F.count_if(F.col("model_confidence") >= t).alias(f"c{i}") for i, t in enumerate(thresholds)])
    each = F.array(*[F.struct(F.lit(float(t)).alias("threshold"), F.col(f"c{i}").alias("above_count"), (F.col("n") - F.col(f"c{i}")).alias("below_count")) for i, t in enumerate(thresholds)])
    out = counts.select("n", F.explode(each).alias("x")).select("n", "x.*")
    return out.select("threshold", "above_count", "below_count", F.when(F.col("n") > 0, F.col("above_count") / F.col("n") * 100).otherwise(0.0).alias("percentage_above"))


def count_discrepancy(truth_rows: DataFrame, expected: DataFrame, id_col: str = "call_id") -> DataFrame:
    """Found against expected numbers by id, type and value, and how many places are found twice."""
    w = Window.partitionBy(id_col, "start", "end")
    found = truth_rows.withColumn("_k", F.count("*").over(w)).groupBy(id_col, "type", "value").agg(F.count("*").alias("found"), F.count_if(F.col("_k") > 1).alias("shared_places"))
    out = found.join(expected, [id_col, "type", "value"], "full")
    return out.select(id_col, "type", "value", F.coalesce("found", F.lit(0)).alias("found"), F.coalesce("expected", F.lit(0)).alias("expected"), (F.coalesce("found", F.lit(0)) - F.coalesce("expected", F.lit(0))).alias("discrepancy"), F.coalesce("shared_places", F.lit(0)).alias("shared_places"))


# -- HTML of bounded results ----------------------------------------------------------------------
_STYLE = "<style>table{border-collapse:collapse}td,th{border:1px solid #ccc;padding:6px;vertical-align:top}.missed{color:#dc3545}.hit{background:#d4edda}.false{background:#fff3cd}.original{background:#fff5f5}.normal{background:#fffdf0}.clean{background:#f0fff4}.detected{background:#f0f5ff}</style>"


def _marked(text: str, values: Sequence[str]) -> str:
    out = html.escape(text or "")
    for v in sorted({html.escape(v) for v in values if v}, key=len, reverse=True):
        out = out.replace(v, f'<span class="missed">{v}</span>')
    return out


def html_cases(cases: DataFrame, id_col: str = "call_id", original_col: str = "original_transcript", clean_col: str = "anonymized_transcript", mode: str = "business", most: int = 100) -> str:
    """A table of at most `most` cases: original with misses in red, clean text with placeholders marked, metrics, status."""
    rows = []
    for r in with_status(cases, mode).limit(most).collect():
        missed = [m.ground_truth_value for m in r.matches if m.match_type == "missed"]
        hits = {t for m in r.matches if m.match_type in ("exact", "partial") for t in m.detected_type.split(" + ")}
        wrong = {m.detected_type for m in r.matches if m.match_type == "over_detection"}
        clean = html.escape(r[clean_col] or "")
        for kind in sorted({d.entity_type for d in r.pii_detections}):
            css = "hit" if kind in hits else "false" if kind in wrong else ""
            clean = clean.replace(f"&lt;{kind}&gt;", f'<span class="{css}">&lt;{kind}&gt;</span>')
        metrics = f"recall {r.recall:.1%}<br>precision {r.precision:.1%}<br>F1 {r.f1_score:.1%}<br>protected {r.pii_protection_rate:.1%}<br>missed {len(missed)}<br>{r.protection_status}"
        rows.append(f"<tr><td>{html.escape(str(r[id_col]))}</td><td>{_marked(r[original_col], missed)}</td><td>{clean}</td><td>{metrics}</td></tr>")
    return f"{_STYLE}<table><tr><th>id</th><th>original</th><th>anonymized</th><th>metrics</th></tr>{''.join(rows)}</table>"


def html_columns(df: DataFrame, columns: Sequence[str], most: int = 100) -> str:
    """A plain table of two to four text columns."""
    if not 2 <= len(columns) <= 4:
        raise ValueError("two to four columns")

    def css(name: str) -> str:
        for part, out in (("original", "original"), ("normal", "normal"), ("clean", "clean"), ("anonym", "clean"), ("detected", "detected")):
            if part in name.lower():
                return out
        return ""

    head = "".join(f"<th>{html.escape(c)}</th>" for c in columns)
    body = "".join("<tr>" + "".join(f'<td class="{css(c)}">{html.escape(str(r[c] if r[c] is not None else ""))}</td>' for c in columns) + "</tr>" for r in df.select(*columns).limit(most).collect())
    return f"{_STYLE}<table><tr>{head}</tr>{body}</table>"


def html_three_stages(cases: DataFrame, id_col: str = "call_id", most: int = 100) -> str:
    return html_columns(cases, [id_col, "original_transcript", "normalized_transcript", "anonymized_transcript"], most)
