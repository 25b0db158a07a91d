"""Evaluation against ground truth: one join by id, then arrays within the row, so that nothing else is shuffled."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import spans as S
from ..functions.constants import COMPATIBLE, GROUND_TRUTH_FIELDS, NAME_FIELDS

TRUTH = "array<struct<type:string,value:string,start:int,end:int>>"
MATCH = "array<struct<ground_truth_value:string,ground_truth_type:string,detected_value:string,detected_type:string,match_type:string,overlap_ratio:double,start_pos:int,end_pos:int>>"

# The phone forms looked for in transcripts.
PHONES = (r"(?U)\b0[2-9]\s?\d{4}\s?\d{4}\b", r"(?U)\b04\d{2}\s?\d{3}\s?\d{3}\b", r"(?U)(?<!\w)\+61\s?[2-9]\s?\d{4}\s?\d{4}\b", r"(?U)\b04\d{4}\s?\d{3}\s?\d{3}\b")


def value_positions(text: Column, value: Column, kind: str, low: Column | None = None) -> Column:
    """Where a field's value occurs: names as whole words outside addresses, phones by digits, others literally. `low`: see literal_positions()."""
    if kind in NAME_FIELDS:
        found = F.when(F.length(value) > 1, S.word_positions(text, value, low))
    elif kind == "member_mobile":
        def same(digits: Column) -> Column:
            every = F.concat(*[S.found_in(text, S.headed(p, "[0+]")) for p in PHONES])
            return F.transform(F.filter(every, lambda p: F.regexp_replace(p["text"], r"(?U)[^\d]", "") == digits), lambda p: F.struct(p["start"].alias("start"), p["end"].alias("end")))

        found = S.once(F.regexp_replace(value, r"(?U)[^\d]", ""), same)
    else:
        found = S.literal_positions(text, value, low)
    return F.array_sort(F.array_distinct(found))


def ground_truth(text: Column, fields: Sequence[str]) -> Column:
    """All occurrences of the fields' values in a text; null and blank values have none."""
    def own(kind: str, low: Column) -> Column:
        def rows(value: Column) -> Column:
            found = F.transform(value_positions(text, value, kind, low), lambda p: F.struct(F.lit(kind).alias("type"), value.alias("value"), p["start"].alias("start"), p["end"].alias("end")))
            return F.when(value != "", found).cast(TRUTH)

        return S.once(F.regexp_replace(F.col(kind).cast("string"), r"(?U)^\s+|\s+\z", ""), rows)

    return S.once(S.lowered(text), lambda low: F.concat(*[F.coalesce(own(kind, low), F.array().cast(TRUTH)) for kind in fields]))


def occurrences(df: DataFrame, id_col: str = "call_id", text_col: str = "call_transcript", fields: Sequence[str] = GROUND_TRUTH_FIELDS) -> DataFrame:
    """A row for each occurrence: id, type, value, start, end, occurrence_id."""
    use = [f for f in fields if f in df.columns]
    rows = df.select(F.col(id_col), F.explode(ground_truth(F.coalesce(F.col(text_col), F.lit("")), use)).alias("g")).select(id_col, "g.*")
    return rows.withColumn("occurrence_id", F.concat_ws("_", "type", "start", "end"))


def _ratio(g: Column, d: Column) -> Column:
    return F.when(g["end"] > g["start"], (F.least(g["end"], d["end"]) - F.greatest(g["start"], d["start"])) / (g["end"] - g["start"])).otherwise(0.0)


def _qualifies(g: Column, d: Column, mode: str) -> Column:
    meet = (d["start"] < g["end"]) & (g["start"] < d["end"])
    if mode == "business":
        return meet & (_ratio(g, d) > 0.1)
    kinds = F.create_map(*[x for k, v in COMPATIBLE.items() for x in (F.lit(k), F.array(*map(F.lit, v)).cast("array<string>"))])
    return meet & (_ratio(g, d) > 0.5) & F.coalesce(F.array_contains(F.try_element_at(kinds, d["entity_type"]), g["type"]), F.lit(False))


def matches(truth: Column, found: Column, mode: str = "business") -> Column:
    """For each occurrence exact, partial or missed, and each detection that met none as over_detection."""
    if mode not in ("business", "research"):
        raise ValueError("mode is business or research")

    def one(g: Column) -> Column:
        own = F.filter(found, lambda d: _qualifies(g, d, mode))
        return F.transform(F.array(F.struct(own.alias("own"), F.aggregate(own, F.lit(0.0), lambda a, d: a + _ratio(g, d)).alias("sum"))), lambda s: F.struct(
            g["value"].alias("ground_truth_value"), g["type"].alias("ground_truth_type"),
            F.array_join(F.transform(s["own"], lambda d: d["text"]), " + ").alias("detected_value"),
            F.array_join(F.array_sort(F.array_distinct(F.transform(s["own"], lambda d: d["entity_type"]))), " + ").alias("detected_type"),
            F.when(F.size(s["own"]) == 0, "missed").when(s["sum"] > 0.8, "exact").otherwise("partial").alias("match_type"),
            F.least(F.lit(1.0), s["sum"]).alias("overlap_ratio"), g["start"].alias("start_pos"), g["end"].alias("end_pos"),
        ))[0]

    over = F.filter(found, lambda d: ~F.exists(truth, lambda g: _qualifies(g, d, mode)))
    rest = F.transform(over, lambda d: F.struct(F.lit("").alias("a"), F.lit("").alias("b"), d["text"].alias("c"), d["entity_type"].alias("d"), F.lit("over_detection").alias("e"), d["score"].cast("double").alias("f"), d["start"].alias("g"), d["end"].alias("h")))
    return F.concat(F.transform(truth, one).cast(MATCH), rest.cast(MATCH))


def first_truth(truth: DataFrame, id_col: str, order_col: str | None = None) -> DataFrame:
    """One ground-truth row for each id: the first by order_col (ties, or without one, by all columns); partial minima leave a task."""
    rest = [c for c, t in truth.dtypes if c not in (id_col, order_col) and not t.startswith(("map", "variant"))]
    order = F.struct(*[F.struct(F.col(c).isNotNull().alias("n"), F.col(c).alias("v")).alias(f"o{i}") for i, c in enumerate([*([order_col] if order_col else []), *rest])])
    row = F.struct(*[F.col(c) for c in truth.columns if c != id_col])
    return truth.groupBy(id_col).agg(F.min_by(row, order).alias("_r")).select(id_col, "_r.*")


def with_truth(results: DataFrame, truth: DataFrame, id_col: str = "call_id", text_col: str = "normalized_transcript", fields: Sequence[str] = GROUND_TRUTH_FIELDS, missing: str = "error", order_col: str | None = None) -> DataFrame:
    """Results with `ground_truth`, found in text_col. Results without ground truth fail the query, or are left out ('skip')."""
    use = [f for f in fields if f in truth.columns]
    one = first_truth(truth.select(id_col, *dict.fromkeys([*use, *([order_col] if order_col else [])])), id_col, order_col).select(F.col(id_col).alias("_id"), F.struct(*use).alias("_gt"))
    both = results.join(one, results[id_col] == one["_id"], "inner" if missing == "skip" else "left")
    if missing == "error":
        both = both.withColumn("_gt", F.when(F.col("_id").isNull(), F.raise_error(F.concat(F.lit("no ground truth for "), F.coalesce(F.col(id_col).cast("string"), F.lit("null"))))).otherwise(F.col("_gt")))
    both = both.withColumns({f: F.col("_gt")[f] for f in use})
    return both.withColumn("ground_truth", ground_truth(F.coalesce(F.col(text_col), F.lit("")), use)).drop("_id", "_gt", *[f for f in use if f not in results.columns])


def evaluate(df: DataFrame, mode: str = "business", truth_col: str = "ground_truth", found_col: str = "pii_detections") -> DataFrame:
    """df with matches, counts and the metrics of each transcript."""
    out = df.withColumn("matches", matches(F.col(truth_col), F.col(found_col), mode))

    def count(kind: str) -> Column:
        return F.size(F.filter("matches", lambda m: m["match_type"] == kind))

    out = out.withColumns({"exact_matches": count("exact"), "partial_matches": count("partial"), "missed": count("missed"), "over_detections": count("over_detection"), "total_ground_truth": F.size(truth_col), "total_detected": F.size(found_col), "pii_protection_rate": S.coverage(F.col(truth_col), F.col(found_col))})
    partial = F.aggregate(F.filter("matches", lambda m: m["match_type"] == "partial"), F.lit(0.0), lambda a, m: a + m["overlap_ratio"])
    out = out.withColumn("true_positives", F.col("exact_matches") + partial)
    tp, over = F.col("true_positives"), F.col("over_detections")
    out = out.withColumns({"false_positives": over, "false_negatives": F.col("missed"), "precision": _share(tp, tp + over), "raw_recall": _share(tp, F.col("total_ground_truth"))})
    out = out.withColumn("recall", F.least(F.lit(1.0), F.col("raw_recall")))
    return out.withColumn("f1_score", _share(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def _share(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def match_rows(evaluated: DataFrame, *keys: str) -> DataFrame:
    # Outer, as Spark would else also compute the matches for a filter on their number before it.
    return evaluated.select(*keys, F.explode_outer("matches").alias("m")).where("m is not null").select(*keys, "m.*")


def overall_metrics(evaluated: DataFrame) -> DataFrame:
    """One row. Recall is over hits and misses together, unlike that of a transcript."""
    sums = evaluated.agg(
        F.count("*").alias("total_transcripts"), *[F.coalesce(F.sum(c), F.lit(0)).alias(f"total_{c}") for c in ("true_positives", "false_positives", "false_negatives")],
        *[F.avg(c).alias(f"avg_{c}") for c in ("precision", "recall", "f1_score")], F.coalesce(F.avg("pii_protection_rate"), F.lit(0.0)).alias("avg_pii_protection_rate"),
    )
    tp = F.col("total_true_positives")
    out = sums.withColumns({"overall_precision": _share(tp, tp + F.col("total_false_positives")), "overall_recall": F.least(F.lit(1.0), _share(tp, tp + F.col("total_false_negatives")))})
    p, r = F.col("overall_precision"), F.col("overall_recall")
    return out.withColumns({"overall_f1_score": _share(2 * p * r, p + r), "recall_target_achievement": r >= 0.99})


def entity_metrics(evaluated: DataFrame) -> DataFrame:
    """A row for each type: hits and misses by the occurrence's type, false ones by the detection's."""
    m = match_rows(evaluated)
    hit, miss, over = F.col("match_type").isin("exact", "partial"), F.col("match_type") == "missed", F.col("match_type") == "over_detection"
    kind = F.when(over, F.col("detected_type")).otherwise(F.col("ground_truth_type"))
    out = m.groupBy(kind.alias("entity_type")).agg(F.sum(F.when(hit, F.col("overlap_ratio")).otherwise(0.0)).alias("true_positives"), F.count_if(over).alias("false_positives"), F.count_if(miss).alias("false_negatives"))
    tp = F.col("true_positives")
    out = out.withColumns({"precision": _share(tp, tp + F.col("false_positives")), "recall": _share(tp, tp + F.col("false_negatives"))})
    return out.withColumn("f1_score", _share(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def details(evaluated: DataFrame, kind: str, *keys: str) -> DataFrame:
    """The missed, over_detection or partial rows, with `position`."""
    return match_rows(evaluated, *keys).where(F.col("match_type") == kind).withColumn("position", F.concat_ws("-", "start_pos", "end_pos"))


def by_recall(metrics: DataFrame) -> DataFrame:
    """entity_metrics() with the best recall first, ties by the type's name."""
    return metrics.orderBy(F.col("recall").desc(), "entity_type")


def occurrence_breakdown(truth_rows: DataFrame, id_col: str = "call_id") -> DataFrame:
    """By id: occurrences, different types; and by id and type their number."""
    return truth_rows.groupBy(id_col, "type").agg(F.count("*").alias("occurrences"))
