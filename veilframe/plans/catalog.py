"""Queries over the tables of a folder, and their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import rewrite as R
from ..functions import spans as S
from ..functions.constants import COMPATIBLE, GROUND_TRUTH_FIELDS, MONTHS, ORDINAL_WORDS
from ..operators import batch, detect, diagnose, evaluate, pipeline
from ..sources import io
from . import transcripts as T

_CUSTOM = {"<ORG>": ["Kestrel Couriers"], "<ROLE>": ["agent", "customer"]}
_FIELDS = {"<PERSON>": ["member_full_name", "member_first_name"], "<MOBILE>": ["member_mobile"], "<ADDRESS>": ["member_address"]}


def _documents(spark, sf_dir, *cols):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", *cols)


def _rewrite(table, column, change, **names):
    def run(spark, sf_dir):
        df = getattr(T, table)(spark, sf_dir)
        return df.select("call_id", change(df[column]).alias("result"))

    return run


# -- detection over documents and transcripts -----------------------------------------------------
def detect_and_redact(spark, sf_dir):
    out = detect.detect_and_redact(_documents(spark, sf_dir), "text")
    return out.select("doc_id", "pii_count", F.col("custom_detections.member_numbers").alias("member_numbers"), F.col("custom_detections.addresses").alias("addresses"), "anonymized_text")


def detections(spark, sf_dir):
    return detect.exploded(detect.detect_and_redact(_documents(spark, sf_dir), "text"), "doc_id")


def _found(recognizer, table="documents"):
    def run(spark, sf_dir):
        df = _documents(spark, sf_dir) if table == "documents" else T.transcripts(spark, sf_dir).select(F.col("call_id").alias("doc_id"), F.col("call_transcript").alias("text"))
        own = detect.detect(F.coalesce("text", F.lit("")), [recognizer], None)
        return df.select("doc_id", F.posexplode(own).alias("ix", "s")).select("doc_id", "ix", "s.text", "s.score")

    return run


def redact(spark, sf_dir):
    df = _documents(spark, sf_dir)
    own = S.resolve(detect.detect(F.coalesce("text", F.lit("")), [detect.EMAIL], None))
    return df.select("doc_id", S.redact(F.col("text"), own).alias("anonymized_text"))


def detect_person_rule(spark, sf_dir):
    return _found(detect.PERSON, "transcripts")(spark, sf_dir)


def redact_numbers(spark, sf_dir):
    number = detect.Recognizer("GENERIC_NUMBER", (detect.GENERIC_NUMBER.patterns[1],), needs=r"(?U)\d")
    out = detect.detect_and_redact(_documents(spark, sf_dir), "text", [detect.EMAIL, number])
    return out.select("doc_id", "pii_count", "anonymized_text")


def pii_types(spark, sf_dir):
    return pipeline.type_histogram(_evaluated(spark, sf_dir))


# -- pipeline -------------------------------------------------------------------------------------
def _processed(spark, sf_dir, **options):
    return pipeline.process(T.transcripts(spark, sf_dir), fields=_FIELDS, **options)


def pipeline_full(spark, sf_dir):
    return _processed(spark, sf_dir).select("call_id", "normalized_transcript", "detected_transcript", "swept_transcript", "anonymized_transcript", "pii_count", "workflow", "normalization_applied", "sweeping_applied")


def process_dataset(spark, sf_dir):
    out = _processed(spark, sf_dir, custom=_CUSTOM)
    return out.select("call_id", "consultant_first_name", "original_transcript", "anonymized_transcript", "pii_count", F.to_json("pii_detections").alias("pii_detections"))


def process_dataset_baseline(spark, sf_dir):
    out = detect.detect_and_redact(T.transcripts(spark, sf_dir))
    return out.select("call_id", "consultant_first_name", F.col("call_transcript").alias("original_transcript"), F.col("anonymized_text").alias("anonymized_transcript"), "pii_count", "workflow")


def run_metrics(spark, sf_dir):
    rows = T.detections(spark, sf_dir).groupBy("call_id").agg(F.count("*").alias("pii_count"))
    return pipeline.run_metrics(rows, 2.5)


def metric_rows(spark, sf_dir):
    return io.metric_rows(run_metrics(spark, sf_dir), "run-1")


# -- evaluation -----------------------------------------------------------------------------------
def gt_occurrences(spark, sf_dir):
    rows = evaluate.occurrences(T.transcripts(spark, sf_dir), fields=GROUND_TRUTH_FIELDS)
    return rows.select("call_id", "type", "value", F.col("start").alias("start_pos"), F.col("end").alias("end_pos"))


def _positions(fields):
    def run(spark, sf_dir):
        rows = evaluate.occurrences(T.transcripts(spark, sf_dir), fields=fields)
        return rows.select("call_id", "type", F.col("start").alias("start_pos"), F.col("end").alias("end_pos"))

    return run


def occurrence_breakdown(spark, sf_dir):
    return evaluate.occurrence_breakdown(evaluate.occurrences(T.transcripts(spark, sf_dir))).groupBy("type").agg(F.sum("occurrences").alias("occurrences"), F.count("*").alias("transcripts"))


def _evaluated(spark, sf_dir, mode="business"):
    span = F.struct("entity_type", F.col("start_pos").alias("start"), F.col("end_pos").alias("end"), "score", "text")
    found = T.detections(spark, sf_dir).groupBy("call_id").agg(F.array_sort(F.collect_list(F.struct("start_pos", "end_pos", "entity_type", span.alias("s")))).alias("d")).select("call_id", F.transform("d", lambda x: x["s"]).alias("found"))
    truth = T.transcripts(spark, sf_dir)
    # Merged, as Spark takes what is made from keys to be as small as these and would broadcast all texts.
    results = truth.select("call_id", F.col("call_transcript").alias("normalized_transcript")).hint("merge").join(found, "call_id", "left").withColumn("pii_detections", F.coalesce("found", S.none())).drop("found").hint("merge")
    return evaluate.evaluate(evaluate.with_truth(results, truth), mode)


def _matches(mode):
    def run(spark, sf_dir):
        return evaluate.match_rows(_evaluated(spark, sf_dir, mode), "call_id").withColumn("overlap_ratio", F.round("overlap_ratio", 6))

    return run


_METRICS = ("true_positives", "precision", "recall", "raw_recall", "f1_score", "pii_protection_rate")


def transcript_metrics(spark, sf_dir):
    out = _evaluated(spark, sf_dir)
    return out.select("call_id", *[F.col(c).cast("long").alias(c) for c in ("exact_matches", "partial_matches", "missed", "over_detections", "total_ground_truth", "total_detected")], *[F.round(c, 6).alias(c) for c in _METRICS])


def overall_metrics(spark, sf_dir):
    out = evaluate.overall_metrics(_evaluated(spark, sf_dir))
    return out.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes])


def entity_metrics(spark, sf_dir):
    out = evaluate.entity_metrics(_evaluated(spark, sf_dir))
    return out.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes])


def entity_ranking(spark, sf_dir):
    out = evaluate.by_recall(evaluate.entity_metrics(_evaluated(spark, sf_dir)).withColumn("recall", F.round("recall", 6)))
    return out.withColumn("place", F.row_number().over(Window.orderBy(F.col("recall").desc(), "entity_type")).cast("long")).select("place", "entity_type", "recall")


def _details(kind):
    def run(spark, sf_dir):
        return evaluate.details(_evaluated(spark, sf_dir), kind, "call_id").select("call_id", "ground_truth_type", "ground_truth_value", "detected_type", "detected_value", "position")

    return run


def evaluate_pipeline(spark, sf_dir):
    """The pipeline's own detections against ground truth, on normalised texts."""
    out = evaluate.evaluate(evaluate.with_truth(_processed(spark, sf_dir).select("call_id", "normalized_transcript", "pii_detections").hint("merge"), T.transcripts(spark, sf_dir)))
    return out.select("call_id", "exact_matches", "partial_matches", "missed", "over_detections", *[F.round(c, 6).alias(c) for c in _METRICS])


# -- diagnostics ----------------------------------------------------------------------------------
def worst_cases(spark, sf_dir):
    out = diagnose.worst_cases(_evaluated(spark, sf_dir).withColumn("recall", F.round("recall", 6)), 10)
    return out.select("call_id", "recall", F.col("missed").cast("long").alias("missed"))


def protection_status(spark, sf_dir):
    return diagnose.with_status(_evaluated(spark, sf_dir)).groupBy("protection_status").agg(F.count("*").alias("n"))


def missed_categories(spark, sf_dir):
    return diagnose.missed_categories(_evaluated(spark, sf_dir)).withColumn("miss_rate", F.round("miss_rate", 6))


def category_examples(spark, sf_dir):
    return diagnose.category_examples(_evaluated(spark, sf_dir), True, "normalized_transcript").select("call_id", "category", "value", "original_text", "context")


def confidence_buckets(spark, sf_dir):
    out = diagnose.confidence_buckets(diagnose.confidence_rows(_evaluated(spark, sf_dir)))
    return out.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes])


def confidence_by_text(spark, sf_dir):
    rows = diagnose.confidence_rows(_evaluated(spark, sf_dir), by_text=True)
    return rows.groupBy("is_correct").agg(F.count("*").alias("n"), F.count_if(F.col("bucket") == "high").alias("high"))


def confidence_thresholds(spark, sf_dir):
    return diagnose.confidence_thresholds(diagnose.confidence_rows(_evaluated(spark, sf_dir))).withColumn("percentage_above", F.round("percentage_above", 6))


def count_discrepancy(spark, sf_dir):
    t = T.transcripts(spark, sf_dir)
    each = F.array(*[F.struct(F.lit(c).alias("type"), F.col(c).alias("value"), F.lit(1).alias("expected")) for c in GROUND_TRUTH_FIELDS])
    expected = t.select("call_id", F.explode(each).alias("x")).select("call_id", "x.*")
    return diagnose.count_discrepancy(evaluate.occurrences(t), expected).where("discrepancy <> 0").select("call_id", "type", "value", "found", "expected", "discrepancy", "shared_places")


# -- batches --------------------------------------------------------------------------------------
def _orders(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_orderdate")


def sequence_id(spark, sf_dir):
    return batch.add_sequence_id(_orders(spark, sf_dir), ["o_orderdate", "o_orderkey"]).select("o_orderkey", "sequence_id")


def batch_assignment(spark, sf_dir):
    return batch.assign_batches(_orders(spark, sf_dir), 100, ["o_orderdate", "o_orderkey"]).groupBy("batch").agg(F.count("*").alias("n"), F.min("o_orderkey").alias("least"))


def chunk_assignment(spark, sf_dir):
    rows = batch.assign_batches(_orders(spark, sf_dir), 1000, "o_orderkey", "chunk")
    return rows.groupBy("chunk").agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first_key"), F.max("o_orderkey").alias("last_key"))


def dynamic_field_mapping(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/customer.parquet").select(
        F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_name")).alias("FIRST_NAME_FATHER"), F.when(F.col("c_custkey") % 3 == 0, "None").otherwise(F.col("c_name")).alias("FIRST_NAME_MOTHER"), F.when(F.col("c_custkey") % 5 == 0, "").otherwise(F.col("c_mktsegment")).alias("SURNAME_1"))
    found = batch.dynamic_field_mapping(df, {"<FIRST_NAME>": "FIRST_NAME_", "<LAST_NAME>": ["SURNAME_1"]})
    return df.withColumn("m", found).select("id", *[F.coalesce(F.array_join(F.try_element_at("m", F.lit(tag)), ","), F.lit("")).alias(name) for tag, name in (("<FIRST_NAME>", "first_names"), ("<LAST_NAME>", "last_names"))])


def queries():
    return {
        "detect_and_redact": detect_and_redact, "detections": detections, "detect_email": _found(detect.EMAIL), "detect_generic_number": _found(detect.Recognizer("GENERIC_NUMBER", (detect.GENERIC_NUMBER.patterns[1],), needs=r"(?U)\d")),
        "detect_numbers": _found(detect.GENERIC_NUMBER), "detect_phone": _found(detect.PHONE), "detect_credit_card": _found(detect.CREDIT_CARD), "detect_au_phone": _found(detect.AU_PHONE, "transcripts"), "detect_au_address": _found(detect.AU_ADDRESS, "transcripts"),
        "detect_member_number": _found(detect.MEMBER_NUMBER, "transcripts"), "detect_location": _found(detect.LOCATION, "transcripts"), "detect_person_rule": detect_person_rule, "redact": redact, "redact_numbers": redact_numbers, "pii_types": pii_types,
        "normalize_number_words": _rewrite("spoken", "numbers", R.normalize_number_words), "normalize_separated_chars": _rewrite("spoken", "letters", R.normalize_separated_chars), "normalize_email": _rewrite("spoken", "mail", R.normalize_email_addresses),
        "remove_fillers": _rewrite("spoken", "fillers", R.remove_filler_words), "remove_fillers_transcripts": _rewrite("transcripts", "call_transcript", R.remove_filler_words), "normalize_text": _rewrite("spoken", "mail", R.normalize_text),
        "sweep_months": _rewrite("transcripts", "call_transcript", R.sweep_months), "sweep_ordinals": _rewrite("transcripts", "call_transcript", R.sweep_ordinals), "sweep_custom": _rewrite("transcripts", "call_transcript", lambda t: R.sweep_custom(t, _CUSTOM)),
        "sweep_fields": lambda s, d: T.transcripts(s, d).select("call_id", R.sweep_fields(F.col("call_transcript"), {k: [F.col(c) for c in v] for k, v in _FIELDS.items()}).alias("result")),
        "sweep_text": _rewrite("transcripts", "call_transcript", lambda t: R.sweep_text(t, custom=_CUSTOM)), "sweep_months_documents": lambda s, d: _documents(s, d).select("doc_id", R.sweep_months(F.col("text")).alias("result")),
        "pipeline_full": pipeline_full, "process_dataset": process_dataset, "process_dataset_baseline": process_dataset_baseline, "run_metrics": run_metrics, "metric_rows": metric_rows,
        "gt_occurrences": gt_occurrences, "gt_name_positions": _positions(("member_first_name", "member_full_name", "consultant_first_name")), "gt_mobile_positions": _positions(("member_mobile",)), "gt_literal_positions": _positions(("member_email", "member_address", "member_number")),
        "occurrence_breakdown": occurrence_breakdown, "match_business": _matches("business"), "match_research": _matches("research"), "transcript_metrics": transcript_metrics, "overall_metrics": overall_metrics, "entity_metrics": entity_metrics, "entity_ranking": entity_ranking,
        "missed_pii": _details("missed"), "over_detections": _details("over_detection"), "partial_matches": _details("partial"), "evaluate": evaluate_pipeline,
        "worst_cases": worst_cases, "protection_status": protection_status, "missed_categories": missed_categories, "category_examples": category_examples, "confidence_buckets": confidence_buckets, "confidence_by_text": confidence_by_text, "confidence_thresholds": confidence_thresholds, "count_discrepancy": count_discrepancy,
        "sequence_id": sequence_id, "batch_assignment": batch_assignment, "chunk_assignment": chunk_assignment, "dynamic_field_mapping": dynamic_field_mapping,
    }


# -- SQL ------------------------------------------------------------------------------------------
def _found_sql(pattern: str, score: float, rows: str = "select doc_id, text from documents") -> str:
    own = f"select doc_id, unnest(regexp_extract_all(text, '{pattern}')) as text, generate_subscripts(regexp_extract_all(text, '{pattern}'), 1) - 1 as ix from ({rows}) r"
    return f"select doc_id, cast(ix as int) as ix, text, cast({score} as double) as score from ({own}) x"


def _spans_sql(patterns, rows: str = "select doc_id, text from documents") -> str:
    """All spans of one type's patterns (pattern, score), once each, without those inside another of a score as high or higher."""
    each = [
        f"""select doc_id, m as text, cast({score} as double) as score, cast(sum(length(pre)) over w + sum(length(m)) over w - length(m) as int) as s, cast(sum(length(pre)) over w + sum(length(m)) over w as int) as e
        from (select doc_id, unnest(ms) as m, unnest(ps[1:len(ms)]) as pre, generate_subscripts(ms, 1) as i from (select doc_id, regexp_extract_all(text, '{p}') as ms, regexp_split_to_array(text, '{p}') as ps from ({rows}) r) x) y
        window w as (partition by doc_id order by i)"""
        for p, score in patterns
    ]
    return f"""with a as (select distinct * from ({' union all '.join(each)}) u)
select doc_id, cast(row_number() over (partition by doc_id order by s, e) - 1 as int) as ix, text, score from a
where not exists (select 1 from a o where o.doc_id = a.doc_id and o.s <= a.s and o.e >= a.e and o.score >= a.score and (o.s <> a.s or o.e <> a.e or o.score <> a.score))"""


def _ascii(patterns):
    """Patterns of a recognizer as DuckDB reads them."""
    return [(p.replace("(?U)", "").replace("(?iU)", "(?i)").replace(r"(?<!\w)", ""), score) for _, p, score in patterns]


_CALLS = f"select call_id as doc_id, call_transcript as text from ({T.TRANSCRIPTS}) t"
_GT, _DET = f"({T.OCCURRENCES})", f"({T.DETECTIONS})"


def _pairs(mode: str) -> str:
    kinds = " or ".join(f"(d.entity_type = '{k}' and g.type in ({', '.join(repr(x) for x in v)}))" for k, v in COMPATIBLE.items() if v)
    limit = "> 0.1" if mode == "business" else f"> 0.5 and ({kinds})"
    ratio = "(least(g.end_pos, d.end_pos) - greatest(g.start_pos, d.start_pos)) / cast(g.end_pos - g.start_pos as double)"
    return f"select g.call_id, g.type, g.value, g.start_pos, g.end_pos, d.entity_type, d.start_pos as ds, d.end_pos as de, d.text, {ratio} as ratio from {_GT} g join {_DET} d on g.call_id = d.call_id and d.start_pos < g.end_pos and g.start_pos < d.end_pos where {ratio} {limit}"


def _matches_sql(mode: str, digits: int = 6) -> str:
    return f"""
with p as ({_pairs(mode)}), s as (
    select call_id, type, start_pos, end_pos, sum(ratio) as total, string_agg(text, ' + ' order by ds, de, entity_type) as texts, list_aggregate(list_sort(list_distinct(list(entity_type))), 'string_agg', ' + ') as kinds from p group by all
)
select g.call_id, g.value as ground_truth_value, g.type as ground_truth_type, coalesce(s.texts, '') as detected_value, coalesce(s.kinds, '') as detected_type,
    case when s.total is null then 'missed' when s.total > 0.8 then 'exact' else 'partial' end as match_type, round(least(1.0, coalesce(s.total, 0.0)), {digits}) as overlap_ratio, g.start_pos, g.end_pos
from {_GT} g left join s on g.call_id = s.call_id and g.type = s.type and g.start_pos = s.start_pos and g.end_pos = s.end_pos
union all
select d.call_id, '', '', d.text, d.entity_type, 'over_detection', round(d.score, {digits}), d.start_pos, d.end_pos from {_DET} d
where not exists (select 1 from p where p.call_id = d.call_id and p.ds = d.start_pos and p.de = d.end_pos and p.entity_type = d.entity_type)
"""


def _metrics_sql() -> str:
    def chars(table: str) -> str:
        return f"select distinct call_id, unnest(range(start_pos, end_pos)) as c from {table} x"

    return f"""
with m as ({_matches_sql("business", 15)}), n as (
    select call_id, count(*) filter (match_type = 'exact') as exact_matches, count(*) filter (match_type = 'partial') as partial_matches, count(*) filter (match_type = 'missed') as missed,
        count(*) filter (match_type = 'over_detection') as over_detections, count(*) filter (match_type <> 'over_detection') as total_ground_truth,
        count(*) filter (match_type = 'exact') + coalesce(sum(overlap_ratio) filter (match_type = 'partial'), 0) as tp
    from m group by call_id
), gc as ({chars(_GT)}), dc as ({chars(_DET)}), cov as (
    select gc.call_id, count(dc.c) / cast(count(*) as double) as share from gc left join dc on gc.call_id = dc.call_id and gc.c = dc.c group by gc.call_id
), d as (select call_id, count(*) as k from {_DET} d group by call_id), b as (
    select n.*, coalesce(d.k, 0) as total_detected, case when tp + over_detections > 0 then tp / (tp + over_detections) else 0 end as p, case when total_ground_truth > 0 then tp / total_ground_truth else 0 end as r, cov.share
    from n left join d on n.call_id = d.call_id left join cov on n.call_id = cov.call_id
)
select call_id, exact_matches, partial_matches, missed, over_detections, total_ground_truth, total_detected, tp as true_positives, p as "precision", least(1.0, r) as recall, r as raw_recall,
    case when p + least(1.0, r) > 0 then 2 * p * least(1.0, r) / (p + least(1.0, r)) else 0 end as f1_score, share as pii_protection_rate
from b
"""


def _share_sql(a: str, b: str) -> str:
    return f"case when {b} > 0 then {a} / cast({b} as double) else 0.0 end"


def oracle_sql():
    gt = f"select call_id, type, value, start_pos, end_pos from {_GT} g"

    def positions(*types: str) -> str:
        return f"select call_id, type, start_pos, end_pos from {_GT} g where type in ({', '.join(map(repr, types))})"

    def written(column: str) -> str:
        return f"select call_id, {column}_written as result from ({T.SPOKEN}) s"

    def calls(expression: str) -> str:
        return f"select call_id, {expression} as result from ({T.TRANSCRIPTS}) t"

    months = f"(?i)\\b(?:{'|'.join(MONTHS)})\\b"
    ordinals = f"regexp_replace(regexp_replace(%s, '(?i)\\b(?:[1-9]|[12][0-9]|3[01])(?:st|nd|rd|th)\\b', '<GENERIC_NUMBER>', 'g'), '(?i)\\b(?:{'|'.join(ORDINAL_WORDS)})\\b', '<GENERIC_NUMBER>', 'g')"
    custom = "regexp_replace(regexp_replace(%s, '(?i)\\b(?:Kestrel Couriers)\\b', '<ORG>', 'g'), '(?i)\\b(?:agent|customer)\\b', '<ROLE>', 'g')"
    fillers = "trim(regexp_replace(regexp_replace(call_transcript, '(?i)\\b(?:uh|huh|mm+|hmm+|um+)\\b', ' ', 'g'), '\\s{2,}', ' ', 'g'))"
    fields = "replace(replace(replace(call_transcript, member_full_name, '<PERSON>'), case when left(member_mobile, 1) = '+' then call_id || ' is not said' else member_mobile end, '<MOBILE>'), member_address, '<ADDRESS>')"
    fields = f"regexp_replace({fields}, '(?i)\\b' || member_first_name || '\\b', '<PERSON>', 'g')"
    m, x = f"({_matches_sql('business', 15)})", f"({_metrics_sql()})"
    right = f"select d.call_id, d.score, exists (select 1 from ({_pairs('business')}) p where p.call_id = d.call_id and p.ds = d.start_pos and p.de = d.end_pos and p.entity_type = d.entity_type) as ok from {_DET} d"
    sums = "sum(true_positives)", "sum(over_detections)", "sum(missed)"
    p, r = _share_sql(sums[0], f"({sums[0]} + {sums[1]})"), f"least(1.0, {_share_sql(sums[0], f'({sums[0]} + {sums[2]})')})"
    kinds = f"select case when match_type = 'over_detection' then detected_type else ground_truth_type end as entity_type, coalesce(sum(overlap_ratio) filter (match_type in ('exact', 'partial')), 0.0) as tp, count(*) filter (match_type = 'over_detection') as fp, count(*) filter (match_type = 'missed') as fn from {m} m group by 1"
    seq = "row_number() over (order by {0})"
    each = f"select call_id, count(*) as pii_count from {_DET} d group by call_id"
    run = f"select count(*) as total_transcripts, cast(sum(pii_count) as bigint) as total_pii_detected, round_even(avg(pii_count), 2) as avg_pii_per_transcript, round_even(2.5 / count(*), 4) as avg_seconds, printf('%.2f {{}}', 1.0) as x from ({each}) e"
    run = run.replace(", printf('%.2f {}', 1.0) as x", "")
    seconds = "2.5 * 1000000 / total_transcripts"
    words = f"case when {seconds} >= 86400 then printf('%.2f days', {seconds} / 86400) when {seconds} >= 3600 then printf('%.2f hours', {seconds} / 3600) when {seconds} >= 60 then printf('%.2f minutes', {seconds} / 60) else printf('%.4f seconds', {seconds}) end"
    return {
        "detect_email": _found_sql(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}", 1.0),
        "detect_generic_number": _found_sql(r"\b\d{1,16}\b", 0.9),
        "detect_numbers": _spans_sql(_ascii(detect.GENERIC_NUMBER.patterns)),
        "detect_au_address": _spans_sql(_ascii(detect.AU_ADDRESS.patterns), _CALLS),
        "detect_au_phone": _spans_sql(_ascii(detect.AU_PHONE.patterns), _CALLS),
        "detect_member_number": _spans_sql(_ascii(detect.MEMBER_NUMBER.patterns), _CALLS),
        "detect_location": _found_sql(r"\b(?:Sydney|Perth|Adelaide)\b", 0.6, _CALLS),
        "detect_person_rule": f"select call_id as doc_id, 0 as ix, consultant_first_name as text, cast(0.6 as double) as score from ({T.TRANSCRIPTS}) t",
        "redact": r"select doc_id, regexp_replace(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}', '<EMAIL_ADDRESS>', 'g') as anonymized_text from documents",
        "redact_numbers": r"""select doc_id, cast(len(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}')) + len(regexp_extract_all(text, '\b\d{1,16}\b')) as int) as pii_count,
            regexp_replace(regexp_replace(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}', '<EMAIL_ADDRESS>', 'g'), '\b\d{1,16}\b', '<GENERIC_NUMBER>', 'g') as anonymized_text from documents""",
        "pii_types": f"select entity_type, count(*) as n from {_DET} d group by entity_type",
        "sweep_months_documents": f"select doc_id, regexp_replace(text, '{months}', '<MONTH>', 'g') as result from documents",
        "metric_rows": f"select 'run-1' as run_id, x.metric, x.value from (select unnest([{', '.join(f'struct_pack(metric := {chr(39)}{c}{chr(39)}, value := cast({c} as double))' for c in ('total_transcripts', 'total_pii_detected', 'avg_pii_per_transcript', 'avg_seconds', 'total_seconds'))}]) as x from (select *, 2.5 as total_seconds from ({run}) r) q) z",
        "entity_ranking": f"select row_number() over (order by recall desc, entity_type) as place, entity_type, recall from (select entity_type, round({_share_sql('tp', '(tp + fn)')}, 6) as recall from ({kinds}) k) z",
        "confidence_by_text": f"select is_correct, count(*) as n, count(*) filter (score >= 0.8) as high from (select d.score, exists (select 1 from {m} m where m.call_id = d.call_id and m.detected_value = d.text and m.match_type in ('exact', 'partial')) as is_correct from {_DET} d) q group by is_correct",
        "normalize_number_words": written("numbers"), "normalize_separated_chars": written("letters"), "normalize_email": written("mail"), "normalize_text": written("mail"), "remove_fillers": written("fillers"),
        "remove_fillers_transcripts": calls(fillers), "sweep_months": calls(f"regexp_replace(call_transcript, '{months}', '<MONTH>', 'g')"), "sweep_ordinals": calls(ordinals % "call_transcript"), "sweep_custom": calls(custom % "call_transcript"), "sweep_fields": calls(fields),
        "sweep_text": calls(custom % (ordinals % f"regexp_replace(call_transcript, '{months}', '<MONTH>', 'g')")),
        "gt_occurrences": gt, "gt_name_positions": positions("member_first_name", "member_full_name", "consultant_first_name"), "gt_mobile_positions": positions("member_mobile"), "gt_literal_positions": positions("member_email", "member_address", "member_number"),
        "occurrence_breakdown": f"select type, count(*) as occurrences, count(distinct call_id) as transcripts from {_GT} g group by type",
        "match_business": _matches_sql("business"), "match_research": _matches_sql("research"),
        "transcript_metrics": f"select call_id, exact_matches, partial_matches, missed, over_detections, total_ground_truth, total_detected, {', '.join(f'round(\"{c}\", 6) as \"{c}\"' for c in _METRICS)} from {x} x",
        "overall_metrics": f"select total_transcripts, round(a, 6) as total_true_positives, cast(b as bigint) as total_false_positives, cast(c as bigint) as total_false_negatives, round(ap, 6) as avg_precision, round(ar, 6) as avg_recall, round(af, 6) as avg_f1_score, round(ac, 6) as avg_pii_protection_rate, round(p, 6) as overall_precision, round(r, 6) as overall_recall, round({_share_sql('2 * p * r', '(p + r)')}, 6) as overall_f1_score, r >= 0.99 as recall_target_achievement from (select count(*) as total_transcripts, {sums[0]} as a, {sums[1]} as b, {sums[2]} as c, avg(\"precision\") as ap, avg(recall) as ar, avg(f1_score) as af, avg(pii_protection_rate) as ac, {p} as p, {r} as r from {x} x) y",
        "entity_metrics": f"select entity_type, round(tp, 6) as true_positives, fp as false_positives, fn as false_negatives, round(p, 6) as \"precision\", round(r, 6) as recall, round({_share_sql('2 * p * r', '(p + r)')}, 6) as f1_score from (select *, {_share_sql('tp', '(tp + fp)')} as p, {_share_sql('tp', '(tp + fn)')} as r from ({kinds}) k) z",
        **{name: f"select call_id, ground_truth_type, ground_truth_value, detected_type, detected_value, start_pos || '-' || end_pos as position from {m} m where match_type = '{kind}'" for name, kind in (("missed_pii", "missed"), ("over_detections", "over_detection"), ("partial_matches", "partial"))},
        "worst_cases": f"select call_id, round(recall, 6) as recall, missed from {x} x order by round(recall, 6), call_id limit 10",
        "protection_status": f"select case when recall >= 0.9 and \"precision\" >= 0.8 then 'Excellent Protection' when recall >= 0.8 then 'Good Protection' else 'Needs Improvement' end as protection_status, count(*) as n from {x} x group by 1",
        "missed_categories": f"select *, case when total_occurrences > 0 then round(missed_count / cast(total_occurrences as double), 6) end as miss_rate, case when total_occurrences = 0 then null when missed_count / cast(total_occurrences as double) > 0.3 then 'HIGH' when missed_count / cast(total_occurrences as double) > 0.1 then 'MEDIUM' else 'LOW' end as priority from (select case when match_type = 'over_detection' then detected_type else ground_truth_type end as category, count(*) filter (match_type = 'missed') as missed_count, count(*) filter (match_type in ('exact', 'partial')) as detected_count, count(*) filter (match_type <> 'over_detection') as total_occurrences from {m} m group by 1) c",
        "category_examples": f"select m.call_id, m.ground_truth_type as category, m.ground_truth_value as value, substr(t.call_transcript, 1, 200) || '...' as original_text, substr(t.call_transcript, greatest(m.start_pos - 50, 0) + 1, m.end_pos + 50 - greatest(m.start_pos - 50, 0)) as context from {m} m join ({T.TRANSCRIPTS}) t on m.call_id = t.call_id where m.match_type = 'missed'",
        "confidence_buckets": f"select hc as high_confidence_correct, hw as high_confidence_wrong, lc as low_confidence_correct, lw as low_confidence_wrong, n as total_detections, round(a, 6) as avg_confidence, round({_share_sql('hc', '(hc + hw)')}, 6) as high_conf_accuracy, round({_share_sql('lc', '(lc + lw)')}, 6) as low_conf_accuracy from (select count(*) filter (score >= 0.8 and ok) as hc, count(*) filter (score >= 0.8 and not ok) as hw, count(*) filter (score <= 0.5 and ok) as lc, count(*) filter (score <= 0.5 and not ok) as lw, count(*) as n, avg(score) as a from ({right}) q) w",
        "confidence_thresholds": f"select cast(t as double) as threshold, count(*) filter (score >= t) as above_count, count(*) filter (score < t) as below_count, round(count(*) filter (score >= t) / cast(count(*) as double) * 100, 6) as percentage_above from {_DET} d, (select unnest([0.3, 0.5, 0.7, 0.8, 0.9]::double[]) as t) h group by t",
        "count_discrepancy": f"select call_id, type, value, count(*) as found, 1 as expected, count(*) - 1 as discrepancy, count(*) filter (same > 1) as shared_places from (select *, count(*) over (partition by call_id, start_pos, end_pos) as same from {_GT} g) h group by call_id, type, value having count(*) <> 1",
        "run_metrics": f"select *, {words} as estimated_time_for_1m_transcripts, 'Normalization + Detection + Sweeping' as workflow_stages, cast(2.5 as double) as total_seconds from ({run}) r",
        "sequence_id": f"select o_orderkey, {seq.format('o_orderdate, o_orderkey')} as sequence_id from orders",
        "batch_assignment": f"select cast(floor((s - 1) / 100) as bigint) as batch, count(*) as n, min(o_orderkey) as least from (select o_orderkey, {seq.format('o_orderdate, o_orderkey')} as s from orders) o group by 1",
        "chunk_assignment": f"select cast(floor((s - 1) / 1000) as bigint) as chunk, count(*) as n, min(o_orderkey) as first_key, max(o_orderkey) as last_key from (select o_orderkey, {seq.format('o_orderkey')} as s from orders) o group by 1",
        "dynamic_field_mapping": "select c_custkey as id, concat_ws(',', case when c_custkey % 2 = 0 then 'FIRST_NAME_FATHER' end, case when c_custkey % 3 <> 0 then 'FIRST_NAME_MOTHER' end) as first_names, case when c_custkey % 5 = 0 then '' else 'SURNAME_1' end as last_names from customer",
    }
