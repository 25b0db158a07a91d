import pytest

from veilframe.functions import rewrite as R
from veilframe.operators import detect
from veilframe.plans import catalog
from veilframe.plans import transcripts as T

SF = "/root/testdata/sf0.001"


def planned(spark, name):
    return catalog.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


def test_examples_compute_the_matches_once(spark):
    assert "size(concat(" not in planned(spark, "category_examples").replace(" ", "")


@pytest.mark.parametrize("name", ["confidence_buckets", "confidence_by_text"])
def test_texts_are_neither_broadcast_nor_shuffled(spark, name):
    plan = planned(spark, name)
    dealt = [x for x in plan.split("\n") if "Exchange " in x and "SinglePartition" not in x and "(is_correct" not in x]
    assert "Broadcast" not in plan and dealt and all("cast(c_custkey" in x and "REPARTITION_BY_NUM" in x for x in dealt)


def test_partitions_grow_with_the_keys(spark, monkeypatch):
    monkeypatch.setattr(T, "KEYS", 10)
    assert T.transcripts(spark, SF).rdd.getNumPartitions() == 15


def test_detections_in_place_are_those_of_the_sql(spark, tmp_path):
    """Also of keys that are there more than once, which the SQL joins with each other, and of none."""
    spark.range(40).selectExpr("case when id < 36 then id % 33 when id < 39 then 7 end as c_custkey").write.parquet(f"{tmp_path}/customer.parquet")
    want = spark.sql(T.DETECTIONS.replace("from customer", "from {customer}"), customer=spark.read.parquet(f"{tmp_path}/customer.parquet"))
    got = T.detections(spark, str(tmp_path))
    assert got.dtypes == want.dtypes and sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


@pytest.mark.parametrize("name,most", [("evaluate", 100), ("entity_metrics", 50), ("worst_cases", 50), ("entity_ranking", 50), ("missed_categories", 50), ("missed_pii", 50), ("process_dataset_baseline", 35), ("transcript_metrics", 50), ("overall_metrics", 50), ("partial_matches", 50), ("over_detections", 50), ("match_research", 50), ("count_discrepancy", 50), ("protection_status", 50), ("occurrence_breakdown", 50), ("match_business", 50), ("process_dataset", 75), ("pipeline_full", 70)])
def test_texts_are_scanned_few_times(spark, name, most):
    """Each pattern of a plan reads every text: the time of these queries grows with their number."""
    plan = planned(spark, name)
    assert plan.count("regexp_replace(") + plan.count("RLIKE") <= most and "Broadcast" not in plan


@pytest.mark.parametrize("text,want", [("one two  three, four", "123, 4"), ("twenty\u00a0one tones", "201 tones"), ("\u017fix \u0131 s\u0131x S\u0130X", "6 \u0131 66"), ("no \ue000 words", "no \ue000 words"), (" seven ", " 7 ")])
def test_number_words_in_one_pass(spark, text, want):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(R.normalize_number_words(df.t)).first()[0] == want


def test_addresses_that_follow_each_other(spark):
    r = detect.detect_and_redact(spark.createDataFrame([("a@b.co1x@c.de,y@z.org",)], "call_transcript string"), recognizers=[detect.EMAIL]).first()
    assert [(d.start, d.end, d.text) for d in r.pii_detections] == [(0, 6, "a@b.co"), (6, 13, "1x@c.de"), (14, 21, "y@z.org")]


@pytest.mark.parametrize("name", ["confidence_thresholds", "pii_types"])
def test_rows_of_a_partition_have_a_bound(spark, monkeypatch, name):
    """No step puts texts or detections into as few partitions as there are cores, whatever their number."""
    monkeypatch.setattr(T, "KEYS", 10)
    dealt = [x for x in planned(spark, name).split("\n") if "Exchange hashpartitioning" in x and "REPARTITION_BY_NUM" in x]
    assert dealt and all("(cast(c_custkey" in x and "15), REPARTITION_BY_NUM" in x for x in dealt)
