import glob
import os

import duckdb
import pytest

from veilframe.plans import catalog
from veilframe.sources import io
from veilframe.streaming import transcripts as stream

SF = "/root/testdata/sf0.001"


def value(v):
    return str(round(v, 5)) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    df, r = catalog.queries()[name](spark, SF), con.sql(catalog.oracle_sql()[name])
    cols = sorted(r.columns)
    assert sorted(df.columns) == cols
    want = sorted(tuple(value(dict(zip(r.columns, x))[c]) for c in cols) for x in r.fetchall())
    assert sorted(tuple(value(x[c]) for c in cols) for x in df.collect()) == want and want


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_query_runs(spark, name):
    assert catalog.queries()[name](spark, SF).count() > 0


def test_csv_table_and_metrics(spark, tmp_path):
    df = spark.createDataFrame([("1", 'said "a,b"\nthen', ["x"])], "call_id string, call_transcript string, l array<string>")
    io.write_csv(df, f"{tmp_path}/c")
    assert io.read_csv(spark, f"{tmp_path}/c", None).first().asDict() == {"call_id": "1", "call_transcript": 'said "a,b"\nthen', "l": '["x"]'}
    io.write_table(df.drop("l"), "calls")
    io.write_table(df.drop("l"), "calls", append=True)
    assert io.read_table(spark, "calls").count() == 2
    io.log_metrics(spark.createDataFrame([(1, 0.5, "x")], "a int, b double, c string"), "r", "run_log")
    assert {(r.metric, r.value) for r in io.read_table(spark, "run_log").collect()} == {("a", 1.0), ("b", 0.5)}


def test_stream_equals_batch(spark, tmp_path):
    df = spark.createDataFrame([("1", "born in January uh"), ("2", None)], "call_id string, call_transcript string")
    df.write.parquet(f"{tmp_path}/in")
    q = stream.start(stream.read_stream(spark, f"{tmp_path}/in", df.schema), f"{tmp_path}/out", f"{tmp_path}/cp")
    q.awaitTermination(60)
    assert {(r.call_id, r.anonymized_transcript) for r in spark.read.parquet(f"{tmp_path}/out").collect()} == {("1", "born in <MONTH>"), ("2", None)}


def test_metrics_go_to_a_tracking_server(spark, monkeypatch):
    import contextlib
    import sys
    import types

    said = []
    log = {k: (lambda *a, k=k, **b: said.append((k, *a))) for k in ("set_experiment", "log_metrics", "log_dict")}
    run = lambda run_name: (said.append(("start_run", run_name)), contextlib.nullcontext())[1]
    metrics, sample = spark.createDataFrame([(1, 0.5)], "a int, b double"), spark.range(9).withColumnRenamed("id", "call_id")
    kinds = spark.createDataFrame([("NAME", 3), ("DATE", 1)], "type string, n long")
    for client in (types.SimpleNamespace(**log, start_run=run), None):
        monkeypatch.setitem(sys.modules, "mlflow", client)  # None: not installed
        io.log_metrics(metrics, "r", "tracked", {"pii_types": kinds}, sample)
    assert said[:3] == [("set_experiment", "veilframe"), ("start_run", "r"), ("log_metrics", {"a": 1.0, "b": 0.5})]
    assert said[3] == ("log_dict", {"NAME": 3, "DATE": 1}, "pii_types.json") and said[4][0] == "log_dict" and len(said[4][1]) == 5 and len(said) == 5
    assert spark.table("tracked").count() == 4 and spark.table("tracked_sample").count() == 10
    assert sorted((r.distribution, r["item"], r.n) for r in spark.table("tracked_distributions").collect()) == sorted([("pii_types", "NAME", 3), ("pii_types", "DATE", 1)] * 2)
