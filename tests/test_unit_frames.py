"""Layer 2: small literal frames for the edge cases of each operator."""

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from attrix.functions import cancel_label, days_since, percent_label, safe_ratio
from attrix.operators import (clean_report, drop_duplicate_rows, filter_not_equals,
                              filter_valid_priority, join_on_keys, sum_per_key)
from attrix.operators.window_counts import priority_window_counts
from attrix.plans.ml import hash_bucket, scale_features


def test_not_equals_rejects_null(spark):
    df = spark.createDataFrame([("a",), ("b",), (None,)], "r string")
    assert [r.r for r in filter_not_equals(df, "r", "a").collect()] == ["b"]
    kept = {r.r for r in filter_not_equals(df, "r", "a", keep_null=True).collect()}
    assert kept == {"b", None}


def test_label_null_reason_is_zero(spark):
    df = spark.createDataFrame(
        [("cancelled", None, dt.datetime(2024, 1, 1)), ("cancelled", "x", dt.datetime(2024, 1, 1)),
         ("cancelled", "Service Replaced", dt.datetime(2024, 1, 1)), ("cancelled", "x", None),
         ("active", "x", dt.datetime(2024, 1, 1))],
        "orderatom_state string, orderatom_cancelation_reason string, orderatom_canceldate timestamp_ntz")
    assert [r.c for r in df.select(cancel_label().alias("c")).collect()] == [0, 1, 0, 0, 0]


def test_days_since_fixed_date(spark):
    df = spark.createDataFrame([(dt.datetime(2001, 12, 31, 23, 0),)], "d timestamp_ntz")
    assert df.select(days_since("d", "2002-01-01").alias("x")).first().x == 1


def test_window_edges(spark):
    """installed 15:00; bound is midnight of day +10: 00:00 in, 00:01 out, earlier same day out."""
    oa = spark.createDataFrame([(1, dt.datetime(2024, 1, 1, 15, 0))],
                               "customer_finance_ref long, orderatom_dateinstalled timestamp_ntz")
    inc = spark.createDataFrame(
        [(1, dt.datetime(2024, 1, 11, 0, 0), 1), (1, dt.datetime(2024, 1, 11, 0, 1), 2),
         (1, dt.datetime(2024, 1, 1, 9, 0), 3), (1, dt.datetime(2024, 1, 1, 15, 0), 4)],
        "incident_customer_finance_ref long, incident_created timestamp_ntz, incident_priority int")
    row = priority_window_counts(oa, inc, priorities=(1, 2, 3, 4), windows=(10,)).first()
    assert row["number_p1_incidents_10_days"] == 1      # exactly at the midnight bound
    assert row["number_p2_incidents_10_days"] == 0      # one minute later
    assert row["number_p3_incidents_10_days"] == 0      # before installation
    assert row["number_p4_incidents_10_days"] == 1      # at installation time


def test_sum_of_nulls_then_fill(spark):
    df = spark.createDataFrame([(1, None)], "k long, v double")
    s = sum_per_key(df, "k", "v", "score")
    assert s.first().score is None
    assert s.fillna(0).first().score == 0.0


def test_fill_numeric_only(spark):
    df = spark.createDataFrame([(None, None, None, None, None)],
                               "i int, d double, m decimal(10,2), s string, b boolean")
    r = df.fillna(0).first()
    assert (r.i, r.d, r.m, r.s, r.b) == (0, 0.0, Decimal("0.00"), None, None)


def test_ratio_zero_denominator(spark):
    df = spark.createDataFrame([(0, 0)], "tp long, fp long")
    assert df.select(safe_ratio("tp", F.col("tp") + F.col("fp")).alias("p")).first().p == 0.0


def test_scale_sample_std_no_centering(spark):
    df = spark.createDataFrame([(Vectors.dense([1.0, 2.0]),), (Vectors.dense([1.0, 3.0]),)], ["v"])
    out = sorted(tuple(r.v_scaled.toArray()) for r in scale_features(df, "v").collect())
    assert [round(x, 4) for x in out[0]] == [0.0, 2.8284]
    assert [round(x, 4) for x in out[1]] == [0.0, 4.2426]


def test_same_key_join_keeps_one_key(spark):
    left = spark.createDataFrame([(1,), (2,)], "k long")
    right = spark.createDataFrame([(1, "x")], "k long, v string")
    out = join_on_keys(left, right, ["k", "k"], "left_outer")
    assert out.columns == ["k", "v"]
    assert sorted(out.collect(), key=lambda r: r.k) == [(1, "x"), (2, None)]


def test_different_key_join_keeps_both(spark):
    left = spark.createDataFrame([(1,), (2,)], "a long")
    right = spark.createDataFrame([(1, "x")], "b long, v string")
    out = join_on_keys(left, right, ["a", "b"], "inner")
    assert out.columns == ["a", "b", "v"] and out.count() == 1


def test_dedupe_survivor_is_stable_across_partitionings(spark):
    rows = [(k % 7, None if k % 5 == 0 else k % 3, f"n{k % 4}") for k in range(200)]
    df = spark.createDataFrame(rows, "key long, p int, name string")
    a = drop_duplicate_rows(df.repartition(1), ["key"]).orderBy("key").collect()
    b = drop_duplicate_rows(df.repartition(9), ["key"]).orderBy("key").collect()
    assert a == b
    # survivor = smallest (p, name) with nulls first
    expect = {}
    for k, p, n in rows:
        cand = (p is not None, p or 0, n)
        if k not in expect or cand < expect[k][0]:
            expect[k] = (cand, (k, p, n))
    assert [tuple(r) for r in a] == [expect[k][1] for k in sorted(expect)]


def test_valid_priority_try_cast(spark):
    df = spark.createDataFrame([("1",), ("5",), ("9",), ("3 - Moderate",), (None,)], "incident_priority string")
    assert [r[0] for r in filter_valid_priority(df).collect()] == ["1", "5"]


def test_clean_report_stages(spark):
    df = spark.createDataFrame([(1, 10), (1, 11), (2, None), (None, 5)],
                               "csi_ticket_sys_id long, csi_ticket_customer_finance_ref long")
    rep = {r.stage: r.row_count for r in clean_report(df, "ticket").collect()}
    assert rep == {"loaded": 4, "not_null": 3, "deduplicated": 2}


def test_percent_label_half_up(spark):
    df = spark.createDataFrame([(1, 8), (1, 3), (2, 3), (0, 5), (1, 800)], "c long, t long")
    got = [r.p for r in df.select(percent_label("c", "t").alias("p")).collect()]
    assert got == ["12.50%", "33.33%", "66.67%", "0.00%", "0.13%"]


def test_hash_bucket_is_deterministic(spark):
    df = spark.createDataFrame([(i,) for i in range(1000)], "k long")
    a = [r.b for r in df.select(hash_bucket("k", 7).alias("b")).collect()]
    b = [r.b for r in df.repartition(5).orderBy("k").select(hash_bucket("k", 7).alias("b")).collect()]
    assert a == b and all(0 <= x < 1000 for x in a)


def test_jdbc_derived_table_and_bounds():
    import pytest
    from attrix.sources.jdbc import as_derived_table, read_jdbc_query
    assert as_derived_table("select a from t", "x") == "(select a from t) as x"
    assert as_derived_table("(select a from t) as x", "x") == "(select a from t) as x"
    with pytest.raises(ValueError):
        read_jdbc_query(None, "jdbc:none", "select 1", {}, partition_column="id", lower_bound=0)


def test_model_path_is_name_then_utc_stamp():
    from attrix.sources.models import model_path
    when = dt.datetime(2025, 3, 4, 5, 6, 7, tzinfo=dt.timezone.utc)
    assert model_path("s3a://bucket/models/", "lr", when) == "s3a://bucket/models/lr/2025-03-04-050607-000000"


def test_fractional_priorities_are_invalid(spark):
    df = spark.createDataFrame([("1",), ("2.5",), ("5.9",), ("5.0",), ("0",)], "incident_priority string")
    assert [r[0] for r in filter_valid_priority(df).collect()] == ["1", "5.0"]


def test_tenure_runs_to_today_by_default(spark):
    import datetime

    from attrix.functions.expressions import days_since
    day = datetime.date.today() - datetime.timedelta(days=40)
    df = spark.createDataFrame([(day,)], "d date")
    assert df.select(days_since("d")).first()[0] in (39, 40, 41)


def test_jdbc_reads_must_say_how_they_split(spark):
    from attrix.sources.jdbc import read_jdbc_query
    for options in ({}, {"partition_column": "d"}, {"partition_column": "d", "single_partition": True}, {"predicates": []}):
        with pytest.raises(ValueError):
            read_jdbc_query(spark, "jdbc:none:", "select 1", {}, **options)


def test_clean_report_scans_each_source_once(spark):
    from attrix.operators.clean import CLEAN_SPECS, clean_report
    from attrix.sources.fixtures import read_table
    orders = read_table(spark, "/root/testdata/sf0.001", "orders")
    df = orders.selectExpr("o_orderkey as order_orderid", "o_orderdate as order_orderdate", "o_custkey as customer_finance_ref",
                           "o_orderkey as orderatom_orderatomid", "o_comment as orderatom_cancelation_reason") \
        if "o_comment" in orders.columns else None
    if df is None:
        df = orders.selectExpr("o_orderkey as order_orderid", "o_orderdate as order_orderdate",
                               "o_custkey as customer_finance_ref", "o_orderkey as orderatom_orderatomid",
                               "o_orderstatus as orderatom_cancelation_reason")
    plan = clean_report(df, "orderatom")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan parquet") == 1 and CLEAN_SPECS["orderatom"].post_filter is not None


def test_hot_customer_join_is_split(spark):
    """A customer with most order atoms meets one written table, so adaptive execution splits the join."""
    from attrix.plans.features import CleanSources, analysis_frame
    n = 40_000
    customer = "CASE WHEN id % 10 < 9 THEN 1 ELSE id END"
    frames = {
        "orderatom": spark.range(n).selectExpr(
            "id AS order_orderid", "timestamp_ntz'2020-01-01 00:00:00' AS order_orderdate", f"{customer} AS customer_finance_ref",
            "id AS orderatom_orderatomid", "'active' AS orderatom_state", "timestamp_ntz'2020-01-01 00:00:00' AS orderatom_dateinstalled",
            "CAST(NULL AS timestamp_ntz) AS orderatom_canceldate", "'' AS orderatom_cancelation_reason", "uuid() AS customer_name"),
        "ticket": spark.range(n).selectExpr("id AS csi_ticket_sys_id", f"{customer} AS csi_ticket_customer_finance_ref"),
        "assessment": spark.range(n).selectExpr(
            "id AS asmt_result_sys_id", "'Customer Relationship Survey' AS asmt_metric_type", "1.5 AS asmt_result_actual_value",
            f"{customer} AS asmt_customer_finance_ref"),
        "incident": spark.range(n).selectExpr(
            "id AS incident_number", "timestamp_ntz'2020-01-02 00:00:00' AS incident_created", "1 AS incident_priority",
            f"{customer} AS incident_customer_finance_ref"),
    }
    tight = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
             "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k",
             "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64k",
             "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2"}
    before = {k: spark.conf.get(k, None) for k in tight}
    try:
        for k, v in tight.items():
            spark.conf.set(k, v)
        frame = analysis_frame(CleanSources({k: (lambda df=df: df) for k, df in frames.items()}))
        rows = frame.groupBy("customer_finance_ref").agg(F.max("number_incidents").alias("n"), F.max("crs_score").alias("s"))
        assert frame.write.format("noop").mode("overwrite").save() is None
        hot = rows.filter("customer_finance_ref = 1").first()
        assert (hot.n, hot.s) == (n * 9 // 10, n * 9 // 10 * 1.5)
        frame.collect()
        assert "skew=true" in frame._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_shared_tables_are_released(spark):
    from attrix import session
    session.shared_table(spark.range(5), "t")
    path = session._written[-1]
    assert session.release_shared_tables(spark) >= 1 and not session._written
    import os
    assert not os.path.exists(path.removeprefix("file:"))
