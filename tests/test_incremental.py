"""Cleaning in batches, written counts, bitmaps, histograms, skewed joins and owned tables."""

import os
import random

import pytest
from pyspark.sql import functions as F

from attrix import session
from attrix.operators import aggregates as agg
from attrix.operators import window_counts as wc
from attrix.operators.clean import CLEAN_SPECS, clean_report, clean_view
from attrix.operators.clean_store import BUCKET, CleanStore, clean_and_count
from attrix.operators.joins import join_aggregate
from attrix.plans import evaluate as ev
from attrix.plans import features
from attrix.sources import storage
from attrix.sources.fixtures import VIEW_COLUMNS, load_view
from conftest import SF_SMALL


def rows_of(df):
    return sorted(map(repr, df.collect()))


# ------------------------------------------------------------ clean in batches
@pytest.mark.parametrize("view", sorted(VIEW_COLUMNS))
def test_batches_equal_one_load(spark, view):
    """Three batches in any order, one of them twice, end as one full load."""
    rows = load_view(spark, SF_SMALL, view)
    part = F.pmod(F.xxhash64(*rows.columns), F.lit(3))
    store = CleanStore(spark, session.shared_folder(spark, "store"), view, buckets=7)
    assert store.clean() is None
    for k in (2, 0, 1, 0):
        counts = store.merge(rows.filter(part == k))
        assert counts["loaded"] == rows.filter(part == k).count() and counts["not_null"] <= counts["loaded"]
    assert rows_of(store.clean()) == rows_of(clean_view(rows, view))
    again = CleanStore(spark, store.path, view, buckets=99)
    assert again.buckets == 7 and rows_of(again.clean()) == rows_of(store.clean())


def incidents(spark, rows):
    return spark.createDataFrame(rows, "incident_number long, incident_created timestamp_ntz, incident_priority int, "
                                       "incident_customer_finance_ref long, incident_customer_name string")


def test_only_touched_buckets_are_rewritten(spark):
    import datetime as dt

    t = dt.datetime(2020, 1, 1)
    store = CleanStore(spark, session.shared_folder(spark, "store"), "incident", buckets=16)
    store.merge(incidents(spark, [(k, t, 3, k, "b") for k in range(200)]))
    before = store._state()["folders"]
    assert len(before) == 16
    counts = store.merge(incidents(spark, [(5, t, 2, 5, "a"), (5, t, 4, 5, "z"), (None, t, 1, 1, "x")]))
    after = store._state()["folders"]
    assert counts == {"loaded": 3, "not_null": 2, "rewritten": 1}
    assert sum(before[b] != after[b] for b in before) == 1
    assert store.clean().count() == 200 and store.clean().filter("incident_number = 5").first().incident_priority == 2
    assert store.merge(incidents(spark, []))["rewritten"] == 0 and store.clean().count() == 200


@pytest.mark.parametrize("step", ["write_text", "replace"])
def test_an_interrupted_batch_has_not_begun(spark, monkeypatch, step):
    import datetime as dt

    t = dt.datetime(2020, 1, 1)
    store = CleanStore(spark, session.shared_folder(spark, "store"), "incident", buckets=4)
    store.merge(incidents(spark, [(k, t, 3, k, "b") for k in range(50)]))
    before = rows_of(store.clean())
    batch = incidents(spark, [(k, t, 1, k, "a") for k in range(20, 70)])

    def crash(*_):
        raise OSError("the writer died")

    with monkeypatch.context() as broken:
        broken.setattr(storage, step, crash)
        with pytest.raises(OSError, match="died"):
            store.merge(batch)
    assert rows_of(store.clean()) == before
    store.merge(batch)
    assert store.clean().count() == 70 and store.clean().filter("incident_priority = 1").count() == 50


@pytest.mark.parametrize("view", sorted(VIEW_COLUMNS))
def test_written_counts_equal_the_report(spark, view):
    rows = load_view(spark, SF_SMALL, view)
    cleaned, counts = clean_and_count(rows, view, session.shared_folder(spark, "clean"))
    assert rows_of(cleaned) == rows_of(clean_view(rows, view))
    assert rows_of(counts) == rows_of(clean_report(rows, view))
    plan = counts._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    needed = {"incident": [], "ticket": [], "assessment": ["asmt_metric_type"], "orderatom": ["orderatom_cancelation_reason"]}[view]
    schema = plan[plan.index("ReadSchema: "):].split(">")[0]
    assert plan.count("FileScan") == 1 and {c.split(":")[0] for c in schema.split("<")[1].split(",")} == {"_loaded", "_present", *needed}


def test_store_holds_each_key_once(spark):
    rows = load_view(spark, SF_SMALL, "incident")
    store = CleanStore(spark, session.shared_folder(spark, "store"), "incident", buckets=3)
    store.merge(rows)
    keys = CLEAN_SPECS["incident"].key_columns
    assert store.survivors().groupBy(*keys).count().filter("count > 1").count() == 0
    assert BUCKET not in store.survivors().columns


# ------------------------------------------------------------------- bitmaps
def test_bitmaps_equal_distinct_counts(spark):
    """Numbers over several blocks, nulls, repeats; rolled up by day, by customer and over batches."""
    rnd = random.Random(4)
    rows = [(rnd.choice([1, 1, 1, 2, None]), rnd.randint(0, 3), rnd.choice([None, *range(0, 120_000, 997), 7, 32_767, 32_768]))
            for _ in range(4000)]
    df = spark.createDataFrame(rows, "customer long, day int, item long")
    daily = agg.distinct_bitmaps(df, ["customer", "day"], "item")
    want = {}
    for c, d, i in rows:
        if i is not None:
            want.setdefault((c, d), set()).add(i)
    assert {(r.customer, r.day): r.n for r in agg.count_bitmaps(daily, ["customer", "day"], "n").collect()} == {
        k: len(v) for k, v in want.items()}
    halves = [agg.distinct_bitmaps(df.filter(f"day % 2 = {k}"), ["customer"], "item") for k in (0, 1)]
    for merged in (agg.merge_bitmaps(daily, ["customer"]), agg.merge_bitmaps(halves[0].unionByName(halves[1]), ["customer"])):
        assert {r.customer: r.n for r in agg.count_bitmaps(merged, ["customer"], "n").collect()} == {
            c: len({i for c2, _, i in rows if c2 == c and i is not None}) for c in {c for c, _, _ in rows}}


def test_scattered_numbers_cost_a_long_each(spark):
    """Numbers far apart (negative ones too): one fixed-width row each at most, in an aggregate that can spill."""
    items = [k * 40_000 - 5 * 40_000 for k in range(50)] * 2 + [-1, -64, -65, 63, 64]
    df = spark.createDataFrame([(k % 3, i) for k, i in enumerate(items)], "customer int, item long")
    bitmaps = agg.distinct_bitmaps(df, ["customer"], "item")
    assert dict(bitmaps.dtypes)["_bitmap"] == "bigint" and bitmaps.count() <= df.distinct().count()
    for frame in (bitmaps, agg.merge_bitmaps(bitmaps, ["customer"])):
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert "HashAggregate" in plan and "SortAggregate" not in plan and "ObjectHashAggregate" not in plan
    totals = agg.count_bitmaps(agg.merge_bitmaps(bitmaps, []), [], "n")
    assert totals.first().n == len(set(items))


# ---------------------------------------------------------------- histograms
@pytest.mark.parametrize("bins", [4, 64, ev.HISTOGRAM_BINS])
def test_histogram_bounds_hold_the_exact_area(spark, bins):
    rnd = random.Random(bins)
    rows = [(m, y, min(1.0, max(0.0, rnd.gauss(0.4 + 0.1 * y, 0.2)))) for m in ("a", "b") for y in [0, 0, 1] * 300]
    rows += [("c", 1, 0.3)]  # one class only
    df = spark.createDataFrame(rows, "model string, cancelled int, probability double")
    parts = [ev.score_histogram(df.filter(F.rand(1) < 0.5), bins=bins, by=["model"]),
             ev.score_histogram(df.filter(F.rand(1) >= 0.5), bins=bins, by=["model"])]
    for histogram in (ev.score_histogram(df, bins=bins, by=["model"]), ev.merge_histograms(*parts)):
        exact = {r.model: r.auc for r in ev.auc_exact(df, score="probability", by=["model"]).collect()}
        for r in ev.auc_bounds(histogram, by=["model"]).collect():
            if r.model == "c":
                assert r.auc is None and exact["c"] is None
            else:
                assert r.auc_low <= exact[r.model] <= r.auc_high
                assert abs(r.auc - exact[r.model]) <= (r.auc_high - r.auc_low) / 2 + 1e-6
    with pytest.raises(Exception, match="null or NaN"):
        ev.score_histogram(spark.createDataFrame([(1, None)], "cancelled int, probability double")).collect()


def test_histogram_of_a_stream_equals_the_batch(spark):
    rows = spark.range(2000).selectExpr("id", "CAST(id % 3 = 0 AS int) AS cancelled", "(id * 37 % 1000) / 1000.0 AS probability")
    folder = session.shared_folder(spark, "stream")
    for k in range(3):
        rows.filter(f"id % 3 = {k}").coalesce(1).write.mode("append").parquet(f"{folder}/in")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    query = (ev.score_histogram(stream, bins=32).writeStream.format("memory").queryName("bins").outputMode("complete")
             .option("checkpointLocation", f"{folder}/ckpt").trigger(availableNow=True).start())
    query.awaitTermination(120)
    assert rows_of(spark.sql("SELECT * FROM bins")) == rows_of(ev.score_histogram(rows, bins=32))


def test_curves_of_several_models_in_one_pass(spark):
    rnd = random.Random(3)
    rows = [(m, rnd.randint(0, 1), float(rnd.randint(0, 30))) for m in ("a", "b", "c") for _ in range(400)]
    df = spark.createDataFrame(rows, "model string, cancelled int, score double")
    curves = {}
    for r in ev.roc_curves(df, ["model"], ranges=5).collect():
        curves.setdefault(r.model, []).append((r.accepted, r.fpr, r.tpr))
    areas = {r.model: r.auc for r in ev.auc_exact(df, by=["model"], ranges=5).collect()}
    for m in "abc":
        alone = df.filter(F.col("model") == m)
        assert areas[m] == ev.auc_exact(alone).first().auc
        points = sorted(curves[m])
        assert points[0] == (0, 0.0, 0.0) and points[-1] == (400, 1.0, 1.0)
        assert sorted((f, t) for _, f, t in points[1:]) == sorted((r.fpr, r.tpr) for r in ev.roc_points(alone).collect())


# --------------------------------------------------------------- skewed joins
TIGHT = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
         "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k",
         "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64k",
         "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2"}


@pytest.fixture
def tight(spark):
    before = {k: spark.conf.get(k, None) for k in TIGHT}
    for k, v in TIGHT.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def hot_frames(spark, n=40_000, days=1):
    """90% of the order atoms and incidents on one customer and one of ``days`` install dates."""
    customer = "CASE WHEN id % 10 < 9 THEN 1 ELSE id END"
    atoms = spark.range(n).selectExpr(
        "id AS orderatom_orderatomid", f"{customer} AS customer_finance_ref", "uuid() AS filler",
        f"timestamp_ntz'2020-01-01 00:00:00' + make_interval(0, 0, 0, CAST(id % {days} AS int)) AS orderatom_dateinstalled",
        "CAST(timestamp_ntz'2020-06-01 00:00:00' AS timestamp_ntz) AS orderatom_canceldate")
    found = spark.range(n // 4).selectExpr(
        "id AS incident_number", f"{customer} AS incident_customer_finance_ref", "CAST(id % 5 + 1 AS int) AS incident_priority",
        "timestamp_ntz'2020-01-02 00:00:00' + make_interval(0, 0, 0, CAST(id % 90 AS int)) AS incident_created")
    return atoms, found


def split(frame):
    frame.collect()
    return "skew=true" in frame._jdf.queryExecution().executedPlan().toString()


def test_hot_customer_and_day_are_split(spark, tight):
    """90% of the order atoms share customer and install date."""
    atoms, found = hot_frames(spark)
    counted = wc.add_priority_counts(atoms, found)
    assert split(counted)
    hot = counted.filter("customer_finance_ref = 1").first()
    assert hot.number_p1_incidents == found.filter("incident_customer_finance_ref = 1 and incident_priority = 1").count()
    assert hot.number_p1_incidents_50_days == found.filter(
        "incident_customer_finance_ref = 1 and incident_priority = 1 and incident_created <= timestamp_ntz'2020-02-20 00:00:00'").count()


def test_hot_customer_is_split_in_every_count(spark, tight):
    """J4, J5, A5, P14."""
    atoms, found = hot_frames(spark, days=50)
    per_customer = agg.incidents_per_customer(found)
    assert split(wc.incident_partners(atoms, found))
    assert split(wc.add_priority_counts(atoms, found, windows=(0,)))
    assert split(wc.incidents_before_cancel(atoms, found))
    joined = join_aggregate(atoms, per_customer, ["customer_finance_ref", "incident_customer_finance_ref"])
    assert split(joined) and joined.count() == atoms.count()


# -------------------------------------------------------------- owned tables
def exists(path):
    return os.path.exists(path.removeprefix("file:"))


def test_tables_go_with_their_owner(spark):
    with session.owned_tables(spark):
        outer = session.shared_table(spark.range(5), "outer")
        with session.owned_tables(spark):
            inner = session.shared_table(spark.range(6), "inner")
            files = inner.inputFiles()[0]
            assert inner.count() == 6
        assert not exists(files.replace("file://", "")) and outer.count() == 5
        kept = outer.inputFiles()[0].replace("file://", "")
    assert not exists(kept)


def test_only_the_result_remains(spark):
    made = []

    def build():
        made.append(session.shared_table(spark.range(100), "step").inputFiles()[0].replace("file://", ""))
        return spark.read.parquet(os.path.dirname(made[0])).selectExpr("sum(id) AS s")

    out = session.settled(spark, build)
    assert out.first().s == 4950 and not exists(made[0]) and exists(out.inputFiles()[0].replace("file://", ""))


def test_a_failed_step_leaves_nothing(spark):
    path = []
    with pytest.raises(ValueError):
        with session.owned_tables(spark):
            path.append(session.shared_table(spark.range(5)).inputFiles()[0].replace("file://", ""))
            raise ValueError
    assert not exists(path[0])


# ------------------------------------------------------------ bucketed tables
@pytest.mark.parametrize("support", [0.001, 0.3, 0.99])
def test_bucketed_join_equals_the_plain_one(spark, support):
    """Whether the hot customer is kept apart or not, in one table or both."""
    from attrix.operators.bucketed import BucketedTables

    atoms, found = hot_frames(spark, 3000)
    atoms = atoms.drop("filler").unionByName(atoms.drop("filler").limit(1).withColumn("customer_finance_ref", F.lit(None).cast("long")))
    stored = BucketedTables(spark, {"atoms": (atoms, "customer_finance_ref"), "found": (found, "incident_customer_finance_ref")},
                            support, buckets=4)
    counts = lambda df, key: df.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.max("incident_number").alias("last"))
    got = stored.join_aggregate("atoms", "found", counts)
    want = atoms.join(counts(found, "incident_customer_finance_ref"),
                      F.col("customer_finance_ref") == F.col("incident_customer_finance_ref"), "left_outer")
    assert rows_of(got) == rows_of(want.select(*got.columns))
    hot = {r.key for r in stored.hot_keys.collect()}
    assert hot == set() if support == 0.99 else hot == {1} if support == 0.3 else 1 in hot
    stored.drop()


def test_buckets_are_read_without_an_exchange(spark):
    from attrix.operators.bucketed import BucketedTables

    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        atoms, found = hot_frames(spark, 3000)
        stored = BucketedTables(spark, {"atoms": (atoms, "customer_finance_ref"), "found": (found, "incident_customer_finance_ref")},
                                buckets=8)
        per_key = stored.spread("found").groupBy("incident_customer_finance_ref").count()
        joined = stored.spread("atoms").join(per_key, F.col("customer_finance_ref") == F.col("incident_customer_finance_ref"))
        joined.collect()
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan
        stored.drop()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_full_frame_cleans_each_view_once(spark, monkeypatch):
    """With the window counts, incidents and order atoms are read twice, but cleaned into one table each."""
    cleaned = []
    monkeypatch.setattr(features, "shared_table", lambda df, name="table": cleaned.append(name) or session.shared_table(df, name))
    src = features.load_clean_sources(spark, SF_SMALL)
    full = features.analysis_frame(src, features.DEFAULT_ANALYSIS_DATE, priority_counts=True)
    assert sorted(cleaned) == ["clean-incident", "clean-orderatom", "customers"]
    assert "_survivor" not in full._jdf.queryExecution().optimizedPlan().toString()
    assert full.count() == src.orderatom.count()
