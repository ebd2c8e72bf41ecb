"""Stored log and versions of models: pruning, writing again, looking back."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tally.errors import ModelNotFoundError
from tally.operators import categorize as C
from tally.operators.listing import log_query
from tally.plans import jobs
from tally.session import scratch_path
from tally.sources import logstore as LOGSTORE
from tally.sources import models as MODELS
from tally.sources import testviews as tv
from tests.conftest import SF001, SF01


def _log(spark):
    t0 = datetime(2024, 1, 1)
    rows = [(t0 + timedelta(hours=7 * i), "ERROR" if i % 5 == 0 else "INFO", f"m{i}", str(i % 3), None) for i in range(200)]
    rows += [(None, "ERROR", f"untimed {i}", "1", None) for i in range(3)]
    return spark.createDataFrame(rows, LOGSTORE.SCHEMA)


def _messages(df):
    return [r.message for r in df.collect()]


def test_log_store_agrees_with_the_flat_log(spark):
    log, path = _log(spark), scratch_path(spark, "t-log")
    for batch, rows in (("a", log.where("level = 'INFO'")), ("b", log.where("level = 'ERROR'")),
                        ("a", log.where("level = 'INFO'"))):  # written again
        LOGSTORE.add(rows.withColumn("extra", F.lit(1)), path, batch)
    assert LOGSTORE.read(spark, path).count() == 203
    for kw in ({}, {"level": "error"}, {"start": "2024-01-10", "end": "2024-01-20"}, {"end": "2024-01-03", "level": "info"},
               {"account_id": 1, "start": "2024-02-20"}, {"start": "2025-01-01"}):
        for limit in (0, 7, 1000):
            assert _messages(LOGSTORE.query(spark, path, limit=limit, **kw)) == _messages(log_query(log, limit=limit, **kw)), (kw, limit)
    with pytest.raises(ValueError):
        LOGSTORE.query(spark, path, limit=-1)
    with pytest.raises(ValueError):
        LOGSTORE.add(log, path, "a/b")


def test_log_store_reads_the_days_it_needs(spark):
    path = scratch_path(spark, "t-log-days")
    LOGSTORE.add(_log(spark), path, "a")
    newest = LOGSTORE.days(spark, path)
    assert newest[0] == "2024-02-28" and newest[-1] == LOGSTORE.NO_DAY
    last = LOGSTORE.query(spark, path, limit=1)
    plan = last._jdf.queryExecution().executedPlan().toString()
    pruned = plan.split("PartitionFilters: [")[1].split("]")[0]
    assert "log_day" in pruned and newest[1] not in pruned and newest[0] in pruned
    ranged = LOGSTORE.query(spark, path, start="2024-01-05", end="2024-01-06", limit=1000)
    plan = ranged._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "log_day" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_an_empty_log_store(spark):
    path = scratch_path(spark, "t-log-none")
    assert LOGSTORE.query(spark, path).count() == 0 and LOGSTORE.total(spark, path).first().total == 0
    LOGSTORE.add(_log(spark).limit(0), path, "a")
    assert LOGSTORE.query(spark, path).count() == 0


def _models(spark, *ids, slope=1.0):
    rows = [(i, 1, "trained" if i != "x" else "insufficient_data", slope) for i in ids]
    return spark.createDataFrame(rows, "account_id string, user_id bigint, status string, slope double")


def _force(spark, path, at):
    return {r.account_id: r.slope for r in MODELS.as_of(spark, path, at).collect()}


def test_models_as_of(spark):
    path = scratch_path(spark, "t-models")
    assert MODELS.as_of(spark, path).count() == 0
    for _ in range(2):  # the second writes the same version again
        MODELS.record(_models(spark, "a", "b", "x", slope=1.0), path, "2024-01-01")
    MODELS.record(_models(spark, "a", "x", slope=2.0), path, "2024-02-01 08:00:00")
    MODELS.forget(spark.createDataFrame([("b",), ("b",), (None,), ("unknown",)], "account_id string"), path, "2024-03-01")
    MODELS.record(_models(spark, "b", slope=3.0), path, "2024-04-01")
    assert _force(spark, path, "2023-12-31") == {}
    assert _force(spark, path, "2024-01-01") == {"a": 1.0, "b": 1.0}
    assert _force(spark, path, "2024-02-01") == {"a": 1.0, "b": 1.0}
    assert _force(spark, path, "2024-02-01 08:00:00") == {"a": 2.0, "b": 1.0}
    assert _force(spark, path, "2024-03-01") == {"a": 2.0}
    assert _force(spark, path, None) == {"a": 2.0, "b": 3.0}
    assert MODELS.as_of(spark, path).count() == 2
    early = MODELS.as_of(spark, path, "2024-01-15")
    plan = early._jdf.queryExecution().executedPlan().toString()
    assert "version" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_versioned_jobs(spark):
    led, acc = tv.transactions(spark, SF001), tv.accounts(spark, SF001)
    store = scratch_path(spark, "t-store")
    n = {r.status: r.accounts for r in jobs.retrain_versions(spark, led, acc, store, "1998-01-01").collect()}
    again = {r.status: r.accounts for r in jobs.retrain_versions(spark, led, acc, store, "1998-01-01").collect()}
    assert n == again and sum(n.values()) == acc.count() and n["trained"] > 0
    per = jobs.run_forecasts(spark, store, scratch_path(spark, "t-fc"), 5, at="1998-06-01").collect()
    assert len(per) == n["trained"] and all(r.points == 5 for r in per)
    assert jobs.run_forecasts(spark, store, scratch_path(spark, "t-fc0"), 5, at="1997-06-01").count() == 0
    gone = acc.limit(1).select("account_id").collect()[0][0]
    MODELS.forget(acc.where(F.col("account_id") == gone), store, "1998-02-01")
    for _ in range(2):
        got = MODELS.lazy_fit(spark, acc, store, led, acc, "1998-03-01")
        assert got.count() == n["trained"]
    assert [str(r.trained_at)[:10] for r in got.where(F.col("account_id") == gone).collect()] == ["1998-03-01"]


def test_text_model_versions(spark):
    path = scratch_path(spark, "t-text")
    rows = spark.createDataFrame([("red apple", "A"), ("green pear", "B")] * 3, "description string, category string")
    with pytest.raises(ModelNotFoundError):
        C.text_model_as_of(path)
    C.record_text_model(C.train_text_model(rows, max_iter=3), path, MODELS.version_of("2024-01-01"))
    other = rows.withColumn("category", F.concat(F.lit("new "), "category"))
    C.record_text_model(C.train_text_model(other, max_iter=3), path, MODELS.version_of("2024-06-01"))
    assert C.model_classes(C.text_model_as_of(path, MODELS.version_of("2024-03-01"))) == ["A", "B"]
    assert C.model_classes(C.text_model_as_of(path)) == ["new A", "new B"]
    with pytest.raises(ModelNotFoundError):
        C.text_model_as_of(path, MODELS.version_of("2023-01-01"))


def test_tree_model_sees_words_together(spark):
    pairs = [("red ring", "A"), ("blue bolt", "A"), ("red bolt", "B"), ("blue ring", "B"), ("red", "C")]
    rows = spark.createDataFrame([p for p in pairs for _ in range(8)], "description string, category string")
    path = scratch_path(spark, "t-trees")
    C.train_tree_model(rows, rounds=4, depth=3).write().save(path)
    model = C.load_model(path)
    asked = spark.createDataFrame([(t,) for t, _ in pairs] + [(None,), ("",), ("word unseen",)], "description string")
    got = model.transform(asked.withColumn(C.MODEL_INPUT, F.coalesce("description", F.lit(""))))
    assert {r.description: r.model_category for r in got.collect() if r.description in dict(pairs)} == dict(pairs)
    assert got.where(F.col("model_category").isNull()).count() == 0
    assert "BatchEvalPython" not in got._jdf.queryExecution().executedPlan().toString()


def test_one_category_only(spark):
    rows = spark.createDataFrame([("a b", "A"), ("c", "A"), (None, "A")], "description string, category string")
    for train in (C.train_text_model, C.train_tree_model):
        assert C.model_classes(train(rows)) == ["A"]


def test_held_out_accuracy_of_the_text_model(spark):
    docs = C.check_labels(tv.labelled_text(spark, SF01)).withColumn("held", F.pmod(F.xxhash64("description"), F.lit(5)) == 0)
    model = C.train_text_model(docs.where(~F.col("held")))
    got = model.transform(docs.where("held").withColumn(C.MODEL_INPUT, F.col("description")))
    assert got.agg(F.avg((F.col("model_category") == F.col("category")).cast("int"))).first()[0] >= 0.9
