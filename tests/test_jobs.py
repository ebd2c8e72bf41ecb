from tally.plans import jobs
from tally.session import scratch_path
from tally.sources import ledger as LG
from tally.sources import testviews as tv
from tests.conftest import SF001


def test_timed_jobs(spark):
    led_path = scratch_path(spark, "j-led")
    LG.write_snapshot(tv.transactions(spark, SF001), led_path)
    led = LG.read_ledger(spark, led_path)
    acc = tv.accounts(spark, SF001)
    models = scratch_path(spark, "j-models")
    st = {r.status: r.accounts for r in jobs.retrain_forecasters(spark, led, acc, models).collect()}
    assert st == {"trained": 10}
    per = jobs.run_forecasts(spark, models, scratch_path(spark, "j-fc"), 7).collect()
    assert len(per) == 10 and all(r.points == 7 for r in per)
    out = scratch_path(spark, "j-clean")
    rep = jobs.cleanup(spark, led_path, out, 1000).first()
    assert LG.read_ledger(spark, out).count() == led.count() - rep.rows_to_delete
    dry = jobs.cleanup(spark, led_path, scratch_path(spark, "j-dry"), 1000, dry_run=True).first()
    assert dry.rows_to_delete == rep.rows_to_delete and dry.dry_run


def test_snapshot_month_pruning(spark):
    from pyspark.sql import functions as F
    p = scratch_path(spark, "j-prune")
    LG.write_snapshot(tv.transactions(spark, SF001), p)
    df = LG.read_ledger(spark, p, with_month=True).where(F.col("txn_month") == "1998-02")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(txn_month" in plan and "1998-02" in plan
    assert df.count() == tv.transactions(spark, SF001).where(
        F.date_format("transaction_date", "yyyy-MM") == "1998-02").count()
