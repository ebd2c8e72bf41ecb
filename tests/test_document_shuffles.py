"""Documents of the JSON export are made where they are written."""

import json

from pyspark.sql import functions as F

from tally.session import scratch_path
from tally.sources import export as EX


def _ledger(spark, n=90):
    return spark.range(n).select(
        F.concat(F.lit("t"), F.lpad(F.col("id").cast("string"), 4, "0")).alias("transaction_id"),
        F.when(F.col("id") < 60, "hot").otherwise(F.concat(F.lit("a"), (F.col("id") % 4).cast("string"))).alias("account_id"),
        F.lit("x").alias("description"), F.lit(None).cast("string").alias("category"), F.col("id").alias("amount"),
        F.lit("inflow").alias("direction"), F.lit("USD").alias("currency"), F.lit("2025-01-01").cast("date").alias("transaction_date"),
        F.lit("2025-01-01 08:00:00").cast("timestamp_ntz").alias("posted_at"))


def test_whole_rows_are_shuffled_twice_and_documents_never(spark, monkeypatch):
    led, frames = _ledger(spark), []
    kind = type(led)
    ranges = kind.repartitionByRange
    monkeypatch.setattr(kind, "repartitionByRange", lambda self, *by: (frames.append(self.columns), ranges(self, *by))[1])
    path = scratch_path(spark, "t-shuffles")
    EX.export_json_documents(led, path, "2025-06-30", part_rows=7)
    assert len(frames) == 1 and "value" not in frames[0] and "document" not in frames[0]
    plan = EX.json_documents(led, "2025-06-30", part_rows=7)._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan
    got = {}
    for r in spark.read.text(path).collect():
        d = json.loads(r.value)
        assert d["account_id"] == r.account_id and len(d["transactions"]) <= 7
        got.setdefault(r.account_id, []).append(d)
    ids = {a: [t["transaction_id"] for d in sorted(ds, key=lambda d: d["part"]) for t in d["transactions"]] for a, ds in got.items()}
    want = {}
    for r in led.orderBy("transaction_id").collect():
        want.setdefault(r.account_id, []).append(r.transaction_id)
    assert ids == want
    for a, ds in got.items():
        assert sorted(d["part"] for d in ds) == list(range(1, len(ds) + 1))
        assert all(d["parts"] == len(ds) and d["transaction_count"] == len(want[a]) for d in ds)
