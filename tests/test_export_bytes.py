"""What the JSON exports move and write: typed rows, files compressed where that is asked for."""

import glob
import json

import pytest
from pyspark.sql import functions as F

from tally.plans import q_ingest as Q
from tally.session import scratch_path
from tally.sources import export as EX
from tests.test_export_order import _ledger


def test_json_is_made_behind_the_shuffle(spark, monkeypatch):
    led, frames = _ledger(spark), []
    kind = type(led)
    ranges = kind.repartitionByRange
    monkeypatch.setattr(kind, "repartitionByRange", lambda self, *by: (frames.append(self.columns), ranges(self, *by))[1])
    EX.export_json(led, scratch_path(spark, "t-typed"), "2025-06-30")
    assert len(frames) == 1 and "value" not in frames[0] and "amount" in frames[0]


@pytest.mark.parametrize("write", [EX.export_json, EX.export_json_documents])
def test_compressed_exports_hold_the_same_lines(spark, write):
    led = _ledger(spark)
    plain, small = scratch_path(spark, "t-plain"), scratch_path(spark, "t-small")
    write(led, plain, "2025-06-30")
    write(led, small, "2025-06-30", compression="gzip")
    assert glob.glob(f"{plain}/account_id=0/*.txt") and glob.glob(f"{small}/account_id=0/*.txt.gz")
    got = [sorted(map(tuple, spark.read.text(p).collect()), key=str) for p in (plain, small)]
    assert got[0] == got[1] and {a for _, a in got[0]} == {0, 1}


def test_rows_without_an_account_share_a_folder(spark):
    led, path = _ledger(spark), scratch_path(spark, "t-none")
    none = led.withColumn("account_id", F.when(F.col("amount") % 4 == 0, F.lit("")).when(F.col("account_id") == "1", "1"))
    assert not EX._lines(none, "2025-06-30").schema["_folder"].nullable  # no second sort at the writer
    EX.export_json(none, path, "2025-06-30")
    got = [json.loads(r.value) for r in spark.read.text(f"{path}/account_id=__HIVE_DEFAULT_PARTITION__").coalesce(1).collect()]
    assert [(r.get("account_id"), r.get("transaction_count")) for r in got] == [
        (None, 5), *[(None, None)] * 5, ("", 5), *[("", None)] * 5]


@pytest.mark.parametrize("query", [Q.export_json, Q.export_json_rows])
def test_the_queries_write_compressed_files(spark, monkeypatch, query):
    led, paths, scratch = _ledger(spark), [], Q.scratch_path
    monkeypatch.setattr(Q, "_led", lambda spark, d: led)
    monkeypatch.setattr(Q, "scratch_path", lambda *a: (paths.append(scratch(*a)), paths[-1])[1])
    assert query(spark, "").count() == (2 if query is Q.export_json else 20)
    files = glob.glob(f"{paths[0]}/*/part-*")
    assert files and all(f.endswith(".gz") for f in files)
