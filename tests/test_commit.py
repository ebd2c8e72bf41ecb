"""A batch is one replayable commit: jobs killed between any two sinks, file
order, ids that come again, the id table."""

import os

import pytest
from pyspark.sql import functions as F

from tally.errors import PermissionDenied
from tally.operators import analytics as A
from tally.operators import joins as J
from tally.plans import ingest as ING
from tally.schema import RAW_TRANSACTION_SCHEMA
from tally.session import scratch_path
from tally.sources import daily, files, ids, rewrite
from tally.sources import ledger as LG
from tally.sources import testviews as tv
from tally.streaming.ingest import stream_ingest
from tests.conftest import SF001

HEAD = ",".join(RAW_TRANSACTION_SCHEMA.fieldNames())


def _row(name, description="Rent", date="2024-01-01", posted="2024-01-05 00:00:00", amount="5", account="a1"):
    row = {"transaction_id": name, "account_id": account, "description": description, "amount": amount,
           "direction": "inflow", "transaction_date": date, "posted_at": posted, "currency": "EUR"}
    return ",".join(row.get(c, "") for c in RAW_TRANSACTION_SCHEMA.fieldNames())


def _folder(spark, **texts):
    src = scratch_path(spark, "t-commit")
    os.makedirs(src)
    for name, rows in texts.items():
        with open(f"{src}/{name}.csv", "w") as f:
            f.write("\n".join([HEAD, *rows]) + "\n")
    return src


def _read(spark, path):
    return sorted((r.transaction_id, r.description) for r in spark.read.parquet(path).collect())


BATCH = [_row("t1"), _row("t2", date="2024-02-01"), _row("t3", amount="much")]


def _run(spark, out, src=None):
    ING.run_ingest(spark, src or _folder(spark, a=BATCH), f"{out}/ledger", f"{out}/bad", backup_path=f"{out}/backup", buckets=4)


def _whole(spark, out):
    assert _read(spark, f"{out}/ledger") == _read(spark, f"{out}/backup") == [("t1", "Rent"), ("t2", "Rent")]
    assert _read(spark, f"{out}/bad") == [("t3", "Rent")]


class Killed(Exception):
    pass


def _kill_at(monkeypatch, at, after):
    """The job dies at its ``at``-th file mark, before or after it is set."""
    seen, touch = [], files.touch

    def dying(spark, path):
        name = path.rsplit("/", 1)[1]
        if name.endswith(("-begun", "-done")):
            seen.append(name)
            if len(seen) == at:
                if after:
                    touch(spark, path)
                raise Killed(name)
        touch(spark, path)

    monkeypatch.setattr(files, "touch", dying)


@pytest.mark.parametrize("at", range(1, 7))
def test_a_job_killed_between_any_two_marks(spark, monkeypatch, at):
    out = scratch_path(spark, "t-killed")
    with monkeypatch.context() as m:
        _kill_at(m, at, after=at % 2 == 0)
        with pytest.raises(Killed):
            _run(spark, out)
    _run(spark, out)
    _whole(spark, out)


@pytest.mark.parametrize("sink", ["ledger", "backup"])
def test_a_job_killed_between_a_sink_and_its_ids(spark, monkeypatch, sink):
    """Rows are in the sink, their ids are not; another batch comes first."""
    out, append = scratch_path(spark, "t-no-ids"), ids.append

    def dying(rows, path):
        if path.endswith(sink):
            raise Killed
        append(rows, path)

    with monkeypatch.context() as m:
        m.setattr(ids, "append", dying)
        with pytest.raises(Killed):
            _run(spark, out)
    other = _folder(spark, b=[_row("t1", "Late copy", date="2024-03-01"), _row("t9", "Nine")])
    ING.run_ingest(spark, other, f"{out}/ledger", buckets=4)  # names no backup: the first batch's own is used
    assert _read(spark, f"{out}/ledger") == [("t1", "Rent"), ("t2", "Rent"), ("t9", "Nine")]
    assert _read(spark, f"{out}/backup") == [("t1", "Rent"), ("t2", "Rent")]
    _run(spark, out)
    assert _read(spark, f"{out}/bad") == [("t3", "Rent")]


def test_a_job_killed_while_it_decides(spark, monkeypatch):
    out = scratch_path(spark, "t-deciding")
    with monkeypatch.context() as m:
        m.setattr(ING, "new_rows", lambda *a: (_ for _ in ()).throw(Killed()))
        with pytest.raises(Killed):
            _run(spark, out)
    _run(spark, out, _folder(spark, x=[_row("t8", "Eight")]))
    _run(spark, out)
    assert _read(spark, f"{out}/ledger") == [("t1", "Rent"), ("t2", "Rent"), ("t8", "Eight")]


def test_a_batch_sent_twice_and_ids_sent_again(spark):
    out = scratch_path(spark, "t-twice")
    for _ in range(2):
        _run(spark, out)
    _whole(spark, out)
    report = ING.run_ingest(spark, _folder(spark, a=[_row("t2", "Other date", date="2020-05-05"), _row("t4")]),
                            f"{out}/ledger", buckets=4).first()
    assert (report.rows_read, report.rows_valid, report.rows_quarantined, report.rows_new) == (2, 2, 0, 1)
    assert _read(spark, f"{out}/ledger") == [("t1", "Rent"), ("t2", "Rent"), ("t4", "Rent")]
    assert files.children(spark, f"{out}/ledger/_batches") and ids.exists(spark, f"{out}/ledger")


def test_the_first_row_of_the_files_is_kept(spark):
    """Not the earliest posted one; files count by name; a rejected row gives way."""
    src = _folder(spark, a=[_row("t1", "first"), _row("t1", "second", posted="1999-01-01 00:00:00"), _row("t2", "bad", amount="x")],
                  b=[_row("t1", "third", posted="1998-01-01 00:00:00"), _row("t2", "good"), _row("t3", "b"), _row("t4", "b")],
                  c=[_row("t3", "c", posted="1990-01-01 00:00:00")] + [_row(f"u{k}", str(k)) for k in range(1500)] + [_row("u7", "again")])
    want = sorted([("t1", "first"), ("t2", "good"), ("t3", "b"), ("t4", "b")] + [(f"u{k}", str(k)) for k in range(1500)])
    batch, stream = scratch_path(spark, "t-order"), scratch_path(spark, "t-order")
    ING.run_ingest(spark, src, batch, buckets=4)
    stream_ingest(spark, src, stream, buckets=4)
    assert _read(spark, batch) == _read(spark, stream) == want


def test_a_refused_batch_leaves_nothing(spark):
    accounts = spark.createDataFrame([("a1", "u1"), ("a2", "u2")], "account_id string, user_id string")
    out = scratch_path(spark, "t-refused")
    with pytest.raises(PermissionDenied):
        ING.run_ingest(spark, _folder(spark, a=[_row("t1"), _row("t2", account="a2")]), f"{out}/ledger", f"{out}/bad",
                       accounts=accounts, user_id="u1", backup_path=f"{out}/backup", buckets=4)
    assert files.children(spark, out) == ["ledger"] and files.children(spark, f"{out}/ledger") == ["_ids"]


def test_appends_keep_the_id_table(spark):
    out = scratch_path(spark, "t-append-ids")
    _run(spark, out)
    led = LG.read_ledger(spark, f"{out}/ledger")
    more = led.withColumn("transaction_id", F.concat("transaction_id", F.lit("x")))
    LG.ledger_append(more, led, f"{out}/ledger")
    again = more.select("transaction_id").unionByName(led.select("transaction_id"))
    assert ids.unseen(again, f"{out}/ledger").count() == 0


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_stored_ids_are_not_shuffled_and_few_ids_read_few_buckets(spark):
    out = scratch_path(spark, "t-plan-ids")
    stored = spark.range(1000).select(F.concat(F.lit("t"), "id").alias("transaction_id"))
    ids.ensure(spark, out, stored, 16)
    ids.ensure(spark, out, None, 8)  # there already
    rows = spark.createDataFrame([("t5", 1), ("n1", 2), (None, 3), ("t6", 4)], "transaction_id string, _seq bigint")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = _plan(ids.unseen(rows, out))
        assert plan.count("Exchange") == 1 and "Bucketed: true" in plan and "SortMergeJoin" in plan
        few = ids.unseen(rows, out, few=True)
        assert "SelectedBucketsCount: 3 out of 16" in _plan(few)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    for got in (few, ids.unseen(rows, out)):
        assert sorted(r[1] for r in got.collect()) == [2, 3]


def _days(df):
    return sorted(tuple(r) for r in df.select("account_id", "transaction_date", "inflow", "outflow", "n_rows").collect())


def test_the_daily_table_equals_a_full_recomputation(spark, monkeypatch):
    """After batches, a job killed while it refreshes, an append, a patch, deletes and a purge."""
    out = scratch_path(spark, "t-daily") + "/ledger"
    same = lambda: _days(daily.read(spark, out)) == _days(daily.of(LG.read_ledger(spark, out)))
    ING.run_ingest(spark, _folder(spark, a=BATCH), out, buckets=4)  # not kept yet
    more = _folder(spark, b=[_row("t5", amount="2.5"), _row("t6", account="a2"), _row("t7", date="2024-03-03")])
    with monkeypatch.context() as m:
        m.setattr(daily, "refresh", lambda *a: (_ for _ in ()).throw(Killed()))
        with pytest.raises(Killed):
            ING.run_ingest(spark, more, out, buckets=4, keep_daily=True)
    ING.run_ingest(spark, more, out, buckets=4, keep_daily=True)
    assert same() and len(_days(daily.read(spark, out))) == 4
    led = LG.read_ledger(spark, out)
    LG.ledger_append(led.withColumn("transaction_id", F.concat("transaction_id", F.lit("x"))), led, out)
    assert same()
    rewrite.delete_tx(spark, out, LG.read_ledger(spark, out).where("transaction_id in ('t1', 't7', 't7x')"))
    assert same()
    rewrite.retention_purge(spark, out, "2024-02-10", 20)
    assert same() and [n for n in files.children(spark, f"{out}/_daily") if n.startswith("txn")] == ["txn_month=2024-02"]
    rewrite.retention_purge(spark, out, "2025-02-10", 20)
    assert daily.read(spark, out).count() == 0


def test_reports_from_the_daily_table(spark):
    led, acc = tv.transactions(spark, SF001), tv.accounts(spark, SF001)
    path = LG.write_snapshot(led, scratch_path(spark, "t-daily-reports"))
    daily.ensure(spark, path)
    days = daily.read(spark, path)
    rows = lambda df: sorted(map(str, df.collect()))
    for report in (A.daily_cashflow, A.weekly_cashflow, A.daily_net, lambda x: A.cashflow_volatility(x, acc)):
        assert rows(report(daily.as_ledger(days))) == rows(report(led))
    models = acc.limit(3).select("account_id", F.lit("2024-01-01").alias("trained_at"))
    assert rows(J.model_status(acc, models, counts=daily.history_counts(days))) == rows(J.model_status(acc, models, led))
