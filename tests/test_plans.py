"""Plan-shape checks for the scale properties the README claims."""

import re

import pytest

import __spark_entry__ as E
from tests.conftest import SF01
from tools.plan_report import summarize

SIDE_EFFECT = {"ingest_run", "stream_ingest", "log_scan_query", "import_csv", "import_report", "import_errors",
               "import_row_numbers", "import_csv_id_mode", "export_csv", "export_json", "export_json_rows", "labeled_scan", "import_row_facts",
               "train_text_model", "categorize_model", "ingest_sinks", "ingest_gate", "daily_maintained", "retrain_from_daily",
               "update_months", "delete_months", "purge_months", "fill_months", "export_json_documents",
               "log_store_query", "log_store_total", "model_versions", "model_status_versions", "lazy_fit_versions",
               "train_tree_model", "text_model_contract", "categorize_contract"}


def _plan(spark, name):
    df = E.queries()[name](spark, SF01)
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(E.queries()) - SIDE_EFFECT))
def test_no_cartesian_or_nested_loop(spark, name):
    s = summarize(_plan(spark, name))
    assert s["CartesianProduct"] == 0 and s["BroadcastNestedLoopJoin"] == 0


def test_page_limit_runs_before_the_shuffle(spark):
    p = _plan(spark, "list_page")
    # a partial WindowGroupLimit sits below a hash exchange
    assert re.search(r"Exchange hashpartitioning[^\n]*\n(.*\n)*?.*WindowGroupLimit", p)


def test_lookback_reaches_the_scan(spark):
    p = _plan(spark, "history_scan")
    assert re.search(r"PushedFilters: \[[^\]]*GreaterThanOrEqual\(l_shipdate", p)


def test_reports_aggregate_partially(spark):
    for name in ("daily_cashflow", "category_breakdown", "account_summary"):
        s = summarize(_plan(spark, name))
        assert s["HashAggregate"] >= 2 and s["SortAggregate"] == 0, name  # partial + final


def test_forecaster_shuffles_little(spark):
    s = summarize(_plan(spark, "fit_forecaster"))
    assert s["shuffles"] <= 2 and s["SortMergeJoin"] == 0


@pytest.mark.parametrize("name", ["account_summary", "largest_tx", "keep_first", "new_rows_only", "processed_merge"])
def test_no_sort_aggregate(spark, name):
    assert summarize(_plan(spark, name))["SortAggregate"] == 0


def _below_first_exchanges(plan: str) -> list[str]:
    """The operators between each scan and the nearest exchange or join above it
    (beyond a join there are only the rows that tie for the first place)."""
    out, lines = [], plan.splitlines()
    depth = [len(re.match(r"[ :+\-*|]*", x).group()) for x in lines]
    for i, line in enumerate(lines):
        if "Scan parquet" not in line:
            continue
        at, own = depth[i], []
        for j in range(i - 1, -1, -1):
            if depth[j] < at:
                at = depth[j]
                if re.search("Exchange|Join", lines[j]):
                    break
                own.append(lines[j])
        out += own
    return out


@pytest.mark.parametrize("name", ["keep_first", "new_rows_only", "processed_merge"])
def test_first_copies_are_not_sorted_before_the_shuffle(spark, name):
    below = _below_first_exchanges(_plan(spark, name))
    assert any("HashAggregate" in x for x in below)
    assert not [x for x in below if re.search(r"\b(Sort|SortAggregate|WindowGroupLimit)\b", x)]
