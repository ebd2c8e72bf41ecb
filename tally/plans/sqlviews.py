"""The test-table views of ``tally.sources.testviews`` written as DuckDB SQL
CTEs, for the oracle side of the correctness check."""

from __future__ import annotations

from tally.sources.testviews import DESCRIPTION_FIXTURE, N_PHRASES


def q(s) -> str:
    return "NULL" if s is None else "'" + str(s).replace("'", "''") + "'"


def _list(vals) -> str:
    return "[" + ", ".join(q(v) for v in vals) + "]"


_IDX = f"CAST(l_partkey % {N_PHRASES} AS INTEGER) + 1"
_TID = ("concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, "
        "strftime(l_shipdate, '%Y%m%d'))")

VIEWS = {
    "accounts": """
  SELECT CAST(s_suppkey AS VARCHAR) AS account_id,
         CAST(s_nationkey AS BIGINT) AS user_id,
         lpad(CAST(s_suppkey AS VARCHAR), 10, '0') AS account_number,
         CAST(round_even(s_acctbal * 100, 0) AS BIGINT) AS starting_balance,
         'USD' AS currency,
         DATE '2025-01-01' AS last_updated
  FROM supplier""",
    "ledger": f"""
  SELECT {_TID} AS transaction_id,
         CAST(l_suppkey AS VARCHAR) AS account_id,
         ({_list(p for p, _ in DESCRIPTION_FIXTURE)})[{_IDX}] AS description,
         (CAST({_list(c for _, c in DESCRIPTION_FIXTURE)} AS VARCHAR[]))[{_IDX}] AS category,
         CAST(round_even(l_extendedprice * 100, 0) AS BIGINT) AS amount,
         CASE WHEN l_returnflag = 'R' THEN 'outflow' ELSE 'inflow' END AS direction,
         'USD' AS currency,
         CAST(l_shipdate AS DATE) AS transaction_date,
         l_shipdate AS posted_at
  FROM lineitem""",
    "order_accounts": """
  SELECT concat_ws('-', CAST(c_nationkey AS VARCHAR), c_mktsegment) AS account_id,
         CAST(c_nationkey AS BIGINT) AS user_id,
         CAST(round_even(sum(c_acctbal) * 100, 0) AS BIGINT) AS starting_balance,
         'USD' AS currency
  FROM customer GROUP BY c_nationkey, c_mktsegment""",
    "order_ledger": """
  SELECT CAST(o_orderkey AS VARCHAR) AS transaction_id,
         concat_ws('-', CAST(c_nationkey AS VARCHAR), c_mktsegment) AS account_id,
         o_orderpriority AS description,
         CAST(NULL AS VARCHAR) AS category,
         CAST(round_even(o_totalprice * 100, 0) AS BIGINT) AS amount,
         CASE WHEN o_orderstatus = 'F' THEN 'outflow' ELSE 'inflow' END AS direction,
         'USD' AS currency,
         CAST(o_orderdate AS DATE) AS transaction_date,
         o_orderdate AS posted_at
  FROM orders JOIN customer ON o_custkey = c_custkey""",
    "raw_batch": f"""
  SELECT ' ' || {_TID} AS transaction_id,
         CAST(l_suppkey AS VARCHAR) AS account_id,
         ({_list(p for p, _ in DESCRIPTION_FIXTURE)})[{_IDX}] AS description,
         '' AS category,
         CASE WHEN l_discount = 0 THEN 'n/a' ELSE CAST(l_extendedprice AS VARCHAR) END AS amount,
         CASE WHEN l_returnflag = 'A' THEN ' Inflow'
              WHEN l_returnflag = 'N' THEN 'OUTFLOW' || chr(9)
              WHEN l_linestatus = 'F' THEN 'outflow'
              ELSE 'refund' END AS direction,
         CASE WHEN l_quantity = 50 THEN 'not a date'
              WHEN l_linestatus = 'F' THEN strftime(l_shipdate, '%Y-%m-%d')
              ELSE strftime(l_shipdate, '%Y-%m-%d %H:%M:%S') END AS transaction_date,
         strftime(l_shipdate, '%Y-%m-%d %H:%M') AS posted_at,
         CASE WHEN l_returnflag = 'N' THEN 'JPY'
              WHEN l_tax = 0 THEN 'XOF'
              ELSE 'USD' END AS currency
  FROM lineitem""",
    "log": """
  SELECT ts, upper(event_type) AS level,
         event_type || ' #' || CAST(event_id AS VARCHAR) AS message,
         json_extract_string(props, '$.k') AS account_id,
         CAST(user_id AS VARCHAR) AS user_id
  FROM events""",
}

# Views each view depends on (CTE order).
DEPS = {"ledger": [], "accounts": [], "order_accounts": [], "order_ledger": [],
        "raw_batch": [], "log": []}


def with_views(body: str, *names: str) -> str:
    ctes = ",\n".join(f"{n} AS ({VIEWS[n]}\n)" for n in names)
    body = body.strip()
    if body.upper().startswith("WITH "):
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"


def ws_sql() -> str:
    from tally.functions.text import WHITESPACE
    return " || ".join(f"chr({ord(ch)})" for ch in WHITESPACE)


def strip_sql(c: str) -> str:
    return f"trim({c}, {ws_sql()})"


def norm_sql(c: str) -> str:
    return f"lower({strip_sql(c)})"


def rule_sql(desc: str = "description", direction: str = "direction") -> str:
    """The keyword rule categorizer as a DuckDB CASE expression."""
    from tally.schema import EMPTY_DESCRIPTIONS, KEYWORD_RULES
    n = norm_sql(desc)
    empties = ", ".join(q(e) for e in EMPTY_DESCRIPTIONS)
    parts = [f"WHEN {desc} IS NULL OR {n} IN ({empties}) THEN "
             f"CASE WHEN {direction} = 'inflow' THEN 'Revenue' ELSE 'Miscellaneous' END"]
    for cat, words in KEYWORD_RULES:
        cond = " OR ".join(f"contains({n}, {q(w)})" for w in words)
        parts.append(f"WHEN {cond} THEN {q(cat)}")
    return "CASE " + " ".join(parts) + " ELSE NULL END"
