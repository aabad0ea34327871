"""The engine's queries on the driver's tables, with DuckDB SQL for each."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .engine import Caller, Engine
from .functions.plugins import AggregateDef, FunctionDef, Plugin, Registry
from .serving.grid import GridAdapter
from .sources.catalog import Catalog
from .types import FLOAT
from .whatif.plugin import WhatIfPlugin
from .whatif.scenarios import MemoryStore

KEYS = {"customer": ["c_custkey"], "supplier": ["s_suppkey"], "part": ["p_partkey"], "orders": ["o_orderkey"], "events": ["event_id"], "nation": ["n_nationkey"], "region": ["r_regionkey"], "lineitem": []}


class Samples(Plugin):
    """A function and an aggregate that are no built-ins."""

    name, version = "samples", "1"

    def register(self, registry: Registry) -> None:
        clip = lambda x, lo, hi: F.least(F.greatest(x, lo), hi)
        registry.add_function(FunctionDef("clip", lambda t: t[0], clip, lambda x, lo, hi: min(max(x, lo), hi), 3, 3))
        registry.add_aggregate(AggregateDef("median", lambda t: FLOAT, lambda c: F.median(c.cast("double")), _median))


def _median(values: list) -> float:
    values = sorted(map(float, values))
    n = len(values)
    return (values[(n - 1) // 2] + values[n // 2]) / 2


def engine_on(spark: SparkSession, sf_dir: str, *tables: str) -> Engine:
    """An engine over some of the driver's tables, read lazily."""
    catalog = Catalog(spark)
    for t in tables:
        catalog.register_scan(t, f"{sf_dir}/{t}.parquet", key_columns=KEYS[t], version="1")
    return Engine(spark, catalog, [Samples(), WhatIfPlugin(MemoryStore())])


def ask(table: str, query: dict, caller: Caller | None = None, **more: Any) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: engine_on(spark, sf_dir, table).frame({"dataset": table, "query": query, **more}, caller)


def against(table: str, query: dict, **more: Any) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: engine_on(spark, sf_dir, table).compare_frame({"dataset": table, "query": query, **more})


def whatif(*steps: dict, strict: bool = True) -> dict:
    return {"extensions": {"whatif": {"steps": list(steps), "strict_edits": strict}}}


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, run: Callable[[SparkSession, str], DataFrame], sql: str, decimals: str = "") -> None:
    """`decimals` names the columns that are exact decimals: both sides show them as text, with every digit and the scale."""
    exact = decimals.split()

    def shown(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = run(spark, sf_dir)
        return df.withColumns({c: F.col(f"`{c}`").cast("string") for c in exact})

    QUERIES[name] = shown if exact else run
    casts = ", ".join(f'CAST("{c}" AS VARCHAR) AS "{c}"' for c in exact)
    ORACLES[name] = f"SELECT * REPLACE ({casts}) FROM ({sql}) answer" if exact else sql


PRICE, DISCOUNT = "decimal(l_extendedprice, 2)", "decimal(l_discount, 2)"
REVENUE = f"{PRICE} * (1 - {DISCOUNT})"
SQL_REVENUE = "CAST(CAST(l_extendedprice AS DECIMAL(15,2)) * (1 - CAST(l_discount AS DECIMAL(5,2))) AS DECIMAL(38,4))"
REV = [{"name": "rev", "expr": REVENUE}]
SUM_REV = {"name": "rev", "fn": "sum", "of": "rev"}
N = {"name": "n", "fn": "count_rows"}

# Rows

query("filter_derive_select", ask("lineitem", {"filter": "l_quantity > 30 and l_returnflag == 'R'", "derive": REV, "select": ["l_orderkey", "l_linenumber", "rev"]}),
      f"SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, {SQL_REVENUE} AS rev FROM lineitem WHERE l_quantity > 30 AND l_returnflag = 'R'", "rev")
query("conditional_derive", ask("orders", {"derive": [{"name": "big", "expr": "o_totalprice * 2", "where": "o_orderstatus == 'F'", "otherwise": "o_totalprice"}, {"name": "only_f", "expr": "o_custkey", "where": "o_orderstatus == 'F'"}, {"name": "size", "expr": "'large' if o_totalprice > 100000 else 'small'"}], "select": ["o_orderkey", "big", "only_f", "size"]}),
      "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN o_totalprice * 2 ELSE o_totalprice END AS big, CASE WHEN o_orderstatus = 'F' THEN o_custkey END AS only_f, CASE WHEN o_totalprice > 100000 THEN 'large' ELSE 'small' END AS size FROM orders")
query("null_logic", ask("customer", {"derive": [{"name": "x", "expr": "c_acctbal", "where": "c_acctbal > 0"}, {"name": "both", "expr": "x > 1000 and c_nationkey > 5"}, {"name": "either", "expr": "x > 1000 or c_nationkey > 5"}, {"name": "neither", "expr": "not (x > 1000)"}, {"name": "gone", "expr": "x is None"}], "filter": "c_nationkey != 3", "select": ["c_custkey", "both", "either", "neither", "gone"]}),
      "WITH t AS (SELECT *, CASE WHEN c_acctbal > 0 THEN c_acctbal END AS x FROM customer WHERE c_nationkey <> 3) SELECT c_custkey, x > 1000 AND c_nationkey > 5 AS both, x > 1000 OR c_nationkey > 5 AS either, NOT (x > 1000) AS neither, x IS NULL AS gone FROM t")
query("null_condition_drops", ask("customer", {"derive": [{"name": "y", "expr": "1 if (None if c_acctbal < 0 else c_acctbal > 5000) else 0"}], "filter": "(None if c_acctbal < 0 else c_acctbal) != 0", "select": ["c_custkey", "y"]}),
      "SELECT c_custkey, CAST(CASE WHEN c_acctbal >= 0 AND c_acctbal > 5000 THEN 1 ELSE 0 END AS BIGINT) AS y FROM customer WHERE CASE WHEN c_acctbal < 0 THEN NULL ELSE c_acctbal END <> 0")
query("in_list", ask("part", {"filter": "p_size in (1, 5, 10) and p_brand not in ['Brand#11', 'Brand#12']", "select": ["p_partkey", "p_size", "p_brand"]}),
      "SELECT p_partkey, CAST(p_size AS BIGINT) AS p_size, p_brand FROM part WHERE p_size IN (1, 5, 10) AND p_brand NOT IN ('Brand#11', 'Brand#12')")
query("chained_comparison", ask("part", {"filter": "5 <= p_size < 20 and -p_size < -6", "select": ["p_partkey", "p_size"]}),
      "SELECT p_partkey, CAST(p_size AS BIGINT) AS p_size FROM part WHERE 5 <= p_size AND p_size < 20 AND -p_size < -6")
query("string_functions", ask("part", {"derive": [{"name": "lo", "expr": "lower(p_brand)"}, {"name": "up", "expr": "upper(p_name)"}, {"name": "has", "expr": "contains(p_type, 'A')"}, {"name": "first", "expr": "starts_with(p_brand, 'Brand#1')"}, {"name": "last", "expr": "ends_with(p_brand, '3')"}], "select": ["p_partkey", "lo", "up", "has", "first", "last"]}),
      "SELECT p_partkey, lower(p_brand) AS lo, upper(p_name) AS up, contains(p_type, 'A') AS has, starts_with(p_brand, 'Brand#1') AS first, ends_with(p_brand, '3') AS last FROM part")
query("round_half_even", ask("part", {"derive": [{"name": "half", "expr": "decimal(p_size, 2) / 2"}, {"name": "r", "expr": "round(decimal(p_size, 1) * 0.5)"}, {"name": "r1", "expr": "round(decimal(p_size, 2) * 0.25, 1)"}], "select": ["p_partkey", "half", "r", "r1"]}),
      "SELECT p_partkey, CAST(p_size / 2.0::DOUBLE AS DECIMAL(38,10)) AS half, CAST(round_even(p_size * 0.5::DOUBLE, 0) AS DECIMAL(38,0)) AS r, CAST(round_even(p_size * 2.5::DOUBLE, 0) / 10 AS DECIMAL(38,1)) AS r1 FROM part", "half r r1")
query("int_division", ask("part", {"derive": [{"name": "seventh", "expr": "p_size / 7"}, {"name": "rest", "expr": "p_size - 7 * 2"}], "select": ["p_partkey", "seventh", "rest"]}),
      "SELECT p_partkey, CAST(CAST((p_size * 10000000000 + CASE WHEN (p_size * 10000000000) % 7 * 2 > 7 THEN 7 - (p_size * 10000000000) % 7 ELSE -((p_size * 10000000000) % 7) END) // 7 AS DECIMAL(38,0)) / 10000000000 AS DECIMAL(38,10)) AS seventh, CAST(p_size - 14 AS BIGINT) AS rest FROM part", "seventh")
query("divide_by_zero_null", ask("orders", {"derive": [{"name": "q", "expr": "o_totalprice / (o_custkey - o_custkey)"}, {"name": "d", "expr": "o_orderkey / (o_custkey - o_custkey)"}, {"name": "ok", "expr": "o_totalprice / 4"}], "select": ["o_orderkey", "q", "d", "ok"]}),
      "SELECT o_orderkey, CAST(NULL AS DOUBLE) AS q, CAST(NULL AS DECIMAL(38,10)) AS d, o_totalprice / 4 AS ok FROM orders", "d")
query("safe_math", ask("customer", {"derive": [{"name": "s", "expr": "round(sqrt(c_acctbal), 6)"}, {"name": "l", "expr": "round(log(c_acctbal), 6)"}, {"name": "e", "expr": "exp(c_acctbal * 1000000) is None"}, {"name": "p", "expr": "round(c_nationkey ** 2, 3)"}], "select": ["c_custkey", "s", "l", "e", "p"]}),
      "SELECT c_custkey, CASE WHEN c_acctbal >= 0 THEN round(sqrt(c_acctbal), 6) END AS s, CASE WHEN c_acctbal > 0 THEN round(ln(c_acctbal), 6) END AS l, c_acctbal > 0.00071 AS e, CAST(c_nationkey * c_nationkey AS DOUBLE) AS p FROM customer")
query("floor_ceil_abs", ask("customer", {"derive": [{"name": "f", "expr": "floor(c_acctbal)"}, {"name": "c", "expr": "ceil(decimal(c_acctbal, 2))"}, {"name": "a", "expr": "abs(c_acctbal)"}], "select": ["c_custkey", "f", "c", "a"]}),
      "SELECT c_custkey, floor(c_acctbal) AS f, CAST(ceil(c_acctbal) AS DECIMAL(38,0)) AS c, abs(c_acctbal) AS a FROM customer", "c")
query("casts", ask("events", {"derive": [{"name": "i", "expr": "int(value)"}, {"name": "s", "expr": "str(user_id)"}, {"name": "back", "expr": "int(s)"}, {"name": "bad", "expr": "int(event_type)"}, {"name": "day", "expr": "str(to_date(ts))"}, {"name": "known", "expr": "to_date('2024-02-30') is None"}, {"name": "f", "expr": "float(user_id) / 2"}], "select": ["event_id", "i", "s", "back", "bad", "day", "known", "f"]}),
      "SELECT event_id, CAST(trunc(value) AS BIGINT) AS i, CAST(user_id AS VARCHAR) AS s, user_id AS back, CAST(NULL AS BIGINT) AS bad, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, TRUE AS known, user_id / 2.0::DOUBLE AS f FROM events")
query("greatest_least_coalesce", ask("customer", {"derive": [{"name": "x", "expr": "c_acctbal", "where": "c_acctbal > 1000"}, {"name": "hi", "expr": "max(x, 2000, c_nationkey)"}, {"name": "lo", "expr": "min(x, 2000)"}, {"name": "z", "expr": "coalesce(x, -1)"}], "select": ["c_custkey", "hi", "lo", "z"]}),
      "WITH t AS (SELECT *, CASE WHEN c_acctbal > 1000 THEN c_acctbal END AS x FROM customer) SELECT c_custkey, greatest(x, 2000::DOUBLE, CAST(c_nationkey AS DOUBLE)) AS hi, least(x, 2000::DOUBLE) AS lo, coalesce(x, -1::DOUBLE) AS z FROM t")
query("date_comparison", ask("orders", {"filter": "datetime('1996-01-01T00:00:00') <= o_orderdate and to_date(o_orderdate) < date('1997-01-01')", "select": ["o_orderkey", "o_orderdate"]}),
      "SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01' AND CAST(o_orderdate AS DATE) < DATE '1997-01-01'")

# Groups

query("group_sum_mean_min_max", ask("lineitem", {"derive": REV, "group_by": ["l_returnflag", "l_linestatus"], "measures": [SUM_REV, {"name": "qty", "fn": "sum", "of": "int(l_quantity)"}, {"name": "lo", "fn": "min", "of": "l_extendedprice"}, {"name": "hi", "fn": "max", "of": "l_shipdate"}, {"name": "avg", "fn": "mean", "of": "int(l_quantity)"}], "post": [{"name": "avg3", "expr": "round(avg, 3)"}]}),
      f"SELECT l_returnflag, l_linestatus, CAST(sum({SQL_REVENUE}) AS DECIMAL(38,4)) AS rev, CAST(sum(CAST(trunc(l_quantity) AS BIGINT)) AS BIGINT) AS qty, min(l_extendedprice) AS lo, max(l_shipdate) AS hi, CAST(CAST((2 * 10000000000::HUGEINT * sum(CAST(trunc(l_quantity) AS HUGEINT)) + count(*)) // (2 * count(*)) AS DECIMAL(38,0)) / 10000000000 AS DECIMAL(38,10)) AS avg, CAST(round_even(avg(trunc(l_quantity)), 3) AS DECIMAL(38,3)) AS avg3 FROM lineitem GROUP BY ALL", "rev avg avg3")
query("count_variants", ask("orders", {"derive": [{"name": "x", "expr": "o_custkey", "where": "o_orderstatus == 'F'"}], "group_by": ["o_orderpriority"], "measures": [N, {"name": "x", "fn": "count", "of": "x"}, {"name": "customers", "fn": "count_distinct", "of": "x"}]}),
      "SELECT o_orderpriority, count(*) AS n, count(CASE WHEN o_orderstatus = 'F' THEN o_custkey END) AS x, count(DISTINCT CASE WHEN o_orderstatus = 'F' THEN o_custkey END) AS customers FROM orders GROUP BY 1")
query("weighted_average", ask("lineitem", {"group_by": ["l_returnflag"], "measures": [{"name": "w", "fn": "wavg", "of": PRICE, "weight": "decimal(l_quantity, 0)", "where": "l_discount > 0.02"}], "post": [{"name": "price", "expr": "round(w, 3)"}, {"name": "same", "expr": "w > 0"}]}),
      "SELECT l_returnflag, CAST(round_even(w, 3) AS DECIMAL(38,3)) AS price, w > 0 AS same, w0 AS w FROM (SELECT l_returnflag, sum(CAST(CAST(l_extendedprice AS DECIMAL(15,2)) * CAST(l_quantity AS DECIMAL(10,0)) AS DECIMAL(38,2))) AS a, sum(CAST(l_quantity AS DECIMAL(38,0))) AS b, CAST(a AS DOUBLE) / CAST(b AS DOUBLE) AS w, CAST(CAST((2 * CAST(a * 100 AS HUGEINT) * 100000000 + CAST(b AS HUGEINT)) // (2 * CAST(b AS HUGEINT)) AS DECIMAL(38,0)) / 10000000000 AS DECIMAL(38,10)) AS w0 FROM lineitem WHERE l_discount > 0.02 GROUP BY 1)", "price w")
query("filtered_measures", ask("lineitem", {"derive": REV, "group_by": ["l_linestatus"], "measures": [{"name": "returned", "fn": "sum", "of": "rev", "where": "l_returnflag == 'R'"}, {"name": "n_big", "fn": "count_rows", "where": "l_quantity > 40"}, {"name": "none", "fn": "sum", "of": "rev", "where": "l_quantity < 0"}]}),
      f"SELECT l_linestatus, sum({SQL_REVENUE}) FILTER (WHERE l_returnflag = 'R') AS returned, count(*) FILTER (WHERE l_quantity > 40) AS n_big, CAST(NULL AS DECIMAL(38,4)) AS none FROM lineitem GROUP BY 1", "returned none")
query("deterministic_float_sum", ask("events", {"group_by": ["event_type"], "measures": [{"name": "v", "fn": "sum", "of": "value"}], "post": [{"name": "total", "expr": "round(v, 4)"}, {"name": "some", "expr": "v > 0"}]}, options={"deterministic": True}),
      "SELECT event_type, list_reduce(list_sort(list(value)), lambda a, b: a + b) AS v, round_even(list_reduce(list_sort(list(value)), lambda a, b: a + b), 4) AS total, list_reduce(list_sort(list(value)), lambda a, b: a + b) > 0 AS some FROM events GROUP BY 1")
query("post_ratio", ask("lineitem", {"derive": REV, "group_by": ["l_returnflag"], "measures": [SUM_REV, N], "post": [{"name": "each", "expr": "float(rev) / n"}, {"name": "double", "expr": "each * 2"}]}),
      f"SELECT l_returnflag, sum({SQL_REVENUE}) AS rev, count(*) AS n, CAST(sum({SQL_REVENUE}) AS DOUBLE) / count(*) AS each, CAST(sum({SQL_REVENUE}) AS DOUBLE) / count(*) * 2 AS double FROM lineitem GROUP BY 1", "rev")
query("weights_total", ask("lineitem", {"filter": "l_quantity > 0", "derive": REV, "group_by": ["l_returnflag", "l_linestatus"], "measures": [SUM_REV, N], "post": [{"name": "weight", "expr": "float(rev) / float(total(rev))"}], "sort": [{"by": "l_returnflag"}, {"by": "l_linestatus"}]}),
      f"SELECT l_returnflag, l_linestatus, sum({SQL_REVENUE}) AS rev, count(*) AS n, CAST(sum({SQL_REVENUE}) AS DOUBLE) / CAST(sum(sum({SQL_REVENUE})) OVER () AS DOUBLE) AS weight FROM lineitem WHERE l_quantity > 0 GROUP BY 1, 2", "rev")
query("having_total", ask("orders", {"group_by": ["o_custkey"], "measures": [N, {"name": "most", "fn": "max", "of": "o_totalprice"}], "having": "n * 500 > total(n) / 10 and most < total(most)"}),
      "SELECT o_custkey, n, most FROM (SELECT o_custkey, count(*) AS n, max(o_totalprice) AS most FROM orders GROUP BY 1) WHERE n * 5000 > (SELECT count(*) FROM orders) AND most < (SELECT max(o_totalprice) FROM orders)")
query("global_aggregate", ask("orders", {"filter": "o_totalprice < 0", "measures": [N, {"name": "s", "fn": "sum", "of": "o_custkey"}, {"name": "m", "fn": "max", "of": "o_orderstatus"}]}),
      "SELECT count(*) AS n, CAST(sum(o_custkey) AS BIGINT) AS s, max(o_orderstatus) AS m FROM orders WHERE o_totalprice < 0")
query("group_without_measures", ask("customer", {"group_by": ["c_mktsegment", "c_nationkey"]}),
      "SELECT DISTINCT c_mktsegment, CAST(c_nationkey AS BIGINT) AS c_nationkey FROM customer")
query("distinct_values", lambda spark, sf: spark.createDataFrame([(v,) for v in engine_on(spark, sf, "orders").distinct_values("orders", "o_orderpriority", "o_totalprice > 1000")], "value string"),
      "SELECT DISTINCT o_orderpriority AS value FROM orders WHERE o_totalprice > 1000")
query("rollup_two_levels", ask("lineitem", {"derive": REV, "group_by": ["l_returnflag", "l_linestatus"], "rollup": True, "measures": [SUM_REV, N], "post": [{"name": "share", "expr": "float(rev) / float(total(rev))"}], "having": "n > 3"}),
      f"WITH g AS (SELECT l_returnflag, l_linestatus, CAST(2 - GROUPING(l_returnflag) - GROUPING(l_linestatus) AS BIGINT) AS __level, sum({SQL_REVENUE}) AS rev, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)) SELECT *, CAST(rev AS DOUBLE) / (SELECT CAST(sum({SQL_REVENUE}) AS DOUBLE) FROM lineitem) AS share FROM g WHERE n > 3", "rev")
query("rollup_empty", ask("orders", {"filter": "o_totalprice < 0", "group_by": ["o_orderstatus"], "rollup": True, "measures": [N, {"name": "s", "fn": "sum", "of": "o_custkey"}]}),
      "SELECT CAST(NULL AS VARCHAR) AS o_orderstatus, CAST(0 AS BIGINT) AS __level, count(*) AS n, CAST(sum(o_custkey) AS BIGINT) AS s FROM orders WHERE o_totalprice < 0")
query("pivot_domain", ask("lineitem", {"derive": REV, "group_by": ["l_returnflag"], "measures": [SUM_REV, N], "pivot": {"on": ["l_linestatus"], "values": ["rev"], "domain": [["O"], ["F"], ["X"]]}}),
      f"SELECT l_returnflag, sum({SQL_REVENUE}) FILTER (WHERE l_linestatus = 'O') AS \"O_rev\", sum({SQL_REVENUE}) FILTER (WHERE l_linestatus = 'F') AS \"F_rev\", CAST(NULL AS DECIMAL(38,4)) AS \"X_rev\" FROM lineitem WHERE l_linestatus IN ('O', 'F', 'X') GROUP BY 1", "O_rev F_rev X_rev")
query("pivot_totals", ask("orders", {"group_by": ["o_orderpriority"], "measures": [N, {"name": "hi", "fn": "max", "of": "o_totalprice"}], "pivot": {"on": ["o_orderstatus"], "domain": [["F"], ["O"]], "totals": True, "separator": "|"}, "post": [{"name": "share", "expr": "n / total(n) > 0.01"}]}),
      "SELECT o_orderpriority, nullif(count(*) FILTER (WHERE o_orderstatus = 'F'), 0) AS \"F|n\", max(o_totalprice) FILTER (WHERE o_orderstatus = 'F') AS \"F|hi\", CASE WHEN count(*) FILTER (WHERE o_orderstatus = 'F') > 0 THEN count(*) FILTER (WHERE o_orderstatus = 'F') * 100 > (SELECT count(*) FROM orders) END AS \"F|share\", nullif(count(*) FILTER (WHERE o_orderstatus = 'O'), 0) AS \"O|n\", max(o_totalprice) FILTER (WHERE o_orderstatus = 'O') AS \"O|hi\", CASE WHEN count(*) FILTER (WHERE o_orderstatus = 'O') > 0 THEN count(*) FILTER (WHERE o_orderstatus = 'O') * 100 > (SELECT count(*) FROM orders) END AS \"O|share\", count(*) AS n, max(o_totalprice) AS hi, count(*) * 100 > (SELECT count(*) FROM orders) AS share FROM orders GROUP BY 1")
query("pivot_rollup", ask("customer", {"group_by": ["c_mktsegment", "c_nationkey"], "rollup": True, "measures": [N], "derive": [{"name": "rich", "expr": "c_acctbal > 5000"}], "pivot": {"on": ["rich"]}}),
      "SELECT c_mktsegment, CAST(c_nationkey AS BIGINT) AS c_nationkey, CAST(2 - GROUPING(c_mktsegment) - GROUPING(c_nationkey) AS BIGINT) AS __level, nullif(count(*) FILTER (WHERE NOT c_acctbal > 5000), 0) AS false_n, nullif(count(*) FILTER (WHERE c_acctbal > 5000), 0) AS true_n FROM customer GROUP BY ROLLUP (c_mktsegment, c_nationkey)")

# Order and pages

query("sort_page_rows", ask("orders", {"select": ["o_orderkey", "o_totalprice", "o_orderstatus"], "sort": [{"by": "o_orderstatus", "desc": True}, {"by": "o_totalprice"}], "page": {"offset": 20, "limit": 50}}),
      "SELECT o_orderkey, o_totalprice, o_orderstatus FROM orders ORDER BY o_orderstatus DESC NULLS LAST, o_totalprice NULLS LAST, o_orderkey LIMIT 50 OFFSET 20")
query("sort_derived_nulls", ask("customer", {"derive": [{"name": "x", "expr": "c_acctbal", "where": "c_nationkey > 12"}], "select": ["c_custkey", "x"], "sort": [{"by": "x", "desc": True, "nulls_last": False}]}),
      "SELECT c_custkey, CASE WHEN c_nationkey > 12 THEN c_acctbal END AS x FROM customer")
query("sort_page_groups", ask("orders", {"group_by": ["o_custkey"], "measures": [N], "sort": [{"by": "n", "desc": True}], "page": {"limit": 25}}),
      "SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 ORDER BY n DESC, o_custkey LIMIT 25")

# Two sides

_SHOCK = {"kind": "shock", "column": "o_totalprice", "op": "pct", "value": 10, "where": "o_orderstatus == 'F'"}
_ADD = {"kind": "shock", "column": "o_custkey", "op": "add", "value": 5, "where": "o_orderstatus == 'F'"}
query("compare_groups", against("orders", {"group_by": ["o_orderstatus"], "measures": [{"name": "hi", "fn": "max", "of": "o_totalprice"}, {"name": "k", "fn": "sum", "of": "o_custkey"}]}, **whatif(_SHOCK, _ADD)),
      "WITH s AS (SELECT o_orderstatus, max(CASE WHEN o_orderstatus = 'F' THEN o_totalprice * 1.1::DOUBLE ELSE o_totalprice END) AS hi, CAST(sum(CASE WHEN o_orderstatus = 'F' THEN o_custkey + 5 ELSE o_custkey END) AS BIGINT) AS k, max(o_totalprice) AS hi__base, CAST(sum(o_custkey) AS BIGINT) AS k__base FROM orders GROUP BY 1) SELECT *, hi - hi__base AS hi__delta, (hi - hi__base) / hi__base * 100 AS hi__pct, k - k__base AS k__delta, CAST(k - k__base AS DOUBLE) / CAST(k__base AS DOUBLE) * 100 AS k__pct FROM s")
query("compare_rows", against("orders", {"filter": "o_custkey > 100", "select": ["o_custkey", "o_orderstatus"]}, **whatif(_ADD)),
      "WITH t AS (SELECT o_orderkey, o_orderstatus, CASE WHEN o_orderstatus = 'F' THEN o_custkey + 5 ELSE o_custkey END AS o_custkey FROM orders), a AS (SELECT * FROM t WHERE o_custkey > 100), b AS (SELECT * FROM orders WHERE o_custkey > 100) SELECT coalesce(a.o_orderkey, b.o_orderkey) AS o_orderkey, a.o_custkey, b.o_custkey AS o_custkey__base, a.o_custkey - b.o_custkey AS o_custkey__delta, CAST(a.o_custkey - b.o_custkey AS DOUBLE) / b.o_custkey * 100 AS o_custkey__pct, a.o_orderstatus, b.o_orderstatus AS o_orderstatus__base FROM a FULL JOIN b ON a.o_orderkey = b.o_orderkey")
query("compare_rollup", against("orders", {"group_by": ["o_orderstatus", "o_orderpriority"], "rollup": True, "measures": [{"name": "n", "fn": "count_rows", "where": "o_custkey > 700"}]}, **whatif(_ADD)),
      "WITH t AS (SELECT *, CASE WHEN o_orderstatus = 'F' THEN o_custkey + 5 ELSE o_custkey END AS c FROM orders), s AS (SELECT o_orderstatus, o_orderpriority, CAST(2 - GROUPING(o_orderstatus) - GROUPING(o_orderpriority) AS BIGINT) AS __level, count(*) FILTER (WHERE c > 700) AS n, count(*) FILTER (WHERE o_custkey > 700) AS n__base FROM t GROUP BY ROLLUP (o_orderstatus, o_orderpriority)) SELECT *, n - n__base AS n__delta, CASE WHEN n__base <> 0 THEN CAST(n - n__base AS DOUBLE) / n__base * 100 END AS n__pct FROM s")

# What if

_EDITS = {"kind": "override", "edits": [{"key": {"p_partkey": k}, "column": "p_size", "value": v} for k, v in ((1, 99), (2, 98), (3, None), (2, 97))]}
query("whatif_override", ask("part", {"select": ["p_partkey", "p_size", "p_retailprice"]}, **whatif(_EDITS, {"kind": "override", "edits": [{"key": {"p_partkey": 1}, "column": "p_retailprice", "value": 1.5}]})),
      "SELECT p_partkey, CAST(CASE p_partkey WHEN 1 THEN 99 WHEN 2 THEN 97 WHEN 3 THEN NULL ELSE p_size END AS BIGINT) AS p_size, CASE WHEN p_partkey = 1 THEN 1.5::DOUBLE ELSE p_retailprice END AS p_retailprice FROM part")
query("whatif_shock_float", ask("part", {"select": ["p_partkey", "p_retailprice"]}, **whatif({"kind": "shock", "column": "p_retailprice", "op": "mul", "value": "1.5", "where": "p_size > 25"}, {"kind": "shock", "column": "p_retailprice", "op": "add", "value": 2})),
      "SELECT p_partkey, CASE WHEN p_size > 25 THEN p_retailprice * 1.5::DOUBLE ELSE p_retailprice END + 2::DOUBLE AS p_retailprice FROM part")


def _shocked_decimal(spark: SparkSession, sf_dir: str) -> DataFrame:
    catalog = Catalog(spark)
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", F.col("p_retailprice").cast("decimal(15,2)").alias("price"))
    catalog.register_frame("prices", part, key_columns=["p_partkey"], version="1")
    return Engine(spark, catalog, [WhatIfPlugin()]).frame({"dataset": "prices", **whatif({"kind": "shock", "column": "price", "op": "pct", "value": "2.5"})})


query("whatif_shock_decimal", _shocked_decimal,
      "WITH t AS (SELECT p_partkey, CAST(CAST(p_retailprice AS DECIMAL(15,2)) * 100000 AS BIGINT) * 1025 // 1000 AS m FROM part) SELECT p_partkey, CAST(CAST((m + CASE WHEN m % 1000 > 500 OR (m % 1000 = 500 AND (m // 1000) % 2 = 1) THEN 1000 - m % 1000 ELSE -(m % 1000) END) // 1000 AS DECIMAL(38,0)) / 100 AS DECIMAL(38,2)) AS price FROM t", "price")
query("whatif_shock_int_round", ask("part", {"select": ["p_partkey", "p_size"]}, **whatif({"kind": "shock", "column": "p_size", "op": "mul", "value": "0.5", "round": True})),
      "SELECT p_partkey, CAST(round_even(p_size * 0.5::DOUBLE, 0) AS BIGINT) AS p_size FROM part")
query("whatif_formula", ask("part", {"select": ["p_partkey", "p_size", "area", "twice"], "filter": "area > 100"}, **whatif({"kind": "formula", "name": "twice", "expr": "area * 2"}, {"kind": "formula", "name": "area", "expr": "p_size * p_size"}, _EDITS)),
      "WITH t AS (SELECT p_partkey, CAST(CASE p_partkey WHEN 1 THEN 99 WHEN 2 THEN 97 WHEN 3 THEN NULL ELSE p_size END AS BIGINT) AS p_size FROM part) SELECT p_partkey, p_size, p_size * p_size AS area, p_size * p_size * 2 AS twice FROM t WHERE p_size * p_size > 100")
query("whatif_disable", ask("part", {"group_by": ["p_brand"], "measures": [{"name": "s", "fn": "sum", "of": "p_size"}]}, **whatif({"kind": "shock", "column": "p_size", "op": "add", "value": 1}, {"kind": "shock", "column": "p_size", "op": "add", "value": 10}, {"kind": "disable", "seq": 2})),
      "SELECT p_brand, CAST(sum(p_size + 1) AS BIGINT) AS s FROM part GROUP BY 1")


def _unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    edits = {"kind": "override", "edits": [{"key": {"p_partkey": k}, "column": "p_size", "value": 1} for k in (1, 2, -5, -7)]}
    done = engine_on(spark, sf_dir, "part").run({"dataset": "part", "query": {"measures": [N]}, **whatif(edits, strict=False)})
    return spark.createDataFrame([(r["p_partkey"],) for r in done.meta.extensions["whatif"]["unmatched_edits"]], "p_partkey long")


query("unmatched_edits", _unmatched, "SELECT k AS p_partkey FROM (VALUES (1::BIGINT), (2), (-5), (-7)) e(k) ANTI JOIN part ON k = p_partkey")


def _scenario(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = engine_on(spark, sf_dir, "orders")
    saved = engine.plugin("whatif").scenarios
    first = saved.create("ten percent", "orders", steps=[_SHOCK])
    saved.append(first.id, [_ADD], 1)
    fork = saved.fork(first.id, "copy", version=1)
    return engine.frame({"dataset": "orders", "query": {"group_by": ["o_orderstatus"], "measures": [{"name": "hi", "fn": "max", "of": "o_totalprice"}, {"name": "k", "fn": "sum", "of": "o_custkey"}]}, "extensions": {"whatif": {"scenario": fork.id, "steps": [_ADD]}}})


query("scenario_fork", _scenario,
      "SELECT o_orderstatus, max(CASE WHEN o_orderstatus = 'F' THEN o_totalprice * 1.1::DOUBLE ELSE o_totalprice END) AS hi, CAST(sum(CASE WHEN o_orderstatus = 'F' THEN o_custkey + 5 ELSE o_custkey END) AS BIGINT) AS k FROM orders GROUP BY 1")

query("whatif_shock_over_formula", ask("part", {"select": ["p_partkey", "p_size", "area"]}, **whatif({"kind": "formula", "name": "area", "expr": "p_size * p_size"}, {"kind": "shock", "column": "p_size", "op": "add", "value": 3, "where": "area > 400 and p_retailprice > 1000"})),
      "WITH t AS (SELECT p_partkey, CAST(CASE WHEN p_size * p_size > 400 AND p_retailprice > 1000 THEN p_size + 3 ELSE p_size END AS BIGINT) AS p_size FROM part) SELECT *, p_size * p_size AS area FROM t")


def _two_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    catalog = Catalog(spark)
    catalog.register_scan("customer", f"{sf_dir}/customer.parquet", key_columns=["c_custkey", "c_nationkey"], version="1")
    edits = [{"key": {"c_custkey": k, "c_nationkey": n}, "column": "c_acctbal", "value": -1} for k in range(1, 11) for n in range(0, 25, 2)]
    return Engine(spark, catalog, [WhatIfPlugin()]).frame({"dataset": "customer", "query": {"select": ["c_custkey", "c_nationkey", "c_acctbal"]}, **whatif({"kind": "override", "edits": edits}, strict=False)})


query("whatif_composite_key", _two_keys,
      "SELECT c_custkey, CAST(c_nationkey AS BIGINT) AS c_nationkey, CASE WHEN c_custkey BETWEEN 1 AND 10 AND c_nationkey % 2 = 0 THEN -1::DOUBLE ELSE c_acctbal END AS c_acctbal FROM customer")
query("compare_totals", against("orders", {"measures": [{"name": "k", "fn": "sum", "of": "o_custkey"}, N]}, **whatif(_ADD)),
      "WITH s AS (SELECT CAST(sum(CASE WHEN o_orderstatus = 'F' THEN o_custkey + 5 ELSE o_custkey END) AS BIGINT) AS k, CAST(sum(o_custkey) AS BIGINT) AS k__base, count(*) AS n FROM orders) SELECT k, k__base, k - k__base AS k__delta, CAST(k - k__base AS DOUBLE) / CAST(k__base AS DOUBLE) * 100 AS k__pct, n, n AS n__base, CAST(0 AS BIGINT) AS n__delta, 0::DOUBLE AS n__pct FROM s")

# Decimals, odd values and names, counts

query("decimal_products", ask("lineitem", {"derive": [{"name": "p", "expr": f"{PRICE} * {DISCOUNT}"}, {"name": "half", "expr": f"{PRICE} / 2"}, {"name": "neg", "expr": f"-{PRICE} + 0.125"}], "select": ["l_orderkey", "p", "half", "neg"]}),
      "SELECT l_orderkey, CAST(CAST(l_extendedprice AS DECIMAL(15,2)) * CAST(l_discount AS DECIMAL(5,2)) AS DECIMAL(38,4)) AS p, CAST(CAST(l_extendedprice AS DECIMAL(15,2)) * CAST(0.5 AS DECIMAL(2,1)) AS DECIMAL(38,10)) AS half, CAST(0.125 - CAST(l_extendedprice AS DECIMAL(15,2)) AS DECIMAL(38,3)) AS neg FROM lineitem", "p half neg")
query("decimal_min_max_distinct", ask("lineitem", {"group_by": ["l_returnflag"], "measures": [{"name": "lo", "fn": "min", "of": PRICE}, {"name": "hi", "fn": "max", "of": REVENUE}, {"name": "kinds", "fn": "count_distinct", "of": DISCOUNT}, {"name": "s", "fn": "sum", "of": PRICE}], "having": "s > 10.5"}),
      f"SELECT l_returnflag, CAST(min(CAST(l_extendedprice AS DECIMAL(15,2))) AS DECIMAL(38,2)) AS lo, max({SQL_REVENUE}) AS hi, count(DISTINCT CAST(l_discount AS DECIMAL(5,2))) AS kinds, CAST(sum(CAST(l_extendedprice AS DECIMAL(15,2))) AS DECIMAL(38,2)) AS s FROM lineitem GROUP BY 1", "lo hi s")
query("decimal_rollup_pivot", ask("lineitem", {"derive": REV, "group_by": ["l_returnflag", "l_linenumber"], "rollup": True, "measures": [SUM_REV], "pivot": {"on": ["l_linestatus"], "domain": [["F"], ["O"]], "totals": True}}),
      f"SELECT l_returnflag, CAST(l_linenumber AS BIGINT) AS l_linenumber, CAST(2 - GROUPING(l_returnflag) - GROUPING(l_linenumber) AS BIGINT) AS __level, sum({SQL_REVENUE}) FILTER (WHERE l_linestatus = 'F') AS \"F_rev\", sum({SQL_REVENUE}) FILTER (WHERE l_linestatus = 'O') AS \"O_rev\", sum({SQL_REVENUE}) AS rev FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linenumber)", "F_rev O_rev rev")
query("rollup_sorted_page", ask("orders", {"group_by": ["o_orderstatus", "o_orderpriority"], "rollup": True, "measures": [N], "sort": [{"by": "o_orderstatus", "desc": True}, {"by": "o_orderpriority", "desc": True}], "page": {"offset": 3, "limit": 9}}),
      "SELECT o_orderstatus, o_orderpriority, CAST(2 - GROUPING(o_orderstatus) - GROUPING(o_orderpriority) AS BIGINT) AS __level, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority) ORDER BY GROUPING(o_orderstatus), o_orderstatus DESC NULLS LAST, GROUPING(o_orderpriority), o_orderpriority DESC NULLS LAST LIMIT 9 OFFSET 3")


def _odd_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    catalog = Catalog(spark)
    x = F.when(F.col("c_custkey") % 3 == 0, float("nan")).when(F.col("c_custkey") % 5 == 0, float("inf")).when(F.col("c_custkey") % 7 == 0, float("-inf")).otherwise(F.col("c_acctbal"))
    customer = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", x.alias("and"), F.col("c_nationkey").alias("Any Name"))
    catalog.register_frame("odd", customer, key_columns=["c_custkey"], version="1")
    return Engine(spark, catalog).frame({"dataset": "odd", "query": {"filter": "col('and') > 100 or col('and') is None", "derive": [{"name": "twice", "expr": "col('and') * 2"}, {"name": "next", "expr": "col('Any Name') + 1"}], "select": ["c_custkey", "and", "twice", "next"]}})


query("odd_values_and_names", _odd_values,
      'WITH t AS (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 OR c_custkey % 5 = 0 OR c_custkey % 7 = 0 THEN NULL ELSE c_acctbal END AS x, CAST(c_nationkey + 1 AS BIGINT) AS next FROM customer) SELECT c_custkey, x AS "and", x * 2 AS twice, next FROM t WHERE x > 100 OR x IS NULL')


def _counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = engine_on(spark, sf_dir, "orders")
    page = {"offset": 10, "limit": 5}
    rows = engine.run({"dataset": "orders", "query": {"filter": "o_totalprice > 50000", "page": page}}).meta
    groups = engine.run({"dataset": "orders", "query": {"group_by": ["o_custkey"], "measures": [N], "page": page}}).meta
    return spark.createDataFrame([(rows.total_rows, rows.rows, groups.total_rows, groups.rows)], "total long, page long, groups long, group_page long")


query("total_rows", _counts, "SELECT count(*) FILTER (WHERE o_totalprice > 50000) AS total, CAST(5 AS BIGINT) AS page, count(DISTINCT o_custkey) AS groups, CAST(5 AS BIGINT) AS group_page FROM orders")

# Plugins, callers, grids

query("plugin_function", ask("part", {"derive": [{"name": "c", "expr": "clip(p_size, 10, 20)"}], "select": ["p_partkey", "c"]}),
      "SELECT p_partkey, CAST(least(greatest(p_size, 10), 20) AS BIGINT) AS c FROM part")
query("plugin_median", ask("part", {"group_by": ["p_brand"], "rollup": True, "measures": [{"name": "m", "fn": "median", "of": "p_size", "where": "p_size > 5"}]}),
      "SELECT p_brand, CAST(1 - GROUPING(p_brand) AS BIGINT) AS __level, median(CAST(p_size AS DOUBLE)) FILTER (WHERE p_size > 5) AS m FROM part GROUP BY ROLLUP (p_brand)")
query("row_filter_context", ask("customer", {"group_by": ["c_mktsegment"], "measures": [N]}, Caller("analyst", "c_nationkey in (1, 2, 3)", frozenset({"c_mktsegment", "c_nationkey"}))),
      "SELECT c_mktsegment, count(*) AS n FROM customer WHERE c_nationkey IN (1, 2, 3) GROUP BY 1")
query("column_restriction", ask("customer", {"sort": [{"by": "c_custkey"}]}, Caller(allowed_columns=frozenset({"c_name"}))),
      "SELECT c_custkey, c_name FROM customer")


def _grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = engine_on(spark, sf_dir, "orders")
    filters = {"o_orderpriority": {"filterType": "text", "type": "contains", "filter": "URGENT"}, "o_totalprice": {"filterType": "number", "type": "greaterThan", "filter": 1000}}
    asked = {"startRow": 0, "endRow": 100, "rowGroupCols": [{"id": "o_orderstatus"}, {"id": "o_custkey"}], "groupKeys": ['"F"'], "valueCols": [{"id": "o_totalprice", "aggFunc": "max"}, {"id": "o_orderkey", "aggFunc": "count"}], "filterModel": filters, "sortModel": [{"colId": "o_orderkey", "sort": "desc"}]}
    return engine.frame(GridAdapter(engine, "orders").request(asked))


query("grid_drilldown", _grid,
      "SELECT o_custkey, max(o_totalprice) AS o_totalprice, count(*) AS o_orderkey FROM orders WHERE contains(lower(o_orderpriority), 'urgent') AND o_totalprice > 1000 AND o_orderstatus = 'F' GROUP BY 1 ORDER BY 3 DESC, 1 LIMIT 100")


def _grid_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = engine_on(spark, sf_dir, "orders")
    filters = {
        "o_orderstatus": {"filterType": "set", "values": ["F", "O", None]},
        "o_orderpriority": {"filterType": "multi", "filterModels": [None, {"filterType": "text", "operator": "OR", "conditions": [{"type": "startsWith", "filter": "1"}, {"type": "endsWith", "filter": "low"}]}]},
        "o_orderdate": {"filterType": "date", "type": "inRange", "inRangeInclusive": True, "dateFrom": "1994-01-01 00:00:00", "dateTo": "1997-12-31 00:00:00"},
        "o_custkey": {"filterType": "number", "type": "notBlank"},
    }
    return engine.frame(GridAdapter(engine, "orders").request({"startRow": 0, "rowGroupCols": [], "valueCols": [], "filterModel": filters})).select("o_orderkey", "o_orderstatus", "o_orderpriority")


query("grid_filters", _grid_filters,
      "SELECT o_orderkey, o_orderstatus, o_orderpriority FROM orders WHERE (o_orderstatus IN ('F', 'O') OR o_orderstatus IS NULL) AND (starts_with(lower(o_orderpriority), '1') OR ends_with(lower(o_orderpriority), 'low')) AND CAST(o_orderdate AS DATE) BETWEEN DATE '1994-01-01' AND DATE '1997-12-31' AND o_custkey IS NOT NULL")


def _grid_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = engine_on(spark, sf_dir, "orders")
    asked = {"startRow": 0, "endRow": 50, "rowGroupCols": [{"id": "o_orderpriority"}], "groupKeys": [], "valueCols": [{"id": "o_custkey", "aggFunc": "sum"}], "pivotCols": [{"id": "o_orderstatus"}], "pivotMode": True, "filterModel": {}}
    return engine.frame(GridAdapter(engine, "orders").request(asked, domain=(("F",), ("O",))))


query("grid_pivot", _grid_pivot,
      "SELECT o_orderpriority, CAST(sum(o_custkey) FILTER (WHERE o_orderstatus = 'F') AS BIGINT) AS \"F_o_custkey\", CAST(sum(o_custkey) FILTER (WHERE o_orderstatus = 'O') AS BIGINT) AS \"O_o_custkey\", CAST(sum(o_custkey) AS BIGINT) AS o_custkey FROM orders GROUP BY 1")
query("keyless_page", lambda spark, sf: engine_on(spark, sf, "lineitem").frame({"dataset": "lineitem", "query": {"filter": "l_quantity > 45", "sort": [{"by": "l_extendedprice"}, {"by": "l_orderkey"}, {"by": "l_partkey"}, {"by": "l_suppkey"}], "select": ["l_orderkey", "l_partkey", "l_extendedprice"], "page": {"offset": 5, "limit": 40}}}),
      "SELECT l_orderkey, l_partkey, l_extendedprice FROM lineitem WHERE l_quantity > 45 ORDER BY l_extendedprice, l_orderkey, l_partkey, l_suppkey LIMIT 40 OFFSET 5")
query("audit_counts", lambda spark, sf: spark.createDataFrame([tuple(engine_on(spark, sf, "orders").run({"dataset": "orders", "query": {"filter": "o_orderstatus == 'O'", "group_by": ["o_orderpriority"]}, "options": {"audit": True}}).meta.stage_rows.values())], "dataset long, filtered long, result long"),
      "SELECT count(*) AS dataset, count(*) FILTER (WHERE o_orderstatus = 'O') AS filtered, count(DISTINCT o_orderpriority) FILTER (WHERE o_orderstatus = 'O') AS result FROM orders")
