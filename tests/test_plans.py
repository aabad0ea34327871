"""What plans look like, and what a cached answer costs."""

import io
import re
from contextlib import redirect_stdout

import pyarrow as pa
import pytest

from tallyspark.engine import Engine, EngineConfig
from tallyspark.sources.catalog import Catalog
from tallyspark.whatif.plugin import WhatIfPlugin


@pytest.fixture(scope="module")
def wide(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("wide") / "t.parquet")
    spark.range(2000).selectExpr("id", "id % 7 as a", "cast(id % 3 as string) as b", "case when id % 11 = 0 then double('NaN') when id % 13 = 0 then double('Infinity') else id / 8.0 end as x", "cast(id as decimal(12,2)) as d").repartition(3).write.parquet(path)
    catalog = Catalog(spark)
    catalog.register_scan("keyed", path, key_columns=["id"], version="1")
    catalog.register_scan("loose", path, version="1")
    return Engine(spark, catalog, [WhatIfPlugin()])


def explained(df):
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


def test_float_filters_reach_the_scan_and_keep_their_meaning(wide):
    for text, n in (("x > 30", None), ("30 < x and a == 2", None), ("x in (1, 2.5)", None), ("x == 1.0", None), ("x <= 2 and x >= 1", None)):
        df = wide.frame({"dataset": "keyed", "query": {"filter": text, "select": ["id", "x"]}})
        pushed = re.search(r"PushedFilters: \[(.*)\]", explained(df))[1]
        assert re.search(r"(GreaterThan|LessThan|EqualTo|In|GreaterThanOrEqual)\(x,", pushed), text
        rows = {(r.id, r.x) for r in df.collect()}
        want = {i for i in range(2000) if i % 11 and i % 13 and eval(text.replace("in (1, 2.5)", "in (1.0, 2.5)"), {"x": i / 8, "a": i % 7})}
        assert {i for i, _ in rows} == want and None not in {x for _, x in rows}
    hidden = wide.frame({"dataset": "keyed", "query": {"filter": "x is None or x != 3", "select": ["id"]}})
    assert "GreaterThan(x" not in explained(hidden) and hidden.count() == 1999


def test_keyless_scans_read_their_order_only_where_it_is_needed(wide):
    assert "row_index" not in explained(wide.frame({"dataset": "loose", "query": {"select": ["a"]}}))
    assert "row_index" not in explained(wide.frame({"dataset": "loose", "query": {"group_by": ["a"], "measures": [{"name": "n", "fn": "count_rows"}]}}))
    assert "row_index" in explained(wide.frame({"dataset": "loose", "query": {"select": ["a"], "page": {"limit": 3}}}))


def test_subtotals_totals_and_pivots_read_the_data_once(wide):
    measures = [{"name": "s", "fn": "sum", "of": "d"}, {"name": "n", "fn": "count_rows"}]
    rollup = {"group_by": ["a", "b"], "rollup": True, "measures": measures, "post": [{"name": "w", "expr": "s / total(s)"}]}
    pivot = {"group_by": ["a"], "measures": measures, "pivot": {"on": ["b"], "domain": [["0"], ["1"], ["2"]], "totals": True}}
    for query in (rollup, pivot, {**pivot, "rollup": True}):
        df = wide.frame({"dataset": "keyed", "query": query})
        df.collect()
        final = explained(df).split("== Initial Plan ==")[0]
        assert len(set(re.findall(r"Scan parquet[^\n]*\((\d+)\)", final))) == 1 or final.count("ReusedExchange") >= len(re.findall(r"\(\d+\) Scan parquet", final)) - 1, query
        expand = re.search(r"\(\d+\) Expand\nInput[^\n]*", final)
        assert expand is None or "__h0_0" in expand[0] or "sum" in expand[0]  # groups are expanded, not rows


def test_a_pivot_finds_its_domain_and_its_cells_in_one_pass(wide):
    query = {"group_by": ["a"], "measures": [{"name": "n", "fn": "count_rows"}], "pivot": {"on": ["b"], "totals": True}, "sort": [{"by": "a"}]}
    got = wide.run({"dataset": "keyed", "query": query})
    assert got.meta.pivot_fields == ["0_n", "1_n", "2_n"] and sum(r["n"] for r in got.to_records()) == 2000
    assert not wide.spark.sparkContext._jsc.getPersistentRDDs()  # let go of after the answer


def test_cached_answers_run_nothing(wide, monkeypatch):
    step = {"kind": "override", "edits": [{"key": {"id": 1}, "column": "a", "value": 5}]}
    ask = lambda at: {"dataset": "keyed", "query": {"group_by": ["a"], "measures": [{"name": "n", "fn": "count_rows"}], "page": {"offset": at, "limit": 2}}, "extensions": {"whatif": {"steps": [step]}}}
    first = wide.run(ask(0))
    assert not first.meta.cached
    monkeypatch.setattr(wide.executor, "run", lambda *a: pytest.fail("a job for a cached page"))
    second = wide.run(ask(2))
    assert second.meta.cached and second.meta.total_rows == 7 and second.meta.timings_ms["total"] < 100


def test_aggregates_beyond_the_cache_are_paged_in_spark(wide, monkeypatch):
    from tallyspark import engine as E

    monkeypatch.setattr(E, "MIN_ROWS", 10)
    own = Engine(wide.spark, wide.catalog, [], EngineConfig(cache_bytes=2000))
    query = {"group_by": ["id"], "measures": [{"name": "n", "fn": "count_rows"}], "sort": [{"by": "id", "desc": True}], "page": {"offset": 5, "limit": 3}}
    for _ in range(2):
        got = own.run({"dataset": "keyed", "query": query})
        assert [r["id"] for r in got.to_records()] == [1994, 1993, 1992] and got.meta.total_rows == 2000
    assert got.meta.cached


def test_rows_of_a_keyless_frame_keep_their_order(spark):
    df = spark.range(1000).repartition(5).selectExpr("id % 10 as a", "id")
    catalog = Catalog(spark)
    catalog.register_frame("f", df, version="1")
    own = Engine(spark, catalog, [], EngineConfig(cache_bytes=0))
    whole = [r["id"] for r in own.run({"dataset": "f", "query": {}}).to_records()]
    some = [r["id"] for r in own.run({"dataset": "f", "query": {"filter": "a > 3"}}).to_records()]
    parts = [r["id"] for at in range(0, 1000, 250) for r in own.run({"dataset": "f", "query": {"page": {"offset": at, "limit": 250}}}).to_records()]
    assert parts == whole and some == [i for i in whole if i % 10 > 3]


def test_arrow_files_with_options(spark, tmp_path):
    for k in range(2):
        table = pa.table({"i": pa.array([k * 10, k * 10 + 1]), "s": ["x", None], "f": [1.5, float("nan")]})
        with pa.OSFile(str(tmp_path / f"{k}.arrow"), "wb") as out, pa.ipc.new_file(out, table.schema) as writer:
            writer.write_table(table)
    catalog = Catalog(spark)
    catalog.register_scan("files", str(tmp_path / "*.arrow"), format="ipc", storage_options={"recursiveFileLookup": "false"})
    got = Engine(spark, catalog).run({"dataset": "files", "query": {}}).to_records()
    assert got == [{"i": 0, "s": "x", "f": 1.5}, {"i": 1, "s": None, "f": None}, {"i": 10, "s": "x", "f": 1.5}, {"i": 11, "s": None, "f": None}]
