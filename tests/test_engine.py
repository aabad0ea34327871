import time

import pyarrow as pa
import pytest

from tallyspark.engine import Caller, Engine, EngineConfig
from tallyspark.errors import EngineError
from tallyspark.plans.logical import Limits
from tallyspark.plans.request import RunRequest, canonical_json, parse_request
from tallyspark.sources.catalog import Catalog, check_keys, normalized
from tallyspark.runtime import Executor, ResultCache, cpu_limit, runtime_check


def code_of(call):
    with pytest.raises(EngineError) as caught:
        call()
    return caught.value.code


def test_rows_in_key_order_and_pages(engine, rows):
    assert [r["id"] for r in rows({"select": ["id"]})] == [1, 2, 3, 4, 5]
    assert [r["id"] for r in rows({"select": ["id"], "sort": [{"by": "price", "desc": True}], "page": {"offset": 1, "limit": 3}})] == [1, 2, 5]
    assert [r["id"] for r in rows({"select": ["id"], "sort": [{"by": "price", "desc": True, "nulls_last": False}], "page": {"limit": 1}})] == [3]
    past = engine.run({"dataset": "trades", "query": {"page": {"offset": 50, "limit": 5}}})
    assert (past.meta.rows, past.meta.total_rows) == (0, 5)
    assert rows({"page": {"limit": 0}}) == []


def test_keyless_rows_keep_their_order_and_hide_it(engine, rows):
    assert rows({}, "loose") == [{"v": 3.0}, {"v": 1.0}, {"v": 2.0}, {"v": None}]
    assert rows({"page": {"offset": 1, "limit": 2}}, "loose") == [{"v": 1.0}, {"v": 2.0}]


def test_null_conditions_drop_rows_and_pick_otherwise(rows):
    assert [r["id"] for r in rows({"filter": "price > 1", "select": ["id"]})] == [1, 2, 4]
    got = rows({"derive": [{"name": "x", "expr": "qty", "where": "price > 1", "otherwise": "0"}, {"name": "y", "expr": "qty", "where": "price > 1"}], "select": ["x", "y"]})
    assert got == [{"x": 4, "y": 4}, {"x": 10, "y": 10}, {"x": 0, "y": None}, {"x": -2, "y": -2}, {"x": 0, "y": None}]


def test_measures(rows):
    measures = [{"name": "s", "fn": "sum", "of": "price * qty"}, {"name": "m", "fn": "mean", "of": "qty"}, {"name": "c", "fn": "count", "of": "price"}, {"name": "n", "fn": "count_rows"}, {"name": "d", "fn": "count_distinct", "of": "zone"}, {"name": "lo", "fn": "min", "of": "day"}, {"name": "w", "fn": "wavg", "of": "yield", "weight": "qty"}, {"name": "none", "fn": "sum", "of": "price", "where": "qty > 99"}, {"name": "med", "fn": "median", "of": "qty"}]
    got = rows({"group_by": ["book"], "measures": measures})
    assert got[0] == {"book": "alpha", "s": "122.50", "m": "7.0000000000", "c": 2, "n": 2, "d": 2, "lo": "2025-01-03", "w": 0.5, "none": None, "med": 7.0}
    assert got[1] == {"book": "beta", "s": "-200.00", "m": "0.5000000000", "c": 1, "n": 2, "d": 1, "lo": "2025-04-03", "w": 3.75, "none": None, "med": 0.5}
    assert got[2]["book"] is None and got[2]["w"] is None


def test_nothing_still_has_a_total(rows):
    assert rows({"filter": "id > 99", "measures": [{"name": "n", "fn": "count_rows"}, {"name": "s", "fn": "sum", "of": "qty"}]}) == [{"n": 0, "s": None}]
    assert rows({"filter": "id > 99", "group_by": ["book"], "rollup": True, "measures": [{"name": "n", "fn": "count_rows"}]}) == [{"book": None, "__level": 0, "n": 0}]
    assert rows({"filter": "id > 99", "group_by": ["book"], "measures": [{"name": "n", "fn": "count_rows"}]}) == []


def test_rollup_puts_subtotals_after_details(rows):
    got = rows({"group_by": ["book", "zone"], "rollup": True, "measures": [{"name": "q", "fn": "sum", "of": "qty"}], "post": [{"name": "share", "expr": "q / total(q)"}], "sort": [{"by": "book", "desc": True}]})
    assert [(r["book"], r["zone"], r["__level"], r["q"]) for r in got] == [
        ("beta", "north", 2, 3), ("beta", None, 2, -2), ("beta", None, 1, 1), ("alpha", "north", 2, 4), ("alpha", "south", 2, 10), ("alpha", None, 1, 14), (None, "north", 2, 0), (None, None, 1, 0), (None, None, 0, 15),
    ]
    assert got[-1]["share"] == "1.0000000000"


def test_having_applies_at_every_level(rows):
    got = rows({"group_by": ["book"], "rollup": True, "measures": [{"name": "q", "fn": "sum", "of": "qty"}], "having": "q * 2 < total(q)"})
    assert [(r["book"], r["__level"]) for r in got] == [("beta", 1), (None, 1)]


def test_pivot(rows):
    query = {"group_by": ["book"], "measures": [{"name": "q", "fn": "sum", "of": "qty"}], "pivot": {"on": ["zone"], "totals": True}}
    assert rows(query) == [{"book": "alpha", "north_q": 4, "south_q": 10, "(blank)_q": None, "q": 14}, {"book": "beta", "north_q": 3, "south_q": None, "(blank)_q": -2, "q": 1}, {"book": None, "north_q": 0, "south_q": None, "(blank)_q": None, "q": 0}]
    fixed = rows({**query, "pivot": {"on": ["zone"], "domain": [["south"]], "totals": True}, "sort": [{"by": "south_q"}]})
    assert [(r["book"], r["south_q"], r["q"]) for r in fixed] == [("alpha", 10, 14), ("beta", None, 1), (None, None, 0)]
    assert [r["book"] for r in rows({**query, "pivot": {"on": ["zone"], "domain": [["south"]]}})] == ["alpha"]
    assert code_of(lambda: rows({**query, "pivot": {"on": ["zone"], "separator": "o"}})) == "pivot_separator_conflict"


def test_compare_versions_and_what_if(engine, spark):
    steps = [{"kind": "shock", "column": "qty", "op": "add", "value": 1, "where": "book == 'alpha'"}]
    got = engine.compare({"dataset": "trades", "extensions": {"whatif": {"steps": steps}}, "query": {"group_by": ["book"], "measures": [{"name": "q", "fn": "sum", "of": "qty"}], "sort": [{"by": "q__delta", "desc": True}]}}).to_records()
    assert got[0] == {"book": "alpha", "q": 16, "q__base": 14, "q__delta": 2, "q__pct": pytest.approx(200 / 14)}
    assert [r for r in got if r["book"] is None][0]["q__pct"] is None  # the base is 0
    rows = engine.compare({"dataset": "trades", "extensions": {"whatif": {"steps": steps}}, "query": {"select": ["qty"], "filter": "qty > 4"}}).to_records()
    assert [(r["id"], r["qty"], r["qty__base"], r["qty__delta"]) for r in rows] == [(1, 5, None, None), (2, 11, 10, 1)]
    assert code_of(lambda: engine.compare({"dataset": "loose", "query": {}})) == "no_key_columns"


def test_callers_see_only_what_they_may(engine):
    caller = Caller("me", "qty > 0", frozenset({"qty", "book"}))
    got = engine.run({"dataset": "trades", "query": {}}, caller)
    assert list(got.to_records()[0]) == ["id", "book", "qty"] and got.meta.total_rows == 3
    assert code_of(lambda: engine.run({"dataset": "trades", "query": {"filter": "price > 1"}}, caller)) == "unknown_column"
    assert engine.distinct_values("trades", "book", caller=caller) == ["alpha", "beta"]


@pytest.mark.parametrize(
    ("request_", "code", "path"),
    [
        ({"dataset": "nope"}, "dataset_not_found", "/dataset"), ({"dataset": {"id": "trades", "version": "v9"}}, "dataset_not_found", "/dataset/version"), ({"dataset": "trades", "query": {"filter": "qty"}}, "type_mismatch", "/query/filter"),
        ({"dataset": "trades", "query": {"measures": [{"name": "m", "fn": "nope", "of": "qty"}]}}, "unknown_aggregate", "/query/measures/0/fn"), ({"dataset": "trades", "query": {"post": [{"name": "a", "expr": "1"}]}}, "invalid_request", "/query"),
        ({"dataset": "trades", "query": {"group_by": ["book"], "sort": [{"by": "qty"}]}}, "unknown_column", "/query/sort/0/by"), ({"dataset": "trades", "query": {"sort": [{"by": "qty"}, {"by": "qty"}]}}, "invalid_sort", "/query/sort/1/by"),
        ({"dataset": "trades", "query": {"group_by": ["book"], "rollup": True, "measures": [{"name": "n", "fn": "count_rows"}], "sort": [{"by": "n"}]}}, "invalid_sort", "/query/sort/0/by"), ({"dataset": "trades", "query": {"derive": [{"name": "__x", "expr": "1"}]}}, "name_conflict", "/query/derive/0/name"),
        ({"dataset": "trades", "query": {"filter": "total(qty) > 1"}}, "invalid_total", "/query/filter"), ({"dataset": "trades", "extensions": {"nope": {}}}, "unknown_extension", "/extensions/nope"), ({"dataset": "trades", "query": {"page": {"limit": 10**6}}}, "limit_exceeded", "/query/page/limit"),
        ({"dataset": "trades", "spec_version": 9}, "unsupported_spec_version", "/spec_version"), ({"dataset": "trades", "query": {"derive": [{"name": "n", "expr": None}]}}, "type_mismatch", "/query/derive/0/expr"),
    ],
)
def test_errors_have_codes_and_places(engine, request_, code, path):
    with pytest.raises(EngineError) as caught:
        engine.run(request_)
    assert (caught.value.code, caught.value.path) == (code, path)


def test_caps_cache_and_overflow(spark, engine):
    small = Engine(spark, engine.catalog, config=EngineConfig(limits=Limits(max_unpaged_rows=3, max_groups=2, max_pivot_columns=1)))
    assert code_of(lambda: small.run({"dataset": "trades"})) == "too_many_rows"
    assert code_of(lambda: small.run({"dataset": "trades", "query": {"group_by": ["id"]}})) == "limit_exceeded"
    assert code_of(lambda: small.run({"dataset": "trades", "query": {"measures": [{"name": "n", "fn": "count_rows"}], "pivot": {"on": ["zone"]}}})) == "limit_exceeded"
    assert code_of(lambda: engine.run({"dataset": "trades", "query": {"derive": [{"name": "big", "expr": "qty * 9223372036854775807"}]}})) == "compute_error"
    query = {"dataset": "trades", "query": {"group_by": ["book"], "measures": [{"name": "s", "fn": "sum", "of": "qty"}]}}
    engine.cache.clear()
    first, second = engine.run(query), engine.run({**query, "query": {**query["query"], "page": {"offset": 1, "limit": 1}}})
    assert (first.meta.cached, second.meta.cached, second.meta.rows, second.meta.total_rows) == (False, True, 1, 3)


def test_fingerprints_follow_meaning(engine):
    of = lambda q, **more: engine.run({"dataset": "trades", "query": {"group_by": ["book"], **q}, **more}).meta.fingerprint
    base = of({"filter": "qty > 1.50"})
    assert base == of({"filter": "(qty) > 1.5", "having": None})
    assert base != of({"filter": "qty > 1.51"}) and base != of({"filter": "qty > 1.50"}, extensions={"whatif": {"steps": [{"kind": "shock", "column": "qty", "op": "add", "value": 1}]}})
    assert canonical_json(parse_request({"query": {}, "dataset": "x"}, RunRequest)) == '{"dataset":{"id":"x"}}'


def test_explain_audit_and_arrow(engine):
    told = engine.explain({"dataset": "trades", "query": {"derive": [{"name": "v", "expr": "price*qty"}], "group_by": ["book"], "measures": [{"name": "v", "fn": "sum", "of": "v"}]}})
    assert told["derive"][0] == {"name": "v", "formula": "price * qty", "columns": ["price", "qty"], "type": "decimal(2)"} and "HashAggregate" in told["plan"]
    got = engine.run({"dataset": "trades", "query": {"filter": "qty > 0", "group_by": ["book"]}, "options": {"audit": True}})
    assert got.meta.stage_rows == {"dataset": 5, "filtered": 3, "result": 2}
    assert pa.ipc.open_stream(got.to_arrow_ipc()).read_all().num_rows == 2


def test_timeouts_cancel_jobs(spark):
    from pyspark.sql import functions as F

    slow = F.udf(lambda x: time.sleep(20) or x, "long")
    began = time.monotonic()
    executor = Executor(spark, 1, 0.05)
    assert code_of(lambda: executor.run(lambda: spark.range(4).select(slow("id")).collect(), time.monotonic() + 2)) == "timeout"
    assert time.monotonic() - began < 15
    with executor.slot():
        assert code_of(lambda: executor.slot().__enter__()) == "engine_busy"


def test_runtime(spark, tmp_path):
    (tmp_path / "cpu.max").write_text("200000 100000")
    assert cpu_limit(str(tmp_path)) == 2.0
    assert runtime_check(spark, str(tmp_path))["warnings"]
    cache = ResultCache(10)
    for k in "abc":
        cache.put(k, k, 4)
    assert (cache.get("a"), cache.get("b"), cache.get("c")) == (None, "b", "c")


def test_catalog(spark, tmp_path):
    catalog = Catalog(spark, max_versions=2)
    frame = spark.createDataFrame([(1, 1.5, "a"), (2, float("inf"), None)], "k short, f float, s string")
    df, types = normalized(frame)
    assert [str(types[c]) for c in ("k", "f", "s")] == ["int", "float", "str"] and df.collect()[1].f is None
    a = catalog.register_frame("d", frame, key_columns=["k"])
    assert a.version.startswith("h:") and a.version == catalog.register_frame("d", frame, key_columns=["k"]).version
    assert [(c.name, c.role, c.editable) for c in a.schema.columns] == [("k", "key", False), ("f", "measure", True), ("s", "dimension", True)]
    for v in ("2", "3"):
        catalog.register_frame("d", frame, key_columns=["k"], version=v)
    assert catalog.get("d").version == "3" and code_of(lambda: catalog.get("d", a.version)) == "dataset_not_found"
    for keys in (["f"], ["nope"], ["s"]):
        assert code_of(lambda keys=keys: catalog.register_frame("e", frame, key_columns=keys)) == "invalid_key"
    assert code_of(lambda: check_keys(frame.union(frame), types, ["k"])) == "invalid_key"
    assert code_of(lambda: catalog.register_frame("e", frame.withColumnRenamed("f", "__f"))) == "name_conflict"
    path = str(tmp_path / "p.parquet")
    frame.write.parquet(path)
    scan = catalog.register_scan("scan", path)
    assert scan.version.startswith("f:") and Engine(spark, catalog).run({"dataset": "scan", "query": {"page": {"limit": 1, "offset": 1}}}).meta.total_rows == 2
    assert code_of(lambda: catalog.register_scan("x", str(tmp_path / "none"))) == "file_not_found"
    assert code_of(lambda: catalog.register_scan("x", "s3://bucket/x")) == "version_required"
    with pa.OSFile(str(tmp_path / "x.arrow"), "wb") as f, pa.ipc.new_file(f, pa.schema([("v", pa.int64())])) as w:
        w.write_batch(pa.record_batch({"v": pa.array([5, 3, 4])}))
    catalog.register_scan("ipc", str(tmp_path / "x.arrow"), format="ipc")
    assert [r["v"] for r in Engine(spark, catalog).run({"dataset": "ipc"}).to_records()] == [5, 3, 4]
    catalog.drop("ipc")
    assert {d.id for d in catalog.list()} == {"d", "scan"}


def test_filters_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "wide.parquet")
    spark.range(100).selectExpr("id", "id * 2 as twice", "cast(id as string) as text").write.parquet(path)
    catalog = Catalog(spark)
    catalog.register_scan("wide", path, key_columns=["id"])
    plan = Engine(spark, catalog).explain({"dataset": "wide", "query": {"filter": "twice > 50", "group_by": ["text"], "measures": [{"name": "n", "fn": "count_rows"}]}})["plan"]
    assert "GreaterThan(twice,50)" in plan and "ReadSchema: struct<twice:bigint,text:string>" in plan


def test_streams_run_the_same_queries(spark, tmp_path):
    from tallyspark.streaming.live import streaming_query

    folder = str(tmp_path / "in")
    spark.createDataFrame([("a", 1.0), ("b", 5.0), ("a", 3.0)], "k string, v double").write.parquet(folder)
    stream = spark.readStream.schema("k string, v double").parquet(folder)
    out = streaming_query(stream, {"filter": "v > 0", "group_by": ["k"], "measures": [{"name": "s", "fn": "sum", "of": "v"}], "having": "s > 1"})
    q = out.writeStream.format("memory").queryName("live").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.table("live").collect())) == [("a", 4.0), ("b", 5.0)]
    assert code_of(lambda: streaming_query(stream, {"sort": [{"by": "v"}]})) == "invalid_request"
