"""Grids, HTTP routes and the ASGI mount."""

import json
import sys
import types

import pytest

from tallyspark.engine import Caller
from tallyspark.errors import EngineError
from tallyspark.plans.request import Measure
from tallyspark.serving.grid import GridAdapter, edit_to_override
from tallyspark.serving.routes import Router, core_router, mount_fastapi


@pytest.fixture
def grid(engine):
    return GridAdapter(engine, "trades")


def ids(grid, model, **more):
    return [r["id"] for r in grid.rows({"startRow": 0, "endRow": 100, "filterModel": model, **more})["rowData"]]


@pytest.mark.parametrize(
    ("model", "want"),
    [
        ({"book": {"filterType": "set", "values": ["alpha"]}}, [1, 2]),
        ({"book": {"filterType": "set", "values": ["beta", None]}}, [3, 4, 5]),
        ({"book": {"filterType": "set", "values": []}}, []),
        ({"book": {"filterType": "text", "type": "contains", "filter": "ALPH"}}, [1, 2]),
        ({"book": {"filterType": "text", "type": "notContains", "filter": "alpha"}}, [3, 4, 5]),
        ({"zone": {"filterType": "text", "type": "notEqual", "filter": "north"}}, [2, 4]),
        ({"zone": {"filterType": "text", "type": "blank"}}, [4]),
        ({"zone": {"filterType": "text", "type": "notBlank"}}, [1, 2, 3, 5]),
        ({"price": {"filterType": "number", "type": "greaterThanOrEqual", "filter": 12.5}}, [1, 4]),
        ({"price": {"filterType": "number", "type": "inRange", "filter": 7.25, "filterTo": 12.5}}, []),
        ({"price": {"filterType": "number", "type": "inRange", "filter": 7.25, "filterTo": 12.5, "inRangeInclusive": True}}, [1, 2]),
        ({"day": {"filterType": "date", "type": "lessThan", "dateFrom": "2025-02-03 00:00:00"}}, [1]),
        ({"day": {"filterType": "date", "type": "blank"}}, [3]),
        ({"qty": {"filterType": "number", "operator": "OR", "conditions": [{"type": "lessThan", "filter": 0}, {"type": "equals", "filter": 10}]}}, [2, 4]),
        ({"qty": {"filterType": "multi", "filterModels": [None, {"filterType": "number", "type": "greaterThan", "filter": 3}]}}, [1, 2]),
        ({"book": None}, [1, 2, 3, 4, 5]),
    ],
)
def test_filters(grid, model, want):
    assert ids(grid, model) == want


@pytest.mark.parametrize("model", [{"filterType": "join"}, {"book": {"filterType": "magic"}}, {"book": {"filterType": "text", "type": "fuzzy"}}, {"qty": {"filterType": "number", "type": "near", "filter": 1}}])
def test_unknown_filters_are_refused(grid, model):
    with pytest.raises(EngineError) as e:
        ids(grid, model)
    assert e.value.code == "unsupported_filter"


def test_groups_drill_down_to_rows_and_null_keys(grid):
    asked = {"startRow": 0, "endRow": 10, "rowGroupCols": [{"id": "book"}, {"field": "zone", "id": "z"}], "valueCols": [{"id": "qty", "aggFunc": "sum"}, {"id": "price", "aggFunc": "count"}], "sortModel": [{"colId": "ag-Grid-AutoColumn", "sort": "desc"}]}
    top = grid.rows(asked)
    assert [(r["book"], r["qty"], r["price"]) for r in top["rowData"]] == [("beta", 1, 2), ("alpha", 14, 2), (None, 0, 1)] and top["rowCount"] == 3
    key = top["rowData"][2]["__group_key"]
    assert key == "null" and json.loads(top["rowData"][0]["__row_id"]) == ['"beta"']
    inner = grid.rows({**asked, "groupKeys": [key]})["rowData"]
    assert [(r["zone"], r["qty"]) for r in inner] == [("north", 0)] and json.loads(inner[0]["__row_id"]) == ["null", '"north"']
    leaves = grid.rows({**asked, "groupKeys": [key, '"north"']})["rowData"]
    assert [r["id"] for r in leaves] == [5] and leaves[0]["__row_id"] == "[5]"


def test_pivots_keep_their_columns_when_a_group_opens(grid):
    asked = {"startRow": 0, "endRow": 10, "rowGroupCols": [{"id": "book"}], "valueCols": [{"id": "qty", "aggFunc": "sum"}], "pivotCols": [{"id": "zone"}], "pivotMode": True}
    top = grid.rows(asked)
    assert top["pivotResultFields"] == ["north_qty", "south_qty", "(null)_qty"] or len(top["pivotResultFields"]) == 3
    rows = {r["book"]: r for r in top["rowData"]}
    assert rows["alpha"]["north_qty"] == 4 and rows["alpha"]["south_qty"] == 10 and rows["alpha"]["qty"] == 14
    assert grid.rows({**asked, "groupKeys": ['"alpha"']})["pivotResultFields"] == top["pivotResultFields"]


def test_own_aggregates_and_refusals(engine, grid):
    own = GridAdapter(engine, "trades", measures={"middle": lambda c: Measure(c, "median", __import__("tallyspark.expr", fromlist=["col"]).col(c))})
    asked = {"startRow": 0, "endRow": 5, "rowGroupCols": [{"id": "book"}], "valueCols": [{"id": "qty", "aggFunc": "middle"}]}
    assert {r["book"]: r["qty"] for r in own.rows(asked)["rowData"]}["alpha"] == 7.0
    for raw, code in ((asked, "unsupported_aggregation"), ({"rowGroupCols": [{}]}, "invalid_request"), ({"groupKeys": ["1"]}, "invalid_request"), ("x", "invalid_request")):
        with pytest.raises(EngineError) as e:
            grid.rows(raw)
        assert e.value.code == code


def test_cell_edits_become_overrides(engine):
    step = edit_to_override(engine, "trades", {"data": {"id": 1, "qty": 4}, "column": "qty", "value": "7"})
    assert step == {"kind": "override", "edits": [{"key": {"id": 1}, "column": "qty", "value": 7}]}
    bad = [({"__group_key": "1"}, "qty", 1, "not_editable"), ({"id": 1}, "book", "x", "not_editable"), ({}, "qty", 1, "invalid_key"), ({"id": 1}, "nope", 1, "unknown_column"), ({"id": 1}, "qty", 1.5, "invalid_value")]
    for data, column, value, code in bad:
        with pytest.raises(EngineError) as e:
            edit_to_override(engine, "trades", {"data": data, "column": column, "value": value})
        assert e.value.code == code
    with pytest.raises(EngineError) as e:
        edit_to_override(engine, "loose", {"data": {"v": 1}, "column": "v", "value": 1})
    assert e.value.code == "no_key_columns"


@pytest.fixture
def call(engine):
    router = core_router(engine, lambda headers: Caller(headers.get("x-user"), allowed_columns=frozenset({"book", "qty"}) if headers.get("x-user") == "few" else None))

    def send(method, path, body=None, query=None, headers=None):
        out = router.handle(method, path, b"" if body is None else json.dumps(body).encode(), query, headers)
        return out.status, out.body

    return send


def test_query_routes(call):
    ask = {"dataset": "trades", "query": {"group_by": ["book"], "measures": [{"name": "p", "fn": "sum", "of": "price"}], "sort": [{"by": "book"}]}}
    status, body = call("POST", "/query", ask, {"decimals": "str"})
    assert status == 200 and [r["p"] for r in body["rows"]] == ["19.75", "100.00", "0.05"]
    assert call("POST", "/query", ask)[1]["rows"][0]["p"] == 19.75
    assert isinstance(call("POST", "/query", ask, headers={"Accept": "application/vnd.apache.arrow.stream"})[1], bytes)
    assert call("POST", "/distinct", {"dataset": "trades", "column": "zone"})[1] == {"values": ["north", "south", None]}
    assert "plan" in call("POST", "/explain", ask)[1]
    status, body = call("POST", "/compare", {**ask, "extensions": {"whatif": {"steps": [{"kind": "shock", "column": "qty", "op": "add", "value": 1}]}}, "query": {"measures": [{"name": "q", "fn": "sum", "of": "qty"}]}})
    assert status == 200 and body["rows"][0]["q__delta"] == 5
    assert call("POST", "/aggrid/rows", {"dataset": "trades", "request": {"startRow": 0, "endRow": 2}})[1]["rowCount"] == 5


def test_errors_have_codes_and_statuses(call, engine):
    assert call("GET", "/nowhere")[0] == 404
    assert call("POST", "/query", {"dataset": "none", "query": {}})[0] == 404
    status, body = call("POST", "/query", {"dataset": "trades", "query": {"filter": "nope > 1"}})
    assert status in (400, 422) and body["code"] == "unknown_column"
    router = Router(engine, lambda _: Caller(), max_body_bytes=10)
    assert router.handle("POST", "/query", b"x" * 11).status >= 400
    assert core_router(engine, lambda _: Caller()).handle("POST", "/query", b"{no json").body["code"] == "invalid_request"
    with pytest.raises(TypeError):
        core_router(engine)


def test_schema_and_columns_by_caller(call):
    columns = lambda user: {c["name"] for c in call("GET", "/datasets/trades/schema", headers={"X-User": user})[1]["columns"]}
    assert columns("few") == {"id", "book", "qty"} and "price" in columns("all")
    assert {"trades", "loose"} <= {d["id"] for d in call("GET", "/datasets")[1]}


def test_scenario_routes(call):
    step = {"kind": "shock", "column": "qty", "op": "add", "value": 1}
    status, made = call("POST", "/scenarios", {"name": "one", "dataset": "trades", "steps": [step]})
    assert status == 201 and made["version"] == 1
    path = f"/scenarios/{made['id']}"
    assert call("POST", path + "/steps", {"steps": [step]})[1]["code"] == "invalid_request"
    assert call("POST", path + "/steps", {"steps": [step], "expected_version": 0})[0] == 409
    headers = {"Idempotency-Key": "k1"}
    for _ in range(2):
        assert call("POST", path + "/steps", {"steps": [step], "expected_version": 1, "note": "again"}, headers=headers)[1]["version"] == 2
    log = call("GET", path + "/log")[1]
    assert [e["seq"] for e in log] == [1, 2] and log[1]["note"] == "again" and len(call("GET", path + "/log", query={"version": "1"})[1]) == 1
    status, fork = call("POST", path + "/fork", {"name": "two", "version": 1})
    assert status == 201 and fork["forked_from"] == {"id": made["id"], "version": 1}
    status, body = call("POST", "/query", {"dataset": "trades", "query": {"measures": [{"name": "q", "fn": "sum", "of": "qty"}]}, "extensions": {"whatif": {"scenario": made["id"]}}})
    assert body["rows"][0]["q"] == 15 + 10
    assert call("DELETE", path)[0] == 204 and call("GET", path)[0] == 404
    assert made["id"] not in {s["id"] for s in call("GET", "/scenarios")[1]}
    assert call("POST", "/aggrid/edit", {"dataset": "trades", "data": {"id": 2}, "column": "qty", "value": 3})[1]["kind"] == "override"


def test_asgi_mount_passes_requests_on(engine, monkeypatch):
    """Against stand-ins for Starlette's three names that it uses."""
    import asyncio

    async def run_in_threadpool(f, *args):
        return f(*args)

    class Reply:
        def __init__(self, content, status, media_type):
            self.content, self.status, self.media_type = content, status, media_type

    for name, values in {"starlette": {}, "starlette.concurrency": {"run_in_threadpool": run_in_threadpool}, "starlette.requests": {"Request": object}, "starlette.responses": {"Response": Reply}}.items():
        module = types.ModuleType(name)
        vars(module).update(values)
        monkeypatch.setitem(sys.modules, name, module)
    held = {}

    class App:
        def add_route(self, path, handler, methods):
            held[path] = handler

    mount_fastapi(core_router(engine, lambda _: Caller()), App(), "/api")

    class Request:
        method, query_params, headers = "GET", {}, {}
        url = types.SimpleNamespace(path="/api/datasets")

        async def body(self):
            return b""

    out = asyncio.run(held["/api/{path:path}"](Request()))
    assert out.status == 200 and "trades" in {d["id"] for d in json.loads(out.content)}
