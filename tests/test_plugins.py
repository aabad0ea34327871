"""The registry, discovery, operations and routes of plugins."""

import pytest

from tallyspark.engine import Caller, Engine
from tallyspark.errors import EngineError
from tallyspark.functions import plugins as P
from tallyspark.functions.plugins import PluginError
from tallyspark.serving.routes import core_router
from tallyspark.types import FLOAT, STR


class Own(P.Plugin):
    name, version = "own", "3"

    def __init__(self, register=lambda r: None, name="own"):
        self._register, self.name = register, name

    def register(self, registry):
        self._register(registry)


def function(name="twice", least=1, most=1):
    return P.FunctionDef(name, lambda t: t[0], lambda x: x * 2, lambda x: x * 2, least, most)


def engine_with(engine, *plugins):
    return Engine(engine.spark, engine.catalog, list(plugins))


@pytest.mark.parametrize(
    "register",
    [
        lambda r: r.add_function(function("abs")),
        lambda r: r.add_aggregate(P.AggregateDef("sum", lambda t: t, lambda c: c, list)),
        lambda r: r.add_operation(P.OperationDef("run", lambda b: b, lambda e, b, c: b)),
        lambda r: r.add_function(function("Bad Name")),
        lambda r: [r.add_function(function()), r.add_function(function())],
        lambda r: r.add_function(function(least=2, most=1)),
    ],
)
def test_conflicts_are_refused(engine, register):
    with pytest.raises(PluginError):
        engine_with(engine, Own(register))


def test_plugins_need_names_of_their_own(engine):
    for two in ([Own(), Own()], [Own(name="")]):
        with pytest.raises(PluginError):
            engine_with(engine, *two)
    with pytest.raises(EngineError) as e:
        engine_with(engine).plugin("own")
    assert e.value.code == "plugin_not_installed"
    with pytest.raises(PluginError) as e:  # the first keeps the name
        engine_with(engine, Own(lambda r: r.add_function(function())), Own(lambda r: r.add_function(function()), "other"))
    assert "own" in str(e.value)


def test_functions_and_aggregates_of_plugins(engine):
    def register(r):
        r.add_function(function())
        r.add_aggregate(P.AggregateDef("spread", lambda t: FLOAT, lambda c: __import__("pyspark.sql.functions", fromlist=["max"]).max(c) - __import__("pyspark.sql.functions", fromlist=["min"]).min(c), lambda v: float(max(v) - min(v))))

    own = engine_with(engine, Own(register))
    got = own.run({"dataset": "trades", "query": {"derive": [{"name": "d", "expr": "twice(qty)"}], "group_by": ["book"], "measures": [{"name": "s", "fn": "spread", "of": "d"}], "sort": [{"by": "book"}]}})
    assert [r["s"] for r in got.to_records()] == [12.0, 10.0, 0.0] and got.meta.versions["own"] == "3"
    for query, code in (({"filter": "twice(qty, 1) > 0"}, "type_mismatch"), ({"filter": "thrice(qty) > 0"}, "unknown_function"), ({"measures": [{"name": "s", "fn": "median", "of": "qty"}]}, "unknown_aggregate")):
        with pytest.raises(EngineError) as e:
            own.run({"dataset": "trades", "query": query})
        assert e.value.code == code


def test_operations_and_routes(engine):
    def register(r):
        r.add_operation(P.OperationDef("own.echo", lambda b: b["x"], lambda e, x, caller: {"x": x, "who": caller.principal}, "says it again"))
        r.add_routes(lambda router: router.add("GET", "/own/{word}", lambda c: {"word": c.params["word"]}))

    own = engine_with(engine, Own(register))
    assert own.call("own.echo", {"x": 5}, Caller("ann")) == {"x": 5, "who": "ann"}
    with pytest.raises(EngineError) as e:
        own.call("nope", {})
    assert e.value.code == "unknown_operation"
    router = core_router(own, lambda headers: Caller(headers.get("x-user")))
    assert router.handle("GET", "/own/hello").body == {"word": "hello"}
    assert router.handle("POST", "/operations/own.echo", b'{"x": 1}', headers={"X-User": "ben"}).body == {"x": 1, "who": "ben"}
    assert router.handle("GET", "/operations").body == [{"name": "own.echo", "description": "says it again"}]


def test_discovery_by_entry_points(monkeypatch):
    class Point:
        def __init__(self, name, made):
            self.name, self.made = name, made

        def load(self):
            return self.made

    monkeypatch.setattr(P, "entry_points", lambda group: [Point("b", lambda: Own(name="b")), Point("a", lambda: Own(name="a"))])
    assert [p.name for p in P.discover()] == ["a", "b"]
    monkeypatch.setattr(P, "entry_points", lambda group: [Point("x", lambda: object())])
    with pytest.raises(PluginError):
        P.discover()


def test_typechecks_of_plugins(engine):
    def only_text(t):
        if t[0] != STR:
            raise TypeError("needs text")
        return STR

    own = engine_with(engine, Own(lambda r: r.add_function(P.FunctionDef("shout", only_text, lambda x: x, lambda x: x, 1, 1))))
    with pytest.raises(EngineError) as e:
        own.run({"dataset": "trades", "query": {"derive": [{"name": "d", "expr": "shout(qty)"}]}})
    assert e.value.code == "type_mismatch" and "needs text" in str(e.value)
