"""Saved scenarios: their chain of hashes, and every store behind the same tests."""

from dataclasses import replace

import pytest

from tallyspark.engine import Caller, Engine, EngineConfig
from tallyspark.errors import EngineError, Forbidden
from tallyspark.whatif.plugin import WhatIfPlugin
from tallyspark.whatif.scenarios import FileStore, MemoryStore, RedisStore, verify_chain

ADD = {"kind": "shock", "column": "qty", "op": "add", "value": 1}
SUM = {"measures": [{"name": "q", "fn": "sum", "of": "qty"}]}


class FakeRedis:
    """get, set, keys and transaction as the client has them; `meddle` runs between a transaction's read and write, once."""

    def __init__(self):
        self.held, self.meddle, self.buffer = {}, None, None

    def get(self, key):
        return self.held.get(key)

    def set(self, key, value):
        if self.buffer is None:
            self.held[key] = value
        else:
            self.buffer.append((key, value))

    def keys(self, pattern):
        return [k for k in self.held if k.startswith(pattern.rstrip("*"))]

    def multi(self):
        pass

    def transaction(self, change, *watched):
        while True:
            before, self.buffer = [self.held.get(k) for k in watched], []
            try:
                change(self)
                wanted = self.buffer
            finally:
                self.buffer = None
            if self.meddle:
                act, self.meddle = self.meddle, None
                act()
            if before == [self.held.get(k) for k in watched]:
                self.held.update(wanted)
                return


@pytest.fixture(params=["memory", "file", "redis"])
def store(request, tmp_path):
    return {"memory": MemoryStore, "file": lambda: FileStore(str(tmp_path / "s")), "redis": lambda: RedisStore(FakeRedis())}[request.param]()


@pytest.fixture
def saved(engine, store):
    own = Engine(engine.spark, engine.catalog, [WhatIfPlugin(store)])
    return own.plugin("whatif").scenarios


def code(call):
    with pytest.raises(EngineError) as e:
        call()
    return e.value.code


def test_life_of_a_scenario(saved):
    made = saved.create("one", "trades", Caller("ann"), description="d", steps=[ADD])
    assert (made.version, made.owner, made.dataset.version) == (1, "ann", "v1")
    more = saved.append(made.id, [ADD, {"kind": "disable", "seq": 1}], 1, Caller("ben"), note="why", client_op_id="op")
    assert more.version == 3 and saved.append(made.id, [ADD], 1, client_op_id="op").version == 3
    log = saved.log(made.id)
    assert [e.seq for e in log] == [1, 2, 3] and log[1].author == "ben" and verify_chain(saved.get(made.id), log)
    assert len(saved.log(made.id, 2)) == 2
    fork = saved.fork(made.id, "two")
    assert fork.version == 1 and fork.forked_from.version == 3 and verify_chain(fork, saved.log(fork.id))
    assert [s.name for s in saved.list()] == ["one", "two"]
    saved.delete(made.id)
    assert [s.name for s in saved.list()] == ["two"] and code(lambda: saved.get(made.id)) == "scenario_not_found"


def test_refusals(saved):
    made = saved.create("one", "trades", steps=[ADD])
    assert code(lambda: saved.append(made.id, [ADD], 0)) == "version_conflict"
    assert code(lambda: saved.append(made.id, [{"kind": "disable", "seq": 9}], 1)) == "invalid_disable"
    assert code(lambda: saved.append(made.id, [{**ADD, "column": "id"}], 1)) == "not_editable"
    assert code(lambda: saved.append(made.id, [{"kind": "magic"}], 1)) == "invalid_request"
    assert code(lambda: saved.log(made.id, 5)) == "invalid_version"
    assert code(lambda: saved.get("nope")) == "scenario_not_found"
    assert saved.get(made.id).version == 1 and len(saved.log(made.id)) == 1


def test_tampering_breaks_the_chain(saved):
    made = saved.create("one", "trades", steps=[ADD, ADD])
    log = saved.log(made.id)
    for wrong in (log[:1], [log[1], log[0]], [replace(log[0], author="eve"), log[1]], [log[0], replace(log[1], note="x")], [log[0], replace(log[1], step=log[0].step, seq=3)]):
        assert not verify_chain(made, wrong)
    assert not verify_chain(replace(made, created_at="2000"), log) and verify_chain(made, log)


def test_queries_with_scenarios_and_pins(engine, store):
    own = Engine(engine.spark, engine.catalog, [WhatIfPlugin(store)])
    saved = own.plugin("whatif").scenarios
    made = saved.create("one", "trades", steps=[ADD])
    saved.append(made.id, [ADD], 1)
    ask = lambda ref, **more: own.run({"dataset": "trades", "query": SUM, "extensions": {"whatif": {"scenario": ref, **more}}})
    assert ask(made.id).to_records()[0]["q"] == 25
    assert ask({"id": made.id, "version": 1}).to_records()[0]["q"] == 20
    last = ask(made.id, steps=[ADD])
    assert last.to_records()[0]["q"] == 30 and last.meta.extensions["whatif"]["scenario"] == {"id": made.id, "version": 2}
    assert code(lambda: own.run({"dataset": "loose", "query": {}, "extensions": {"whatif": {"scenario": made.id}}})) == "dataset_mismatch"
    assert code(lambda: own.run({"dataset": {"id": "trades", "version": "v0"}, "query": SUM, "extensions": {"whatif": {"scenario": made.id}}})) in ("version_conflict", "dataset_not_found")


def test_what_callers_may_do(engine, store):
    def allow(caller, action, resource):
        if action.startswith("scenario") and caller.principal != "ann":
            raise Forbidden(f"{caller.principal} may not {action}")

    own = Engine(engine.spark, engine.catalog, [WhatIfPlugin(store)], EngineConfig(authorize=allow))
    saved = own.plugin("whatif").scenarios
    made = saved.create("one", "trades", Caller("ann"), steps=[ADD])
    for act in (lambda: saved.get(made.id, Caller("eve")), lambda: saved.append(made.id, [ADD], 1, Caller("eve")), lambda: saved.delete(made.id, Caller("eve"))):
        assert code(act) == "forbidden"
    assert saved.list(Caller("eve")) == [] and len(saved.list(Caller("ann"))) == 1


def test_without_a_store(engine):
    own = Engine(engine.spark, engine.catalog, [WhatIfPlugin()])
    assert code(lambda: own.plugin("whatif").scenarios.list()) == "no_scenario_store"


def test_concurrent_appends_of_redis_conflict(engine):
    client = FakeRedis()
    saved = Engine(engine.spark, engine.catalog, [WhatIfPlugin(RedisStore(client))]).plugin("whatif").scenarios
    made = saved.create("one", "trades")
    client.meddle = lambda: saved.append(made.id, [ADD], 0)
    assert code(lambda: saved.append(made.id, [ADD, ADD], 0)) == "version_conflict"
    assert saved.get(made.id).version == 1 and verify_chain(saved.get(made.id), saved.log(made.id))


def test_files_outlive_the_store(engine, tmp_path):
    folder = str(tmp_path / "kept")
    saved = Engine(engine.spark, engine.catalog, [WhatIfPlugin(FileStore(folder))]).plugin("whatif").scenarios
    made = saved.create("one", "trades", steps=[ADD, {"kind": "formula", "name": "f", "expr": "qty * 2"}])
    again = FileStore(folder)
    assert again.get(made.id) == made and verify_chain(made, again.log(made.id))
