"""Saved what-if scenarios: append-only, hash-chained logs of steps over a pinned dataset version, and where they are kept."""

from __future__ import annotations

import datetime as dt
import hashlib
import json
import os
import tempfile
import threading
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace
from typing import Any, Protocol

from ..engine import Caller
from ..errors import ScenarioNotFound, SpecError, VersionConflict
from ..plans.request import DatasetRef, canonical, canonical_json, fingerprint
from .steps import ScenarioRef, Step, read_step
from .transform import effective


@dataclass(frozen=True)
class Scenario:
    """Its version is the length of its log; head is the hash of the last entry, or genesis."""

    id: str
    name: str
    dataset: DatasetRef
    genesis: str
    head: str
    created_at: str
    updated_at: str
    version: int = 0
    description: str | None = None
    owner: str | None = None
    forked_from: ScenarioRef | None = None
    deleted: bool = False


@dataclass(frozen=True)
class LogEntry:
    seq: int
    step: Step
    at: str
    hash: str
    author: str | None = None
    note: str | None = None
    client_op_id: str | None = None


def genesis_of(s: Scenario) -> str:
    return fingerprint({"id": s.id, "dataset": s.dataset, "forked_from": s.forked_from, "created_at": s.created_at})


def link(previous: str, e: LogEntry) -> str:
    body = canonical_json({"seq": e.seq, "step": e.step, "author": e.author, "at": e.at, "note": e.note})
    return hashlib.sha256((previous + body).encode()).hexdigest()


def verify_chain(scenario: Scenario, log: Sequence[LogEntry]) -> bool:
    """Whether every hash follows from what came before it, from the scenario's own data on."""
    head = genesis_of(scenario)
    if head != scenario.genesis or len(log) != scenario.version:
        return False
    for i, e in enumerate(log, 1):
        head = link(head, e)
        if e.seq != i or e.hash != head:
            return False
    return head == scenario.head


class ScenarioStore(Protocol):
    """Keeps scenarios. `append` compares the version and appends in one step, or raises VersionConflict."""

    def create(self, scenario: Scenario, log: Sequence[LogEntry]) -> None: ...

    def get(self, id: str) -> Scenario: ...

    def log(self, id: str, upto: int | None = None) -> list[LogEntry]: ...

    def append(self, id: str, expected: int, entries: Sequence[LogEntry], updated_at: str) -> Scenario: ...

    def list(self) -> list[Scenario]: ...

    def delete(self, id: str, updated_at: str) -> None: ...


class MemoryStore:
    """In this process."""

    def __init__(self) -> None:
        self._lock, self._held = threading.RLock(), {}

    def _load(self, id: str) -> tuple[Scenario, list[LogEntry]]:
        if id not in self._held:
            raise ScenarioNotFound(f"no scenario {id}")
        return self._held[id]

    def _save(self, id: str, scenario: Scenario, log: list[LogEntry]) -> None:
        self._held[id] = (scenario, log)

    def create(self, scenario: Scenario, log: Sequence[LogEntry]) -> None:
        with self._lock:
            self._save(scenario.id, scenario, list(log))

    def get(self, id: str) -> Scenario:
        with self._lock:
            return self._load(id)[0]

    def log(self, id: str, upto: int | None = None) -> list[LogEntry]:
        with self._lock:
            return self._load(id)[1][:upto]

    def append(self, id: str, expected: int, entries: Sequence[LogEntry], updated_at: str) -> Scenario:
        with self._lock:
            scenario, log = self._load(id)
            if scenario.version != expected or scenario.deleted:
                raise VersionConflict(f"scenario {id} is at version {scenario.version}, not {expected}", version=scenario.version)
            new = replace(scenario, version=expected + len(entries), head=entries[-1].hash if entries else scenario.head, updated_at=updated_at)
            self._save(id, new, [*log, *entries])
            return new

    def list(self) -> list[Scenario]:
        with self._lock:
            return [s for s, _ in self._held.values()]

    def delete(self, id: str, updated_at: str) -> None:
        with self._lock:
            scenario, log = self._load(id)
            self._save(id, replace(scenario, deleted=True, updated_at=updated_at), log)


class FileStore(MemoryStore):
    """A JSON file for each scenario in a folder, replaced whole, under a lock file: durable, for several processes of a host."""

    def __init__(self, folder: str) -> None:
        super().__init__()
        self.folder = folder
        os.makedirs(folder, exist_ok=True)
        self._lock = _FileLock(os.path.join(folder, ".lock"))

    def _path(self, id: str) -> str:
        return os.path.join(self.folder, hashlib.sha256(id.encode()).hexdigest() + ".json")

    def _load(self, id: str) -> tuple[Scenario, list[LogEntry]]:
        try:
            with open(self._path(id), encoding="utf-8") as f:
                return from_json(json.load(f))
        except FileNotFoundError:
            raise ScenarioNotFound(f"no scenario {id}") from None

    def _save(self, id: str, scenario: Scenario, log: list[LogEntry]) -> None:
        handle, part = tempfile.mkstemp(dir=self.folder)
        with os.fdopen(handle, "w", encoding="utf-8") as f:
            json.dump(to_json(scenario, log), f)
        os.replace(part, self._path(id))

    def list(self) -> list[Scenario]:
        with self._lock:
            found = []
            for x in sorted(os.listdir(self.folder)):
                if x.endswith(".json"):
                    with open(os.path.join(self.folder, x), encoding="utf-8") as f:
                        found.append(from_json(json.load(f))[0])
            return found


class _FileLock:
    """Between threads and processes."""

    def __init__(self, path: str) -> None:
        self.path, self._own, self._held = path, threading.RLock(), []

    def __enter__(self) -> None:
        import fcntl

        self._own.acquire()
        f = open(self.path, "w")
        if not self._held:
            fcntl.flock(f, fcntl.LOCK_EX)
        self._held.append(f)

    def __exit__(self, *_: object) -> None:
        self._held.pop().close()
        self._own.release()


class RedisStore(MemoryStore):
    """In Redis: one key a scenario, changed under WATCH, so that a concurrent append is a conflict. The client is given."""

    def __init__(self, client: Any, prefix: str = "tallyspark:scenario:") -> None:
        super().__init__()
        self.client, self.prefix = client, prefix

    def _load(self, id: str) -> tuple[Scenario, list[LogEntry]]:
        raw = self.client.get(self.prefix + id)
        if raw is None:
            raise ScenarioNotFound(f"no scenario {id}")
        return from_json(json.loads(raw))

    def _save(self, id: str, scenario: Scenario, log: list[LogEntry]) -> None:
        self.client.set(self.prefix + id, json.dumps(to_json(scenario, log)))

    def append(self, id: str, expected: int, entries: Sequence[LogEntry], updated_at: str) -> Scenario:
        def change(pipe: Any) -> None:
            raw = pipe.get(self.prefix + id)
            if raw is None:
                raise ScenarioNotFound(f"no scenario {id}")
            local = MemoryStore()
            local.create(*from_json(json.loads(raw)))
            local.append(id, expected, entries, updated_at)
            pipe.multi()
            pipe.set(self.prefix + id, json.dumps(to_json(*local._load(id))))

        self.client.transaction(change, self.prefix + id)
        return self.get(id)

    def list(self) -> list[Scenario]:
        return [from_json(json.loads(self.client.get(k)))[0] for k in sorted(self.client.keys(self.prefix + "*"))]


def to_json(scenario: Scenario, log: Sequence[LogEntry]) -> dict:
    return {"scenario": _json(scenario), "log": [{**vars(e), "step": canonical(e.step)} for e in log]}


def _json(s: Scenario) -> dict:
    return {**vars(s), "dataset": vars(s.dataset), "forked_from": vars(s.forked_from) if s.forked_from else None}


def from_json(raw: dict) -> tuple[Scenario, list[LogEntry]]:
    s = raw["scenario"]
    forked = ScenarioRef(**s["forked_from"]) if s["forked_from"] else None
    return Scenario(**{**s, "dataset": DatasetRef(**s["dataset"]), "forked_from": forked}), [LogEntry(**{**e, "step": read_step(e["step"])}) for e in raw["log"]]


class ScenarioManager:
    """Creates, extends, forks and lists scenarios. `check(dataset, steps, caller)` raises if steps do not fit the dataset."""

    def __init__(self, store: ScenarioStore | None, engine: Any = None, check: Callable[[DatasetRef, Sequence[Step], Caller], None] | None = None) -> None:
        self._store, self.engine, self.check = store, engine, check

    @property
    def store(self) -> ScenarioStore:
        if self._store is None:
            raise SpecError("the engine has no scenario store", "no_scenario_store")
        return self._store

    def _allowed(self, caller: Caller, action: str, resource: Any) -> None:
        if self.engine is not None:
            self.engine.authorize(caller, action, resource)

    def create(self, name: str, dataset: Any, caller: Caller | None = None, *, description: str | None = None, steps: Sequence[Any] = (), id: str | None = None, forked_from: ScenarioRef | None = None) -> Scenario:
        """A scenario over a dataset version, the latest unless one is named."""
        caller, ref = caller or Caller(), DatasetRef.read(dataset, "/dataset")
        held = self.engine.catalog.get(ref.id, ref.version)
        ref, now = DatasetRef(held.id, held.version), _now()
        read = [read_step(s, f"/steps/{i}") for i, s in enumerate(steps)]
        draft = Scenario(id or uuid.uuid4().hex, name, ref, "", "", now, now, description=description, owner=caller.principal, forked_from=forked_from)
        self._allowed(caller, "scenario.create", draft)
        if read and self.check is not None:
            self.check(ref, read, caller)
        genesis = genesis_of(draft)
        entries = _entries(genesis, 1, read, caller, now, None, None)
        out = replace(draft, genesis=genesis, head=entries[-1].hash if entries else genesis, version=len(entries))
        self.store.create(out, entries)
        return out

    def get(self, id: str, caller: Caller | None = None) -> Scenario:
        found = self.store.get(id)
        if found.deleted:
            raise ScenarioNotFound(f"no scenario {id}")
        self._allowed(caller or Caller(), "scenario.read", found)
        return found

    def log(self, id: str, version: int | None = None, caller: Caller | None = None) -> list[LogEntry]:
        scenario = self.get(id, caller)
        if version is not None and not 0 <= version <= scenario.version:
            raise SpecError(f"scenario {id} has versions 0 to {scenario.version}", "invalid_version", version=version)
        return self.store.log(id, version if version is not None else scenario.version)

    def append(self, id: str, steps: Sequence[Any], expected_version: int, caller: Caller | None = None, *, note: str | None = None, client_op_id: str | None = None) -> Scenario:
        """Adds steps if the scenario is still at `expected_version`. A repeated client_op_id changes nothing. The whole log
        that would result is checked first."""
        caller = caller or Caller()
        scenario = self.get(id, caller)
        self._allowed(caller, "scenario.write", scenario)
        log = self.store.log(id)
        if client_op_id is not None and any(e.client_op_id == client_op_id for e in log):
            return scenario
        if scenario.version != expected_version:
            raise VersionConflict(f"scenario {id} is at version {scenario.version}, not {expected_version}", version=scenario.version)
        new = [read_step(s, f"/steps/{i}") for i, s in enumerate(steps)]
        whole = [*(e.step for e in log), *new]
        effective(whole)
        if self.check is not None:
            self.check(scenario.dataset, whole, caller)
        now = _now()
        return self.store.append(id, expected_version, _entries(scenario.head, scenario.version + 1, new, caller, now, note, client_op_id), now)

    def fork(self, id: str, name: str, caller: Caller | None = None, *, version: int | None = None) -> Scenario:
        """A new scenario with the steps that are in effect at a version of another."""
        log = self.log(id, version, caller)
        source = self.get(id, caller)
        steps = [s for _, s in effective([e.step for e in log])]
        return self.create(name, source.dataset, caller, description=source.description, steps=steps, forked_from=ScenarioRef(id, len(log)))

    def list(self, caller: Caller | None = None) -> list[Scenario]:
        """Those that are not deleted and that the caller may read."""
        from ..errors import Forbidden

        out = []
        for s in self.store.list():
            try:
                if not s.deleted:
                    self._allowed(caller or Caller(), "scenario.read", s)
                    out.append(s)
            except Forbidden:
                continue
        return sorted(out, key=lambda s: (s.created_at, s.id))

    def delete(self, id: str, caller: Caller | None = None) -> None:
        scenario = self.get(id, caller)
        self._allowed(caller or Caller(), "scenario.delete", scenario)
        self.store.delete(id, _now())


def _now() -> str:
    return dt.datetime.now(dt.timezone.utc).isoformat()


def _entries(head: str, first: int, steps: Sequence[Step], caller: Caller, at: str, note: str | None, op: str | None) -> list[LogEntry]:
    out = []
    for seq, step in enumerate(steps, first):
        draft = LogEntry(seq, step, at, "", caller.principal, note, op)
        head = link(head, draft)
        out.append(replace(draft, hash=head))
    return out
