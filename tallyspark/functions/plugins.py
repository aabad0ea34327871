"""Extension points: functions, aggregates, dataset transforms, operations and routes, and the registry that holds them."""

from __future__ import annotations

import re
from abc import ABC, abstractmethod
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from importlib.metadata import entry_points
from typing import TYPE_CHECKING, Any

from ..expr import FUNCTIONS
from ..plans.request import AGGREGATES
from ..types import ValueType

if TYPE_CHECKING:
    from pyspark.sql import Column, DataFrame

ENTRY_POINTS = "tallyspark.plugins"


class PluginError(ValueError):
    """Plugins that do not fit together."""


@dataclass(frozen=True)
class FunctionDef:
    """A formula function. `column` builds a Column from argument columns of their declared types; `reference` computes one
    value from plain values. With nulls="propagate" a null argument gives null without calling either."""

    name: str
    typecheck: Callable[[Sequence[ValueType]], ValueType]
    column: Callable[..., Column]
    reference: Callable[..., Any]
    min_args: int = 1
    max_args: int | None = 1
    nulls: str = "propagate"
    description: str = ""


@dataclass(frozen=True)
class AggregateDef:
    """A measure function. `column` turns a column whose nulls Spark's aggregates skip into an aggregate Column; `reference`
    takes the list of a group's values that are not null, never empty. A group without values is null."""

    name: str
    typecheck: Callable[[ValueType], ValueType]
    column: Callable[[Column], Column]
    reference: Callable[[list], Any]
    description: str = ""


class TransformPlan(ABC):
    """A transform checked against a dataset. `env` holds the column types after it; `canonical` is its identity as JSON."""

    env: dict[str, ValueType]
    canonical: list

    @abstractmethod
    def apply(self, df: DataFrame) -> DataFrame: ...

    @abstractmethod
    def apply_reference(self, rows: list[dict]) -> list[dict]: ...

    def meta(self) -> dict:
        return {}

    def explain(self) -> dict:
        return {}


class Bound(ABC):
    """A transform's block resolved for one request. `identity` must hold all that its plan depends on; `version` is the
    dataset version that it needs, if any."""

    version: str | None = None
    identity: Any = None

    @abstractmethod
    def plan(self, env: dict[str, ValueType], df: DataFrame, context: PlanContext) -> TransformPlan: ...


@dataclass(frozen=True)
class BindContext:
    """What a transform sees when a request is resolved."""

    engine: Any
    dataset: Any
    caller: Any
    path: str


@dataclass(frozen=True)
class PlanContext:
    """What a transform sees when it is planned against a version."""

    engine: Any
    dataset: Any
    env: dict[str, ValueType]
    caller: Any
    path: str


@dataclass(frozen=True)
class TransformDef:
    """Enabled in a request by extensions[name]. `parse(block, path)` reads the block, `bind(parsed, BindContext)` resolves it.
    Transforms run in the order in which they were installed, after entitlements and before the query."""

    name: str
    parse: Callable[[Any, str], Any]
    bind: Callable[[Any, BindContext], Bound]
    description: str = ""


@dataclass(frozen=True)
class OperationDef:
    """engine.call(name, request): `parse(request)` reads it, `run(engine, parsed, caller)` answers."""

    name: str
    parse: Callable[[Any], Any]
    run: Callable[[Any, Any, Any], Any]
    description: str = ""


class Plugin:
    """Subclasses set name and version (part of every fingerprint) and register; attach gets the engine afterwards."""

    name = ""
    version = "0"

    def register(self, registry: Registry) -> None:
        raise NotImplementedError

    def attach(self, engine: Any) -> None:
        return None


_TAKEN = {"function": frozenset(FUNCTIONS), "aggregate": AGGREGATES, "transform": frozenset(), "operation": frozenset({"run", "compare", "explain", "distinct", "schema"})}


@dataclass
class Registry:
    """What plugins registered, by kind and name; names are unique over all plugins."""

    entries: dict[str, dict[str, Any]] = field(default_factory=lambda: {k: {} for k in _TAKEN})
    routes: list[Callable] = field(default_factory=list)
    owners: dict[tuple[str, str], str] = field(default_factory=dict)
    owner: str = "core"

    @classmethod
    def of(cls, plugins: Sequence[Plugin]) -> Registry:
        out = cls()
        for i, p in enumerate(plugins):
            if not p.name or any(q.name == p.name for q in plugins[:i]):
                raise PluginError(f"plugin {p.name or type(p).__name__} has no name or is installed twice")
            out.owner = p.name
            p.register(out)
        out.owner = "core"
        return out

    def _add(self, kind: str, entry: Any) -> None:
        if not re.fullmatch(r"[a-z][a-z0-9_.]*" if kind == "operation" else r"[a-z][a-z0-9_]*", entry.name):
            raise PluginError(f"{self.owner}: invalid {kind} name {entry.name!r}")
        if entry.name in _TAKEN[kind]:
            raise PluginError(f"{self.owner}: {kind} {entry.name!r} is built in")
        if (kind, entry.name) in self.owners:
            raise PluginError(f"{self.owner}: {kind} {entry.name!r} belongs to {self.owners[kind, entry.name]}")
        self.owners[kind, entry.name] = self.owner
        self.entries[kind][entry.name] = entry

    def add_function(self, f: FunctionDef) -> None:
        if f.min_args < 0 or f.max_args is not None and f.max_args < f.min_args:
            raise PluginError(f"function {f.name}: invalid argument counts")
        self._add("function", f)

    def add_aggregate(self, a: AggregateDef) -> None:
        self._add("aggregate", a)

    def add_transform(self, t: TransformDef) -> None:
        self._add("transform", t)

    def add_operation(self, o: OperationDef) -> None:
        self._add("operation", o)

    def add_routes(self, hook: Callable) -> None:
        self.routes.append(hook)


def discover(group: str = ENTRY_POINTS) -> list[Plugin]:
    """A plugin of every installed entry point of that group, by name."""
    found = [e.load()() for e in sorted(entry_points(group=group), key=lambda e: e.name)]
    for p in found:
        if not isinstance(p, Plugin):
            raise PluginError(f"{p!r} is no plugin")
    return found
