"""Requests: their shape, defaults, canonical form and fingerprint. Unknown fields are refused; errors carry JSON pointers."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field, fields, is_dataclass
from decimal import Decimal

from .. import expr
from ..errors import SpecError, pointer
from ..expr import FUNCTION_NAME, Node
from ..types import plain

SPEC_VERSION = 2
AGGREGATES = frozenset({"sum", "mean", "min", "max", "count", "count_rows", "count_distinct", "wavg"})


def bad(message: str, path: str) -> SpecError:
    return SpecError(message, "invalid_request", path)


Reader = Callable[[object, str], object]


def _plain(kind: type | tuple, what: str, test: Callable[[object], bool] = lambda _: True) -> Reader:
    def read(v: object, path: str) -> object:
        if not isinstance(v, kind) or isinstance(v, bool) and kind is not bool or not test(v):
            raise bad(f"expected {what}", path)
        return v

    return read


def optional(read: Reader) -> Reader:
    return lambda v, path: None if v is None else read(v, path)


def many(read: Reader, least: int = 0) -> Reader:
    def run(v: object, path: str) -> tuple:
        if not isinstance(v, list | tuple) or len(v) < least:
            raise bad(f"expected a list of {least} or more", path)
        return tuple(read(x, pointer(path, i)) for i, x in enumerate(v))

    return run


text = _plain(str, "text")
filled = _plain(str, "text that is not empty", bool)
flag = _plain(bool, "true or false")
count = _plain(int, "a whole number from 0", lambda v: v >= 0)
number = _plain((int, float), "a number above 0", lambda v: v > 0)
mapping = _plain(dict, "an object")
scalar = lambda v, path: v if v is None or isinstance(v, str | int | float | bool | Decimal) else _raise(bad("expected a plain value", path))
formula: Reader = expr.parse


def _raise(e: Exception) -> None:
    raise e


def part(read: Reader, default: object = ...) -> object:
    """A field of a request: how it is read, and its default (required without one)."""
    meta = {"read": read}
    if default is ...:
        return field(metadata=meta)
    return field(default_factory=dict, metadata=meta) if default == {} and isinstance(default, dict) else field(default=default, metadata=meta)


class Shape:
    """Base of request parts: `read` builds one from JSON."""

    def rules(self, path: str) -> None:
        """Raises if the fields do not go together."""

    @classmethod
    def lift(cls, v: object) -> object:
        """Short forms to full ones."""
        return v

    @classmethod
    def read(cls, v: object, path: str = "") -> Shape:
        if isinstance(v, cls):
            return v
        v = cls.lift(v)
        if not isinstance(v, Mapping):
            raise bad(f"expected an object ({cls.__name__})", path)
        known = {f.name: f for f in fields(cls)}
        extra = sorted(set(v) - set(known))
        if extra:
            raise bad(f"unknown field {extra[0]!r}", pointer(path, extra[0]))
        given = {}
        for name, f in known.items():
            if name in v:
                given[name] = f.metadata["read"](v[name], pointer(path, name))
        missing = [n for n, f in known.items() if n not in given and f.default is f.default_factory]
        if missing:
            raise bad(f"{missing[0]} is missing", pointer(path, missing[0]))
        out = cls(**given)
        out.rules(path)
        return out


@dataclass(frozen=True)
class Derive(Shape):
    name: str = part(filled)
    expr: Node = part(formula)
    where: Node | None = part(optional(formula), None)
    otherwise: Node | None = part(optional(formula), None)

    def rules(self, path: str) -> None:
        if self.otherwise is not None and self.where is None:
            raise bad("'otherwise' only goes with 'where'", path)


@dataclass(frozen=True)
class Measure(Shape):
    name: str = part(filled)
    fn: str = part(_plain(str, "an aggregate's name", lambda v: bool(FUNCTION_NAME.match(v))))
    of: Node | None = part(optional(formula), None)
    weight: Node | None = part(optional(formula), None)
    where: Node | None = part(optional(formula), None)

    def rules(self, path: str) -> None:
        if (self.of is None) != (self.fn == "count_rows"):
            raise bad(f"{self.fn} takes no 'of'" if self.of is not None else f"{self.fn} needs 'of'", path)
        if (self.weight is not None) != (self.fn == "wavg"):
            raise bad("'weight' goes with wavg, and only with it", path)


@dataclass(frozen=True)
class Post(Shape):
    name: str = part(filled)
    expr: Node = part(formula)


@dataclass(frozen=True)
class Pivot(Shape):
    on: tuple = part(many(text, 1))
    values: tuple | None = part(optional(many(text)), None)
    domain: tuple | None = part(optional(many(many(scalar))), None)
    totals: bool = part(flag, False)
    separator: str = part(filled, "_")
    null_label: str = part(text, "(blank)")

    def rules(self, path: str) -> None:
        if any(len(d) != len(self.on) for d in self.domain or ()):
            raise bad("every domain entry needs a value for each 'on' column", path)


@dataclass(frozen=True)
class SortKey(Shape):
    by: str = part(text)
    desc: bool = part(flag, False)
    nulls_last: bool = part(flag, True)


@dataclass(frozen=True)
class Page(Shape):
    limit: int = part(count)
    offset: int = part(count, 0)


@dataclass(frozen=True)
class Query(Shape):
    filter: Node | None = part(optional(formula), None)
    derive: tuple = part(many(Derive.read), ())
    select: tuple | None = part(optional(many(text)), None)
    group_by: tuple = part(many(text), ())
    measures: tuple = part(many(Measure.read), ())
    post: tuple = part(many(Post.read), ())
    having: Node | None = part(optional(formula), None)
    rollup: bool = part(flag, False)
    pivot: Pivot | None = part(optional(Pivot.read), None)
    sort: tuple = part(many(SortKey.read), ())
    page: Page | None = part(optional(Page.read), None)

    @property
    def aggregated(self) -> bool:
        return bool(self.group_by or self.measures)

    def rules(self, path: str) -> None:
        if not self.aggregated:
            for name in ("post", "having", "rollup", "pivot"):
                if getattr(self, name):
                    raise bad(f"'{name}' needs group_by or measures", path)
        elif self.select is not None:
            raise bad("'select' is for row views", path)
        if self.rollup and not self.group_by:
            raise bad("'rollup' needs group_by", path)
        if self.pivot and self.having is not None:
            raise bad("'having' does not go with 'pivot'", path)


@dataclass(frozen=True)
class DatasetRef(Shape):
    id: str = part(filled)
    version: str | None = part(optional(text), None)

    @classmethod
    def lift(cls, v: object) -> object:
        return {"id": v} if isinstance(v, str) else v


def _engine(v: object, path: str) -> object:
    return v if v in ("auto", "in-memory", "streaming") else _raise(bad("expected auto, in-memory or streaming", path))


@dataclass(frozen=True)
class Options(Shape):
    """`engine` is accepted for compatibility: Spark plans every request alike."""

    deterministic: bool = part(flag, False)
    engine: str = part(_engine, "auto")
    timeout_s: float | None = part(optional(number), None)
    audit: bool = part(flag, False)


def _version(v: object, path: str) -> object:
    return v if v == SPEC_VERSION else _raise(SpecError(f"spec_version {v!r} is not supported", "unsupported_spec_version", path))


@dataclass(frozen=True)
class Side(Shape):
    version: str | None = part(optional(text), None)
    extensions: dict = part(mapping, {})


@dataclass(frozen=True)
class RunRequest(Shape):
    dataset: DatasetRef = part(DatasetRef.read)
    spec_version: int = part(_version, SPEC_VERSION)
    extensions: dict = part(mapping, {})
    query: Query = part(Query.read, Query())
    options: Options = part(Options.read, Options())


@dataclass(frozen=True)
class CompareRequest(Shape):
    dataset: DatasetRef = part(DatasetRef.read)
    spec_version: int = part(_version, SPEC_VERSION)
    extensions: dict = part(mapping, {})
    base: Side = part(Side.read, Side())
    query: Query = part(Query.read, Query())
    options: Options = part(Options.read, Options())

    def rules(self, path: str) -> None:
        if self.query.pivot:
            raise bad("compare does not go with pivot", pointer(path, "query", "pivot"))


def upgrade(raw: dict) -> dict:
    """Version 1 requests, which had what-if at the top level, as version 2."""
    version = raw.get("spec_version", 1 if {"scenario", "what_if", "base_what_if"} & set(raw) else SPEC_VERSION)
    if version == SPEC_VERSION or not isinstance(version, int):
        return raw
    if version != 1:
        raise SpecError(f"spec_version {version} is not supported", "unsupported_spec_version", "/spec_version")
    out = {k: v for k, v in raw.items() if k not in ("spec_version", "scenario", "what_if", "base", "base_what_if")}
    options = dict(out.get("options") or {})
    strict = options.pop("strict_edits", None)
    if "options" in out:
        out["options"] = options

    def moved(scenario: object, steps: object) -> dict:
        block = {"scenario": scenario, "steps": steps or None, "strict_edits": strict}
        return {"whatif": {k: v for k, v in block.items() if v is not None}} if scenario is not None or steps else {}

    target, base = moved(raw.get("scenario"), raw.get("what_if")), moved(raw.get("base"), raw.get("base_what_if"))
    if target:
        out["extensions"] = {**(out.get("extensions") or {}), **target}
    if base:
        out["base"] = {"extensions": base}
    return out


def parse_request(raw: object, kind: type) -> Shape:
    if isinstance(raw, str | bytes):
        try:
            raw = json.loads(raw)
        except ValueError as e:
            raise bad(f"not JSON: {e}", "") from None
    return kind.read(upgrade(raw) if isinstance(raw, Mapping) else raw)


def canonical(value: object) -> object:
    """JSON data without fields at their defaults, so that requests of the same meaning have the same form."""
    if isinstance(value, Node):
        return expr.to_json(value)
    if is_dataclass(value) and not isinstance(value, type):
        out = {}
        for f in fields(value):
            v = getattr(value, f.name)
            default = f.default if f.default_factory is f.default else f.default_factory() if callable(f.default_factory) else f.default
            if v != default or f.default is f.default_factory:
                out[f.name] = canonical(v)
        return {**({"kind": value.kind} if hasattr(value, "kind") else {}), **out}
    if isinstance(value, Mapping):
        return {str(k): canonical(v) for k, v in value.items()}
    if isinstance(value, list | tuple | set | frozenset):
        return [canonical(v) for v in (sorted(value) if isinstance(value, set | frozenset) else value)]
    if isinstance(value, Decimal):
        return plain(value)
    return value if value is None or isinstance(value, str | int | float | bool) else str(value)


def canonical_json(value: object) -> str:
    return json.dumps(canonical(value), sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def fingerprint(value: object) -> str:
    return hashlib.sha256(canonical_json(value).encode()).hexdigest()
