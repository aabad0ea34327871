"""Grids with a server-side row model: their row requests as engine requests, and answers in the shape that they expect."""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from typing import Any

from ..engine import Caller, Engine
from ..errors import SpecError, pointer
from ..expr import Node, col, literal, node
from ..plans.request import DatasetRef, Measure, Page, Pivot, Query, RunRequest, SortKey
from ..types import ValueType, checked, json_value

#: The grid's own column for groups, and its aggregate names as ours.
GROUP_COLUMN = "ag-Grid-AutoColumn"
AGGREGATES = {"sum": "sum", "min": "min", "max": "max", "avg": "mean", "count": "count_rows"}
_NUMBER = {"equals": "eq", "notEqual": "ne", "lessThan": "lt", "lessThanOrEqual": "le", "greaterThan": "gt", "greaterThanOrEqual": "ge"}


@dataclass(frozen=True)
class GridRequest:
    start: int
    end: int | None
    groups: tuple[str, ...]
    values: tuple[tuple[str, str], ...]
    pivots: tuple[str, ...]
    pivoting: bool
    keys: tuple[str, ...]
    filters: Mapping[str, Any]
    sorts: tuple[tuple[str, bool], ...]

    @classmethod
    def read(cls, raw: Mapping[str, Any]) -> GridRequest:
        """From the grid's JSON; fields that it may add are let be."""
        if not isinstance(raw, Mapping):
            raise SpecError("expected a row request", "invalid_request")
        column = lambda c: c.get("field") or c["id"]
        try:
            return cls(
                int(raw.get("startRow") or 0), raw.get("endRow"), tuple(column(c) for c in raw.get("rowGroupCols") or ()), tuple((column(c), c.get("aggFunc") or "sum") for c in raw.get("valueCols") or ()),
                tuple(column(c) for c in raw.get("pivotCols") or ()), bool(raw.get("pivotMode")), tuple(raw.get("groupKeys") or ()), raw.get("filterModel") or {},
                tuple((s["colId"], s["sort"] == "desc") for s in raw.get("sortModel") or ()),
            )
        except (KeyError, TypeError, AttributeError, ValueError) as e:
            raise SpecError(f"not a row request: {e!r}", "invalid_request") from None


def _same(c: str, value: Any, t: ValueType) -> Node:
    """Equality in which null equals null."""
    if value is None:
        return node("is_null", col(c), negate=False)
    return node("cmp", col(c), _value(value, t), op="eq")


def _value(value: Any, t: ValueType) -> Node:
    kind = {"decimal": "num", "int": "int", "float": "num"}.get(t.kind, t.kind)
    plain = json_value(value)
    return literal(kind, str(plain) if kind == "num" and not isinstance(plain, int | float) else plain)


def _all(parts: Sequence[Node], op: str = "and") -> Node | None:
    return None if not parts else parts[0] if len(parts) == 1 else node("logic", *parts, op=op)


FALSE = literal("bool", False)


class GridAdapter:
    """For one engine and dataset. `measures` maps further aggregate names to functions from column to Measure."""

    def __init__(self, engine: Engine, dataset: Any, *, separator: str = "_", measures: Mapping[str, Callable[[str], Measure]] | None = None) -> None:
        self.engine, self.dataset, self.separator, self.measures = engine, DatasetRef.read(dataset, "/dataset"), separator, dict(measures or {})

    # Requests

    def request(self, raw: Mapping[str, Any], caller: Caller | None = None, extensions: Mapping[str, Any] | None = None, domain: tuple | None = None) -> RunRequest:
        """The engine's request for what the grid asks: one level of groups, or rows under all groups."""
        grid = GridRequest.read(raw)
        held = self.engine.catalog.get(self.dataset.id, self.dataset.version)
        types = held.schema.restrict((caller or Caller()).allowed_columns).types
        extensions = dict(extensions or {})
        if extensions:
            types = self.engine.view(self.dataset, extensions, caller or Caller()).env
        parts = self._filters(grid.filters, types)
        if len(grid.keys) > len(grid.groups):
            raise SpecError("more group keys than groups", "invalid_request", "/groupKeys")
        for c, k in zip(grid.groups, grid.keys, strict=False):
            parts.append(_same(c, self._key(k, self._type(types, c)), self._type(types, c)))
        page = Page(limit=max(0, grid.end - grid.start), offset=grid.start) if grid.end is not None else None
        level = grid.groups[len(grid.keys)] if len(grid.keys) < len(grid.groups) else None
        pivot = None
        if level is None and not (grid.pivoting and grid.pivots):
            allowed = [s for s in grid.sorts if s[0] in types]
            query = Query(filter=_all(parts), sort=tuple(SortKey(by, desc) for by, desc in dict(allowed).items()), page=page)
            return RunRequest(self.dataset, extensions=extensions, query=query)
        measures = tuple(self._measure(c, a, types) for c, a in grid.values)
        if grid.pivoting and grid.pivots:
            pivot = Pivot(on=grid.pivots, domain=domain, separator=self.separator, totals=True)
            for c in grid.pivots:
                self._type(types, c)
        sorts: dict[str, bool] = {}
        names = {m.name for m in measures}
        for by, desc in grid.sorts:
            by = level if by in (GROUP_COLUMN, level) and level else by
            if by == level or by in names or pivot is not None and self.separator in by:
                sorts.setdefault(by, desc)
        query = Query(filter=_all(parts), group_by=(level,) if level else (), measures=measures, pivot=pivot, sort=tuple(SortKey(by, desc) for by, desc in sorts.items()), page=page)
        return RunRequest(self.dataset, extensions=extensions, query=query)

    def _type(self, types: Mapping[str, ValueType], column: str) -> ValueType:
        if column not in types:
            raise SpecError(f"unknown column: {column}", "unknown_column", column=column)
        return types[column]

    def _measure(self, column: str, aggregate: str, types: Mapping[str, ValueType]) -> Measure:
        if aggregate in self.measures:
            return self.measures[aggregate](column)
        self._type(types, column)
        fn = AGGREGATES.get(aggregate)
        if fn is None:
            raise SpecError(f"aggregate {aggregate!r} has no measure", "unsupported_aggregation")
        return Measure(column, fn, None if fn == "count_rows" else col(column))

    def _key(self, key: str, t: ValueType) -> Any:
        """Group keys travel as JSON text."""
        try:
            value = json.loads(key)
        except ValueError:
            value = key
        return checked(value if value is None or not isinstance(value, dict | list) else key, t, "/groupKeys")

    # Filters

    def _filters(self, model: Mapping[str, Any], types: Mapping[str, ValueType]) -> list[Node]:
        if model.get("filterType") == "join":
            raise SpecError("advanced filters are not supported", "unsupported_filter", "/filterModel")
        return [n for c, spec in model.items() if spec is not None and (n := self._filter(c, spec, self._type(types, c), pointer("/filterModel", c))) is not None]

    def _filter(self, c: str, spec: Mapping[str, Any], t: ValueType, path: str) -> Node | None:
        kind = spec.get("filterType")
        if kind == "multi":
            return _all([n for s in spec.get("filterModels") or () if s is not None and (n := self._filter(c, s, t, path)) is not None])
        if "operator" in spec:
            own = spec.get("conditions") or [spec[k] for k in ("condition1", "condition2") if spec.get(k)]
            return _all([n for s in own if (n := self._filter(c, {"filterType": kind, **s}, t, path)) is not None], spec["operator"].lower())
        if kind == "set":
            values = [None if v is None else checked(v, t, path) for v in spec.get("values") or ()]
            parts = [node("in", col(c), *[_value(v, t) for v in values if v is not None], negate=False)] if any(v is not None for v in values) else []
            parts += [node("is_null", col(c), negate=False)] if None in values else []
            return _all(parts, "or") or FALSE
        test = spec.get("type")
        if test in ("blank", "notBlank"):
            empty = node("is_null", col(c), negate=False)
            if t.kind == "str":
                empty = node("logic", empty, node("cmp", col(c), literal("str", ""), op="eq"), op="or")
            return empty if test == "blank" else node("unary", empty, op="not")
        if kind == "text":
            return self._text(c, test, str(spec.get("filter") or ""), path)
        if kind in ("number", "date"):
            return self._range(c, test, spec, t, kind == "date", path)
        raise SpecError(f"filter type {kind!r} is not supported", "unsupported_filter", path)

    def _text(self, c: str, test: str, wanted: str, path: str) -> Node:
        """Without regard to case; null counts as empty."""
        have = node("func", node("func", col(c), literal("str", ""), name="coalesce"), name="lower")
        want = literal("str", wanted.lower())
        call = lambda f: node("func", have, want, name=f)
        made = {"contains": lambda: call("contains"), "notContains": lambda: node("unary", call("contains"), op="not"), "equals": lambda: node("cmp", have, want, op="eq"), "notEqual": lambda: node("cmp", have, want, op="ne"), "startsWith": lambda: call("starts_with"), "endsWith": lambda: call("ends_with")}
        if test not in made:
            raise SpecError(f"text filter {test!r} is not supported", "unsupported_filter", path)
        return made[test]()

    def _range(self, c: str, test: str, spec: Mapping[str, Any], t: ValueType, dates: bool, path: str) -> Node:
        subject, kind = col(c), t
        if dates and t.kind == "datetime":  # calendar days
            subject, kind = node("cast", col(c), to="date", scale=None), ValueType("date")

        def bound(name: str) -> Node:
            raw = spec.get(name)
            if raw is None:
                raise SpecError(f"{name} is missing", "invalid_request", path)
            if dates:
                return literal("date", dt.date.fromisoformat(str(raw)[:10])) if kind.kind == "date" else _value(checked(raw, kind, path), kind)
            return literal("num", raw)

        low, high = ("dateFrom", "dateTo") if dates else ("filter", "filterTo")
        if test == "inRange":
            closed = bool(spec.get("inRangeInclusive"))
            return node("logic", node("cmp", subject, bound(low), op="ge" if closed else "gt"), node("cmp", subject, bound(high), op="le" if closed else "lt"), op="and")
        if test not in _NUMBER:
            raise SpecError(f"filter {test!r} is not supported", "unsupported_filter", path)
        return node("cmp", subject, bound(low), op=_NUMBER[test])

    # Answers

    def rows(self, raw: Mapping[str, Any], caller: Caller | None = None, extensions: Mapping[str, Any] | None = None) -> dict:
        """The grid's answer: rows (groups with __group_key, and all with __row_id), their number, and a pivot's columns. The
        pivot's domain follows from the filters alone, so columns stay put when a group is opened."""
        grid = GridRequest.read(raw)
        domain = None
        if grid.pivoting and grid.pivots:
            whole = self.request({**raw, "groupKeys": [], "rowGroupCols": [], "startRow": 0, "endRow": None, "pivotMode": False, "pivotCols": [], "sortModel": []}, caller, extensions)
            ask = RunRequest(self.dataset, extensions=whole.extensions, query=Query(filter=whole.query.filter, group_by=grid.pivots))
            domain = tuple(tuple(json_value(r[c]) for c in grid.pivots) for r in self.engine.run(ask, caller).table.to_pylist())
        request = self.request(raw, caller, extensions, domain)
        answer = self.engine.run(request, caller)
        level = request.query.group_by[0] if request.query.group_by else None
        keys = self.engine.catalog.get(self.dataset.id, self.dataset.version).schema.keys
        records = answer.to_records()
        for row, source in zip(records, answer.table.to_pylist(), strict=True):
            if level is not None:
                row["__group_key"] = json.dumps(json_value(source[level]))
                row["__row_id"] = json.dumps([*grid.keys, row["__group_key"]])
            elif keys and all(k in source for k in keys):
                row["__row_id"] = json.dumps([json_value(source[k]) for k in keys])
        return {"rowData": records, "rowCount": answer.meta.total_rows, "pivotResultFields": answer.meta.pivot_fields}


def edit_to_override(engine: Engine, dataset: Any, body: Mapping[str, Any]) -> dict:
    """A cell edit of the grid ({"data": row, "column", "value"}) as an override step."""
    held = engine.catalog.get(*vars(DatasetRef.read(dataset, "/dataset")).values())
    data, column = body.get("data") or {}, body.get("column")
    if "__group_key" in data:
        raise SpecError("a group row cannot be edited", "not_editable", "/data")
    if not held.schema.keys:
        raise SpecError("edits need a dataset with key columns", "no_key_columns", "/dataset")
    meta = {c.name: c for c in held.schema.columns}.get(column)
    if meta is None:
        raise SpecError(f"unknown column: {column}", "unknown_column", "/column")
    if not meta.editable:
        raise SpecError(f"{column} cannot be edited", "not_editable", "/column")
    missing = [k for k in held.schema.keys if data.get(k) is None]
    if missing:
        raise SpecError(f"the row lacks its key {missing[0]}", "invalid_key", "/data")
    value = checked(body.get("value"), meta.type, "/value")
    return {"kind": "override", "edits": [{"key": {k: data[k] for k in held.schema.keys}, "column": column, "value": json_value(value)}]}
