"""The engine: resolves a request to views, plans its query, compiles it to DataFrames, and runs it under limits."""

from __future__ import annotations

import contextlib
import io
import time
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field, replace
from functools import cached_property, reduce
from typing import Any

import pyarrow as pa
import pyspark
from pyspark.sql import Column, DataFrame, SparkSession

from .errors import LimitExceeded, SpecError, VersionConflict, pointer
from .expr import Node, parse
from .formula import to_formula
from .functions.columns import Compiler, name
from .functions.plugins import BindContext, Bound, PlanContext, Plugin, Registry, TransformPlan
from .operators.compare import compared
from .operators.frames import aggregated, distinct_values, ordered, ordering, paged, prepared, scan_bounds
from .plans.checker import Scope
from .plans.logical import Compute, Limits, Planner, QueryPlan, Where, check_sort
from .plans.request import CompareRequest, DatasetRef, Page, Query, RunRequest, canonical, fingerprint, parse_request
from .runtime import Executor, ResultCache
from .sources.catalog import ROW, Dataset, DatasetCatalog
from .types import ValueType, Scales, json_value


@dataclass(frozen=True)
class Caller:
    """Who asks, and what they may see: `row_filter` holds before anything else, and other columns than `allowed_columns`
    (keys excepted) do not exist for them. A row filter reads only columns that the caller may see."""

    principal: str | None = None
    row_filter: str | Node | None = None
    allowed_columns: frozenset[str] | None = None
    attributes: Mapping[str, Any] = field(default_factory=dict)

    def filter_node(self) -> Node | None:
        return None if self.row_filter is None else parse(self.row_filter, "/row_filter")

    def digest(self) -> str:
        return fingerprint({"filter": self.filter_node(), "columns": self.allowed_columns})


@dataclass(frozen=True)
class EngineConfig:
    numeric: Scales = Scales()
    limits: Limits = Limits()
    cache_bytes: int = 256 * 2**20
    slots: int = 2
    queue_timeout_s: float = 10.0
    timeout_s: float | None = None
    authorize: Callable[[Caller, str, Any], None] | None = None
    on_result: Callable[[ResultMeta, Caller], None] | None = None


@dataclass(frozen=True)
class ResultMeta:
    """What is needed to reproduce, audit or cache a result."""

    fingerprint: str
    dataset: DatasetRef
    total_rows: int
    offset: int
    rows: int
    columns: list[dict]
    timings_ms: dict[str, float]
    pivot_fields: list[str] | None = None
    engine: str = "spark"
    cached: bool = False
    extensions: dict = field(default_factory=dict)
    stage_rows: dict[str, int] | None = None
    versions: dict[str, str] = field(default_factory=dict)

    def to_dict(self) -> dict:
        return {**vars(self), "dataset": {"id": self.dataset.id, "version": self.dataset.version}}


@dataclass(frozen=True)
class Result:
    table: pa.Table
    meta: ResultMeta

    def to_records(self, *, decimals: str = "float") -> list[dict]:
        """Rows as JSON data; decimals as floats, or with "str" exact."""
        return [{k: json_value(v, decimals) for k, v in row.items()} for row in self.table.to_pylist()]

    def to_dict(self, *, decimals: str = "float") -> dict:
        return {"rows": self.to_records(decimals=decimals), "meta": self.meta.to_dict()}

    def to_arrow_ipc(self) -> bytes:
        out = io.BytesIO()
        with pa.ipc.new_stream(out, self.table.schema) as writer:
            writer.write_table(self.table)
        return out.getvalue()


class View:
    """A dataset as one caller sees it, after transforms. Frames are made when first asked for: a cached answer needs none."""

    def __init__(self, dataset: Dataset, env: dict[str, ValueType], plans: Sequence[tuple[str, TransformPlan]], identity: str, source: Callable[[Column | None, bool], DataFrame]) -> None:
        self.dataset, self.env, self.plans, self.identity, self._source = dataset, env, tuple(plans), identity, source

    @cached_property
    def base(self) -> DataFrame:
        """Before transforms."""
        return self._source(None, True)

    @cached_property
    def df(self) -> DataFrame:
        return reduce(lambda df, p: p[1].apply(df), self.plans, self.base)

    def rows_for(self, plan: QueryPlan, ordered: bool = True) -> DataFrame:
        """`df` for a plan: read with what its filter says of raw float columns (unless transforms may change those), and
        without the rows' hidden order if nothing is ordered by it."""
        bounds = None if self.plans else scan_bounds(plan, {c for c, t in self.env.items() if t.kind == "float"})
        if ordered and bounds is None:
            return self.df
        return reduce(lambda df, p: p[1].apply(df), self.plans, self._source(bounds, ordered))

    @property
    def keys(self) -> tuple[str, ...]:
        return tuple(k for k in self.dataset.schema.keys if k in self.env)

    def ties(self) -> list[Column]:
        return [name(k).asc_nulls_last() for k in self.keys] or ([name(ROW).asc()] if ROW in self.dataset.df.columns else [])


#: Planned transforms that an engine keeps.
MOST_TRANSFORMS = 256
#: Bytes that a cell of a collected result is taken to need, where a table's share of the cache decides how much to collect.
CELL_BYTES = 24
#: Rows of an aggregate that are collected whole whatever the cache's size.
MIN_ROWS = 10_000
#: Read when a frame is analysed, so set once, on the session that owns the frames.
SESSION = {"spark.sql.decimalOperations.allowPrecisionLoss": "false", "spark.sql.ansi.enabled": "true"}


class Engine:
    """`run`, `compare`, `explain`, `distinct_values` and `call` answer requests; `frame` and `compare_frame` give the same
    answers as lazy DataFrames, to go on with in Spark."""

    def __init__(self, spark: SparkSession, catalog: DatasetCatalog, plugins: Sequence[Plugin] = (), config: EngineConfig | None = None) -> None:
        for k, v in SESSION.items():
            spark.conf.set(k, v)
        self.spark, self.catalog, self.config = spark, catalog, config or EngineConfig()
        self.plugins = {p.name: p for p in plugins}
        self.registry = Registry.of(list(plugins))
        self.executor = Executor(spark, self.config.slots, self.config.queue_timeout_s)
        self.cache = ResultCache(self.config.cache_bytes)
        self.transforms = ResultCache(MOST_TRANSFORMS if self.config.cache_bytes else 0)  # each counts 1
        for p in plugins:
            p.attach(self)

    # Views

    def plugin(self, plugin: str) -> Plugin:
        if plugin not in self.plugins:
            raise SpecError(f"plugin {plugin} is not installed", "plugin_not_installed")
        return self.plugins[plugin]

    def authorize(self, caller: Caller, action: str, resource: Any) -> None:
        if self.config.authorize is not None:
            self.config.authorize(caller, action, resource)

    def slot(self):
        return self.executor.slot()

    def view(self, ref: DatasetRef, extensions: Mapping[str, Any], caller: Caller, path: str = "/extensions", run: Callable[[Callable], Any] | None = None) -> View:
        """Entitlements, then transforms in the order in which plugins were installed. Planned transforms are kept by what they
        depend on, so that a request that comes again (another page, say) does not plan them anew; `run` runs what a new plan
        asks of Spark."""
        transforms = self.registry.entries["transform"]
        for k in extensions:
            if k not in transforms:
                raise SpecError(f"no plugin handles extension {k}", "unknown_extension", pointer(path, k), available=sorted(transforms))
        bound: list[tuple[str, Bound]] = []
        for k, t in transforms.items():
            if k in extensions:
                block = t.parse(extensions[k], pointer(path, k))
                bound.append((k, t.bind(block, BindContext(self, ref, caller, pointer(path, k)))))
        pins = {v for v in (ref.version, *(b.version for _, b in bound)) if v is not None}
        if len(pins) > 1:
            raise VersionConflict("the request needs several versions of the dataset", path="/dataset/version", versions=sorted(pins))
        dataset = self.catalog.get(ref.id, next(iter(pins), None))
        self.authorize(caller, "dataset.read", dataset)
        own = dataset.schema.restrict(caller.allowed_columns).types
        allowed = caller.filter_node()
        test = None if allowed is None else self.scope(own).predicate(allowed, "/row_filter")

        def source(bounds: Column | None, ordered: bool) -> DataFrame:
            df = dataset.frame(bounds, ordered)
            df = df.select(*[name(c) for c in own], *([name(ROW)] if ROW in df.columns else []))
            return df if test is None else df.filter(Compiler().predicate(test))

        env, plans, trail = own, [], [dataset.id, dataset.version, caller.digest()]
        base = View(dataset, own, (), "", source)
        for k, b in bound:
            trail.append([k, b.identity])
            key = fingerprint(trail) if b.identity is not None else None
            plan = self.transforms.get(key) if key else None
            if plan is None:
                context, so_far = PlanContext(self, dataset, env, caller, pointer(path, k)), View(dataset, own, plans, "", lambda *_: base.base)
                make = lambda b=b, env=env, context=context, so_far=so_far: b.plan(env, so_far.df, context)
                plan = make() if run is None else run(make)
                if key:
                    self.transforms.put(key, plan, 1)
            env = dict(plan.env)
            plans.append((k, plan))
        identity = fingerprint({"dataset": [dataset.id, dataset.version], "caller": caller.digest(), "transforms": [[k, p.canonical] for k, p in plans]})
        return View(dataset, env, plans, identity, source)

    def scope(self, env: Mapping[str, ValueType]) -> Scope:
        limits = self.config.limits
        return Scope(env, self.config.numeric, self.registry.entries["function"], None, limits.max_expr_depth, limits.max_expr_nodes)

    def plan(self, query: Query, view: View) -> QueryPlan:
        entries = self.registry.entries
        return Planner(view.env, tuple(view.env), self.config.numeric, self.config.limits, entries["function"], entries["aggregate"]).plan(query)

    # Frames

    def frame(self, request: Any, caller: Caller | None = None) -> DataFrame:
        """The request's answer as a DataFrame, with its sort and page; without a page, all rows and no order."""
        req = parse_request(request, RunRequest)
        view = self.view(req.dataset, req.extensions, caller or Caller())
        plan = self.plan(req.query, view)
        df, output, _ = self._whole(plan, view, req.options.deterministic, ordered=req.query.page is not None)
        if req.query.page is not None:
            df = paged(df, self._order(plan, view, output), req.query.page, 0)
        return df.select(*[name(c) for c in output])

    def compare_frame(self, request: Any, caller: Caller | None = None) -> DataFrame:
        req = parse_request(request, CompareRequest)
        _, df, output, order, _ = self._sides(req, caller or Caller())
        return (paged(df, order, req.query.page, 0) if req.query.page is not None else df).select(*[name(c) for c in output])

    def _whole(self, plan: QueryPlan, view: View, deterministic: bool, held: list | None = None, ordered: bool = True) -> tuple[DataFrame, dict[str, ValueType], list[str] | None]:
        if plan.group is None:
            return prepared(view.rows_for(plan, ordered), plan), plan.output, None
        df, output, fields = aggregated(view.rows_for(plan, False), plan, deterministic, self.config.limits.max_pivot_columns, held)
        if plan.spread is not None and not plan.rollup:
            check_sort(plan.sort, set(output), "/query")
        return df, output, fields

    def _order(self, plan: QueryPlan, view: View, output: Mapping[str, ValueType]) -> list[Column]:
        return ordering(plan, view.ties())

    # Answers

    def run(self, request: Any, caller: Caller | None = None) -> Result:
        began, caller = time.monotonic(), caller or Caller()
        req = parse_request(request, RunRequest)
        with self.slot():
            deadline = self._deadline(req.options.timeout_s, began)
            view = self.view(req.dataset, req.extensions, caller, run=lambda make: self.executor.run(make, deadline))
            plan = self.plan(req.query, view)
            planned = time.monotonic()
            key = self._fingerprint(req, view)
            if plan.group is not None:
                table, total, fields, output, cached = self._groups(req, plan, view, deadline)
            else:
                table, total, fields, output, cached = self._leaves(req, plan, view, deadline, key)
            stages = self._audit(req, plan, view, total, deadline) if req.options.audit else None
        return self._finish(caller, req, view, key, table, total, fields, output, cached, stages, began, planned)

    def _groups(self, req: RunRequest, plan: QueryPlan, view: View, deadline: float | None):
        """Aggregates are collected and cached whole, without their page, if they fit in the cache; of larger ones, only the page
        asked for leaves Spark."""
        shared = {"view": view.identity, "deterministic": req.options.deterministic, "numeric": self.config.numeric._asdict(), "plugins": self._versions()}
        key, page, limits = fingerprint({**shared, "query": _unpaged(req.query)}), req.query.page, self.config.limits
        paged_key = fingerprint({**shared, "query": req.query})
        held = self.cache.get(key)
        if held is None and page is not None and (own := self.cache.get(paged_key)) is not None:
            return *own, True
        cached = held is not None
        if held is None:

            def collect():
                kept: list[DataFrame] = []
                try:
                    df, output, fields = self._whole(plan, view, req.options.deterministic, kept)
                    df, order = df.select(*[name(c) for c in output]), self._order(plan, view, output)
                    fits = max(MIN_ROWS, self.config.cache_bytes // (CELL_BYTES * max(1, len(output))))
                    table = _table(paged(df, order, None, min(limits.max_groups, fits)))
                    if table.num_rows <= min(limits.max_groups, fits):
                        return (table, output, fields), None
                    groups = df.count()
                    if groups > limits.max_groups:
                        raise LimitExceeded(f"over {limits.max_groups} groups", path="/query/group_by")
                    if page is None:
                        raise LimitExceeded("too many rows without a page", "too_many_rows", "/query/page")
                    del table
                    return None, (_table(paged(df, order, page, 0)), groups, fields, output)
                finally:
                    for df in kept:
                        df.unpersist()

            held, large = self.executor.run(collect, deadline)
            if large is not None:
                self.cache.put(paged_key, large, large[0].nbytes)
                return *large, False
            self.cache.put(key, held, held[0].nbytes)
        table, output, fields = held
        if page is None and table.num_rows > limits.max_unpaged_rows:
            raise LimitExceeded("too many rows without a page", "too_many_rows", "/query/page")
        return table.slice(page.offset, page.limit) if page else table, table.num_rows, fields, output, cached

    def _leaves(self, req: RunRequest, plan: QueryPlan, view: View, deadline: float | None, key: str):
        held = self.cache.get(key)
        if held is not None:
            return *held, True

        def collect():
            df, output, _ = self._whole(plan, view, False)
            cap, page = self.config.limits.max_unpaged_rows, req.query.page
            rows = paged(df, self._order(plan, view, output), page, cap).select(*[name(c) for c in output])
            table = _table(rows)
            if page is None and table.num_rows > cap:
                raise LimitExceeded("too many rows without a page", "too_many_rows", "/query/page")
            whole = page is None or 0 < table.num_rows < page.limit
            total = (page.offset if page else 0) + table.num_rows if whole else prepared(view.rows_for(plan, False), plan).count()
            return table, total, None, output

        out = self.executor.run(collect, deadline)
        self.cache.put(key, out, out[0].nbytes)
        return *out, False

    def compare(self, request: Any, caller: Caller | None = None) -> Result:
        began, caller = time.monotonic(), caller or Caller()
        req = parse_request(request, CompareRequest)
        with self.slot():
            deadline = self._deadline(req.options.timeout_s, began)
            view, df, output, order, base = self.executor.run(lambda: self._sides(req, caller), deadline)
            planned = time.monotonic()
            key = fingerprint({"sides": [view.identity, base.identity], "query": req.query, "numeric": self.config.numeric._asdict(), "plugins": self._versions()})
            held = self.cache.get(key)
            if held is None:
                def collect():
                    cap, page = self.config.limits.max_unpaged_rows, req.query.page
                    table = _table(paged(df, order, page, cap).select(*[name(c) for c in output]))
                    if page is None and table.num_rows > cap:
                        raise LimitExceeded("too many rows without a page", "too_many_rows", "/query/page")
                    whole = page is None or 0 < table.num_rows < page.limit
                    return table, (page.offset if page else 0) + table.num_rows if whole else df.count()

                held = self.executor.run(collect, deadline)
                self.cache.put(key, held, held[0].nbytes)
                cached = False
            else:
                cached = True
        return self._finish(caller, req, view, key, held[0], held[1], None, output, cached, None, began, planned)

    def _sides(self, req: CompareRequest, caller: Caller):
        """The joined frame of both sides: by group columns, or for rows by the dataset's keys."""
        view = self.view(req.dataset, req.extensions, caller)
        ref = DatasetRef(req.dataset.id, req.base.version or view.dataset.version)
        base = self.view(ref, req.base.extensions, caller, "/base/extensions")
        core = _unpaged(req.query, sort=())
        self.plan(req.query if not req.query.sort else _resorted(req.query), view)  # page cap
        plan, other = self.plan(core, view), self.plan(core, base)
        if plan.group is not None:
            keys = plan.keys
            left, types, _ = self._whole(plan, view, req.options.deterministic)
            right, base_types, _ = self._whole(other, base, req.options.deterministic)
        else:
            keys = view.keys
            if not keys:
                raise SpecError("comparing rows needs a dataset with key columns", "no_key_columns", "/dataset")
            chosen = [*keys, *(c for c in plan.output if c not in keys)]
            left, types = prepared(view.rows_for(plan, False), plan).select(*[name(c) for c in chosen]), {c: plan.types[c] for c in chosen}
            right, base_types = prepared(base.rows_for(other, False), other).select(*[name(c) for c in chosen if c in other.types]), other.types
        values = [c for c in types if c not in keys]
        df, output = compared(left, right, keys, values, types, base_types, self.config.numeric)
        if plan.rollup:
            check_sort(req.query.sort, set(plan.group.keys), "/query", "a rollup can be sorted by its group columns only")
            order = ordering(plan.sorted_by(req.query.sort))
        else:
            check_sort(req.query.sort, set(output), "/query")
            given = [k.by for k in req.query.sort]
            order = [ordered(name(k.by), k.desc, k.nulls_last) for k in req.query.sort] + [name(k).asc_nulls_last() for k in keys if k not in given]
        return view, df, output, order, base

    def explain(self, request: Any, caller: Caller | None = None) -> dict:
        """How a request would be answered, without answering it."""
        req = parse_request(request, RunRequest)
        view = self.view(req.dataset, req.extensions, caller or Caller())
        plan = self.plan(req.query, view)
        df, output, _ = self._whole(plan, view, req.options.deterministic)
        df = paged(df, self._order(plan, view, output), req.query.page, self.config.limits.max_unpaged_rows)
        text = io.StringIO()
        with contextlib.redirect_stdout(text):
            df.explain("formatted")
        return {
            "fingerprint": self._fingerprint(req, view),
            "dataset": {"id": view.dataset.id, "version": view.dataset.version},
            "query": canonical(req.query),
            "extensions": {k: p.explain() for k, p in view.plans},
            "derive": [{"name": d.name, "formula": to_formula(d.value.node), "columns": d.value.node.columns(), "type": str(d.type)} for d in plan.before if isinstance(d, Compute)],
            "types": {c: str(t) for c, t in output.items()},
            "plan": text.getvalue(),
        }

    def distinct_values(self, dataset: Any, column: str, filter: Any = None, limit: int = 1000, caller: Caller | None = None) -> list:
        """Distinct values of a column in order, nulls last."""
        view = self.view(DatasetRef.read(dataset, "/dataset"), {}, caller or Caller())
        if column not in view.env:
            raise SpecError(f"unknown column: {column}", "unknown_column", "/column")
        if view.env[column].kind == "other":
            raise SpecError(f"cannot list values of {column}", "unsupported_type", "/column")
        df = view.df
        if filter is not None:
            df = df.filter(Compiler().predicate(self.scope(view.env).predicate(parse(filter, "/filter"), "/filter")))
        with self.slot():
            return [r[0] for r in self.executor.run(distinct_values(df, column, limit).collect, self._deadline(None, time.monotonic()))]

    def call(self, operation: str, request: Any, caller: Caller | None = None) -> Any:
        found = self.registry.entries["operation"].get(operation)
        if found is None:
            raise SpecError(f"unknown operation: {operation}", "unknown_operation", available=sorted(self.registry.entries["operation"]))
        self.authorize(caller or Caller(), f"operation.{operation}", request)
        return found.run(self, found.parse(request), caller or Caller())

    # Parts

    def _deadline(self, own: float | None, began: float) -> float | None:
        seconds = own if own is not None else self.config.timeout_s
        return None if seconds is None else began + seconds

    def _versions(self) -> dict[str, str]:
        return {"pyspark": pyspark.__version__, **{k: p.version for k, p in sorted(self.plugins.items())}}

    def _fingerprint(self, req: RunRequest, view: View) -> str:
        return fingerprint({"view": view.identity, "query": req.query, "deterministic": req.options.deterministic, "numeric": self.config.numeric._asdict(), "plugins": self._versions()})

    def _audit(self, req: RunRequest, plan: QueryPlan, view: View, total: int, deadline: float | None) -> dict[str, int]:
        filtered = view.rows_for(plan, False)
        if plan.before and isinstance(plan.before[0], Where):
            filtered = filtered.filter(Compiler().predicate(plan.before[0].test))
        both = self.executor.run(lambda: (view._source(None, False).count(), filtered.count()), deadline)
        return {"dataset": both[0], "filtered": both[1], "result": total}

    def _finish(self, caller, req, view, key, table, total, fields, output, cached, stages, began, planned) -> Result:
        ended = time.monotonic()
        columns = [{"name": c, "type": str(t), "kind": t.kind, "scale": t.scale} for c, t in output.items()]
        page: Page | None = req.query.page
        meta = ResultMeta(
            fingerprint=key, dataset=DatasetRef(view.dataset.id, view.dataset.version), total_rows=total, offset=page.offset if page else 0, rows=table.num_rows, columns=columns,
            timings_ms={"plan": (planned - began) * 1e3, "run": (ended - planned) * 1e3, "total": (ended - began) * 1e3}, pivot_fields=fields, cached=cached,
            extensions={k: p.meta() for k, p in view.plans}, stage_rows=stages, versions=self._versions(),
        )
        if self.config.on_result is not None:
            self.config.on_result(meta, caller)
        return Result(table, meta)


def _unpaged(q: Query, **more: Any) -> Query:
    return replace(q, page=None, **more)


def _resorted(q: Query) -> Query:
    """Without sort keys, which may name columns that only the joined sides have."""
    return replace(q, sort=())


def _table(df: DataFrame) -> pa.Table:
    return df.toArrow()
