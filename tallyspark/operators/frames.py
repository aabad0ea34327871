"""Query plans as lazy DataFrames. Nothing here runs a job but the search for a pivot's domain."""

from __future__ import annotations

import datetime as dt
import functools
from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import LimitExceeded, SpecError
from ..functions.columns import Compiler, half_even, name
from ..plans.checker import Typed
from ..plans.logical import LEVEL, Compute, Partial, QueryPlan, Where
from ..plans.request import Page, SortKey
from ..types import FLOAT, ValueType

#: How partials of finer groups make up those of coarser ones, for the aggregates that do.
MERGED = {"sum": F.sum, "count": F.sum, "count_rows": F.sum, "min": F.min, "max": F.max}


def prepared(df: DataFrame, plan: QueryPlan) -> DataFrame:
    """Filtered rows with derived columns."""
    to = Compiler()
    for s in plan.before:
        df = df.filter(to.predicate(s.test)) if isinstance(s, Where) else df.withColumn(s.name, to(s.value, s.type).cast(s.type.spark()))
    return df


def scan_bounds(plan: QueryPlan, floats: set[str]) -> Column | None:
    """What a plan's filter says of raw float columns, as tests that a file's scan can use: the engine reads floats that are
    not finite as null, and its filters on that hide the column. Every row that the filter keeps passes; others may too."""
    first = plan.before[0] if plan.before else None
    if not isinstance(first, Where):
        return None
    tests = []

    def literal(t: Typed) -> Column | None:
        n = t.node
        return F.lit(float(n["value"])) if n.kind == "lit" and n["type"] in ("int", "num", "float") else None

    def visit(t: Typed) -> None:
        n = t.node
        if n.kind == "logic" and n["op"] == "and":
            for a in t.args:
                visit(a)
        if n.kind not in ("cmp", "in") or t.meet is None or t.meet.kind != "float" or (n.kind == "in" and n["negate"]) or (n.kind == "cmp" and n["op"] == "ne"):
            return
        args = t.args
        op = n["op"] if n.kind == "cmp" else "in"
        if op != "in" and args[0].node.kind == "lit":
            args, op = args[::-1], {"lt": "gt", "le": "ge", "gt": "lt", "ge": "le"}.get(op, op)
        values = [literal(a) for a in args[1:]]
        if args[0].node.kind != "col" or args[0].node["name"] not in floats or any(v is None for v in values):
            return
        c = name(args[0].node["name"])
        tests.append(c.isin(*values) if op == "in" else {"eq": c == values[0], "lt": c < values[0], "le": c <= values[0], "gt": c > values[0], "ge": c >= values[0]}[op])

    visit(first.test)
    return functools.reduce(lambda a, b: a & b, tests) if tests else None


def _input(p: Partial) -> Column:
    """What a partial sees: null in rows that do not count."""
    to = Compiler()
    value = F.lit(1).cast("bigint") if p.input is None else to.materialize(p.input)
    tests = [to.predicate(t) for t in p.only]
    return F.when(functools.reduce(lambda a, b: a & b, tests), value) if tests else value


def inputs(plan: QueryPlan) -> list[Column]:
    """Inputs of a plan's partials, as columns."""
    return [_input(p).alias("__in" + p.name) for p in plan.group.partials]


def _aggregate(p: Partial, deterministic: bool) -> Column:
    x = name("__in" + p.name)
    if p.fn == "plugin":
        out = p.plugin.column(x)
        out = half_even(out, p.type.scale) if p.type.kind == "decimal" else out.cast(p.type.spark())
        return F.when(F.count(x) > 0, F.when(~F.isnan(out) & (F.abs(out) != float("inf")), out) if p.type.kind == "float" else out)
    if p.fn == "sum" and p.type == FLOAT and deterministic:
        # The same sum whatever order tasks end in; a group's values meet in one task, so this is on demand.
        ordered = F.array_sort(F.collect_list(x))
        return F.when(F.count(x) > 0, F.aggregate(ordered, F.lit(0.0), lambda a, v: a + v))
    whole = {"sum": F.sum, "min": F.min, "max": F.max, "count": F.count, "count_rows": F.count, "count_distinct": F.count_distinct}[p.fn](x)
    return whole.cast(p.type.spark())


def _merge(p: Partial) -> Column:
    out = MERGED[p.fn](name(p.name)).cast(p.type.spark())
    return F.coalesce(out, F.lit(0).cast("bigint")) if p.fn.startswith("count") else out


class Grouped:
    """Aggregation of prepared rows at a plan's levels.

    Where all partials merge, the rows are aggregated once, by the finest keys, and coarser levels, totals and a pivot's
    cells are made of those groups (Spark reuses their exchange); else each is an aggregation of the rows.
    """

    def __init__(self, rows: DataFrame, plan: QueryPlan, deterministic: bool = False, first: Sequence[str] = ()) -> None:
        self.plan, self.deterministic, self.partials = plan, deterministic, plan.group.partials
        self.on = (*first, *(plan.spread.on if plan.spread else ()))
        # Inputs are computed once, below any expansion into levels.
        self.rows = rows.select(*[name(k) for k in (*plan.group.keys, *self.on)], *inputs(plan))
        self.merges = self._merge(self.partials)
        self.finest = self.by(self.rows, (*plan.group.keys, *self.on))

    def _merge(self, partials: Sequence[Partial]) -> bool:
        return all(p.fn in MERGED and not (self.deterministic and p.type == FLOAT) for p in partials)

    def _columns(self, partials: Sequence[Partial], merged: bool) -> list[Column]:
        made = [(_merge(p) if merged else _aggregate(p, self.deterministic)).alias(p.name) for p in partials]
        return made or [F.max(F.lit(1)).alias("__any")]

    def by(self, rows: DataFrame, keys: Sequence[str]) -> DataFrame:
        """Partials by these keys; one row without keys, even of no rows."""
        return rows.groupBy(*[name(k) for k in keys]).agg(*self._columns(self.partials, False))

    def levels(self, extra: Sequence[str] = ()) -> DataFrame:
        """Partials of every level by its keys and `extra`, in a rollup with the level's number: of group columns that are
        not subsumed. The grand total is there even of no rows, which Spark's own rollup leaves out."""
        plan, keys = self.plan, self.plan.group.keys
        merged = self.merges
        source = self.finest if merged else self.rows
        if not plan.rollup:
            if merged and tuple(extra) == tuple(self.on):
                return self.finest
            return source.groupBy(*[name(k) for k in (*keys, *extra)]).agg(*self._columns(self.partials, merged))
        sets = [(*level, *extra) for level in plan.group.levels if level or extra]
        parts = []
        if sets:
            number = (F.lit(len(keys)) - F.bit_count(F.grouping_id())).cast("bigint")
            grouped = source.groupingSets([[name(k) for k in s] for s in sets], *[name(k) for k in (*keys, *extra)])
            parts.append(grouped.agg(number.alias(LEVEL), *self._columns(self.partials, merged)))
        if not extra:
            whole = source.agg(F.lit(0).cast("bigint").alias(LEVEL), *self._columns(self.partials, merged))
            parts.append(whole.withColumns({k: F.lit(None).cast(plan.types[k].spark()) for k in keys}))
        return functools.reduce(lambda a, b: a.unionByName(b), parts)

    def totals(self) -> DataFrame | None:
        """One row of the measures that total() names, over all rows."""
        wanted = self.plan.totals
        if not wanted:
            return None
        parts = self.plan.group.parts_of(wanted)
        merged = self._merge(parts)  # of the finest groups' partials, whatever the others are
        whole = (self.finest if merged else self.rows).agg(*self._columns(parts, merged))
        to = Compiler()
        return whole.select(*[to(m.value, m.type).alias(f"__total_{m.name}") for m in self.plan.group.measures if m.name in wanted])

    def finish(self, partials: DataFrame, keys: Sequence[str], totals: DataFrame | None, *, flag: str | None = None, keep: Sequence[str] = ()) -> DataFrame:
        """Measures and what is computed of them, over partials. Tests drop rows, or with `flag` only say in that column
        whether a row passes."""
        plan, passed = self.plan, []
        to = Compiler({m: f"__total_{m}" for m in plan.totals})
        out = partials.select(*[name(k) for k in (*keys, *keep)], *[to(m.value, m.type).alias(m.name) for m in plan.group.measures])
        if totals is not None:
            out = out.crossJoin(F.broadcast(totals))  # one row
        for s in plan.after:
            if isinstance(s, Compute):
                out = out.withColumn(s.name, to(s.value, s.type).cast(s.type.spark()))
            elif flag is None:
                out = out.filter(to.predicate(s.test))
            else:
                passed.append(F.coalesce(to.predicate(s.test), F.lit(False)))
        more = [] if flag is None else [functools.reduce(lambda a, b: a & b, passed, F.lit(True)).alias(flag)]
        return out.select(*[name(k) for k in (*keys, *keep)], *[name(v) for v in plan.values], *more)


def aggregated(df: DataFrame, plan: QueryPlan, deterministic: bool = False, max_pivot_columns: int = 2000, held: list | None = None) -> tuple[DataFrame, dict[str, ValueType], list[str] | None]:
    """The aggregate of a view, its column types, and a pivot's columns. A pivot looks up its domain; given `held`, it keeps the
    groups that it found it in for the answer, and adds them there for the caller to let go of."""
    grouped = Grouped(prepared(df, plan), plan, deterministic)
    if plan.spread is not None:
        return _pivoted(grouped, max_pivot_columns, held)
    return grouped.finish(grouped.levels(), plan.keys, grouped.totals()), plan.output, None


def label(value: object, t: ValueType, null_label: str) -> str:
    """A pivot value as part of a column name."""
    if value is None:
        return null_label
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, Decimal):
        return format(value, "f")
    return value.isoformat() if isinstance(value, dt.date) else str(value)


def _domain(grouped: Grouped, most: int, held: list | None) -> tuple[tuple, ...]:
    """The given values of a pivot, or those found, in order, nulls last; one more than `most` at most."""
    s = grouped.plan.spread
    if s.domain is not None:
        return s.domain
    if grouped.merges and held is not None:
        grouped.finest = grouped.finest.persist()
        held.append(grouped.finest)
    on = [name(k) for k in s.on]
    found = (grouped.finest if grouped.merges else grouped.rows).select(*on).distinct()
    return tuple(tuple(r) for r in found.orderBy(*[c.asc_nulls_last() for c in on]).limit(most + 1).collect())


def _pivoted(grouped: Grouped, most: int, held: list | None) -> tuple[DataFrame, dict[str, ValueType], list[str]]:
    plan, s = grouped.plan, grouped.plan.spread
    domain = _domain(grouped, most, held)
    if len(domain) * len(s.values) > most:
        raise LimitExceeded(f"a pivot has at most {most} columns", path="/query/pivot")
    labels = [[label(v, t, s.pivot.null_label) for v, t in zip(d, s.types, strict=True)] for d in domain]
    if any(s.pivot.separator in part for row in labels for part in row):
        raise SpecError(f"a pivot value holds the separator {s.pivot.separator!r}", "pivot_separator_conflict", "/query/pivot/separator")
    columns = {s.pivot.separator.join([*parts, v]): (i, v) for i, parts in enumerate(labels) for v in s.values}
    if len(columns) < len(labels) * len(s.values):
        raise SpecError("two pivot values have the same label", "pivot_separator_conflict", "/query/pivot")
    totals, keys = grouped.totals(), [name(k) for k in plan.keys]
    merged = [p.name for p in grouped.partials] if s.pivot.totals and grouped.merges else []
    cells = grouped.finish(grouped.levels(s.on), (*plan.keys, *s.on), totals, flag="__passes", keep=merged)
    fields = ", ".join(f"p{i} {t.spark().simpleString()}" for i, t in enumerate(s.types))
    index = cells.sparkSession.createDataFrame([(*d, i) for i, d in enumerate(domain)], f"{fields}, __cell int")
    same = functools.reduce(lambda a, b: a & b, [name(k).eqNullSafe(F.col(f"p{i}")) for i, k in enumerate(s.on)])
    placed = cells.join(F.broadcast(index), same, "left")  # at most max_pivot_columns rows
    if merged and plan.rollup:  # the grand total is there even of no rows
        given = {LEVEL: F.lit(0), "__passes": F.lit(False)}
        none = placed.sparkSession.range(1).select(*[given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in placed.schema.fields])
        placed = placed.unionByName(none)
    shown = F.col("__passes") & F.col("__cell").isNotNull()
    picks = [F.max(F.when(shown & (F.col("__cell") == i), name(v))).alias(c) for c, (i, v) in columns.items()]
    wide = placed.groupBy(*keys).agg(F.coalesce(F.max(shown), F.lit(False)).alias("__shown"), *picks, *[_merge(p).alias(p.name) for p in grouped.partials if merged])
    output = {k: plan.output[k] for k in plan.keys} | {c: plan.output[v] for c, (_, v) in columns.items()}
    if not s.pivot.totals:
        wide = wide.filter("__shown") if plan.keys or not domain else wide
        return wide.select(*[name(c) for c in output]), output, list(columns)
    if merged:
        across = grouped.finish(wide, plan.keys, totals, flag="__passes", keep=["__shown", *columns])
        wide = across.withColumns({v: F.when(F.col("__passes"), name(v)) for v in s.values}).filter(F.col("__passes") | F.col("__shown") if plan.keys else F.col("__passes") & F.lit(bool(domain)))
    else:
        across = grouped.finish(grouped.levels(), plan.keys, totals).select(*keys, *[name(v) for v in s.values])
        wide = wide.filter("__shown") if plan.keys or not domain else wide
        wide = null_safe_join(wide, across, plan.keys) if plan.keys else wide.crossJoin(F.broadcast(across))
    output |= {v: plan.output[v] for v in s.values}
    return wide.select(*[name(c) for c in output]), output, list(columns)


def null_safe_join(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Full outer join in which null keys are equal, with each key once."""
    right = b.withColumnsRenamed({k: f"__r{i}" for i, k in enumerate(keys)})
    same = functools.reduce(lambda x, y: x & y, [name(k).eqNullSafe(F.col(f"__r{i}")) for i, k in enumerate(keys)])
    both = a.withColumn("__left", F.lit(True)).join(right, same, "full")
    for i, k in enumerate(keys):
        both = both.withColumn(k, F.when(F.col("__left"), name(k)).otherwise(F.col(f"__r{i}")))
    return both.drop("__left", *[f"__r{i}" for i in range(len(keys))])


def ordered(c: Column, desc: bool = False, nulls_last: bool = True) -> Column:
    if desc:
        return c.desc_nulls_last() if nulls_last else c.desc_nulls_first()
    return c.asc_nulls_last() if nulls_last else c.asc_nulls_first()


def ordering(plan: QueryPlan, ties: Sequence[Column] = ()) -> list[Column]:
    """A total order: the sort keys, then whatever tells rows apart. In a rollup, subtotals follow their details."""
    given = {k.by: k for k in plan.sort}
    if plan.rollup:
        out = []
        for i, k in enumerate(plan.group.keys):
            out += [(name(LEVEL) <= i).asc(), ordered(name(k), given[k].desc, given[k].nulls_last) if k in given else name(k).asc_nulls_last()]
        return out
    keys = [ordered(name(k.by), k.desc, k.nulls_last) for k in plan.sort]
    return keys + ([name(k).asc_nulls_last() for k in plan.group.keys if k not in given] if plan.group is not None else list(ties))


def paged(df: DataFrame, order: list[Column], page: Page | None, cap: int) -> DataFrame:
    """A page, or without one the rows up to one more than `cap`; both plan as a top-k."""
    df = df.orderBy(*order) if order else df
    return df.offset(page.offset).limit(page.limit) if page is not None else df.limit(cap + 1)


def distinct_values(df: DataFrame, column: str, limit: int) -> DataFrame:
    return df.select(name(column)).distinct().orderBy(name(column).asc_nulls_last()).limit(limit)
