"""Steps as a dataset transform: value changes in log order, then formula columns in order of dependence."""

from __future__ import annotations

import functools
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from decimal import ROUND_HALF_EVEN, Decimal
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from ..errors import LimitExceeded, SpecError, pointer
from ..expr import Node
from ..formula import to_formula
from ..functions.columns import Compiler, half_even, name
from ..functions.plugins import PlanContext, TransformPlan
from ..plans.checker import Scope, Typed, materialized
from ..plans.request import canonical
from ..types import ValueType, checked, decimal, json_value, places, rounded
from .steps import Disable, Formula, Override, Shock, Step

MAX_STEPS, MAX_LOG, MAX_EDITS = 500, 10_000, 200_000
#: Unmatched edits that a result lists.
LISTED = 100


@dataclass
class Edits:
    """Consecutive overrides as one batch: by key, the new values by column; the last edit of a cell holds."""

    cells: dict[tuple, dict[str, Any]] = field(default_factory=dict)
    columns: dict[str, None] = field(default_factory=dict)

    def set(self, key: tuple, column: str, value: Any) -> None:
        self.cells.setdefault(key, {})[column] = value
        self.columns[column] = None


@dataclass(frozen=True)
class Change:
    """A shock, checked: the column, its type, the exact amount, and where it holds."""

    step: Shock
    type: ValueType
    where: Typed | None


def effective(steps: Sequence[Step], path: str = "") -> list[tuple[int, Step]]:
    """Steps with their numbers from 1, without the disabled ones and the disables."""
    gone = set()
    for i, s in enumerate(steps, 1):
        if isinstance(s, Disable):
            target = steps[s.seq - 1] if s.seq < i else None
            if target is None or isinstance(target, Disable):
                raise SpecError(f"step {i} cannot disable step {s.seq}", "invalid_disable", pointer(path, "steps", i - 1, "seq"))
            gone.add(s.seq)
    return [(i, s) for i, s in enumerate(steps, 1) if i not in gone and not isinstance(s, Disable)]


class StepsPlan(TransformPlan):
    """Checked steps over a dataset version."""

    def __init__(self, steps: Sequence[Step], strict: bool, env: Mapping[str, ValueType], df: DataFrame, context: PlanContext, check_edits: bool = True, saved: int = 0) -> None:
        self.path, self.keys = context.path, context.dataset.schema.keys
        self.editable = {c.name for c in context.dataset.schema.columns if c.editable}
        if len(steps) - saved > MAX_STEPS or len(steps) > MAX_LOG:
            raise LimitExceeded("too many steps", path=pointer(self.path, "steps"))
        self.base, self.env, self.scope = dict(env), dict(env), context.engine.scope(env)
        self.canonical = [canonical(s) for _, s in effective(steps, self.path)]
        self.stages: list[Edits | Change] = []
        self.formulas: dict[str, Node] = {}
        self.lineage: dict[str, list[str]] = {}
        self.unmatched: list[dict] = []
        edits = 0
        for seq, step in effective(steps, self.path):
            where = pointer(self.path, "steps", seq - 1 - saved) if seq > saved else pointer(self.path, "scenario", seq)
            if isinstance(step, Override):
                edits += len(step.edits)
                if edits > MAX_EDITS:
                    raise LimitExceeded(f"over {MAX_EDITS} edits", path=where)
                self._override(seq, step, where)
            elif isinstance(step, Shock):
                self._shock(seq, step, where)
            else:
                self._formula(seq, step, where)
        self.columns = self._order()
        if check_edits:
            self._match(df, strict)

    def _writable(self, column: str, path: str) -> ValueType:
        if column not in self.base:
            raise SpecError(f"unknown column: {column}", "unknown_column", path)
        if column in self.keys or column not in self.editable:
            raise SpecError(f"{column} cannot be edited", "not_editable", path)
        return self.base[column]

    def _override(self, seq: int, step: Override, path: str) -> None:
        if not self.keys:
            raise SpecError("overrides need a dataset with key columns", "no_key_columns", path)
        batch = self.stages[-1] if self.stages and isinstance(self.stages[-1], Edits) else Edits()
        if not self.stages or self.stages[-1] is not batch:
            self.stages.append(batch)
        for i, e in enumerate(step.edits):
            where = pointer(path, "edits", i)
            if set(e.key) != set(self.keys):
                raise SpecError(f"a key needs exactly {', '.join(self.keys)}", "invalid_key", pointer(where, "key"))
            key = tuple(checked(e.key[k], self.base[k], pointer(where, "key", k)) for k in self.keys)
            if None in key:
                raise SpecError("key values cannot be null", "invalid_key", pointer(where, "key"))
            kind = self._writable(e.column, pointer(where, "column"))
            batch.set(key, e.column, checked(e.value, kind, pointer(where, "value")))
            self._trace(e.column, f"step {seq}: override")

    def _shock(self, seq: int, step: Shock, path: str) -> None:
        kind = self._writable(step.column, pointer(path, "column"))
        if not kind.numeric:
            raise SpecError(f"{step.column} is no number", "type_mismatch", pointer(path, "column"))
        if kind.kind == "int" and not step.round and step.factor != step.factor.to_integral_value():
            raise SpecError(f"{step.column} holds whole numbers; set round", "needs_rounding", pointer(path, "round"))
        where = None
        if step.where is not None:
            inlined = step.where.replace(self._inlined())
            where = self.scope.predicate(inlined, pointer(path, "where"))
        self.stages.append(Change(step, kind, where))
        self._trace(step.column, f"step {seq}: {step.op} {step.value}")

    def _inlined(self) -> dict[str, Node]:
        """Formulas as defined so far, in terms of dataset columns."""
        done: dict[str, Node] = {}

        def expand(n: str, open_: tuple[str, ...]) -> Node:
            if n in open_:
                raise SpecError(f"formulas depend on each other: {' -> '.join([*open_, n])}", "formula_cycle", pointer(self.path, "steps"))
            if n not in done:
                parts = {c: expand(c, (*open_, n)) for c in self.formulas[n].columns() if c in self.formulas}
                done[n] = self.formulas[n].replace(parts)
            return done[n]

        return {n: expand(n, ()) for n in self.formulas}

    def _formula(self, seq: int, step: Formula, path: str) -> None:
        if step.name in self.base or step.name.startswith("__"):
            raise SpecError(f"{step.name} is a dataset column or reserved", "name_conflict", pointer(path, "name"))
        self.formulas.pop(step.name, None)
        self.formulas[step.name] = step.expr
        self.lineage[step.name] = [f"step {seq}: {to_formula(step.expr)}"]

    def _trace(self, column: str, what: str) -> None:
        told = self.lineage.setdefault(column, [])
        if not told or told[-1] != what:
            told.append(what)

    def _order(self) -> list[tuple[str, Typed, ValueType]]:
        """Formulas so that each comes after those that it reads."""
        self._inlined()  # finds cycles
        out, left = [], dict(self.formulas)
        while left:
            ready = [n for n, e in left.items() if not set(e.columns()) & set(left)]
            for n in ready:
                scope = Scope(self.env, self.scope.numeric, self.scope.functions, None, self.scope.max_depth, self.scope.max_nodes)
                typed = scope.check(left.pop(n), pointer(self.path, "formulas", n))
                self.env[n] = materialized(typed, pointer(self.path, "formulas", n))
                out.append((n, typed, self.env[n]))
        return out

    def _frame(self, df: DataFrame, batch: Edits, marks: bool = True) -> DataFrame:
        """A batch as rows of keys, with value and whether it is set for each column. At most MAX_EDITS rows."""
        fields = [StructField(f"__k{i}", self.base[k].spark()) for i, k in enumerate(self.keys)]
        rows = []
        for key, cells in batch.cells.items():
            rows.append((*key, *[v for c in batch.columns for v in (cells.get(c), c in cells)]) if marks else key)
        if marks:
            fields += [f for i, c in enumerate(batch.columns) for f in (StructField(f"__v{i}", self.base[c].spark()), StructField(f"__s{i}", BooleanType()))]
        return df.sparkSession.createDataFrame(rows, StructType(fields))

    def _same(self) -> Column:
        return functools.reduce(lambda a, b: a & b, [name(k) == F.col(f"__k{i}") for i, k in enumerate(self.keys)])

    def _match(self, df: DataFrame, strict: bool) -> None:
        """Edits of rows that this caller's view lacks."""
        for batch in self.stages:
            if isinstance(batch, Edits):
                keys = self._frame(df, batch, marks=False)
                there = df.join(F.broadcast(keys), self._same(), "left_semi").select(*[name(k) for k in self.keys])
                found = {tuple(r) for r in there.collect()}  # at most MAX_EDITS keys
                self.unmatched += [{k: json_value(v) for k, v in zip(self.keys, key, strict=True)} for key in batch.cells if key not in found]
        if strict and self.unmatched:
            raise SpecError(f"{len(self.unmatched)} edits match no row", "unmatched_edits", pointer(self.path, "steps"), keys=self.unmatched[:LISTED])

    def apply(self, df: DataFrame) -> DataFrame:
        for stage in self.stages:
            df = self._edited(df, stage) if isinstance(stage, Edits) else self._shocked(df, stage)
        to = Compiler()
        for n, typed, kind in self.columns:
            df = df.withColumn(n, to(typed, kind).cast(kind.spark()))
        return df

    def _edited(self, df: DataFrame, batch: Edits) -> DataFrame:
        joined = df.join(F.broadcast(self._frame(df, batch)), self._same(), "left")
        at = {c: i for i, c in enumerate(batch.columns)}
        return joined.select(*[F.when(F.col(f"__s{at[c]}"), F.col(f"__v{at[c]}")).otherwise(name(c)).alias(c) if c in at else name(c) for c in df.columns])

    def _shocked(self, df: DataFrame, change: Change) -> DataFrame:
        step, kind, c = change.step, change.type, name(change.step.column)
        amount = step.factor
        if kind.kind == "float":
            value = c + float(amount) if step.op == "add" else c * float(amount)
            value = F.when(~F.isnan(value) & (F.abs(value) != float("inf")), value)
        else:
            fixed = F.lit(format(amount, "f")).cast(decimal(places(amount)).spark())
            own = c.cast(decimal(kind.scale or 0).spark())
            value = half_even(own + fixed if step.op == "add" else own * fixed, kind.scale or 0).cast(kind.spark())
        if change.where is not None:
            value = F.when(Compiler().predicate(change.where), value).otherwise(c)
        return df.withColumn(step.column, value)

    def apply_reference(self, rows: list[dict]) -> list[dict]:
        from ..verify.oracle import Evaluator

        rows = [dict(r) for r in rows]
        at = {tuple(r[k] for k in self.keys): r for r in rows} if self.keys else {}
        judge = Evaluator(self.scope.numeric)
        for stage in self.stages:
            if isinstance(stage, Edits):
                for key, cells in stage.cells.items():
                    at.get(key, {}).update(cells)
                continue
            for r in rows:
                old = r[stage.step.column]
                if old is not None and (stage.where is None or judge.value(stage.where, r) is True):
                    r[stage.step.column] = moved(old, stage.step, stage.type)
        for n, typed, kind in self.columns:
            for r in rows:
                r[n] = judge.converted(typed, r, kind)
        return rows

    def meta(self) -> dict:
        return {"steps": len(self.canonical), "unmatched_edits": self.unmatched[:LISTED], "lineage": self.lineage}

    def explain(self) -> dict:
        return {"steps": self.canonical, "formulas": {n: to_formula(self.formulas[n]) for n, _, _ in self.columns}, "lineage": self.lineage}


def moved(old: Any, step: Shock, kind: ValueType) -> Any:
    """A shocked value."""
    if kind.kind == "float":
        import math

        value = old + float(step.factor) if step.op == "add" else old * float(step.factor)
        return value if math.isfinite(value) else None
    value = Decimal(old) + step.factor if step.op == "add" else Decimal(old) * step.factor
    return rounded(value, kind.scale) if kind.kind == "decimal" else int(value.quantize(Decimal(1), ROUND_HALF_EVEN))
