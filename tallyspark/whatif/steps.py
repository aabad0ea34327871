"""What-if steps, and the block of a request that holds them."""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal
from typing import ClassVar

from ..errors import pointer
from ..expr import Node
from ..plans.request import Shape, bad, count, filled, flag, formula, many, mapping, optional, part, scalar, text
from ..types import exact, plain


def _amount(v: object, path: str) -> Decimal:
    try:
        return Decimal(plain(exact(v)))
    except ValueError as e:
        raise bad(str(e), path) from None


def _op(v: object, path: str) -> object:
    if v not in ("add", "mul", "pct"):
        raise bad("expected add, mul or pct", path)
    return v


def _key(v: object, path: str) -> dict:
    found = mapping(v, path)
    if not found:
        raise bad("a key needs columns", path)
    return {k: scalar(x, pointer(path, k)) for k, x in found.items()}


def _seq(v: object, path: str) -> int:
    if count(v, path) < 1:
        raise bad("sequence numbers begin at 1", path)
    return v


@dataclass(frozen=True)
class Edit(Shape):
    """One cell: a value for every key column, the column, and its new value (null too)."""

    key: dict = part(_key)
    column: str = part(text)
    value: object = part(scalar)


class Step(Shape):
    """Steps carry their kind in JSON."""

    kind: ClassVar[str]

    @classmethod
    def lift(cls, v: object) -> object:
        return {k: x for k, x in v.items() if k != "kind"} if isinstance(v, dict) else v


@dataclass(frozen=True)
class Override(Step):
    kind: ClassVar[str] = "override"
    edits: tuple = part(many(Edit.read, 1))


@dataclass(frozen=True)
class Shock(Step):
    """Adds to, multiplies, or moves by percent a column, where the condition is true."""

    kind: ClassVar[str] = "shock"
    column: str = part(text)
    op: str = part(_op)
    value: Decimal = part(_amount)
    where: Node | None = part(optional(formula), None)
    round: bool = part(flag, False)

    @property
    def factor(self) -> Decimal:
        return 1 + self.value / 100 if self.op == "pct" else self.value


@dataclass(frozen=True)
class Formula(Step):
    kind: ClassVar[str] = "formula"
    name: str = part(filled)
    expr: Node = part(formula)


@dataclass(frozen=True)
class Disable(Step):
    kind: ClassVar[str] = "disable"
    seq: int = part(_seq)


KINDS = {c.kind: c for c in (Override, Shock, Formula, Disable)}


def read_step(v: object, path: str = "") -> Step:
    if isinstance(v, Step):
        return v
    kind = v.get("kind") if isinstance(v, dict) else None
    if kind not in KINDS:
        raise bad("expected a step: override, shock, formula or disable", pointer(path, "kind"))
    return KINDS[kind].read(v, path)


@dataclass(frozen=True)
class ScenarioRef(Shape):
    id: str = part(filled)
    version: int | None = part(optional(count), None)

    @classmethod
    def lift(cls, v: object) -> object:
        return {"id": v} if isinstance(v, str) else v


@dataclass(frozen=True)
class WhatIf(Shape):
    """A saved scenario, if any, then further steps. With strict_edits an override of a row that is not there is an error."""

    scenario: ScenarioRef | None = part(optional(ScenarioRef.read), None)
    steps: tuple = part(many(read_step), ())
    strict_edits: bool = part(flag, True)
