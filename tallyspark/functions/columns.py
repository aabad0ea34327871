"""Typed expressions as Spark columns.

Every operand is cast explicitly, so Spark's own coercion never decides. Decimals are decimal(38, s) throughout, rounded half
to even, with spark.sql.decimalOperations.allowPrecisionLoss off (the engine sets it): sums and products are then exact or
raise. Floats that are not finite become null.
"""

from __future__ import annotations

import datetime as dt
import functools
from collections.abc import Mapping
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.checker import Typed
from ..types import FLOAT, INT, ValueType, decimal

WHOLE, NUMBER, ISO_DATE = r"^[+-]?\d+$", r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$", r"^\d{4}-\d{2}-\d{2}$"


def name(n: str) -> Column:
    return F.col("`" + n.replace("`", "``") + "`")


def finite(c: Column) -> Column:
    return F.when(~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))), c)


def half_even(c: Column, scale: int) -> Column:
    return F.bround(c, scale).cast(decimal(scale).spark())


def convert(c: Column, source: ValueType, target: ValueType) -> Column:
    """Between types that meet: never from decimal literals' exactness to less unless the target is float."""
    if source.kind == target.kind == "decimal" and target.scale < source.scale:
        return half_even(c, target.scale)
    if source.kind == target.kind and source.scale == target.scale:
        return c
    return c.cast(target.spark())


class Compiler:
    """Columns of expressions; `totals` names the column that holds each measure's total."""

    def __init__(self, totals: Mapping[str, str] | None = None) -> None:
        self.totals = totals or {}

    def materialize(self, t: Typed) -> Column:
        """As a column of the expression's own type."""
        return self(t, t.type.settled())

    def predicate(self, t: Typed) -> Column:
        return self(t).cast("boolean")

    def __call__(self, t: Typed, target: ValueType | None = None) -> Column:
        if target is not None and t.node.kind == "lit":
            return _literal(t, target)
        out = getattr(self, "_" + t.node.kind)(t)
        return out if target is None or target.kind == "null" else convert(out, t.type, target)

    def _lit(self, t: Typed) -> Column:
        return _literal(t, t.type)

    def _col(self, t: Typed) -> Column:
        return name(t.node["name"])

    def _binary(self, t: Typed) -> Column:
        op, out = t.node["op"], t.type
        if out.kind == "null":
            return F.lit(None)
        if out.kind == "float":
            x, y = (self(a, FLOAT) for a in t.args)
            plain = {"add": lambda: x + y, "sub": lambda: x - y, "mul": lambda: x * y, "div": lambda: F.try_divide(x, y), "pow": lambda: F.pow(x, y)}[op]()
            return finite(plain)
        if out.kind == "int":
            x, y = (self(a, INT) for a in t.args)
            return {"add": lambda: x + y, "sub": lambda: x - y, "mul": lambda: x * y}[op]()
        if op in ("add", "sub"):
            x, y = (self(a, out) for a in t.args)
            return (x + y if op == "add" else x - y).cast(out.spark())
        own = [decimal(a.type.scale if a.type.kind == "decimal" else 0) for a in t.args]
        x, y = (self(a, s) for a, s in zip(t.args, own, strict=True))
        if op == "mul":
            product = x * y
            return product.cast(out.spark()) if sum(s.scale for s in own) <= out.scale else half_even(product, out.scale)
        return divide(x, y, own[0].scale, own[1].scale, out.scale)

    def _unary(self, t: Typed) -> Column:
        if t.node["op"] == "not":
            return ~self.predicate(t.args[0])
        x = self(t.args[0])
        return x if t.type.kind == "null" else (-x).cast(t.type.spark())

    def _cmp(self, t: Typed) -> Column:
        x, y = (self(a, t.meet) for a in t.args)
        return {"eq": lambda: x == y, "ne": lambda: x != y, "lt": lambda: x < y, "le": lambda: x <= y, "gt": lambda: x > y, "ge": lambda: x >= y}[t.node["op"]]()

    def _logic(self, t: Typed) -> Column:
        return functools.reduce(lambda a, b: a & b if t.node["op"] == "and" else a | b, [self.predicate(a) for a in t.args])

    def _in(self, t: Typed) -> Column:
        subject, *values = (self(a, t.meet) for a in t.args)
        found = subject.isin(*values)
        return ~found if t.node["negate"] else found

    def _is_null(self, t: Typed) -> Column:
        x = self(t.args[0])
        return x.isNotNull() if t.node["negate"] else x.isNull()

    def _if(self, t: Typed) -> Column:
        then = self(t.args[1], t.meet)
        other = self(t.args[2], t.meet) if len(t.args) > 2 else F.lit(None)
        return F.when(self.predicate(t.args[0]), then).otherwise(other)

    def _func(self, t: Typed) -> Column:
        if t.plugin is not None:
            return self._plugin(t)
        fn = t.node["name"]
        if fn == "total":
            return name(self.totals[t.node.args[0]["name"]])
        if fn in ("min", "max", "coalesce"):
            values = [self(a, t.meet) for a in t.args]
            return {"min": F.least, "max": F.greatest, "coalesce": F.coalesce}[fn](*values)
        if fn in ("sqrt", "log", "exp"):
            x = self(t.args[0], FLOAT)
            return finite({"sqrt": F.sqrt, "log": F.ln, "exp": F.exp}[fn](x))
        if fn in ("lower", "upper", "contains", "starts_with", "ends_with"):
            text = [self(a).cast("string") for a in t.args]
            return {"lower": F.lower, "upper": F.upper, "contains": F.contains, "starts_with": F.startswith, "ends_with": F.endswith}[fn](*text)
        x, kind = self(t.args[0]), t.args[0].type.kind
        if kind == "null" or kind == "int" and fn != "abs":
            return x
        if fn == "abs":
            return F.abs(x).cast(t.type.spark())
        if fn == "round":
            digits = t.args[1].node["value"] if len(t.args) > 1 else 0
            if kind == "float":
                return F.bround(x, digits)
            return x if t.type.scale == t.args[0].type.scale else half_even(x, t.type.scale)
        edge = F.floor if fn == "floor" else F.ceil
        # Doubles of this size are whole; the guard keeps them from overflowing Spark's bigint result.
        return edge(x).cast(t.type.spark()) if kind == "decimal" else F.when(F.abs(x) < 2.0**53, edge(x).cast("double")).otherwise(x)

    def _plugin(self, t: Typed) -> Column:
        args = [self(a, a.type.settled()) for a in t.args]
        out = t.plugin.column(*args).cast(t.type.spark()) if t.type.kind != "decimal" else half_even(t.plugin.column(*args), t.type.scale)
        if t.type.kind == "float":
            out = finite(out)
        if t.plugin.nulls == "propagate" and args:
            out = F.when(functools.reduce(lambda a, b: a & b, [a.isNotNull() for a in args]), out)
        return out

    def _cast(self, t: Typed) -> Column:
        x, source, target = self(t.args[0]), t.args[0].type, t.type
        if source.kind == "null":
            return F.lit(None).cast(target.spark())
        text = source.kind == "str"
        match target.kind:
            case "int":
                number = F.when(x.rlike(WHOLE), x) if text else x
                return number.try_cast("bigint")
            case "float":
                number = F.when(x.rlike(NUMBER), x) if text else x
                return finite(number.try_cast("double"))
            case "decimal":
                if source.kind == "int" or source.kind == "decimal" and source.scale <= target.scale:
                    return x.cast(target.spark())
                if source.kind == "decimal":
                    return half_even(x, target.scale)
                number = F.when(x.rlike(NUMBER), x) if text else finite(x)
                # Digits beyond the target's are read before rounding, as many as leave room for whole digits.
                spare = min(38, target.scale + 10)
                return F.bround(number.try_cast(decimal(spare).spark()), target.scale).try_cast(target.spark())
            case "str":
                return x.cast("string")
        return F.when(x.rlike(ISO_DATE), x).try_cast("date") if text else x.cast("date")


def divide(x: Column, y: Column, sx: int, sy: int, scale: int) -> Column:
    """x / y rounded half to even at `scale`; null for a zero divisor.

    Spark rounds its own quotient first, so one that lies close to a tie could be taken for a tie. Where it looks like one,
    |x| is compared with |tie * y|, which tells on which side the true quotient lies.
    """
    quotient = F.try_divide(x.cast(decimal(sx).spark()), y.cast(decimal(sy).spark()))
    near = half_even(quotient, scale)
    if scale >= 37:
        return near
    ulp, half = Decimal(1).scaleb(-scale), Decimal(5).scaleb(-scale - 1)
    cut = decimal(scale + 1).spark()
    lit = lambda v: F.lit(v).cast(cut)
    away = F.abs(quotient.cast(cut) - near.cast(cut))
    tie = F.abs(F.bround(quotient, scale + 1).cast(cut))
    side = F.abs(x) - tie * F.abs(y)
    low = tie - lit(half)
    magnitude = F.when(side > 0, low + lit(ulp)).when(side < 0, low)
    signed = F.when(quotient < 0, -magnitude).otherwise(magnitude).cast(decimal(scale).spark())
    return F.when((away == lit(half)) & (side != 0), signed).otherwise(near)


def _literal(t: Typed, target: ValueType) -> Column:
    kind, value = t.node["type"], t.node["value"]
    if value is None or kind == "null":
        return F.lit(None) if target.kind == "null" else F.lit(None).cast(target.spark())
    if kind == "date":
        return F.lit(dt.date.fromisoformat(value))
    if kind == "datetime":
        return F.lit(value).cast("timestamp_ntz")
    if kind in ("int", "num", "float") and target.kind in ("decimal", "float", "int"):
        if target.kind == "float":
            return F.lit(float(value))
        if target.kind == "int":
            return F.lit(int(value)).cast("bigint")
        return F.lit(format(Decimal(str(value)), "f")).cast(target.spark())
    return F.lit(value)
