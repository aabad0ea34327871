"""Two sides of the same query, joined: m, m__base, m__delta, m__pct."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import SpecError
from ..expr import col, lit, node
from ..functions.columns import Compiler, name
from ..plans.checker import Scope
from ..types import NUMERIC, ValueType, Scales
from .frames import null_safe_join


def compared(target: DataFrame, base: DataFrame, keys: Sequence[str], values: Sequence[str], types: Mapping[str, ValueType], base_types: Mapping[str, ValueType], numeric: Scales) -> tuple[DataFrame, dict[str, ValueType]]:
    """Full outer join on the keys (nulls equal). Numbers get a difference, null where a side is missing, and a percentage of
    the base, null also for a base of 0."""
    for k in keys:
        if k not in base_types or base_types[k].kind != types[k].kind:
            raise SpecError(f"{k} differs between the two sides", "compare_mismatch")
    for v in values:
        if v not in base_types:
            raise SpecError(f"{v} is on one side only", "compare_mismatch")
        if types[v].kind != base_types[v].kind and not {types[v].kind, base_types[v].kind} <= NUMERIC:
            raise SpecError(f"{v} has different types on the two sides", "compare_mismatch")
    right = base.select(*[name(k) for k in keys], *[name(v).alias(v + "__base") for v in values])
    left = target.select(*[name(c) for c in (*keys, *values)])
    both = null_safe_join(left, right, keys) if keys else left.crossJoin(F.broadcast(right))
    out, columns = {k: types[k] for k in keys}, [name(k) for k in keys]
    to = Compiler()
    for v in values:
        env = {v: types[v], v + "__base": base_types[v]}
        out |= env
        columns += [name(v), name(v + "__base")]
        if types[v].kind in NUMERIC and base_types[v].kind in NUMERIC:
            delta = Scope(env, numeric).check(node("binary", col(v), col(v + "__base"), op="sub"))
            kind = delta.type.settled()
            as_float = lambda c: node("cast", col(c), to="float", scale=None)
            share = node("binary", node("binary", as_float(v + "__delta"), as_float(v + "__base"), op="div"), lit(100), op="mul")
            pct = Scope(env | {v + "__delta": kind}, numeric).check(share)
            both = both.withColumn(v + "__delta", to(delta, kind))
            both = both.withColumn(v + "__pct", to(pct))
            out |= {v + "__delta": kind, v + "__pct": pct.type.settled()}
            columns += [name(v + "__delta"), name(v + "__pct")]
    return both.select(*columns), out
