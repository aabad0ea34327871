"""Expressions on Spark against plain Python decimals, value by value."""

import random
from decimal import ROUND_HALF_EVEN, Context, Decimal

import pytest

from tallyspark.expr import parse
from tallyspark.functions.columns import Compiler
from tallyspark.plans.checker import Scope
from tallyspark.errors import SpecError
from tallyspark.types import BOOL, DATETIME, FLOAT, INT, STR, decimal

EXACT = Context(prec=120, rounding=ROUND_HALF_EVEN)


def evaluate(engine, rows, schema, env, formula):
    typed = Scope(env).check(parse(formula))
    df = engine.spark.createDataFrame(rows, schema)
    return [r[0] for r in df.select(Compiler()(typed)).collect()]


def test_division_rounds_half_to_even(engine):
    rng = random.Random(5)
    pairs = [(Decimal(rng.randrange(-10**8, 10**8)).scaleb(-2), Decimal(rng.randrange(1, 10**6)).scaleb(-rng.randrange(3))) for _ in range(300)]
    pairs += [(Decimal(a).scaleb(-2), Decimal(2048)) for a in range(1, 400, 7)]  # ties at scale 10
    pairs += [(Decimal("1.00"), Decimal(3)), (Decimal("-1.00"), Decimal(2**11)), (Decimal(5), Decimal(0))]
    pairs += [(Decimal("0.0000000001") * k + Decimal("0.00000000005") * 3, Decimal(3)) for k in (1, 4, 7)]
    pairs = [(x.quantize(Decimal("1e-10")), y.quantize(Decimal("1e-10"))) for x, y in pairs]
    got = evaluate(engine, pairs, "x decimal(38,10), y decimal(38,10)", {"x": decimal(10), "y": decimal(10)}, "x / y")
    want = [EXACT.divide(x, y).quantize(Decimal("1e-10"), context=EXACT) if y else None for x, y in pairs]
    assert got == want


def test_a_quotient_beside_a_tie_is_no_tie(engine):
    # 0.5 ulp plus or minus a share too small for Spark's own quotient to show.
    y = Decimal(10) ** 17 * 2
    x = [Decimal(10) ** 7 * 10**0 * (2 * k + 1) + d for k in (0, 1) for d in (-1, 0, 1)]
    pairs = [(v, y) for v in x]
    got = evaluate(engine, pairs, "x decimal(38,0), y decimal(38,0)", {"x": decimal(0), "y": decimal(0)}, "x / y")
    assert got == [EXACT.divide(a, b).quantize(Decimal("1e-10"), context=EXACT) for a, b in pairs]


def test_products_are_exact_and_capped(engine):
    env = {"x": decimal(6), "y": decimal(10), "z": decimal(12)}
    rows = [(Decimal("1.234567"), Decimal("2.0000000001"), Decimal("0.000000000003")), (None, Decimal(1), Decimal(1))]
    schema = "x decimal(38,6), y decimal(38,10), z decimal(38,12)"
    assert evaluate(engine, rows, schema, env, "x * y") == [EXACT.multiply(rows[0][0], rows[0][1]), None]
    assert evaluate(engine, rows, schema, env, "y * z")[0] == EXACT.multiply(rows[0][1], rows[0][2]).quantize(Decimal("1e-18"), context=EXACT)


@pytest.mark.parametrize(
    ("formula", "want"),
    [
        ("round(x)", [Decimal(2), Decimal(-2), None]), ("round(x, 1)", [Decimal("2.5"), Decimal("-2.5"), None]), ("floor(x)", [Decimal(2), Decimal(-3), None]), ("ceil(x)", [Decimal(3), Decimal(-2), None]),
        ("int(x)", [2, -2, None]), ("str(x)", ["2.50", "-2.50", None]), ("x > 0 or None", [True, None, None]), ("x > 0 and None", [None, False, None]), ("not (x > 0)", [False, True, None]),
        ("x in (2.5, 7)", [True, False, None]), ("x not in (2.5, 7)", [False, True, None]), ("f / 0", [None, None, None]), ("sqrt(f)", [2.0, None, None]), ("log(f) is None", [False, True, True]), ("f ** 0.5", [2.0, None, None]),
        ("exp(f * 1000)", [None, 0.0, None]), ("int(t)", [12, None, None]), ("float(t)", [12.0, None, None]), ("decimal(t, 1)", [Decimal("12.0"), None, None]), ("to_date(t)", [None, None, None]), ("min(i, 5)", [3, 5, 5]), ("max(i, f)", [4.0, -1.0, None]),
        ("i / 2", [Decimal("1.5"), None, None]), ("1.5 * f", [6.0, -1.5, None]), ("i if f > 0 else 9", [3, 9, 9]), ("coalesce(i, 7) * 2", [6, 14, 14]), ("contains(t, '2')", [True, False, None]), ("upper(t)", ["12", " 7", None]), ("0 < f < 10", [True, False, None]), ("-i + 1", [-2, None, None]),
    ],
)
def test_values(engine, formula, want):
    env = {"x": decimal(2), "f": FLOAT, "t": STR, "i": INT, "b": BOOL}
    rows = [(Decimal("2.50"), 4.0, "12", 3, True), (Decimal("-2.50"), -1.0, " 7", None, False), (None, None, None, None, None)]
    got = evaluate(engine, rows, "x decimal(38,2), f double, t string, i long, b boolean", env, formula)
    assert got == want


@pytest.mark.parametrize("formula", ["x * f", "x + t", "b + 1", "x ** 2", "sqrt(x)", "t < 1", "not x", "lower(i)", "1 if i else 2", "round(x, i)", "float(b)", "str(f)", "d == t", "x == f", "nope(x)", "missing"])
def test_types_are_checked_before_spark_sees_them(formula):
    env = {"x": decimal(2), "f": FLOAT, "t": STR, "i": INT, "b": BOOL, "d": DATETIME}
    with pytest.raises(SpecError) as caught:
        Scope(env).check(parse(formula))
    assert caught.value.code in ("type_mismatch", "unknown_function", "unknown_column")
