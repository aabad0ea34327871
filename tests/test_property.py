"""Random frames and queries: Spark's answers against the row-at-a-time evaluator's."""

import random
from datetime import date
from decimal import Decimal

import pytest

from tallyspark.engine import Engine
from tallyspark.queries import Samples
from tallyspark.sources.catalog import Catalog
from tallyspark.verify.checks import pages_partition, subtotals_add_up, verify
from tallyspark.whatif.plugin import WhatIfPlugin

DECIMALS = ["d", "d * 1.5", "d / 3", "round(d * i, 1)", "decimal(f, 3)", "i / 7", "coalesce(d, 0.25)", "max(d, i)", "abs(-d)", "floor(d)"]
FLOATS = ["f", "f * 2", "f / i", "sqrt(f)", "float(d) + f", "f ** 2", "1.5 - f", "float(i) / 3"]
TESTS = ["d > 0", "f <= i", "g in ('a', 'b')", "g is None", "not flag", "flag or d > 1", "flag and f < 0", "day >= date('2025-01-10')", "contains(g, 'a')", "i != 3 and g == 'a'", "0 <= d < 5"]
FNS = ["sum", "mean", "min", "max", "count", "count_distinct", "median"]


def frame(rng, n):
    maybe = lambda v: None if rng.random() < 0.2 else v
    return [(k, maybe(rng.choice("abc")), maybe(rng.randrange(4)), maybe(Decimal(rng.randrange(-999, 999)).scaleb(-2)), maybe(rng.randrange(-500, 500) / 100), maybe(rng.randrange(-9, 9)), maybe(rng.random() < 0.5), maybe(date(2025, 1, rng.randrange(1, 20)))) for k in range(n)]


def query(rng):
    pick = lambda: rng.choice(DECIMALS + FLOATS)
    out = {"derive": [{"name": "x", "expr": pick()}, {"name": "y", "expr": pick(), "where": rng.choice(TESTS)}]}
    if rng.random() < 0.5:
        out["filter"] = rng.choice(TESTS)
    if rng.random() < 0.25:
        return out | {"sort": [{"by": rng.choice(["x", "y", "g"]), "desc": rng.random() < 0.5, "nulls_last": rng.random() < 0.5}, {"by": "k"}], "page": {"offset": rng.randrange(3), "limit": 5}}
    out["group_by"] = rng.choice([["g"], ["h", "g"], [], ["flag"]])
    out["measures"] = [{"name": f"m{i}", "fn": rng.choice(FNS), "of": rng.choice(["x", "y", "d", "i", pick()])} | ({"where": rng.choice(TESTS)} if rng.random() < 0.4 else {}) for i in range(2)]
    out["measures"] += [{"name": "n", "fn": "count_rows"}, {"name": "w", "fn": "wavg", "of": "f", "weight": "i"}]
    out["post"] = [{"name": "share", "expr": "n / total(n)"}]
    if out["group_by"] and rng.random() < 0.5:
        out["rollup"] = True
    if rng.random() < 0.3:
        out["pivot"] = {"on": ["h" if out["group_by"] != ["h", "g"] else "flag"], "values": ["m0", "share"], "totals": rng.random() < 0.5}
    elif rng.random() < 0.5:
        out["having"] = "n > 1 or m0 is None"
    return out


def steps(rng, n):
    return [
        {"kind": "shock", "column": "d", "op": rng.choice(["pct", "mul"]), "value": "1.37", "where": rng.choice(TESTS)}, {"kind": "override", "edits": [{"key": {"k": rng.randrange(n)}, "column": "d", "value": rng.choice([None, "1.25"])}, {"key": {"k": 0}, "column": "g", "value": "z"}]},
        {"kind": "shock", "column": "i", "op": "mul", "value": "0.5", "round": True}, {"kind": "shock", "column": "f", "op": "add", "value": "0.1"}, {"kind": "formula", "name": "v", "expr": "u * 2"}, {"kind": "formula", "name": "u", "expr": "d * i"}, {"kind": "disable", "seq": rng.choice([1, 4])},
    ]


@pytest.mark.parametrize("seed", range(5))
def test_both_evaluators_agree(spark, seed):
    rng = random.Random(seed)
    n = [0, 1, 30, 30, 25][seed]
    catalog = Catalog(spark)
    df = spark.createDataFrame(frame(rng, n), "k int, g string, h int, d decimal(12,2), f double, i int, flag boolean, day date")
    catalog.register_frame("t", df.coalesce(2), key_columns=["k"], version="1")
    engine = Engine(spark, catalog, [Samples(), WhatIfPlugin()])
    for j in range(7):
        request = {"dataset": "t", "query": query(rng)}
        if n and j % 3 == 2:
            request["extensions"] = {"whatif": {"steps": steps(rng, n)}}
        report = verify(engine, request)
        assert report.ok, (request, report.differences[:5])


def test_subtotals_and_pages(engine):
    request = {"dataset": "trades", "query": {"group_by": ["book", "zone"], "rollup": True, "measures": [{"name": "q", "fn": "sum", "of": "qty"}]}}
    assert subtotals_add_up(engine, request, "q") == []
    assert pages_partition(engine, {"dataset": "trades", "query": {"sort": [{"by": "zone"}]}}, 2)
    assert verify(engine, {"dataset": "loose", "query": {"sort": [{"by": "v", "desc": True}]}}).ok
