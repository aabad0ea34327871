import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tallyspark.llm import mixing as M


def brute(rows, weights=(5, 2, 1), most=3):
    """Targets by resharing the excess again and again."""
    size = defaultdict(int)
    for r in rows:
        size[r["source"]] += r["size"]
    names = sorted(size, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    capped, total = {}, sum(size.values())
    while True:
        left = [s for s in names if s not in capped]
        level = (total - sum(capped.values())) / max(1, sum(weight[s] for s in left))
        over = [s for s in left if level * weight[s] > most * size[s]]
        if not over:
            return {s: capped.get(s, level * weight[s]) for s in names}, size
        capped |= {s: most * size[s] for s in over}


def test_targets_copies_and_reruns(docs):
    mixed = M.mix_sources(docs)
    rows = [r.asDict() for r in mixed.collect()]
    assert len(rows) == docs.count() and "Node" in mixed.columns
    by_text = {(r.doc_id, r.text): r.text for r in docs.collect()}
    for r in rows:
        text = by_text[(r["doc_id"], r["text"])]
        assert r["size"] == len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
        assert 0 <= r["taken"] <= 3 * r["size"] and r["taken"] == r["size"] * r["copies"]
    targets, size = brute(rows)
    taken, largest = defaultdict(int), defaultdict(int)
    for r in rows:
        assert r["target"] == pytest.approx(targets[r["source"]]) and r["source_size"] == size[r["source"]]
        taken[r["source"]] += r["taken"]
        largest[r["source"]] = max(largest[r["source"]], r["size"])
    for s, t in targets.items():
        assert abs(taken[s] - t) <= largest[s] + 1, s
    again = M.mix_sources(docs.repartition(7)).select("doc_id", "text", "copies")
    assert sorted(map(str, again.collect())) == sorted(map(str, mixed.select("doc_id", "text", "copies").collect()))


def test_epochs_differ_by_one_and_weights_draw(spark):
    df = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("a").alias("source"), F.lit("w w").alias("text"), (F.col("id") % 2).cast("double").alias("q"))
    df = df.union(spark.createDataFrame([(9999, "b", "w " * 20000, 1.0)], df.schema))
    got = M.mix_sources(df, weight=M.quality_weight(F.col("q"))).filter("source = 'a'").groupBy("q", "copies").count().collect()
    n = {(r.q, r.copies): r["count"] for r in got}
    copies = sorted({c for _, c in n})
    assert len(copies) == 2 and copies[1] == copies[0] + 1
    more = lambda q: n.get((q, copies[1]), 0) / sum(n.get((q, c), 0) for c in copies)
    assert more(1.0) > more(0.0) + 0.1


def test_empty_and_blank(none, spark):
    assert M.mix_sources(none).collect() == []
    blank = spark.createDataFrame([(1, None, None), (2, "a", " ")], "doc_id long, source string, text string")
    assert [(r.size, r.target, r.copies) for r in M.mix_sources(blank).orderBy("doc_id").collect()] == [(0, 0.0, 0), (0, 0.0, 0)]


def test_repeated_rows_are_taken_one_by_one(spark):
    """A source of 50 rows of ten words and one row 2,000 times over still comes within half a row of its target."""
    rows = [(i, "a", "w " * 10) for i in range(50)] + [(99, "a", "w " * 10)] * 2000 + [(1000 + i, "b", "v " * 30) for i in range(2000)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(5)
    got = M.mix_sources(df).collect()
    assert len(got) == len(rows)
    for s in "ab":
        own = [r for r in got if r.source == s]
        assert abs(sum(r.taken for r in own) - own[0].target) <= max(r["size"] for r in own) / 2 + 1e-6
    spread = {r.copies for r in got if r.doc_id == 99}
    assert len(spread) <= 2 and all(r.taken <= 3 * r["size"] for r in got)


def test_clashing_names_survive(spark):
    names = ["doc_id", "text", "source", "__size", "key", "a.b", "row", "plan"]
    df = spark.createDataFrame([(1, "x y", "s", 7, 8, 9, 10, 11), (2, "z", "t", 17, 18, 19, 20, 21)], names)
    got = M.mix_sources(df)
    assert got.columns == [*names, *M.OUTPUTS]
    assert sorted(tuple(r)[3:8] for r in got.collect()) == [(7, 8, 9, 10, 11), (17, 18, 19, 20, 21)]


def test_copies_are_numbered_and_quality_is_joined(spark):
    df = spark.createDataFrame([(1, "x"), (1, "x"), (1, "y"), (None, "x"), (None, "x")], "doc_id long, text string")
    assert sorted((str(r.doc_id), r.text, r.copy) for r in M.number_copies(df).collect()) == [("1", "x", 1), ("1", "x", 2), ("1", "y", 1), ("None", "x", 1), ("None", "x", 2)]
    labels = spark.createDataFrame([(1, 1), (1, 0), (None, 1)], "doc_id long, quality int")
    assert {(r.doc_id, r.quality) for r in M.with_quality(df, labels).collect()} == {(1, 0.5), (None, None)}


def test_plan_stays_in_the_jvm(docs, capsys):
    M.mix_sources(docs).explain()
    assert not re.search("Python|Arrow|Pandas", capsys.readouterr().out)
