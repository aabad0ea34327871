import corpus_pipeline as C
from pyspark.sql import functions as F

from tallyspark.llm import registry
from tallyspark.llm.common import materialize

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def rated(spark, folder):
    spark.createDataFrame([(i, i % 2, 0) for i in range(0, 60, 3)] + [(None, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(str(folder / "labels.parquet"))


def test_stages_and_run_agree(spark, docs, tmp_path):
    table = docs.select(*COLUMNS)
    path = str(tmp_path / "documents.parquet")
    rated(spark, tmp_path)
    table.write.parquet(path)
    step = spark.read.parquet(path)
    for name, stage in C.STAGES:
        before, step = step, materialize(stage(spark, step, str(tmp_path)))
        if name != "sentencepiece":
            assert step.columns == COLUMNS
        if name == "language_id":
            gone = before.exceptAll(step).collect()
            assert all(not any(c.isalpha() for c in r.text or "") for r in gone if r.doc_id is not None and r.doc_id < 60)
            assert step.filter(F.col("text").isNull()).count() == 0
        if name == "line_dedup":
            assert step.filter(F.array_contains(F.split("text", "\n"), "Common header line") & (F.col("source") == "web")).count() == 0
        if name == "near_dedup":
            assert step.count() < before.count() and step.count() == step.dropDuplicates(["doc_id", "text"]).count()
        if name == "mix_sources":
            assert step.exceptAll(before.unionAll(before).unionAll(before)).count() == 0
    assert step.filter(~F.col("lossless")).count() == 0
    ran = C.run(spark, str(tmp_path))
    assert sorted(map(str, ran.collect())) == sorted(map(str, step.collect()))


def test_empty_table(spark, none, tmp_path):
    none.select(*COLUMNS).write.parquet(str(tmp_path / "documents.parquet"))
    rated(spark, tmp_path)
    assert C.run(spark, str(tmp_path)).collect() == []


def test_every_operator_has_one_query():
    import re

    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in registry.QUERIES) == list(range(1, 11))


def test_groups_of_copies_are_no_boilerplate(spark, tmp_path):
    """A third of a source are copies of one document and a third near copies of another; one of each stays, uncut."""
    text = lambda name: "\n".join(" ".join(f"{name}{i}x{j}" for j in range(40)) for i in range(5))
    rows = [(k, text("copy")) for k in range(20)]
    rows += [(20 + k, text("near").replace("near2x7", f"changed{k}")) for k in range(20)]
    rows += [(40 + k, "Common header\n" + text(f"own{k}a")) for k in range(20)]
    table = spark.createDataFrame([(i, t, "en", "web", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    cut = materialize(C.drop_boilerplate(spark, table, str(tmp_path)))
    left = {r.doc_id: r.text for r in cut.collect()}
    assert left == {i: t.removeprefix("Common header\n") for i, t in rows}
    stay = {r.doc_id for r in C.drop_near_duplicates(spark, cut, str(tmp_path)).collect()}
    assert stay == {0, 20, *range(40, 60)}


def test_tables_and_shuffle_files_go_when_nothing_reads_them(spark, docs, tmp_path):
    import time
    from pathlib import Path
    from urllib.parse import urlparse

    from tallyspark.llm import common
    from tallyspark.llm.neardup import near_duplicates

    docs.count()  # its own shuffle files, of a kept table, stay
    folder = Path(urlparse(common.scratch(spark)).path).parent
    tables = lambda: set(folder.glob("tallyspark-*"))
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    before, files, setting = tables(), disk.getAllFiles().size(), spark.conf.get(common.TIDY, None)
    common.discard(common.materialize(docs.groupBy("text").count()))
    for _ in range(20):
        if disk.getAllFiles().size() <= files:
            break
        time.sleep(0.5)
    assert disk.getAllFiles().size() <= files and tables() == before and spark.conf.get(common.TIDY, None) == setting
    found = near_duplicates(docs)
    assert len(tables() - before) == 2 and found.count() == docs.count()
    common.discard(found)
    assert tables() == before
    rated(spark, tmp_path)
    table = materialize(docs.select(*COLUMNS))
    before = tables()
    for name, stage in C.STAGES[1:4]:
        after = stage(spark, table, str(tmp_path))
        assert len(tables() - before) <= 2, name
        assert after.count() > 0
        common.discard(after)


def test_the_mix_makes_its_keys_without_texts(spark, docs, tmp_path, monkeypatch):
    from tallyspark.llm import mixing

    plans = []
    monkeypatch.setattr(mixing, "materialize", lambda df: plans.append(df._jdf.queryExecution().optimizedPlan()) or materialize(df))
    rated(spark, tmp_path)
    C.mix(spark, docs.select(*COLUMNS), str(tmp_path))

    def nodes(plan):
        return [plan] + [n for i in range(plan.children().size()) for n in nodes(plan.children().apply(i))]

    sides = [n.children().apply(0).output() for n in nodes(plans[0]) if n.nodeName() == "Join"]
    assert len(sides) == 1
    assert [sides[0].apply(i).dataType().simpleString() for i in range(sides[0].size())].count("string") <= 1  # the source
