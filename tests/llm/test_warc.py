import hashlib

import pytest
from pyspark.sql import functions as F

from tallyspark.llm import warc as W


def test_records_round_trip(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://a/é", "<p>ü</p>"), (None, None, None), (3, "http://b", "x\r\n\r\ny")], "k long, u string, h string")
    raw = [r[0].encode() for r in pages.select(W.warc_record(F.col("k"), F.col("u"), F.col("h"))).collect()]
    found = list(W.parse_warc(b"".join(raw)))
    assert [r.payload.decode() for r in found] == ["<p>ü</p>", "", "x\r\n\r\ny"] and [r.length for r in found] == [len(x) for x in raw]
    (tmp_path / "a.warc").write_bytes(b"".join(raw))
    read = W.read_warc(spark, str(tmp_path / "a.warc")).orderBy("offset").collect()
    assert [r.digest for r in read] == [hashlib.sha256(x).hexdigest() for x in raw] and [r.offset for r in read] == [r.offset for r in found]
    for bad in (b"no record", raw[0][:-1], raw[0].replace(b"<p>", b"<q>")):
        with pytest.raises((W.WarcError, KeyError)):
            list(W.parse_warc(bad))


def manifest(spark, n=400):
    rows = [(f"f{i % 3}", i // 3 * 900, 900, hashlib.sha256(str(i).encode()).hexdigest()) for i in range(n)]
    return rows, spark.createDataFrame(rows, "file string, offset long, length long, digest string")


def test_audit_finds_exactly_the_damage(spark):
    rows, good = manifest(spark)
    hurt = {(r[0], r[1]): r for r in rows}
    for at, kind in ((5, "changed"), (77, "missing"), (200, "gone"), (399, "changed")):
        f, o, n, d = rows[at]
        if kind == "gone":
            del hurt[(f, o)]
        else:
            hurt[(f, o)] = (f, o, n, None if kind == "missing" else d[::-1])
    hurt[("f1", 10**6)] = ("f1", 10**6, 5, "new")
    bad = spark.createDataFrame(list(hurt.values()), good.schema)
    found, trail = W.audit(good, bad, span=4000, fan_out=3)
    got = {(r.file, r.offset): r.kind for r in found.collect()}
    assert got == {rows[5][:2]: "changed", rows[77][:2]: "missing", rows[200][:2]: "missing", rows[399][:2]: "changed", ("f1", 10**6): "extra"}
    assert len(trail) > 2 and trail[-1].count() == 5 and trail[0].count() <= 3


def test_equal_and_empty_replicas(spark):
    _, good = manifest(spark)
    found, trail = W.audit(good, good.repartition(5))
    assert found.collect() == [] and trail[0].count() == 0
    assert W.audit(good.limit(0), good.limit(0))[0].collect() == []
    assert W.audit(good, good.limit(0))[0].count() == 400


def test_layout_is_even_and_keeps_copies(spark):
    rows = [(i % 50, hashlib.sha256(str(i % 50).encode()).hexdigest(), 100) for i in range(2000)] + [(None, "ab", 7), (None, "ab", 7)]
    laid = W.lay_out(spark.createDataFrame(rows, "record_key long, digest string, length long"), per_file=500).collect()
    assert sum(r.copies for r in laid) == 2002 and len({r.file for r in laid}) > 4
    for f in {r.file for r in laid}:
        own, at = sorted((r for r in laid if r.file == f), key=lambda r: r.offset), 0
        for r in own:
            assert r.offset == at
            at += r.length * r.copies


def test_the_query_hashes_every_record_of_the_replica(spark, tmp_path, monkeypatch):
    """A false digest in the manifest is found for a page that is not among the damaged ones."""
    rows = [(i, f"http://a/{i}", f"<p>é{i}</p>") for i in range(250)] + [(None, None, None), (1, "http://a/1", "<p>é1</p>")]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    hurt = {i: "missing" if i % 193 == 7 else "changed" for i in range(250) if i % 193 == 7 or i % 97 == 11}
    assert {r.page_id: r.kind for r in W.op5_warc_audit(spark, str(tmp_path)).collect()} == hurt
    lay_out = W.lay_out
    monkeypatch.setattr(W, "lay_out", lambda records: lay_out(records).withColumn("digest", F.when(F.col("record_key") == 50, "false").otherwise(F.col("digest"))))
    assert {r.page_id for r in W.op5_warc_audit(spark, str(tmp_path)).collect()} == {50, *hurt}


def test_lost_copies_of_a_record_are_found(spark):
    """The last record of a file in three copies, of which a replica holds one: offsets say nothing of it."""
    names = "file string, offset long, length long, record_key long, copies long, digest string"
    good = spark.createDataFrame([("f", 0, 10, 1, 1, "a"), ("f", 10, 10, 2, 3, "b"), ("g", 0, 5, None, 1, "c")], names)
    bad = spark.createDataFrame([("f", 0, 10, 1, 1, "a"), ("f", 10, 10, 2, 1, "b"), ("g", 0, 5, None, 1, "c")], names)
    found, _ = W.audit(good, bad)
    assert [(r.file, r.offset, r.kind) for r in found.collect()] == [("f", 10, "changed")]
    assert W.audit(good, good)[0].collect() == []
    plain = W.audit(good.drop("copies"), bad.drop("copies"))[0]
    assert plain.collect() == [] and "copies" not in plain.columns


def test_null_keys_and_repeated_pages_through_the_query(spark, tmp_path):
    rows = [(None, None, None), (11, "http://a/", "<p>x"), (11, "http://a/", "<p>x"), (7, "http://b/", None), (3, "http://c/", "fine")]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    got = {(r.page_id, r.kind, r.copies) for r in W.op5_warc_audit(spark, str(tmp_path)).collect()}
    assert got == {(11, "changed", 2), (7, "missing", 1)}
