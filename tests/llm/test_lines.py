from collections import Counter, defaultdict

from pyspark.sql import functions as F

from tallyspark.llm import lines as L


def brute(rows, ratio, least):
    pages, held = Counter(), defaultdict(Counter)
    for r in rows:
        pages[r.source] += 1
        held[r.source].update({x.strip(" \t\r") for x in (r.text or "").split("\n")} - {""})
    drop = lambda s, x: x != "" and held[s][x] >= least and held[s][x] > ratio * pages[s]
    return Counter((r.doc_id, None if r.text is None else "\n".join(x for x in r.text.split("\n") if not drop(r.source, x.strip(" \t\r")))) for r in rows)


def test_against_brute_force(docs):
    for ratio, least in ((0.1, 3), (0.5, 2), (0.0, 2)):
        got = L.dedup_lines(docs, site=F.col("source"), text=F.col("text"), ratio=ratio, min_pages=least)
        assert Counter((r.doc_id, r.kept_text) for r in got.collect()) == brute(docs.collect(), ratio, least)
    dropped = got.filter("n_dropped > 0").first()
    assert dropped.n_lines >= dropped.n_dropped


def test_empty_and_host(none, spark):
    assert L.dedup_lines(none, site=F.col("source"), text=F.col("text")).collect() == []
    urls = ["http://A.example.com/x?y", "https://b.org", "nothing", None]
    got = spark.createDataFrame([(u,) for u in urls], "u string").select(L.host(F.col("u"))).collect()
    assert [r[0] for r in got] == ["a.example.com", "b.org", "", None]
    html = spark.createDataFrame([("<p>one<br>two <b>bold</b></p><li>three",)], "h string").select(L.page_text(F.col("h"))).first()[0]
    assert [x for x in html.split("\n") if x] == ["one", "two bold", "three"]
