import random

from pyspark.sql import functions as F

from tallyspark.llm import toxicity as X

CLEAN = "river stone cloud forest window paper garden music silver morning table bridge".split()


def rows(n=300):
    rng, out = random.Random(6), []
    for i in range(n):
        said = [" ".join(rng.choice(CLEAN) for _ in range(rng.randrange(4, 10))) for _ in range(rng.randrange(1, 7))]
        bad = i % 3 == 0
        if bad:
            k = rng.randrange(len(said))
            said[k] = said[k] + " you " + rng.choice(["vilebrute", "vilefool", "grimhater"])
        out.append((i, ". ".join(said) + ".", int(bad)))
    return out


def test_learns_finds_sentences_and_ignores_held_out_labels(spark):
    data = rows()
    docs = spark.createDataFrame([(i, t) for i, t, _ in data], "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, y) for i, _, y in data if i < 200] + [(None, 1), (5, None)], "doc_id long, label int")
    model = X.train(docs, labels)
    got = {r.doc_id: r for r in X.score(docs, model, keep=["doc_id"]).collect()}
    held = [(i, t, y) for i, t, y in data if i >= 200]
    assert sum(got[i].predicted == y for i, _, y in held) >= 0.95 * len(held)
    for i, t, y in held:
        assert 0 <= got[i].score <= 1 and got[i].predicted == int(got[i].score >= 0.5)
        if y and got[i].predicted and got[i].offending:
            worst = max(got[i].offending, key=lambda s: s.score)
            assert any(w in t.encode()[worst.start : worst.end].decode() for w in ("vile", "grim"))
    again = {r.doc_id: r.score for r in X.score(docs.repartition(7), X.train(docs.repartition(5), labels), keep=["doc_id"]).collect()}
    assert all(abs(again[i] - got[i].score) < 1e-6 for i in again)


def test_odd_texts_and_no_labels(docs, none, spark):
    empty = spark.createDataFrame([], "doc_id long, label int")
    model = X.train(docs.select("doc_id", "text"), empty)
    got = X.score(docs, model, keep=["doc_id", "text", "size"]).collect()
    assert len(got) == docs.count() and all(0 < r.score < 0.5 and r.predicted == 0 for r in got)
    assert X.score(none, model, keep=["doc_id"]).collect() == []


def test_noisy_or():
    import numpy as np

    model = X.Model(-1.0, np.zeros(X.FEATURES, np.float32))
    p = 1 / (1 + np.exp(1.0))
    got = model.documents(np.array([-1.0, -1.0, -1.0]), np.array([0, 0, 2]), 3)
    assert np.allclose(got, [1 - (1 - p) ** 2, p, p])


def test_folds(spark):
    import zlib

    from tallyspark.llm.langid import fold

    got = spark.range(50).select(fold(F.col("id"), 5)).collect()
    assert [r[0] for r in got] == [zlib.crc32(str(i).encode()) % 5 for i in range(50)]


def test_scores_against_the_definition(spark):
    """Sentences, features and the noisy-or computed one by one."""
    import math
    import re

    import numpy as np

    from tallyspark.llm.wordhash import hash_of, mix

    rng = np.random.default_rng(2)
    model = X.Model(-3.0, rng.normal(0, 0.7, X.FEATURES).astype(np.float32))

    def place(word, kind):
        return (kind << X.FEATURE_BITS) | hash_of(word) >> (64 - X.FEATURE_BITS)

    def slow(text):
        clean, n = 1.0, 0
        for sentence in re.split(r"[.!?\n]", text or ""):
            found = set()
            for w in re.findall(r"[^\x00-\x40\x5b-\x60\x7b-\x7f]+", sentence):
                w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w)
                found.add(place(w, 0))
                found |= {place(w.encode()[:size].decode("utf-8", "surrogateescape"), k) for k, size in enumerate(X.STEM_BYTES, 1) if len(w.encode()) > size and w.isascii()}
            if found:
                n += 1
                clean *= 1 - 1 / (1 + math.exp(3.0 - sum(float(model.weights[f]) for f in found)))
        return 1 - clean if n else 1 / (1 + math.exp(3.0))

    texts = ["One sentence here. Another, longer sentence!", "WORDS words Words", "no end", "", None, "a\nb\nc? d", "...", "it's 3 o'clock", "extraordinary extraordinarily extra"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.score for r in X.score(df, model, keep=["doc_id"]).collect()}
    for i, t in enumerate(texts):
        assert abs(got[i] - slow(t)) < 1e-5, t


def test_long_texts_teach_and_names_clash_with_nothing(spark):
    rows = [(i, ("calm words only. " * 4000 if i < 4 else "calm words. ") + ("you vilebeast." if i % 2 else ""), i % 2, 7) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, label int, `a.b` int")
    model = X.train(df.select("doc_id", "text"), df.select("doc_id", "label"))
    got = X.score(df, model, keep=["doc_id", "a.b", "text"]).collect()
    assert all(r.predicted == r.doc_id % 2 and r["a.b"] == 7 for r in got)
