import math
import random
import unicodedata
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tallyspark.llm import langid as L


def test_learns_and_predicts(docs, none):
    model = L.train(docs)
    assert model.languages == ["en", "fr"]
    got = L.predict(docs, model, keep=["doc_id", "lang", "text", "size"]).collect()
    sure = [r for r in got if r.lang and r.text and len(r.text) > 200 and r.doc_id is not None and r.doc_id < 60]
    assert sum(r.lang_pred == r.lang for r in sure) >= 0.95 * len(sure)
    for r in got:
        assert 0 <= r.score <= 1 and r.lang_pred in ("en", "fr", "und")
        assert (r.lang_pred == "und") == (not any(c.isalpha() for c in r.text or ""))
    assert L.predict(none, model).collect() == []
    again = L.predict(docs.repartition(9), L.train(docs.repartition(5)), keep=["doc_id", "text"]).collect()
    assert sorted(str((r.doc_id, r.text, r.lang_pred, round(r.score, 9))) for r in again) == sorted(str((r.doc_id, r.text, r.lang_pred, round(r.score, 9))) for r in got)


def model_of(counts, docs):
    lang, kind, token, n = zip(*counts, strict=True)
    return L.Model.of_table(pa.table({"lang": list(lang), "kind": pa.array(kind, pa.int32()), "key": np.array([L.token_hash(x) for x in token], np.uint64).view(np.int64), "n": pa.array(n, pa.int64())}), docs)


def test_words_first_then_shorter_grams():
    counts = [("a", 0, "known", 9), ("b", 0, "known", 1), ("a", 4, "\x02zor", 5), ("b", 2, "mi", 7), ("b", 1, "q", 3), ("a", 1, "z", 1)]
    model = model_of(counts, {"a": 1, "b": 1})
    assert model.predict(["known"])[0] == ["a"]
    assert model.predict(["zorro"])[0] == ["a"]
    assert model.predict(["mimi"])[0] == ["b"] and model.predict(["q"])[0] == ["b"]
    assert model.predict(["", "12 !", "KNOWN"])[0] == ["und", "und", "a"]


def brute_words(text):
    out, word = [], ""
    for c in text.lower() + "\n":
        if unicodedata.category(c)[0] in "LM":
            word += c
        elif word:
            out, word = [*out, word], ""
    return out


def brute_model(rows):
    """Counts by (kind, language) and over all languages, of words and n-grams."""
    count, pooled, docs = defaultdict(Counter), defaultdict(Counter), Counter()
    for text, lang in rows:
        docs[lang] += 1
        for w in brute_words(text):
            keys = [(0, w)] + [(k, f"\x02{w}\x03"[i : i + k]) for k in (4, 3, 2, 1) for i in range(len(w) + 3 - k)]
            for kind, key in keys:
                count[kind, lang][key] += 1
                pooled[kind][key] += 1
    return count, pooled, docs


def brute_predict(text, count, pooled, docs):
    words = brute_words(text)
    if not any(unicodedata.category(c)[0] == "L" for c in text.lower()):
        return "und", 0.0
    total = {lang: 0.0 for lang in docs}
    for w in words:
        if w in pooled[0]:
            hits = [(0, w, 1.0)]
        else:
            f, hits = f"\x02{w}\x03", []
            for i in range(len(f)):
                k = next((k for k in (4, 3, 2, 1) if i + k <= len(f) and f[i : i + k] in pooled[k]), None)
                hits += [(k, f[i : i + k], 1 / len(f))] if k else []
        for kind, key, weight in hits:
            q = pooled[kind][key] / sum(pooled[kind].values())
            for lang in total:
                own = count[kind, lang]
                total[lang] += weight * math.log((own[key] + q) / (sum(own.values()) + 1) / q)
    odds = {lang: x / math.sqrt(len(words)) + math.log(docs[lang] / sum(docs.values())) for lang, x in total.items()}
    best = max(sorted(odds), key=odds.get)
    return best, 1 / sum(math.exp(x - odds[best]) for x in odds.values())


def test_against_a_brute_force_scorer(docs):
    rows = docs.collect()
    got = L.predict(docs, L.train(docs), keep=["doc_id", "text"]).collect()
    model = brute_model([(r.text, r.lang) for r in rows if r.text is not None and r.lang is not None])
    for r in got:
        lang, score = brute_predict(r.text or "", *model)
        assert r.lang_pred == lang and abs(r.score - score) < 1e-4, r.text


def test_three_hundred_languages_are_all_learned(spark):
    rows = [(300 * c + i, f"word{chr(97 + i % 26)}{chr(97 + i // 26)} shared thing", f"l{i:03d}") for i in range(300) for c in range(3)]
    df = spark.createDataFrame([(i, "".join(c for c in t if not c.isdigit()), x) for i, t, x in rows], "doc_id long, text string, lang string")
    got = L.predict(df, L.train(df)).collect()
    assert all(r.lang_pred == r.lang for r in got)


def test_a_tiny_language_takes_no_foreign_texts(spark):
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefghijklm") for _ in range(7)) for _ in range(3000)]
    draw = lambda: " ".join(rng.choice(words) for _ in range(10))
    rows = [(i, draw(), "big") for i in range(600)] + [(1000 + i, "foo bar " * 5, "tiny") for i in range(5)]
    model = L.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert set(model.predict([draw() for _ in range(50)])[0]) == {"big"} and model.predict(["bar foo"])[0] == ["tiny"]


def test_long_texts_and_words_are_read_whole(spark):
    rows = [(1, "a" * 70_000 + " " + "uno " * 40_000, "xx"), (2, "b" * 70_000 + " due", "yy")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = L.train(df)
    assert model.predict(["uno", "due", "a" * 70_000, "x" * 0])[0] == ["xx", "yy", "xx", "und"]
    assert [r.lang_pred for r in L.predict(df, model).orderBy("doc_id").collect()] == ["xx", "yy"]


def test_nothing_to_learn_from(none, docs):
    assert L.train(none).languages == []
    assert {r.lang_pred for r in L.predict(docs, L.train(none)).collect()} == {"und"}


def test_held_out_rows_teach_nothing(spark):
    rows = [(i, "alpha beta" if L_crc(i) != 2 else "gamma delta", "xx" if L_crc(i) != 2 else "yy") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert L.learned(df).languages == ["xx"]
    assert df.filter(L.fold(F.col("doc_id"), 4) == 2).count() == sum(L_crc(i) == 2 for i in range(40))


def L_crc(i):
    import zlib

    return zlib.crc32(str(i).encode()) % 4
