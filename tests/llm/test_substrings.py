import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from tallyspark.llm import substrings as S


def brute(rows, length):
    """By (key, hash of text) order of first places; rows equal in both are one document."""
    places, out = {}, {}
    for key, raw in rows:
        if (key, raw) in out:
            continue
        gone = np.zeros(len(raw), bool)
        for i in range(len(raw) - length + 1):
            if raw[i : i + length] in places:
                gone[i : i + length] = True
            else:
                places[raw[i : i + length]] = True
        left = np.frombuffer(raw, np.uint8)[~gone].tobytes()
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out[(key, raw)] = (len(raw), int(gone.sum()), spans, hashlib.sha256(left).hexdigest())
    return out


@pytest.mark.parametrize("length", [20, 100])
def test_documents_against_brute_force(docs, none, spark, length):
    from pyspark.sql import functions as F

    order = docs.withColumn("t", F.xxhash64("text")).orderBy(F.col("doc_id").asc_nulls_last(), "t").collect()
    want = brute([(r.doc_id, (r.text or "").encode()) for r in order], length)
    got = S.dedup_substrings(docs, length=length, keep=["doc_id", "text"]).collect()
    assert Counter((r.doc_id, r.text, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == Counter((r.doc_id, r.text, *want[(r.doc_id, (r.text or "").encode())]) for r in order)
    assert sum(r.n_removed for r in got) > 500
    assert S.dedup_substrings(none).collect() == []


@pytest.mark.parametrize("hot", [1, 2000])
def test_periods_ties_and_long_texts(spark, hot):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("ab") for _ in range(rng.randrange(1, 9)))
    base = " ".join(word() for _ in range(600))
    texts = ["a" * 500, "ab" * 300, base, base[200:900], base[:150] + "é" * 40 + base[100:400], "z" * 99, "z" * 100, "", base]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(4)
    want = brute([(i, t.encode()) for i, t in enumerate(texts)], 40)
    got = S.dedup_substrings(df, length=40, keep=["doc_id"], with_text=True, hot=hot).collect()
    for r in got:
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == want[(r.doc_id, texts[r.doc_id].encode())]
        assert hashlib.sha256(bytes(r.kept)).hexdigest() == r.kept_sha256


def test_every_window_has_a_trigger_of_its_own_bytes():
    rng = np.random.default_rng(1)
    data = rng.integers(97, 101, 3000, dtype=np.uint8)
    data[2000:2400] = data[500:900]
    row, lo, hi, trigger, phrase = S.phrases(data, np.array([0, 1000, 1050, 3000]), 60, 20)
    covered = Counter((r, w) for r, a, b in zip(row, lo, hi, strict=True) for w in range(a, b + 1))
    assert set(covered.values()) == {1} and len(covered) == sum(max(0, n - 59) for n in (1000, 50, 1950))
    assert len(set(phrase.tolist())) < len(phrase)


def test_long_rows_are_cut_without_losing_a_window(monkeypatch):
    monkeypatch.setattr(S, "PART_BYTES", 700)
    data = np.random.default_rng(2).integers(97, 123, 5000, dtype=np.uint8)
    seen = Counter()
    for part, cuts, _, base in S._cut(data, np.array([0, 5000]), 100):
        _, lo, hi, _, _ = S.phrases(part, cuts, 100, 32)
        seen.update(w + base for a, b in zip(lo, hi, strict=True) for w in range(a, b + 1))
    assert set(seen) == set(range(4901)) and set(seen.values()) == {1}


def test_suffix_array_orders_blocks_and_finds_equal_suffixes():
    rng = np.random.default_rng(5)
    data = rng.integers(0, 2, 400, dtype=np.uint8) * 255  # zeros too: bytes that string types like to strip
    at = rng.permutation(380)
    block = rng.integers(0, 3, 380)
    order, same = S.suffix_array(data, at, block, 13)
    keys = [(block[k], data[at[k] : at[k] + 13].tobytes()) for k in order]
    assert keys == sorted(keys) and same.tolist() == [False] + [a == b for a, b in zip(keys, keys[1:], strict=False)]
    assert all(order[i] > order[i - 1] for i in np.flatnonzero(same))


@pytest.mark.parametrize("hot", [3, 2000])
def test_one_trigger_in_very_many_phrases(spark, monkeypatch, hot):
    """A passage of 80 bytes, shorter than a string, with something else around it in each document; and blocks of a few phrases."""
    monkeypatch.setattr(S, "BLOCK_BYTES", 300)
    rng = random.Random(4)
    word = lambda n: "".join(rng.choice("abcdefghij") for _ in range(n))
    passage = word(80)
    texts = [word(60) + passage + word(60) for _ in range(120)]
    texts += [t[30:170] for t in texts[:20]] + [texts[3][40:] + texts[4][:100]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    want = brute([(i, t.encode()) for i, t in enumerate(texts)], 100)
    got = S.dedup_substrings(df, hot=hot).collect()
    assert len(got) == len(texts) and sum(r.n_removed for r in got) > 2000
    for r in got:
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == want[(r.doc_id, texts[r.doc_id].encode())]


def test_odd_column_names_and_empty_texts(spark):
    df = spark.createDataFrame([(1, "x" * 300, 5, 6), (2, None, 7, 8), (3, "", 9, 10)], ["doc_id", "text", "a.b", "marks"])
    got = S.dedup_substrings(df, keep=["a.b", "marks"]).orderBy("marks").collect()
    assert [tuple(r)[:4] for r in got] == [(5, 6, 300, 299), (7, 8, 0, 0), (9, 10, 0, 0)]
