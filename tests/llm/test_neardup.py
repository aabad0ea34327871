import re
from fractions import Fraction

import numpy as np
import pytest

from tallyspark.llm import neardup as N
from tallyspark.llm.wordhash import hash_of


def shingles(text, width):
    """By the contract's own words: A-Z in lower case, words [^\\x20\\x09-\\x0D]+, distinct runs of `width` words, or all words if fewer."""
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def brute(rows, width, threshold):
    sets = [shingles(t, width) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and Fraction(both, len(sets[i] | sets[j])) >= threshold:
                root[find(i)] = find(j)
    small = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            small[find(i)] = min(small.get(find(i), k), k)
    return [(k, len(sets[i]), small.get(find(i)) if sets[i] else k) for i, (k, _) in enumerate(rows)]


@pytest.mark.parametrize("width", [2, 5])
def test_components_against_brute_force(docs, none, width):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = brute(rows, width, Fraction(4, 5))
    got = N.near_duplicates(docs, width=width).collect()
    key = lambda t: str(t)
    assert sorted([(r.doc_id, r.n_shingles, r.component_id) for r in got], key=key) == sorted(want, key=key)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got if r.doc_id is not None)
    assert N.near_duplicates(none).collect() == []


def test_large_groups_are_compared_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(N, "SMALL_BUCKET", 4)
    monkeypatch.setattr(N, "BLOCK", 7)
    rng = np.random.default_rng(4)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(60):
        words = list(base)
        for at in rng.choice(60, rng.integers(1, 9), replace=False):
            words[at] = f"x{rng.integers(1000)}"
        rows.append((i, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in N.near_duplicates(df, width=2).collect()}
    assert got == {k: c for k, _, c in brute(rows, 2, Fraction(4, 5))}


def test_one_document_of_each_group_stays(docs):
    kept = N.keep_one(docs)
    assert kept.columns == docs.columns
    want = {(k, t) for (k, t), (_, n, c) in zip([(r.doc_id, r.text) for r in docs.collect()], brute([(r.doc_id, r.text) for r in docs.collect()], 5, Fraction(4, 5)), strict=True) if n == 0 or k == c}
    rows = [(r.doc_id, r.text) for r in kept.collect()]
    assert set(rows) == want and len(rows) == len(set(rows))


def test_odd_sketches_estimate_similarity():
    rng = np.random.default_rng(9)
    mins = rng.integers(0, 2**63, (1, N.SAMPLES)).astype(np.uint64)
    near = mins.copy()
    near[0, :30] = 7  # four fifths of the samples agree
    a, b = N.sketch_rows(mins), N.sketch_rows(near)
    x = int(np.bitwise_count((a ^ b).view(np.uint64)).sum())
    n, k = N.SKETCH_BITS, N.SAMPLES
    assert abs(1 + n / (4 * k) * np.log(1 - 2 * x / n) - 0.8) < 0.08 and x <= N.MOST_DIFFERING


def test_words_hash_alike_in_any_place():
    from tallyspark.llm.wordhash import find_words, word_hashes

    data = np.frombuffer(b" One two\tONE  three\x0bone", np.uint8)
    starts, ends = find_words(data, np.array([0, 5, len(data)]))
    hashes = word_hashes(data, starts, ends).tolist()
    assert hashes[0] == hashes[2] == hashes[4] == hash_of("one") != hashes[1]


def test_components(spark):
    from tallyspark.llm.graph import components

    chain = [(i, i + 1) for i in range(1, 40)] + [(100, 101), (200, 100), (300, 300)]
    got = {r.node: r.component for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert {got[i] for i in range(1, 41)} == {1} and got[200] == got[101] == 100 and got[300] == 300
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_hot_keys_are_dealt_to_several_tasks(spark, monkeypatch):
    from tallyspark.llm import common
    from tallyspark.llm.graph import components

    monkeypatch.setattr(common, "HOT_ROWS", 5)
    monkeypatch.setattr(common, "SMALL_BYTES", 0)
    left = spark.createDataFrame([(1 if i < 60 else i, i) for i in range(80)] + [(None, 99)], "k long, x long")
    right = spark.createDataFrame([(i, i * 10) for i in range(70)], "k long, y long")
    for how, n in (("inner", 70), ("left", 81)):
        got = common.join_dealt(left, right, "k", how)
        assert got.columns == ["k", "x", "y"] and got.count() == n
        assert sorted(map(str, got.collect())) == sorted(map(str, left.join(right, "k", how).collect()))
    star = [(0, i) for i in range(1, 50)] + [(49, 100), (100, 101)]
    assert {r.component for r in components(spark.createDataFrame(star, "a long, b long")).collect()} == {0}


def test_sets_that_share_half_a_hash_are_told_apart(spark, monkeypatch):
    real = N.hashlib.blake2b

    class Half:
        def __init__(self, data, digest_size):
            self.out = real(data, digest_size=digest_size).digest()

        def digest(self):
            return bytes(8) + self.out[8:]

    monkeypatch.setattr(N.hashlib, "blake2b", Half)
    batch = __import__("pyarrow").RecordBatch.from_pydict({"doc_id": [1, 2], "text": ["a b c", "d e f"], "text_key": ["x", "y"]})
    signed = __import__("pyarrow").Table.from_batches(list(N._sign(iter([batch]), 2))).to_pylist()
    assert signed[0]["node"] == signed[1]["node"] and signed[0]["twin"] != signed[1]["twin"]
