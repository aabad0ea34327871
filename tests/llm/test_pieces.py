from collections import Counter

import numpy as np
import pytest

from tallyspark.llm import pieces as P

TEXTS = ["Hello world, the quick brown fox", "  a  ▁b\n\n 12 é 漢字😀", "", " ", "\0\x01\t", "x" * 3000, "no break here " * 200, "a\r\nb", "▁▁", "𝒳" * 5]


@pytest.fixture(scope="module")
def vocabulary():
    return P.Vocabulary.load(P.MODEL_PATH)


def test_decoding_is_lossless_and_draws_do_not_depend_on_neighbours(vocabulary):
    seeds = np.arange(len(TEXTS), dtype=np.uint64)
    flat, cut = P.encode(vocabulary, TEXTS, seeds)
    for i, t in enumerate(TEXTS):
        own, _ = P.encode(vocabulary, [t], seeds[i : i + 1])
        assert own.tolist() == flat[cut[i] : cut[i + 1]].tolist()
        assert vocabulary.decode(own) == t if t else not len(own)


def test_the_library_decodes_them_too(vocabulary):
    sentencepiece = pytest.importorskip("sentencepiece")
    model = sentencepiece.SentencePieceProcessor(model_file=P.MODEL_PATH)
    flat, _ = P.encode(vocabulary, [TEXTS[0]], np.array([5], np.uint64))
    assert model.decode(flat.tolist()) == TEXTS[0]


def test_draws_have_the_lattice_distribution():
    pieces = [(300, "▁a"), (301, "▁"), (302, "a"), (303, "b"), (304, "ab"), (305, "▁ab")]
    weights = np.array([5.0, 3.0, 2.0, 2.0, 4.0, 1.0])
    v = P.Vocabulary.of(pieces, weights, np.arange(256, dtype=np.int32), 400)
    want = {(305,): 1.0, (300, 303): 10.0, (301, 304): 12.0, (301, 302, 303): 12.0}
    n = 60_000
    flat, cut = P.encode(v, ["ab"] * n, np.arange(n, dtype=np.uint64))
    got = Counter(tuple(flat[cut[i] : cut[i + 1]].tolist()) for i in range(n))
    assert set(got) == set(want)
    for k, w in want.items():
        assert abs(got[k] / n - w / 35) < 0.01


def test_documents(docs, none):
    got = P.encode_documents(docs).collect()
    assert all(r.lossless for r in got) and len(got) == docs.count()
    texts = {}
    for r in docs.collect():
        texts.setdefault(r.doc_id, set()).add(r.text)
    for r in got:
        assert (r.ids is None) == (texts[r.doc_id] == {None}) and r.n_pieces == len(r.ids or [])
    again = {(r.doc_id, r.n_bytes): r.ids for r in P.encode_documents(docs.repartition(5)).collect()}
    assert all(again[(r.doc_id, r.n_bytes)] == r.ids for r in got if r.doc_id != 7)
    assert P.encode_documents(none).collect() == []


def test_draws_of_a_long_unit_have_the_lattice_distribution(monkeypatch):
    """Units in blocks, with pieces across the blocks' ends, against every segmentation."""
    pieces = [(300, "▁a"), (301, "▁"), (302, "a"), (303, "b"), (304, "ab"), (305, "ba"), (306, "bab")]
    weights = np.array([5.0, 3.0, 2.0, 2.0, 4.0, 3.0, 6.0])
    v = P.Vocabulary.of(pieces, weights, np.arange(256, dtype=np.int32), 400)
    names = {"▁a": 5.0, "▁": 3.0, "a": 2.0, "b": 2.0, "ab": 4.0, "ba": 3.0, "bab": 6.0}
    ids = {name: i for i, name in pieces}

    def every(left):
        if not left:
            yield (), 1.0
        for name, w in names.items():
            if left.startswith(name):
                for rest, x in every(left[len(name) :]):
                    yield (ids[name], *rest), w * x

    want = dict(every("▁ababab"))
    monkeypatch.setattr(P, "LONG_UNIT", 3)
    monkeypatch.setattr(P, "BLOCK_CHARS", 2)
    n = 20_000
    flat, cut = P.encode(v, ["ababab"] * n, np.arange(n, dtype=np.uint64))
    got = Counter(tuple(flat[cut[i] : cut[i + 1]].tolist()) for i in range(n))
    assert set(got) <= set(want)
    for k, w in want.items():
        assert abs(got[k] / n - w / sum(want.values())) < 0.012


def test_a_long_text_is_encoded_by_runs_and_blocks(vocabulary, monkeypatch):
    text = "  words and é 漢字 ▁ more, " * 400 + "x" * 9000 + " tail " * 300
    seeds = np.array([11], np.uint64)
    whole, _ = P.encode(vocabulary, [text], seeds)
    monkeypatch.setattr(P, "CHUNK_CHARS", 1000)
    parts, cut = P.encode(vocabulary, [text], seeds)
    assert parts.tolist() == whole.tolist() and cut.tolist() == [0, len(whole)]
    assert vocabulary.decode(parts) == text


def test_copies_get_draws_of_their_own(spark, vocabulary):
    df = spark.createDataFrame([(1, "the same document of several words " * 30, c) for c in (1, 2, 3)] + [(2, None, 1), (2, "", 2)], "doc_id long, text string, copy long")
    got = P.encode_documents(df, copy="copy").collect()
    assert len({tuple(r.ids) for r in got if r.doc_id == 1}) == 3 and all(r.lossless for r in got)
    assert sorted(str(r.ids) for r in got if r.doc_id == 2) == ["None", "[]"]


@pytest.mark.parametrize("lot", [0.0, 1 - 2.0**-53])
def test_extreme_lots_draw_possible_pieces(vocabulary, monkeypatch, lot):
    monkeypatch.setattr(P, "_uniform", lambda seed, step: np.full(np.broadcast(seed, step).shape, lot))
    for long_unit in (4096, 2):
        monkeypatch.setattr(P, "LONG_UNIT", long_unit)
        flat, cut = P.encode(vocabulary, TEXTS, np.zeros(len(TEXTS), np.uint64))
        assert [vocabulary.decode(flat[cut[i] : cut[i + 1]]) for i in range(len(TEXTS))] == TEXTS
