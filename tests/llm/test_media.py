import hashlib
import math
import struct
import zlib

import numpy as np
import pytest

from tallyspark.llm import media as M


def filtered(samples, kinds, step):
    """Rows filtered as the format says, pixel by pixel."""
    out = b""
    for y, kind in enumerate(kinds):
        line = [kind]
        for x in range(samples.shape[1]):
            a = int(samples[y, x - step]) if x >= step else 0
            b = int(samples[y - 1, x]) if y else 0
            c = int(samples[y - 1, x - step]) if y and x >= step else 0
            near = min((a, b, c), key=lambda v: abs(a + b - c - v))
            line.append((int(samples[y, x]) - (0, a, b, (a + b) // 2, near)[kind]) % 256)
        out += bytes(line)
    return out


def png(body, width, height, colour):
    return M.SIGNATURE + M._chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, colour, 0, 0, 0)) + M._chunk(b"tEXt", b"k\0v") + M._chunk(b"IDAT", body[:7]) + M._chunk(b"IDAT", body[7:]) + M._chunk(b"IEND", b"")


@pytest.mark.parametrize(("colour", "step"), [(0, 1), (2, 3), (4, 2), (6, 4)])
def test_every_filter_is_undone(colour, step):
    rng = np.random.default_rng(step)
    samples = rng.integers(0, 256, (25, 12 * step), dtype=np.uint8)
    data = png(zlib.compress(filtered(samples, [i * 7 % 5 for i in range(25)], step)), 12, 25, colour)
    assert (M.decode_png(data).reshape(25, -1) == samples).all()


def test_round_trip_and_checksums():
    rng = np.random.default_rng(0)
    for shape in ((1, 64), (3, 64), (200, 64), (5, 1)):
        samples = rng.integers(0, 256, shape, dtype=np.uint8)
        assert (M.decode_png(M.encode_png(samples))[:, :, 0] == samples).all()
    data = bytearray(M.encode_png(samples))
    for at in (3, 20, len(data) // 2, len(data) - 2):
        broken = bytes(data[:at]) + bytes([data[at] ^ 1]) + bytes(data[at + 1 :])
        with pytest.raises((M.PngError, zlib.error)):
            M.decode_png(broken)
    with pytest.raises(M.PngError):
        M.decode_png(bytes(data[:40]))


def test_hash_is_of_low_frequencies():
    rng = np.random.default_rng(3)
    waves = lambda n: np.cos(np.pi * np.arange(8)[:, None] * (2 * np.arange(n) + 1) / (2 * n))
    image = waves(128).T @ rng.normal(size=(8, 8)) @ waves(64)
    image = (30 + 180 * (image - image.min()) / np.ptp(image)).astype(np.uint8)
    bits = lambda s: np.unpackbits(np.frombuffer(M.cosine_hash(s), np.uint8))
    noisy = (image + np.random.default_rng(1).integers(0, 3, image.shape)).astype(np.uint8)
    other = np.random.default_rng(2).integers(0, 256, image.shape, dtype=np.uint8)
    assert (bits(image) != bits(noisy)).sum() <= 6 < 16 < (bits(image) != bits(other)).sum()
    assert M.cosine_hash(image) == M.cosine_hash(image + 9)


def test_documents(docs, none):
    got = M.media_features(M.add_media(docs, keep=["doc_id", "size"]), keep=["doc_id", "n_bytes", "size"]).collect()
    want = []
    for r in docs.collect():
        raw = (r.text or "").encode()
        payload = raw + bytes(-len(raw) % 64) if raw else bytes(64)
        want.append((r.doc_id, len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:])))
    key = lambda t: (t[0] is None, str(t))
    assert sorted(((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in got), key=key) == sorted(want, key=key)
    assert all(len(r.feature) == 16 and bytes(r.feature_bits).hex() == r.feature for r in got)
    assert len({(r.media_sha256, r.feature) for r in got}) == len({r.payload_sha256 for r in got})
    assert M.add_media(none, keep=["doc_id"]).collect() == []


def test_damaged_media_are_null(spark):
    good = M.store_text("hello")
    rows = spark.createDataFrame([(1, good), (2, good[:-9]), (3, None)], "k long, media binary")
    got = {r.k: r for r in M.media_features(rows, keep=["k"]).collect()}
    assert got[1].payload_bytes == 64 and got[2].payload_sha256 is None and got[2].media_bytes == len(good) - 9 and got[3].media_bytes is None


def image(head, lines):
    """A PNG of these header fields and filtered lines, with right checksums."""
    return M.SIGNATURE + M._chunk(b"IHDR", head) + M._chunk(b"IDAT", zlib.compress(lines)) + M._chunk(b"IEND", b"")


def test_malformed_images_with_right_checksums_give_nulls(spark):
    head = lambda w, h, *more: struct.pack(">IIBBBBB", w, h, *(more or (8, 0, 0, 0, 0)))
    bad = [
        M.SIGNATURE + M._chunk(b"IHDR", b"12345") + M._chunk(b"IEND", b""),
        image(head(4, 0), b""), image(head(0, 4), b"\0" * 4), image(head(4, 2), b"\0" * 9), image(head(4, 2), b"\0" * 11), image(head(4, 2), b"\7" + b"\0" * 9),
        image(head(4, 2), b"\0" * 10_000_000), image(head(2**31 - 1, 2**31 - 1), b"\0" * 10), image(head(4, 2, 16, 0, 0, 0, 0), b"\0" * 18), image(head(4, 2, 8, 5, 0, 0, 0), b"\0" * 10),
        M.SIGNATURE + M._chunk(b"IHDR", head(4, 2)) + M._chunk(b"IDAT", b"no zlib") + M._chunk(b"IEND", b""), M.SIGNATURE, b"", image(head(4, 2), b"\0" * 10)[:-3],
    ]
    for data in bad:
        with pytest.raises(M.PngError):
            M.decode_png(data)
    df = spark.createDataFrame([(i, bytearray(b)) for i, b in enumerate(bad)] + [(99, None), (100, bytearray(image(head(4, 2), bytes(10))))], "a long, `a.b` binary")
    got = {r.a: r for r in M.media_features(df, media="a.b", keep=["a"]).collect()}
    assert all(got[i].payload_bytes is None and got[i].media_bytes == len(b) for i, b in enumerate(bad))
    assert got[99].media_bytes is None and got[100].payload_bytes == 8


def naive_hash(samples):
    """The cosine hash by its definition, coefficient by coefficient."""
    rows, columns = len(samples), len(samples[0])
    side, low = 32, 8

    def part(n, i):
        lo = i * n // side
        return range(lo, max((i + 1) * n // side, lo + 1))

    small = [[sum(samples[y][x] for y in part(rows, i) for x in part(columns, j)) / (len(part(rows, i)) * len(part(columns, j))) for j in range(side)] for i in range(side)]
    cos = [[math.cos(math.pi * k * (2 * n + 1) / (2 * side)) for n in range(side)] for k in range(low)]
    flat = [round(sum(cos[u][i] * cos[v][j] * small[i][j] for i in range(side) for j in range(side)), 6) if u or v else 0.0 for u in range(low) for v in range(low)]
    middle = sum(sorted(flat)[31:33]) / 2
    return f"{int(''.join(str(int(x > middle)) for x in flat), 2):016x}"


def test_features_against_the_definition(spark):
    texts = ["a", "some words of text " * 30, "é漢" * 100, "x" * 64, "ab" * 4000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.feature for r in M.media_features(M.add_media(df, keep=["doc_id"]), keep=["doc_id"]).collect()}
    for i, t in enumerate(texts):
        raw = t.encode() + bytes(-len(t.encode()) % 64)
        assert got[i] == naive_hash([list(raw[k : k + 64]) for k in range(0, len(raw), 64)])
