"""Media columns: a PNG codec on binary columns and low-frequency cosine-transform hashes of images."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

from .common import col, numbered, read

#: Fixed values of the PNG format: signature, and samples a pixel by colour type.
SIGNATURE = b"\x89PNG\r\n\x1a\n"
SAMPLES = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
WIDTH = 64
#: PNG allows heights below 2**31; longer payloads go to wider rows.
MOST_ROWS = 2**31 - 1
#: A binary cell, and so an image that is read back, holds fewer bytes than this.
MOST_BYTES = 2**31 - 1
LEVEL = 6
#: Images are reduced to SIDE x SIDE before the transform, of which LOW x LOW coefficients make the hash.
SIDE, LOW = 32, 8
#: Rows with about so many bytes leave a task at a time.
BATCH_BYTES = 8_000_000


class PngError(ValueError):
    """Bytes that are no intact PNG of 8-bit samples."""


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def encode_png(samples: np.ndarray, level: int = LEVEL) -> bytes:
    """A grey 8-bit PNG of (rows, columns) samples. Each row takes the one of filters none, sub and up with the smallest
    sum of absolute differences; all three are undone in numpy without a loop over pixels."""
    rows, columns = samples.shape
    left, above = np.zeros_like(samples), np.zeros_like(samples)
    left[:, 1:], above[1:] = samples[:, :-1], samples[:-1]
    tried = np.stack([samples, samples - left, samples - above])  # unsigned bytes wrap, as the format asks
    cost = np.minimum(tried, 0 - tried).sum(2, dtype=np.int64)
    kind = cost.argmin(0)
    lines = np.empty((rows, columns + 1), np.uint8)
    lines[:, 0], lines[:, 1:] = kind, tried[kind, np.arange(rows)]
    head = struct.pack(">IIBBBBB", columns, rows, 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), level)) + _chunk(b"IEND", b"")


def _unfilter(lines: np.ndarray, kinds: np.ndarray, step: int) -> np.ndarray:
    """Undoes the five row filters. Runs of rows of none, sub or up go through numpy at once; average and Paeth rows, which
    depend on their own left neighbour after filtering, go pixel by pixel."""
    if kinds.max(initial=0) > 4:
        raise PngError("unknown row filter")
    out = np.empty_like(lines)
    rows, width = lines.shape
    at = 0
    while at < rows:
        kind, end = kinds[at], at + 1
        while end < rows and kinds[end] == kind and kind < 3:
            end += 1
        above = out[at - 1] if at else np.zeros(width, np.uint8)
        if kind == 0:
            out[at:end] = lines[at:end]
        elif kind == 1:
            block = lines[at:end].reshape(end - at, -1, step)
            out[at:end] = np.cumsum(block, 1, dtype=np.uint8).reshape(end - at, width)
        elif kind == 2:
            out[at:end] = np.cumsum(lines[at:end], 0, dtype=np.uint8) + above
        else:
            up, row = above.astype(int).tolist(), lines[at].tolist()
            for x in range(width):
                a, b, c = (row[x - step], up[x], up[x - step]) if x >= step else (0, up[x], 0)
                if kind == 3:
                    guess = (a + b) >> 1
                else:
                    near = [(abs(b - c), 0, a), (abs(a - c), 1, b), (abs(a + b - 2 * c), 2, c)]
                    guess = min(near)[2]
                row[x] = (row[x] + guess) & 255
            out[at] = row
        at = end
    return out


def decode_png(data: bytes) -> np.ndarray:
    """The samples of a non-interlaced 8-bit PNG as (rows, columns, samples a pixel). Every chunk's checksum is tested."""
    if data[:8] != SIGNATURE:
        raise PngError("no PNG signature")
    at, head, body = 8, None, []
    while True:
        if at + 12 > len(data):
            raise PngError("it ends within a chunk")
        size, kind = struct.unpack_from(">I4s", data, at)
        content = data[at + 8 : at + 8 + size]
        if at + 12 + size > len(data) or zlib.crc32(kind + content) != struct.unpack_from(">I", data, at + 8 + size)[0]:
            raise PngError(f"checksum of chunk {kind!r} at {at} is wrong")
        at += 12 + size
        if kind == b"IHDR":
            if len(content) != 13:
                raise PngError("a header of the wrong length")
            head = struct.unpack(">IIBBBBB", content)
        elif kind == b"IDAT":
            body.append(content)
        elif kind == b"IEND":
            break
    if head is None or head[2] != 8 or head[3] not in SAMPLES or head[6]:
        raise PngError("only non-interlaced images of 8-bit samples can be read")
    columns, rows, step = head[0], head[1], SAMPLES[head[3]]
    if not (columns and rows):
        raise PngError("an image without pixels")
    size, stream = rows * (columns * step + 1), zlib.decompressobj()
    try:
        raw = stream.decompress(b"".join(body), min(size + 1, MOST_BYTES))  # no more than the header asks for, whatever is packed
    except zlib.error as e:
        raise PngError(f"its samples cannot be unpacked: {e}") from None
    if len(raw) != size or not stream.eof:
        raise PngError("its size is not what the header says")
    lines = np.frombuffer(raw, np.uint8).reshape(rows, -1)
    return _unfilter(lines[:, 1:], lines[:, 0], step).reshape(rows, columns, step)


def _cosines() -> np.ndarray:
    k, n = np.arange(LOW)[:, None], np.arange(SIDE)[None, :]
    return np.cos(np.pi * k * (2 * n + 1) / (2 * SIDE))


_COSINES = _cosines()


def _reduce(x: np.ndarray, axis: int) -> np.ndarray:
    """Means of SIDE even parts along an axis; parts of a short axis repeat its values."""
    n = x.shape[axis]
    edges = np.arange(SIDE + 1) * n // SIDE
    lo, hi = edges[:-1], np.maximum(edges[1:], edges[:-1] + 1)
    sums = np.concatenate([np.zeros_like(np.take(x, [0], axis)), np.cumsum(x, axis)], axis)
    shape = [-1 if i == axis else 1 for i in range(x.ndim)]
    return (np.take(sums, hi, axis) - np.take(sums, lo, axis)) / (hi - lo).reshape(shape)


def cosine_hash(samples: np.ndarray) -> bytes:
    """8 bytes: for each of the LOW x LOW lowest cosine coefficients of the reduced grey image, whether it is above their
    median. The constant term counts as 0, so that brightness does not matter."""
    grey = samples.reshape(samples.shape[0], samples.shape[1], -1).mean(2, dtype=np.float64)
    low = np.round(_COSINES @ _reduce(_reduce(grey, 0), 1) @ _COSINES.T, 6)
    low[0, 0] = 0.0
    return np.packbits((low > np.median(low)).ravel()).tobytes()


def payload_of(text: str | None) -> bytes:
    """UTF-8 bytes, filled with zero bytes to a positive multiple of WIDTH; null counts as empty."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + bytes(-len(raw) % WIDTH or (0 if raw else WIDTH))


def store_text(text: str | None) -> bytes:
    payload = payload_of(text)
    rows = len(payload) // WIDTH
    wide = -(-rows // MOST_ROWS)
    return encode_png(np.frombuffer(payload, np.uint8).reshape(-1, WIDTH * wide) if rows % wide == 0 else np.frombuffer(payload, np.uint8).reshape(1, -1))


def _parts(batches: Iterator[pa.RecordBatch], size_of: int) -> Iterator[pa.RecordBatch]:
    """Slices of batches, so that results of long rows leave in small numbers."""
    for batch in batches:
        lo = size = 0
        column = batch.column(size_of)
        for i in range(len(column)):
            size += len(column[i].as_buffer() or b"") if column[i].is_valid else 0
            if size >= BATCH_BYTES or i + 1 == len(column):
                yield batch.slice(lo, i + 1 - lo)
                lo, size = i + 1, 0


def add_media(df: DataFrame, *, text: str = "text", keep: list[str]) -> DataFrame:
    """Columns `keep` with n_bytes (of the text's UTF-8) and media: the text's payload as a PNG in a binary column. Null texts
    count as empty; equal texts give equal bytes; an empty table gives an empty result. Columns of `keep` named as an output
    are replaced. A text must fit in a binary cell."""
    keep = [c for c in keep if c.lower() not in ("n_bytes", "media")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _parts(batches, len(keep)):
            texts = part.column(len(keep)).to_pylist()
            yield pa.RecordBatch.from_arrays([*[part.column(i) for i in range(len(keep))], pa.array([len((t or "").encode("utf-8", "surrogatepass")) for t in texts], pa.int64()), pa.array([store_text(t) for t in texts], pa.binary())], names=[*keep, "n_bytes", "media"])

    kept = [next(f for f in df.schema.fields if f.name == c) for c in keep]
    schema = StructType([*kept, StructField("n_bytes", LongType()), StructField("media", BinaryType())])
    return df.select(*numbered(keep), col(text).alias("text")).mapInArrow(run, schema)


def media_features(df: DataFrame, *, media: str = "media", keep: list[str]) -> DataFrame:
    """Columns `keep` with what is read back from a binary column of PNGs: payload_bytes, payload_sha256, tail_crc32 (of the
    last 64 bytes), media_bytes, media_sha256, feature_bits (the cosine hash, binary) and feature (the same as hex).
    Null or damaged media give nulls (media_bytes and media_sha256 of damaged ones stay), as a checksum that fails must
    not lose the rest of a table."""
    names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature_bits", "feature"]
    keep = [c for c in keep if c.lower() not in names]

    def one(data: bytes | None) -> tuple:
        if data is None:
            return (None,) * 7
        stored = (len(data), hashlib.sha256(data).hexdigest())
        try:
            samples = decode_png(data)
        except PngError:
            return (None, None, None, *stored, None, None)
        payload = samples.tobytes()
        bits = cosine_hash(samples)
        return (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), *stored, bits, bits.hex())

    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _parts(batches, len(keep)):
            found = [one(x) for x in part.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*[part.column(i) for i in range(len(keep))], *[pa.array([f[i] for f in found], k) for i, k in enumerate(kinds)]], names=[*keep, *names])

    kept = [next(f for f in df.schema.fields if f.name == c) for c in keep]
    types = [LongType(), StringType(), LongType(), LongType(), StringType(), BinaryType(), StringType()]
    schema = StructType([*kept, *[StructField(n, t) for n, t in zip(names, types, strict=True)]])
    return df.select(*numbered(keep), col(media).alias("media")).mapInArrow(run, schema)


def op3_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of documents stored as a PNG, read back, and hashed. Null texts count as empty."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    found = media_features(add_media(docs, keep=["doc_id"]), keep=["doc_id", "n_bytes"])
    return found.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
