"""Vectorised word hashing over Arrow string columns, for operators that run in numpy."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
#: Bytes of text that are worked on at a time; one longer text is worked on alone.
CHUNK_BYTES = 2_000_000
_RATIO = 0x9E3779B97F4A7C13  # odd, and 3 modulo 4
_INVERSE = pow(_RATIO, -1, 2**64)
_TABLE = np.random.default_rng(20240601).integers(0, 2**63, 256, dtype=U64) * U64(2) + U64(1)

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: For words of letters only: every ASCII byte that is no letter parts words; bytes of longer UTF-8 sequences don't.
NOT_LETTER = np.array([b < 0x80 and not chr(b).isalpha() for b in range(256)])
LOWER = np.array([b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)], np.uint8)


def mix(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every input bit over the output (the splitmix64 constants)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
        return x ^ (x >> U64(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, U64)
    filled, step = 1, base
    with np.errstate(over="ignore"):
        while filled < n:
            m = min(filled, n - filled)
            out[filled : filled + m] = out[:m] * U64(step)
            filled, step = filled + m, step * step % 2**64
    return out


_cache: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if n > 2 * CHUNK_BYTES:  # for one very long text: not kept
        return _powers(_RATIO, n), _powers(_INVERSE, n)
    if len(_cache.get("up", ())) < n:
        _cache["up"], _cache["down"] = _powers(_RATIO, n), _powers(_INVERSE, n)
    return _cache["up"][:n], _cache["down"][:n]


def forget() -> None:
    """For the end of a task: gives back what an idle worker would go on holding, as workers outlive stages."""
    _cache.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # glibc only
        ctypes.CDLL(None).malloc_trim(0)


def runs(batch: pa.RecordBatch, column: int, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """A batch in slices of about `limit` bytes of a text column: one longer text is a slice of its own."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends, lo = np.cumsum(sizes), 0
    while lo < len(sizes):
        before = ends[lo] - sizes[lo]
        hi = max(lo + 1, int(np.searchsorted(ends, before + limit, "right")))
        yield batch.slice(lo, hi - lo)
        lo = hi


def text_chunks(column: pa.Array | pa.ChunkedArray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, UTF-8 bytes, offsets into them) for runs of rows of about `limit` bytes; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
        yield first, last, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def find_words(data: np.ndarray, offsets: np.ndarray, parts: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of words, none of which crosses a row's end."""
    inside = ~parts[data]
    before = np.empty(len(data) + 1, bool)
    before[0] = before[-1] = False
    before[1:-1] = inside[:-1]
    edges = offsets[(offsets < len(data))]
    opens = inside.copy()
    opens &= ~before[:-1]
    opens[edges] = inside[edges]
    starts = np.flatnonzero(opens)
    after = np.empty(len(data), bool)
    if len(data):
        after[:-1], after[-1] = inside[1:], False
    closes = inside & ~after
    lasts = offsets[1:][offsets[1:] > 0] - 1
    closes[lasts] = inside[lasts]
    return starts, np.flatnonzero(closes) + 1


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes, A-Z in lower case."""
    up, down = powers(len(data) + 1)
    with np.errstate(over="ignore"):
        sums = np.zeros(len(data) + 1, U64)
        np.cumsum(_TABLE[LOWER[data]] * up[:-1], out=sums[1:])
        return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(U64))


def hash_of(word: str) -> int:
    """The hash that word_hashes() gives this word."""
    data = np.frombuffer(word.encode(), np.uint8)
    return int(word_hashes(data, np.array([0]), np.array([len(data)]))[0])
