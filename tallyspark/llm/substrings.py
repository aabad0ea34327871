"""Removing repeated passages: byte strings of a given length that also start earlier in the corpus."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

from .common import col, hot_keys, join_dealt, materialize, packed, read, release
from .wordhash import _TABLE, U64, forget, mix, powers, runs, text_chunks

LENGTH = 100
#: Bytes of the strings among which triggers are chosen, for strings of LENGTH bytes.
GRAM = 32
#: Window starts worked on at a time; a longer text is worked on in several parts. Positions must fit in PLACE_BITS.
PART_BYTES, PLACE_BITS = 4_000_000, 24
#: Texts up to so many bytes are gathered before their phrases are compared with each other.
GATHERED_BYTES = 16_000_000
_OTHER = mix(_TABLE + U64(5)) | U64(1)
OUTPUTS = ["n_bytes", "n_removed", "n_spans", "kept_sha256"]


def _sums(data: np.ndarray, table: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        out = np.zeros(len(data) + 1, U64)
        np.cumsum(table[data] * powers(len(data) + 1)[0][:-1], out=out[1:])
    return out


def _span_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix((sums[ends] - sums[starts]) * powers(len(sums))[1][starts] + (ends - starts).astype(U64))


def phrases(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """The parse of some rows: (row, first and last window start, trigger's hash, phrase's hash) of every phrase.

    Each window of `length` bytes has a trigger, the gram in it of the smallest rolling hash (the first of several): that
    depends on the window's bytes alone. A phrase is a run of windows of the same trigger, with all their bytes. Equal
    windows therefore lie in phrases of equal trigger, at the same distance from it.
    """
    span = length - gram + 1
    size = np.diff(offsets)
    n_windows = np.maximum(size - length + 1, 0)
    if len(data) < length or not n_windows.any():
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, U64, U64))
    n = len(data)
    sums = _sums(data, _TABLE)
    at = np.arange(n - gram + 1)
    with np.errstate(over="ignore"):
        grams = mix((sums[gram:] - sums[:-gram]) * powers(len(sums))[1][: n - gram + 1])
    lowest = (grams >> U64(PLACE_BITS) << U64(PLACE_BITS)) | at.astype(U64)
    reach, low = 1, lowest
    while reach * 2 <= span:
        low = np.minimum(low[:-reach], low[reach:])
        reach *= 2
    if reach < span:
        low = np.minimum(low[: len(low) - (span - reach)], low[span - reach :])
    trigger = (low & U64(2**PLACE_BITS - 1)).astype(np.int64)  # of the window that starts here
    row = np.repeat(np.arange(len(size)), n_windows)
    start = np.arange(len(row)) - np.repeat(np.cumsum(n_windows) - n_windows, n_windows) + np.repeat(offsets[:-1], n_windows)
    own = trigger[start]
    new = np.ones(len(row), bool)
    new[1:] = (own[1:] != own[:-1]) | (row[1:] != row[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(row)) - 1
    lo, hi, place = start[first], start[last], own[first]
    with np.errstate(over="ignore"):
        phrase = mix(_span_hash(sums, lo, hi + length) + (place - lo).astype(U64) * U64(0x9E3779B97F4A7C15))
    base = offsets[row[first]]
    return row[first], lo - base, hi - base, grams[place], phrase


def _cut(data: np.ndarray, offsets: np.ndarray, length: int) -> Iterator[tuple[np.ndarray, np.ndarray, int, int]]:
    """A chunk of rows as it is, or a long row in parts that overlap by length - 1 bytes: (bytes, offsets, first row, byte at which it begins)."""
    if len(data) <= PART_BYTES + length or len(offsets) > 2:
        yield data, offsets, 0, 0
    else:
        for at in range(0, len(data) - length + 1, PART_BYTES):
            part = data[at : at + PART_BYTES + length - 1]
            yield part, np.array([0, len(part)]), 0, at


_PARSED = "route long, other long, d long, t long, lo long, hi long, kind int"
_NAMES = ["route", "other", "d", "t", "lo", "hi", "kind"]
_PHRASE, _MARK, _ASK, _ASK_HOT = 0, 1, 2, 3
#: Phrases of one trigger, up to so many, are put into one suffix array; those of a trigger that stands in more different phrases
#: go window by window, in order of hashes that spread over all tasks. Both give the same marks.
HOT_TRIGGER = 2000
#: Bytes of phrases whose suffixes are sorted together.
BLOCK_BYTES = 1_000_000


def _rows(route, other, d, t, lo, hi, kind) -> pa.RecordBatch:
    as_long = lambda x: pa.array(x.view(np.int64) if x.dtype == U64 else x.astype(np.int64))
    return pa.RecordBatch.from_arrays([*[as_long(x) for x in (route, other, d, t, lo, hi)], pa.array(kind.astype(np.int32))], names=_NAMES)


def _marks(d: np.ndarray, t: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> pa.RecordBatch:
    """Ranges of window starts that have an earlier equal, neighbouring ones of a document as one."""
    order = np.lexsort((lo, t, d))
    d, t, lo, hi = d[order], t[order], lo[order], hi[order]
    new = np.ones(len(d), bool)
    new[1:] = (d[1:] != d[:-1]) | (t[1:] != t[:-1]) | (lo[1:] > hi[:-1] + 1)
    head = np.flatnonzero(new)
    spread = mix(d[head].view(U64))  # any even spread over tasks will do
    return _rows(spread, spread, d[head], t[head], lo[head], np.maximum.reduceat(hi, head) if len(head) else hi, np.full(len(head), _MARK))


def _local(parsed: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
    """Of the places gathered in a task, the first of each phrase (or window), and all others as marks: they have an earlier
    one, so a passage that a third of all documents hold leaves a task once."""
    if not parsed:
        return
    route, other, d, t, lo, hi = (np.concatenate(x) for x in zip(*parsed, strict=True))
    order = np.lexsort((lo, t, d, other, route))
    route, other, d, t, lo, hi = (x[order] for x in (route, other, d, t, lo, hi))
    same = np.zeros(len(route), bool)
    same[1:] = (route[1:] == route[:-1]) & (other[1:] == other[:-1])
    first = np.maximum.accumulate(np.where(same, 0, np.arange(len(route))))
    later = (d != d[first]) | (t != t[first]) | (lo != lo[first])  # by repeated rows, a place may come twice: it is first both times
    yield _rows(*[x[~later] for x in (route, other, d, t, lo, hi)], np.full((~later).sum(), _PHRASE))
    if later.any():
        yield _marks(*[x[later] for x in (d, t, lo, hi)])


def _parse(batches: Iterator[pa.RecordBatch], length: int, gram: int) -> Iterator[pa.RecordBatch]:
    parsed, size = [], 0
    for batch in batches:
        d, t = (batch.column(c).to_numpy() for c in ("d", "t"))
        for first, _, data, offsets in text_chunks(batch.column("text")):
            for part, cuts, _, base in _cut(data, offsets, length):
                row, lo, hi, trigger, phrase = phrases(part, cuts, length, gram)
                parsed.append((trigger, phrase, d[first + row], t[first + row], lo + base, hi + base))
            size += len(data)
            if size >= GATHERED_BYTES:
                yield from _local(parsed)
                parsed, size = [], 0
    yield from _local(parsed)
    del parsed
    forget()


class _Ordered:
    """Phrases (or windows) sorted by their hashes and place, batch by batch: the first place of each, and all later ones as marks."""

    def __init__(self) -> None:
        self.last: list | None = None  # of the group that a batch's end may cut: its hashes and first place

    def feed(self, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        route, other, d, t, lo, hi, kind = (batch.column(c).to_numpy() for c in _NAMES)
        given = kind == _MARK
        if given.any():
            yield batch.filter(pa.array(given)).select(_NAMES)
        route, other, d, t, lo, hi = (x[~given] for x in (route, other, d, t, lo, hi))
        if not len(route):
            return
        own = [route, other, d, t, lo]
        joined = [np.concatenate([[y], x]) for x, y in zip(own, self.last, strict=True)] if self.last else own
        same = np.zeros(len(joined[0]), bool)
        same[1:] = (joined[0][1:] == joined[0][:-1]) & (joined[1][1:] == joined[1][:-1])
        first = np.maximum.accumulate(np.where(same, 0, np.arange(len(same))))
        later = (joined[2] != joined[2][first]) | (joined[3] != joined[3][first]) | (joined[4] != joined[4][first])
        self.last = [x[first[-1]] for x in joined]
        cut = len(joined[0]) - len(route)
        fresh, later = ~same[cut:], later[cut:]
        yield _rows(*[x[fresh] for x in (route, other, d, t, lo, hi)], np.full(fresh.sum(), _PHRASE))
        if later.any():
            yield _marks(*[x[later] for x in (d, t, lo, hi)])


def _firsts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    ordered = _Ordered()
    for batch in batches:
        yield from ordered.feed(batch)
    forget()


_COMPARED = _PARSED + ", raw binary"


def _with_raw(batch: pa.RecordBatch, raw: list[bytes] | None = None) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*batch.columns, pa.array(raw if raw is not None else [None] * len(batch), pa.binary())], names=[*batch.schema.names, "raw"])


def _spread(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every window start of some ranges: which range it is of, and the start."""
    many = hi - lo + 1
    which = np.repeat(np.arange(len(lo)), many)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(many) - many, many) + lo[which]


def _two_hashes(data: np.ndarray, at: np.ndarray, length: int) -> list[np.ndarray]:
    return [_span_hash(_sums(data, table), at, at + length) for table in (_TABLE, _OTHER)]


def _windows(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Documents with the window ranges asked for, to the phrases' bytes, or for triggers of very many phrases to the windows' hashes."""
    parsed, size = [], 0
    for batch in batches:
        d, t, asks = batch.column("d").to_numpy(), batch.column("t").to_numpy(), batch.column("asks")
        for first, last, data, offsets in text_chunks(batch.column("text")):
            lists = asks.slice(first, last - first)
            flat = lists.flatten()
            lo, hi, route, kind = (flat.field(c).to_numpy() for c in ("lo", "hi", "route", "kind"))
            row = np.repeat(np.arange(last - first), np.diff(lists.offsets.to_numpy()))
            whole = np.flatnonzero(kind == _ASK)
            if len(whole):
                begin, end = offsets[row[whole]] + lo[whole], offsets[row[whole]] + hi[whole] + length
                raw = [data[a:b].tobytes() for a, b in zip(begin, end, strict=True)]
                none = np.zeros(len(whole), np.int64)
                yield _with_raw(_rows(route[whole], none, d[first + row[whole]], t[first + row[whole]], lo[whole], hi[whole], none + _ASK), raw)
            hot = np.flatnonzero(kind == _ASK_HOT)
            which, start = _spread(lo[hot], hi[hot])
            own = row[hot][which]
            parsed.append((*_two_hashes(data, start + offsets[own], length), d[first + own], t[first + own], start, start))
            size += 8 * len(start)
            if size >= GATHERED_BYTES:
                yield from map(_with_raw, _local(parsed))
                parsed, size = [], 0
    yield from map(_with_raw, _local(parsed))
    del parsed
    forget()


def suffix_array(data: np.ndarray, at: np.ndarray, block: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes that begin at `at`, block by block in lexicographic order of their first `length` bytes, equal ones in the
    order given; and which of them agree in those bytes and the block with the one before."""
    wide = -(-(length + 4) // 8) * 8
    words = np.zeros((len(at), wide), np.uint8)
    words[:, :4] = block.astype(">u4")[:, None].view(np.uint8)
    words[:, 4 : 4 + length] = np.lib.stride_tricks.sliding_window_view(data, length)[at]
    order = np.argsort(words.view(f"S{wide}")[:, 0], kind="stable")
    cells = words.view(np.uint64)[order]
    same = np.zeros(len(at), bool)
    same[1:] = (cells[1:] == cells[:-1]).all(1)
    return order, same


def _sorted_block(route: np.ndarray, d: np.ndarray, t: np.ndarray, lo: np.ndarray, hi: np.ndarray, raw: list[bytes], length: int) -> pa.RecordBatch | None:
    """The dictionary of some triggers: windows of its phrases of which an equal one comes earlier in the corpus, as marks.

    The parse gives the phrases' order in the corpus; their windows' suffix array, stable on that order, has of each run of
    suffixes that agree in `length` bytes the earliest in front.
    """
    order = np.lexsort((lo, t, d))  # the parse: first places of the phrases in corpus order
    sizes = np.array([len(raw[k]) for k in order])
    data = np.frombuffer(b"".join([raw[k] for k in order]), np.uint8)
    route, d, t, lo, hi = (x[order] for x in (route, d, t, lo, hi))
    which, start = _spread(lo, hi)
    _, block = np.unique(route, return_inverse=True)
    by, same = suffix_array(data, (np.cumsum(sizes) - sizes)[which] + start - lo[which], block[which], length)
    which, start = which[by], start[by]
    first = np.maximum.accumulate(np.where(same, 0, np.arange(len(by))))
    later = (d[which] != d[which[first]]) | (t[which] != t[which[first]]) | (start != start[first])
    if not later.any():
        return None
    which, start = which[later], start[later]
    return _marks(d[which], t[which], start, start)


def _combine(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Later places of equal windows, as marks. Phrases come sorted by trigger and are sorted by suffixes block by block (a
    block never parts a trigger); hashed windows of hot triggers come sorted by hash and place."""
    ordered, held = _Ordered(), []
    for batch in batches:
        asked = pa.array(batch.column("kind").to_numpy() == _ASK)
        held.append(batch.filter(asked))
        for out in ordered.feed(batch.filter(pc.invert(asked))):
            yield out.filter(pc.equal(out.column("kind"), _MARK))
        if sum(x.nbytes for x in held) >= BLOCK_BYTES:
            table = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            route = table.column("route").to_numpy()
            whole = int(np.flatnonzero(route == route[-1])[0])  # the last trigger may go on in the next batch
            yield from _sorted_blocks(table.slice(0, whole), length)
            held = [table.slice(whole)]
    if sum(len(x) for x in held):
        yield from _sorted_blocks(pa.Table.from_batches(held).combine_chunks().to_batches()[0], length)
    del held
    forget()


def _sorted_blocks(table: pa.RecordBatch, length: int) -> Iterator[pa.RecordBatch]:
    """_sorted_block() of runs of whole triggers, of about BLOCK_BYTES each."""
    route, ends = table.column("route").to_numpy(), np.cumsum(pc.binary_length(table.column("raw")).to_numpy())
    lo = 0
    while lo < len(table):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + BLOCK_BYTES, "right")))
        hi += int(np.argmax(np.append(route[hi:] != route[hi - 1], True)))  # to the end of its last trigger
        part = table.slice(lo, hi - lo)
        found = _sorted_block(*[part.column(c).to_numpy() for c in ("route", "d", "t", "lo", "hi")], part.column("raw").to_pylist(), length)
        if found is not None:
            yield found
        lo = hi


def _cover(raw: bytes, marks: list[tuple[int, int]], length: int) -> tuple[bytes, int]:
    """What is left of a text, and the number of maximal removed runs."""
    if not marks:
        return raw, 0
    step = np.zeros(len(raw) + 1, np.int64)
    np.add.at(step, [lo for lo, _ in marks], 1)
    np.add.at(step, [hi + length for _, hi in marks], -1)
    gone = np.cumsum(step[:-1]) > 0
    return np.frombuffer(raw, np.uint8)[~gone].tobytes(), int(np.count_nonzero(np.diff(np.concatenate([[0], gone.astype(np.int8)])) == 1))


def dedup_substrings(df: DataFrame, *, text: str = "text", row_key: str = "doc_id", length: int = LENGTH, gram: int | None = None, keep: list[str] | None = None, with_text: bool = False, hot: int = HOT_TRIGGER) -> DataFrame:
    """Columns `keep` with n_bytes, n_removed, n_spans and kept_sha256 (and kept, the bytes left, on demand).

    A byte goes if a string of `length` bytes that covers it also starts earlier: in a row of a smaller key, or earlier in the
    same row. Strings are judged on the input. Texts are UTF-8; null counts as empty; no string crosses a row's end. Null
    keys come after all others; rows of the same key come in order of a hash of their text, and rows equal in both are
    one document, whose results are equal. An empty table gives an empty result. Columns of `keep` named as an output are
    left out; others clash with nothing.

    Prefix-free parsing: rolling-hash triggers, at least one in every string of `length` bytes, cut texts into phrases that
    overlap by length - 1 bytes, so that every string lies in one phrase, at the same distance from its trigger wherever it
    stands. The dictionary holds each different phrase once, with its first place; all later places in the parse are marked
    whole. A string can be shared in part only by different phrases of a trigger: those that have any form a block of the
    dictionary, whose suffix array, combined with the phrases' order in the parse, tells for each run of suffixes that agree in
    `length` bytes which comes first in the corpus. Phrases are counted by trigger before they meet, with map-side sums; those
    of a trigger in over `hot` phrases are put in order string by string, by 128-bit hash and place, over all tasks. Phrases and
    strings that repeat within a task leave it once, so a passage in a third of all documents gathers nowhere.
    """
    gram = gram or max(4, length * GRAM // LENGTH)
    spark = df.sparkSession
    keep = [c for c in ([row_key] if keep is None else keep) if c.lower() not in (*OUTPUTS, "kept")]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    key = {"d": F.coalesce(col(row_key).cast("long"), F.lit(2**63 - 1)), "t": F.xxhash64(col(text))}
    rows = df.select(*[c.alias(n) for n, c in key.items()], col(text).alias("text"))
    repeats = not rows.groupBy("d").count().filter("count > 1").isEmpty()
    if not repeats:  # the key alone orders rows
        key["t"] = F.lit(0).cast("long")
        rows = df.select(*[c.alias(n) for n, c in key.items()], col(text).alias("text"))
    order = ["route", "other", "d", "t", "lo"]
    parsed = rows.mapInArrow(lambda it: _parse(it, length, gram), _PARSED)
    known = materialize(parsed.repartition(parts, "other").sortWithinPartitions("other", *order).mapInArrow(_firsts, _PARSED).select("route", "d", "t", "lo", "hi", "kind"))
    release(spark)
    dictionary = known.filter(F.col("kind") == _PHRASE).drop("kind")
    shared = materialize(dictionary.groupBy("route").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"))
    asked = join_dealt(dictionary, shared, "route", hot=hot_keys(dictionary, "route", shared.select(F.col("route").alias("hot"), "n"))).withColumn("kind", F.when(F.col("n") > hot, _ASK_HOT).otherwise(_ASK))
    asks = materialize(asked.groupBy("d", "t").agg(F.collect_set(F.struct("lo", "hi", "route", "kind")).alias("asks")))
    texts = rows.dropDuplicates(["d", "t"]) if repeats else rows
    windows = texts.join(asks, ["d", "t"]).select("d", "t", "text", "asks").mapInArrow(lambda it: _windows(it, length), _COMPARED)
    found = windows.repartition(parts, "route").sortWithinPartitions(*order).mapInArrow(lambda it: _combine(it, length), _PARSED)
    found = materialize(found.select("d", "t", "lo", "hi"))
    del windows, asks, asked, parsed
    release(spark)
    marks = known.filter(F.col("kind") == _MARK).select("d", "t", "lo", "hi").union(found).groupBy(F.col("d").alias("of_d"), F.col("t").alias("of_t")).agg(F.collect_list(F.struct("lo", "hi")).alias("marks"))
    marked = packed(df.select(*[col(c) for c in dict.fromkeys([*keep, row_key, text])]), {**key, "text": col(text)})
    names = list(dict.fromkeys([*keep, row_key, text]))
    marked = marked.join(marks, (F.col("d") == F.col("of_d")) & (F.col("t") == F.col("of_t")), "left").select(*[F.col(f"row.c{names.index(c)}").alias(f"c{i}") for i, c in enumerate(keep)], "text", "marks")
    kept_fields = [next(f for f in df.schema.fields if f.name == c) for c in keep]
    fields = [StructField(c, LongType()) for c in OUTPUTS[:3]] + [StructField(OUTPUTS[3], StringType())] + ([StructField("kept", BinaryType())] if with_text else [])
    schema, at = StructType([*kept_fields, *fields]), len(keep)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in runs(batch, at):
                n, removed, spans, digest, kept = [], [], [], [], []
                for value, own in zip(part.column(at), part.column(at + 1), strict=True):
                    raw = value.as_buffer().to_pybytes() if value.is_valid else b""
                    left, several = _cover(raw, list(zip(own.values.field("lo").to_pylist(), own.values.field("hi").to_pylist(), strict=True)) if own.is_valid else [], length)
                    n.append(len(raw))
                    removed.append(len(raw) - len(left))
                    spans.append(several)
                    digest.append(hashlib.sha256(left).hexdigest())
                    kept.append(left if with_text else None)
                out = [pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(digest, pa.string()), *([pa.array(kept, pa.binary())] if with_text else [])]
                yield pa.RecordBatch.from_arrays([*[part.column(i) for i in range(at)], *out], names=[f.name for f in schema.fields])
        forget()

    return marked.mapInArrow(finish, schema)


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every whole text of documents without strings of LENGTH bytes that start earlier; see dedup_substrings()."""
    return dedup_substrings(read(spark, sf_dir, "documents"))
