"""SentencePiece encoding by forward filtering and backward sampling over the piece lattice, and its lossless decoding."""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StringType, StructField, StructType

from .common import col, numbered, read
from .wordhash import U64, forget, mix, powers, text_chunks

#: The vocabulary, unless a caller names another; it is read on the driver and sent along.
MODEL_PATH = os.path.join("/opt/tokenizers", "piece_bpe_32k.model")
SEED = 9
#: Pieces weigh 1 / (rank + RANK_SHIFT) to this power: 1 is a plain Zipf law, larger values sample closer to the best segmentation.
SHARPNESS, RANK_SHIFT = 1.5, 10.0
#: A byte of a character without a piece weighs so much as a share of the lightest piece.
BYTE_SHARE = 0.1
#: Bytes of text encoded at a time; units of more characters go block by block, of so many; cells of lattices made at once, and kept.
CHUNK_CHARS, LONG_UNIT, BLOCK_CHARS, CELLS, CACHED_CELLS = 400_000, 4096, 32_768, 300_000, 4_000_000
#: SentencePiece's mark for a space, and a code outside Unicode that stands for the mark itself in a text.
SPACE, OWN_MARK = 0x2581, 0x110000
_CODES = 0x110001
_STEP = 0xD1342543DE82EF95
_UNDER_ONE = np.nextafter(np.float32(1), np.float32(0))  # a lot of 1 would lie beyond every piece


def _code_table() -> np.ndarray:
    return mix(np.arange(11, _CODES + 11, dtype=U64)) | U64(1)


_tables: dict = {}


def _sums(data: np.ndarray) -> np.ndarray:
    if not _tables:
        _tables["codes"] = _code_table()
    with np.errstate(over="ignore"):
        out = np.zeros(len(data) + 1, U64)
        np.cumsum(_tables["codes"][data] * powers(len(data) + 1)[0][:-1], out=out[1:])
    return out


@dataclass
class Vocabulary:
    """Pieces by id as bytes (spaces for their marks), ids of the 256 byte pieces, and the lookup of pieces by hash."""

    raw: list[bytes]
    byte_ids: np.ndarray
    keys: np.ndarray
    ids: np.ndarray
    weights: np.ndarray
    longest: int
    single: np.ndarray  # code points that stand in no piece of several characters
    single_id: np.ndarray  # by code point: its piece's id, or -1
    single_weight: np.ndarray
    byte_weight: float
    inner_space: bool  # some piece has a space after another character
    bytes: np.ndarray | None = None  # all of raw, and where each begins: made on first use
    cuts: np.ndarray | None = None

    @classmethod
    def load(cls, path: str, sharpness: float = SHARPNESS) -> Vocabulary:
        """From a SentencePiece model file whose scores rank its pieces (as those of a BPE model do)."""
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        names = [model.id_to_piece(i) for i in range(n)]
        byte_ids, usual = np.full(256, -1, np.int32), []
        for i in range(n):
            if model.is_byte(i):
                byte_ids[int(names[i][1:-1], 16)] = i
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                usual.append(i)
        if (byte_ids < 0).any():
            raise ValueError(f"{path} has no piece for every byte, so not every text could be decoded again")
        usual.sort(key=lambda i: (-model.get_score(i), i))
        weights = (np.arange(len(usual)) + RANK_SHIFT) ** -sharpness
        return cls.of([(i, names[i]) for i in usual], weights, byte_ids, n)

    @classmethod
    def of(cls, pieces: list[tuple[int, str]], weights: np.ndarray, byte_ids: np.ndarray, size: int) -> Vocabulary:
        raw = [b""] * size
        for b, i in enumerate(byte_ids):
            raw[i] = bytes([b])
        single, single_id, single_weight = np.ones(_CODES, bool), np.full(_CODES, -1, np.int32), np.zeros(_CODES)
        keys = np.zeros(len(pieces), U64)
        for k, (i, name) in enumerate(pieces):
            raw[i] = name.replace(chr(SPACE), " ").encode()
            codes = np.array([ord(c) for c in name])
            if len(codes) == 1:
                single_id[codes], single_weight[codes] = i, weights[k]
            else:
                single[codes] = False
            with np.errstate(over="ignore"):
                keys[k] = mix(_sums(codes)[-1:] + U64(len(codes)))[0]
        order = np.argsort(keys)
        mark = chr(SPACE)
        return cls(raw, byte_ids, keys[order], np.array([i for i, _ in pieces], np.int32)[order], weights[order], max((len(p) for _, p in pieces), default=1), single, single_id, single_weight, float(weights.min() * BYTE_SHARE) if len(weights) else 1.0, any(mark in p.lstrip(mark) for _, p in pieces))

    def spell(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of all pieces, one after the other, and where each piece's begin."""
        if self.bytes is None:
            self.bytes, self.cuts = np.frombuffer(b"".join(self.raw), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in self.raw])])
        size = np.diff(self.cuts)[ids]
        begin = np.concatenate([[0], np.cumsum(size)])
        at = np.arange(begin[-1], dtype=np.int64)
        at += np.repeat(self.cuts[ids] - begin[:-1], size)
        return self.bytes[at], begin

    def decode(self, ids: list[int] | np.ndarray) -> str:
        """The text that these pieces spell, without the space that encoding puts before it."""
        return self.spell(np.asarray(ids, np.int64))[0][1:].tobytes().decode("utf-8", "replace")


def _known(v: Vocabulary, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Piece ids (-1: none) and weights (0: none). A bit table over the hashes' high bits rules most strings out."""
    if "bits" not in _tables or _tables.get("of") is not v:
        bits = np.zeros(1 << 20, bool)
        bits[(v.keys >> U64(44)).astype(np.int64)] = True
        _tables["bits"], _tables["of"] = bits, v
    ids, weights = np.full(hashes.shape, -1, np.int32), np.zeros(hashes.shape)
    maybe = np.nonzero(_tables["bits"][(hashes >> U64(44)).astype(np.int64)])
    found = hashes[maybe]
    at = np.minimum(np.searchsorted(v.keys, found), max(0, len(v.keys) - 1))
    hit = v.keys[at] == found if len(v.keys) else np.zeros(len(found), bool)
    where = tuple(x[hit] for x in maybe)
    ids[where], weights[where] = v.ids[at[hit]], v.weights[at[hit]]
    return ids, weights


def _pieces(v: Vocabulary, codes: np.ndarray, sums: np.ndarray, down: np.ndarray, at: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """For strings whose characters lie at `at` (a row each, with a last column for the place after): by string, end and
    length, the id and weight of the piece that ends there."""
    m, n = at.shape[0], at.shape[1] - 1
    ids = np.full((m, n + 1, most), -1, np.int32)
    weights = np.zeros((m, n + 1, most), np.float32)
    grid = sums[at]
    chars = codes[at[:, :-1]]
    one = v.single_id[chars]
    wide = 1 + (chars >= 0x80) + (chars >= 0x800) + ((chars >= 0x10000) & (chars != OWN_MARK))
    byte = v.byte_ids[np.minimum(chars, 127)]
    ids[:, 1:, 0] = np.where(one >= 0, one, np.where(chars < 0x80, byte, -2 - chars.astype(np.int64)))
    weights[:, 1:, 0] = np.where(one >= 0, v.single_weight[chars], v.byte_weight**wide)
    with np.errstate(over="ignore"):
        for k in range(2, most + 1):
            ids[:, k:, k - 1], weights[:, k:, k - 1] = _known(v, mix((grid[:, k:] - grid[:, :-k]) * down[at[:, :-k]] + U64(k)))
    return ids, weights


def _lattice(v: Vocabulary, codes: np.ndarray, sums: np.ndarray, down: np.ndarray, starts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """For strings of n characters: by string, end and length, the id of the piece that ends there, and the running
    probability of the lengths given that a segmentation has a boundary at that end (forward filtering)."""
    most = min(n, v.longest)
    ids, weights = _pieces(v, codes, sums, down, starts[:, None] + np.arange(n + 1)[None, :], most)
    ahead = np.zeros((len(starts), n + 1 + most))  # the chance of a boundary, `most` zeros before the string
    ahead[:, most] = 1
    for i in range(1, n + 1):
        run = np.cumsum(ahead[:, i : i + most][:, ::-1] * weights[:, i], 1)
        total = run[:, -1:]
        weights[:, i] = run / total
        ahead[:, most + i] = total[:, 0]
        if i % 8 == 0:  # only ratios matter; long strings must not underflow
            ahead[:, i : i + most + 1] /= total
    return ids, weights


def _cached_lattice(v: Vocabulary, codes: np.ndarray, sums: np.ndarray, down: np.ndarray, starts: np.ndarray, names: np.ndarray, n: int) -> tuple[np.ndarray, ...]:
    """_lattice() for units of ascending names, with the row of each. Short units come back all the time, so the lattices of
    the first CACHED_CELLS cells are kept until the task ends; that only saves time, as a lattice is its unit's alone."""
    if _tables.get("of_lattices") is not v:
        _tables["of_lattices"], _tables["lattices"], _tables["cells"] = v, {}, 0
    held, each = _tables["lattices"], (n + 1) * min(n, v.longest)
    keys, order, ids, chance = held.get(n) or (np.zeros(0, U64), np.zeros(0, np.int64), None, None)
    at = np.minimum(np.searchsorted(keys, names), max(0, len(keys) - 1))
    hit = keys[at] == names if len(keys) else np.zeros(len(names), bool)
    row = np.empty(len(names), np.int64)
    row[hit] = order[at[hit]]
    miss = np.flatnonzero(~hit)
    if len(miss):
        new_ids, new_chance = _lattice(v, codes, sums, down, starts[miss], n)
        row[miss] = len(keys) + np.arange(len(miss))
        ids = new_ids if ids is None else np.concatenate([ids, new_ids])
        chance = new_chance if chance is None else np.concatenate([chance, new_chance])
        if _tables["cells"] + each * len(miss) <= CACHED_CELLS:
            _tables["cells"] += each * len(miss)
            keys, order = np.concatenate([keys, names[miss]]), np.concatenate([order, row[miss]])
            by_key = np.argsort(keys)
            held[n] = (keys[by_key], order[by_key], ids, chance)
    return ids, chance, row


def _uniform(seed: np.ndarray, step: int | np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        step = step.astype(U64) * U64(_STEP) + U64(1) if isinstance(step, np.ndarray) else U64((step * _STEP + 1) % 2**64)
        return (mix(seed + step) >> U64(11)) * 2.0**-53


def _long_unit(v: Vocabulary, codes: np.ndarray, seed: U64) -> np.ndarray:
    """Pieces of one long unit, negative for characters without one. Forward sums are kept at the blocks' ends only; the
    blocks' lattices are made again from the last one backwards, so memory is a block's whatever the unit's length."""
    most, n = v.longest, len(codes)

    def block(first: int, last: int, ahead: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids and weights of the pieces ending in (first, last], and the forward sums up to there, from those of the `most` places up to first."""
        lo = max(0, first - most)
        part = codes[lo:last]
        ids, weights = _pieces(v, part, _sums(part), powers(len(part) + 1)[1], np.arange(len(part) + 1)[None, :], most)
        ids, weights = ids[0, first - lo + 1 :], weights[0, first - lo + 1 :, ::-1].astype(np.float64)
        sums = np.concatenate([ahead, np.zeros(last - first)])  # sums[most + i] is that of first + 1 + i
        for i in range(last - first):
            sums[most + i] = total = sums[i : i + most] @ weights[i]
            if i % 8 == 7:
                sums[i + 1 : i + most + 1] /= total
        return ids, weights, sums

    ahead = np.zeros(most)
    ahead[-1] = 1
    edges, begins = [*range(0, n, BLOCK_CHARS), n], [ahead]
    for first, last in zip(edges[:-2], edges[1:-1], strict=True):
        begins.append(block(first, last, begins[-1])[2][-most:])
    end, turn, out = n, 0, []
    for k in reversed(range(len(begins))):
        ids, weights, sums = block(edges[k], edges[k + 1], begins[k])
        lots, began = _uniform(seed, turn + np.arange(edges[k + 1] - edges[k])), turn
        run = np.cumsum((np.lib.stride_tricks.sliding_window_view(sums, most)[: len(weights)] * weights)[:, ::-1], 1)
        while end > edges[k]:
            i = end - edges[k] - 1
            lot = min(run[i, -1] * lots[turn - began], np.nextafter(run[i, -1], 0))
            size = int(np.searchsorted(run[i], lot, "right"))
            out.append(ids[i, size])
            end, turn = end - size - 1, turn + 1
    return np.array(out[::-1], np.int32)


def _spelt(v: Vocabulary, flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pieces with the byte pieces of the characters that have none (negative in flat), and where each of flat begins."""
    width = np.ones(len(flat), np.int64)
    odd = np.flatnonzero(flat < 0)
    if not len(odd):
        return flat, np.arange(len(flat) + 1)
    kinds, which = np.unique(-2 - flat[odd].astype(np.int64), return_inverse=True)
    spelt = [v.byte_ids[np.frombuffer((chr(SPACE) if c == OWN_MARK else chr(c)).encode("utf-8", "surrogatepass"), np.uint8)] for c in kinds.tolist()]
    sizes = np.array([len(s) for s in spelt])
    width[odd] = sizes[which]
    place = np.concatenate([[0], np.cumsum(width)])
    out = np.repeat(flat, width)
    for k, s in enumerate(spelt):
        at = place[odd[which == k]]
        for i, b in enumerate(s):
            out[at + i] = b
    return out, place


def _opens(v: Vocabulary, codes: np.ndarray, before: int | None) -> np.ndarray:
    """Where units begin, given the character before (None: the text begins here)."""
    alone = v.single[codes]
    out = np.zeros(len(codes), bool)
    out[1:] = alone[1:] | alone[:-1]
    space = codes == SPACE
    if not v.inner_space:
        out[1:] |= space[1:] & ~space[:-1]
    out[0] = before is None or bool(alone[0] or v.single[before] or (not v.inner_space and space[0] and before != SPACE))
    return out


def _encode_units(v: Vocabulary, codes: np.ndarray, starts: np.ndarray, seed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pieces of the units of some characters (negative for characters without one), and where each unit's begin. Equal units share one lattice."""
    length = np.diff(np.append(starts, len(codes)))
    sums, (_, down) = _sums(codes), powers(len(codes) + 1)
    with np.errstate(over="ignore"):
        name = mix((sums[starts + length] - sums[starts]) * down[starts] + length.astype(U64))
    count, drawn, whole = np.zeros(len(starts), np.int64), [], []
    by_name = np.lexsort((name, length))
    new = np.ones(len(starts), bool)
    new[1:] = (name[by_name][1:] != name[by_name][:-1]) | (length[by_name][1:] != length[by_name][:-1])
    kind_of, heads = np.cumsum(new) - 1, np.flatnonzero(new)  # kinds are in order of length
    kind_length = length[by_name[heads]]
    bounds = np.append(heads, len(starts))
    lo = 0
    while lo < len(heads):
        n = int(kind_length[lo])
        most = min(n, v.longest)
        if n > LONG_UNIT:
            for u in by_name[bounds[lo] :]:
                whole.append((u, _long_unit(v, codes[starts[u] : starts[u] + length[u]], seed[u])))
                count[u] = len(whole[-1][1])
            break
        hi = min(int(np.searchsorted(kind_length, n, "right")), lo + max(1, CELLS // (n * most)))
        units = by_name[heads[lo:hi]]
        ids, chance, row = _cached_lattice(v, codes, sums, down, starts[units], name[units], n)
        which = by_name[bounds[lo] : bounds[hi]]
        row, end, turn = row[kind_of[bounds[lo] : bounds[hi]] - lo], np.full(len(which), n, np.int64), 0
        while len(which):
            lots = np.minimum(_uniform(seed[which], turn).astype(np.float32), _UNDER_ONE)
            size, open_ = np.zeros(len(which), np.int64), np.arange(len(which))
            for k in range(most - 1):  # long pieces are rare: look on only where the lot lies beyond
                open_ = open_[chance[row[open_], end[open_], k] <= lots[open_]]
                if not len(open_):
                    break
                size[open_] += 1
            size = np.minimum(size, end - 1)
            drawn.append((which, turn, ids[row, end, size]))
            count[which] += 1
            end = end - size - 1
            left = end > 0
            which, row, end, turn = which[left], row[left], end[left], turn + 1
        lo = hi
    begin = np.concatenate([[0], np.cumsum(count)])
    flat = np.empty(begin[-1], np.int32)
    for which, turn, ids in drawn:
        flat[begin[which] + count[which] - 1 - turn] = ids
    for u, ids in whole:
        flat[begin[u] : begin[u + 1]] = ids
    return flat, begin


def characters(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of rows of UTF-8, spaces as the mark and a mark before each row that is not empty; and where rows begin."""
    codes = np.frombuffer(data.tobytes().decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32)
    before = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offsets]
    full = np.flatnonzero(np.diff(before))
    out = np.empty(len(codes) + len(full), np.uint32)
    added = np.concatenate([[0], np.cumsum(np.diff(before) > 0)])
    body = np.ones(len(out), bool)
    body[before[full] + np.arange(len(full))] = False
    out[~body] = SPACE
    out[body] = np.where(codes == 0x20, SPACE, np.where(codes == SPACE, OWN_MARK, codes))
    return out, before + added


def encode_bytes(v: Vocabulary, data: np.ndarray, offsets: np.ndarray, seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Piece ids of all rows of UTF-8, one after the other, and where each row's begin. One segmentation of each text is drawn
    with the chance that its pieces' weights give it; the draw depends on the text and its seed alone.

    No piece spans the end of a unit (before a space, or around a character that stands in no longer piece), so units are
    drawn independently. Rows longer than CHUNK_CHARS go in runs of whole units, and units over LONG_UNIT in blocks.
    """
    codes, at = characters(data, offsets)
    if len(at) == 2 and len(codes) > CHUNK_CHARS:
        flat = np.concatenate(list(_long_text(v, codes, seeds[0])))
        return flat, np.array([0, len(flat)])
    if not len(codes):
        return np.zeros(0, np.int32), np.zeros(len(at), np.int64)
    opens = _opens(v, codes, None)
    opens[at[:-1][at[:-1] < len(codes)]] = True
    starts = np.flatnonzero(opens)
    first = np.searchsorted(starts, at)  # units of row r: first[r] to first[r + 1]
    doc = np.repeat(np.arange(len(at) - 1), np.diff(first))
    flat, begin = _encode_units(v, codes, starts, _unit_seeds(seeds[doc], np.arange(len(starts)) - first[doc]))
    flat, place = _spelt(v, flat)
    return flat, place[begin[first]]


def _unit_seeds(seed: np.ndarray, number: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(seed + number.astype(U64) * U64(0x9E3779B97F4A7C15))


def _long_text(v: Vocabulary, codes: np.ndarray, seed: U64) -> Iterator[np.ndarray]:
    lo = number = 0
    while lo < len(codes):
        before = int(codes[lo - 1]) if lo else None
        opens = np.flatnonzero(_opens(v, codes[lo : lo + CHUNK_CHARS], before))
        if len(codes) - lo <= CHUNK_CHARS:
            hi = len(codes)
        elif len(opens) > 1:
            hi, opens = lo + int(opens[-1]), opens[:-1]
        else:  # one unit of CHUNK_CHARS at least
            hi = lo + CHUNK_CHARS
            while hi < len(codes):
                more = np.flatnonzero(_opens(v, codes[hi : hi + CHUNK_CHARS], int(codes[hi - 1])))
                hi = hi + int(more[0]) if len(more) else min(len(codes), hi + CHUNK_CHARS)
                if len(more):
                    break
            yield _spelt(v, _long_unit(v, codes[lo:hi], _unit_seeds(np.array([seed], U64), np.array([number]))[0]))[0]
            lo, number = hi, number + 1
            continue
        seeds = _unit_seeds(np.full(len(opens), seed, U64), number + np.arange(len(opens)))
        yield _spelt(v, _encode_units(v, codes[lo:hi], opens, seeds)[0])[0]
        lo, number = hi, number + len(opens)


def encode(v: Vocabulary, texts: list[str], seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """encode_bytes() of strings."""
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    return encode_bytes(v, np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in raw])]).astype(np.int64), seeds)


def same_text(v: Vocabulary, flat: np.ndarray, cut: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Which rows of UTF-8 their pieces spell byte for byte, by decoding all of them."""
    spelt, begin = v.spell(flat)
    begin, size = begin[cut], np.diff(offsets)
    out = np.diff(begin) == size + (size > 0)
    good = np.flatnonzero(out & (size > 0))
    for r in good:  # a row's comparison is one pass over its bytes
        out[r] = spelt[begin[r]] == 0x20 and np.array_equal(spelt[begin[r] + 1 : begin[r + 1]], data[offsets[r] : offsets[r + 1]])
    return out


def add_pieces(df: DataFrame, vocabulary: Vocabulary, *, text: str = "text", row_key: str | list[str] = "doc_id", seed: int = SEED, keep: list[str], output: str = "ids", verified: str | None = None) -> DataFrame:
    """Columns `keep` with `ids`: a sampled segmentation of each whole text (null for null, empty for empty), and `verified`
    on demand: whether the ids decode to the very text (true for null).

    A draw depends on text, row key and seed alone, not on partitions, so reruns and lost executors give the same ids. Rows
    repeated in key and text get the same ids: give copies numbers of their own and name both columns as the key. Null keys
    are a key like others. An empty table gives an empty result. Columns of `keep` named as an output are replaced.
    """
    outputs = [output, *([verified] if verified else [])]
    keep = [c for c in keep if c.lower() not in {x.lower() for x in outputs}]
    shared = df.sparkSession.sparkContext.broadcast(vocabulary)  # the vocabulary's size, whatever the data's
    kept = [next(f for f in df.schema.fields if f.name == c) for c in keep]
    schema = StructType([*kept, StructField(output, ArrayType(IntegerType())), *([StructField(verified, BooleanType())] if verified else [])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, at = shared.value, len(keep)
        for batch in batches:
            keys = batch.column(at + 1).to_numpy().view(U64)
            for lo, hi, data, offsets in text_chunks(batch.column(at), CHUNK_CHARS):
                flat, cut = encode_bytes(v, data, offsets, keys[lo:hi])
                part = batch.slice(lo, hi - lo)
                null = pc.is_null(part.column(at))
                cells = [pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(flat, pa.int32()), mask=null)]
                if verified:
                    cells.append(pc.or_(null, pa.array(same_text(v, flat, cut, data, offsets))))
                yield pa.RecordBatch.from_arrays([*[part.column(i) for i in range(at)], *cells], names=[f.name for f in schema.fields])
                del flat, cut, data, offsets, part, cells
        _tables.pop("lattices", None)
        _tables.pop("of_lattices", None)
        forget()

    keys = [row_key] if isinstance(row_key, str) else row_key
    own = [col(text).alias("text"), F.xxhash64(F.lit(seed), *[col(k) for k in keys]).alias("seed")]
    return df.select(*numbered(keep), *own).mapInArrow(run, schema)


def add_text(df: DataFrame, vocabulary: Vocabulary, *, ids: str = "ids", keep: list[str], output: str = "decoded") -> DataFrame:
    """Columns `keep` with `decoded`: the text that the ids spell (null for null, empty for none)."""
    keep = [c for c in keep if c.lower() != output.lower()]
    shared = df.sparkSession.sparkContext.broadcast(vocabulary)
    kept = [next(f for f in df.schema.fields if f.name == c) for c in keep]
    schema = StructType([*kept, StructField(output, StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, len(batch), 100):
                part = batch.slice(lo, 100)
                lists = part.column(len(keep))
                texts = [None if not x.is_valid else shared.value.decode(x.values.to_numpy()) for x in lists]
                yield pa.RecordBatch.from_arrays([*[part.column(i) for i in range(len(keep))], pa.array(texts, pa.string())], names=[f.name for f in schema.fields])

    return df.select(*numbered(keep), col(ids).alias("ids")).mapInArrow(run, schema)


def encode_documents(docs: DataFrame, path: str = MODEL_PATH, copy: str | None = None) -> DataFrame:
    """doc_id, n_bytes, n_pieces, ids and whether the ids decode to the very text; null texts have no ids and count as 0
    pieces. `copy`: a column that numbers copies of a document, each of which then gets a draw of its own."""
    rows = docs.select("doc_id", "text", *([copy] if copy else []), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    spelt = add_pieces(rows, Vocabulary.load(path), row_key=["doc_id", copy] if copy else "doc_id", keep=["doc_id", "n_bytes"], verified="lossless")
    return spelt.select("doc_id", "n_bytes", F.coalesce(F.array_size("ids"), F.lit(0)).cast("long").alias("n_pieces"), "ids", "lossless")


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of documents as sampled pieces. Null text: no ids, 0 pieces, lossless; empty text: an empty list;
    rows of equal key and text agree."""
    return encode_documents(read(spark, sf_dir, "documents"))
