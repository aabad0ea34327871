"""Near-duplicate documents: banded MinHash, odd sketches, and an exact check of every link that counts."""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import col, discard, hot_keys, join_dealt, materialize, packed, read, release, resting, unpacked
from .graph import components
from .wordhash import U64, find_words, forget, mix, text_chunks, word_hashes

BANDS, ROWS = 30, 5
SAMPLES = BANDS * ROWS
SKETCH_BITS = 512
#: Pairs whose sketches differ in more bits are estimated at under 0.6 similarity; a pair at 0.8 lies 4.9 standard deviations below.
MOST_DIFFERING = 96
#: Buckets up to this size are paired by a join; larger ones in blocks of about BLOCK members.
SMALL_BUCKET, BLOCK = 16, 500
STAR_ROUNDS = 2
_MULTIPLIERS = np.random.default_rng(8).integers(0, 2**63, SAMPLES, dtype=U64) * U64(2) + U64(1)
_SEATS = mix(np.arange(1, SAMPLES + 1, dtype=U64))


def shingle_hashes(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every row's shingles (with fewer words, of the whole sequence as one), and where each row's begin."""
    starts, ends = find_words(data, offsets)
    words = word_hashes(data, starts, ends)
    first = np.searchsorted(starts, offsets)  # words of row r: first[r] to first[r + 1]
    n_words = np.diff(first)
    n = np.where(n_words >= width, n_words - width + 1, np.minimum(n_words, 1))
    begin = np.concatenate([[0], np.cumsum(n)])
    at = np.arange(begin[-1]) - np.repeat(begin[:-1], n) + np.repeat(first[:-1], n)
    span = np.minimum(width, np.repeat(n_words, n))
    out = mix(span.astype(U64) + U64(77))
    with np.errstate(over="ignore"):
        for k in range(width):
            has = span > k
            out[has] = mix(out[has] * U64(0x9E3779B97F4A7C15) + words[at[has] + k])
    return out, begin


def sketch_rows(mins: np.ndarray) -> np.ndarray:
    """Odd sketches: each MinHash sample flips one bit of its row's bitmap."""
    bits = (mix(mins + _SEATS) >> U64(64 - SKETCH_BITS.bit_length() + 1)).astype(np.int64)
    flips = np.bincount((bits + np.arange(len(mins))[:, None] * SKETCH_BITS).ravel(), minlength=len(mins) * SKETCH_BITS)
    return np.packbits((flips & 1).astype(np.uint8)).reshape(len(mins), SKETCH_BITS // 8).view(np.int64)


def _sign(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, data, offsets in text_chunks(batch.column("text")):
            hashes, begin = shingle_hashes(data, offsets, width)
            sets = [np.unique(hashes[begin[r] : begin[r + 1]]) for r in range(hi - lo)]
            sizes = np.array([len(s) for s in sets])
            digests = np.frombuffer(b"".join(hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets), np.int64).reshape(-1, 2)
            full = np.flatnonzero(sizes)
            bands, sketch = [None] * len(sets), [None] * len(sets)
            if len(full):
                flat = np.concatenate([sets[r] for r in full])
                where = np.concatenate([[0], np.cumsum(sizes[full])[:-1]])
                mins = np.empty((len(full), SAMPLES), U64)
                scratch = np.empty_like(flat)
                for i, m in enumerate(_MULTIPLIERS):
                    np.multiply(flat, m, out=scratch)
                    mins[:, i] = np.minimum.reduceat(scratch, where)
                key = np.zeros((len(full), BANDS), U64)
                with np.errstate(over="ignore"):
                    for k in range(ROWS):
                        key = mix(key * U64(0x9E3779B97F4A7C15) + mins[:, k::ROWS])
                    key = mix(key + np.arange(BANDS, dtype=U64))
                odd = sketch_rows(mins)
                for i, r in enumerate(full):
                    bands[r], sketch[r] = key[i].view(np.int64), odd[i]
            part = batch.slice(lo, hi - lo)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("text_key"), pa.array(digests[:, 0]), pa.array(digests[:, 1]), pa.array(sizes, pa.int64()), pa.array(bands, pa.list_(pa.int64())), pa.array(sketch, pa.list_(pa.int64()))],
                names=["doc_id", "text_key", "node", "twin", "n_shingles", "bands", "sketch"],
            )
            del data, hashes, sets, bands, sketch
    forget()


@functools.lru_cache(maxsize=4)
def shingle_set(text: str, width: int) -> frozenset:
    words = text.encode().lower().split()
    return frozenset(zip(*(words[k:] for k in range(width)), strict=False)) if len(words) >= width else frozenset([tuple(words)] if words else [])


def _alike(p: frozenset, q: frozenset, over: int, under: int) -> bool:
    both = len(p & q)
    return both > 0 and under * both >= over * (len(p) + len(q) - both)


def _verify(batches: Iterator[pa.RecordBatch], width: int, over: int, under: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = []
        for x, y in zip(batch.column("text_a"), batch.column("text_b"), strict=True):
            p, q = shingle_set(x.as_py(), width), shingle_set(y.as_py(), width)
            keep.append(_alike(p, q, over, under))
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))
    shingle_set.cache_clear()  # the worker may stay idle, and sets of long texts are large
    forget()


def _differing(x: str, y: str) -> Column:
    """Bits in which two sketches differ."""
    return functools.reduce(lambda p, q: p + q, [F.bit_count(F.col(x)[i].bitwiseXOR(F.col(y)[i])) for i in range(SKETCH_BITS // 64)])


def _near_in_block(key: tuple, rows) -> object:
    """Of the members in one block of a bucket, or in two, those whose sketch is close to that of another component's member."""
    import pandas as pd

    _, i, j = key
    sketches, chunk = np.array(rows.sketch.tolist(), np.int64).view(U64), rows.chunk.to_numpy()
    _, root = np.unique(rows.component.to_numpy(), return_inverse=True)
    near, right = np.zeros(len(rows), bool), np.flatnonzero(chunk == j)
    for p in np.flatnonzero(chunk == i):
        others = right[root[right] != root[p]]
        others = others[np.bitwise_count(sketches[others] ^ sketches[p]).sum(1) <= MOST_DIFFERING]
        near[others] = True
        near[p] |= len(others) > 0
    return pd.DataFrame({"band": rows.band[near], "node": rows.node[near]})


def _cross(key: tuple, rows, width: int, over: int, under: int) -> object:
    """Links between different components in one block of a bucket, or between two blocks: sketches first, then full sets.
    A pair is only looked at in the first band that it shares, and not once links found here connect it."""
    import pandas as pd

    band, i, j = key
    bands, sketches = (np.array(rows[c].tolist(), np.int64) for c in ("bands", "sketch"))
    sketches, chunk, ids = sketches.view(U64), rows.chunk.to_numpy(), rows.node.to_numpy()
    _, root = np.unique(rows.component.to_numpy(), return_inverse=True)
    place = (bands == band).argmax(1)
    texts, sets, found = rows.text.tolist(), {}, []

    def full(k: int) -> frozenset:
        if k not in sets:
            sets[k] = shingle_set.__wrapped__(texts[k], width)
        return sets[k]

    right = np.flatnonzero(chunk == j)
    for p in np.flatnonzero(chunk == i):
        others = right[(root[right] != root[p]) & ((ids[right] > ids[p]) if i == j else True)]
        others = others[np.bitwise_count(sketches[others] ^ sketches[p]).sum(1) <= MOST_DIFFERING]
        others = others[(bands[others] == bands[p]).argmax(1) == place[p]]
        for q in others:
            if root[p] != root[q] and _alike(full(p), full(q), over, under):
                found.append((min(ids[p], ids[q]), max(ids[p], ids[q])))
                root[root == root[q]] = root[p]
    return pd.DataFrame(found, columns=["a", "b"], dtype="int64")


class _Verifier:
    """Checks pairs of nodes on their full sets; texts come from `texts` (node, text)."""

    def __init__(self, texts: DataFrame, nodes: DataFrame, width: int, threshold: Fraction):
        self.texts, self.nodes = texts, nodes
        self.rule = (width, threshold.numerator, threshold.denominator)

    def links(self, pairs: DataFrame) -> DataFrame:
        """Of (a, b), those that are links. Sketches first, then texts."""
        of = lambda side: self.nodes.select(F.col("node").alias(side), F.col("sketch").alias(f"sketch_{side}"))
        text = lambda side: self.texts.select(F.col("node").alias(side), F.col("text").alias(f"text_{side}"))
        pairs = materialize(pairs.distinct())
        near = self._joined(pairs, of).filter(_differing("sketch_a", "sketch_b") <= MOST_DIFFERING)
        width, over, under = self.rule
        near = materialize(near.select("a", "b"))
        discard(pairs)
        both = self._joined(near, text).select("a", "b", "text_a", "text_b")
        links = materialize(both.mapInArrow(lambda it: _verify(it, width, over, under), "a long, b long"))
        discard(near)
        return links

    @staticmethod
    def _joined(pairs: DataFrame, of: Callable[[str], DataFrame]) -> DataFrame:
        """Written pairs with what `of` gives both sides; a node may be in very many pairs."""
        hot = {side: hot_keys(pairs, side) for side in "ba"}
        return join_dealt(join_dealt(pairs, of("b"), "b", hot=hot["b"]), of("a"), "a", hot=hot["a"])


def near_duplicates(df: DataFrame, *, text: str = "text", row_key: str = "doc_id", width: int = 5, threshold: Fraction = Fraction(4, 5)) -> DataFrame:
    """Components of documents whose sets of `width`-word shingles have a Jaccard similarity of `threshold` or more.

    Returns doc_id, text_key (MD5 of the text), node (the shingle set's hash), n_shingles, component_id and kept, a row
    for each input row. component_id is the smallest row key in the component. Null and blank texts have no shingles and
    link with nothing; their component is their own key. Null keys count as larger than all others: such a row takes the
    component of what it is linked with, and is kept only if nothing it is linked with has a key.

    Documents of equal sets are one node, told by a 128-bit hash of the set. Two nodes are candidates if one of 30 bands of 5
    MinHash values agrees (a pair at 0.8 is missed with a chance of 7 in a million). First each bucket's members are only
    compared with one member, then those of another component again with another, and last all members of buckets that still
    hold several components, except pairs that are in one component already: a group of m copies costs about m comparisons, and
    no link that would join components is left out. Odd sketches (150 samples in 512 bits) drop pairs well below the threshold
    before texts are compared as full sets. Joins deal the members of a large bucket to several tasks (join_dealt). An empty
    table gives an empty result. Written tables go as soon as nothing reads them; what the result reads goes with discard().
    """
    rows = df.select(col(row_key).cast("long").alias("doc_id"), col(text).alias("text"), F.md5(col(text).cast("binary")).alias("text_key"))
    signed = materialize(rows.mapInArrow(lambda it: _sign(it, width), "doc_id long, text_key string, node long, twin long, n_shingles long, bands array<bigint>, sketch array<bigint>"))
    clash = materialize(signed.groupBy("node").agg(F.min("twin").alias("low"), F.max("twin").alias("high")).filter("low < high").select("node", "low"))
    if not clash.isEmpty():  # different sets agree in the first 64 bits: the others tell them apart
        whole, signed = signed, materialize(signed.join(clash, "node", "left").withColumn("node", F.when(F.col("low").isNull() | (F.col("low") == F.col("twin")), F.col("node")).otherwise(F.xxhash64("node", "twin"))).drop("low"))
        discard(whole)
    discard(clash)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("keyless"), "doc_id", "text_key")).alias("one")
    full = signed.filter("n_shingles > 0")
    nodes = materialize(full.groupBy("node").agg(first, F.first("bands").alias("bands"), F.first("sketch").alias("sketch")))
    whole, signed = signed, materialize(signed.select("doc_id", "text_key", "node", "n_shingles"))
    discard(whole)  # bands and sketches are with the nodes
    banded = nodes.select("node", F.explode("bands").alias("band"))
    shared = materialize(banded.groupBy("band").agg(F.min("node").alias("low"), F.max("node").alias("high"), F.count(F.lit(1)).alias("n")).filter("low < high").select("band", "low", "n"))
    hot = hot_keys(shared, "band", shared.select(F.col("band").alias("hot"), "n"))
    members = materialize(join_dealt(banded, shared.drop("n"), "band", hot=hot))
    discard(shared)
    release(df.sparkSession)
    # One text of each node that shares a bucket with another.
    wanted = materialize(members.select("node").distinct().join(nodes.select("node", "one.doc_id", "one.text_key"), "node"))
    key = lambda side: [F.coalesce("doc_id", F.lit(0)).alias(f"{side}_id"), F.col("doc_id").isNull().alias(f"{side}_none"), F.col("text_key").alias(f"{side}_key")]
    same = (F.col("t_id") == F.col("w_id")) & (F.col("t_none") == F.col("w_none")) & (F.col("t_key") == F.col("w_key"))
    texts = rows.select("text", *key("t")).join(wanted.select("node", *key("w")), same)
    texts = materialize(texts.groupBy("node").agg(F.first("text").alias("text")))  # rows repeated in key and text
    discard(wanted)
    release(df.sparkSession)
    check = _Verifier(texts, nodes.select("node", "sketch"), width, threshold)
    links = [check.links(members.filter("low < node").select(F.col("low").alias("a"), F.col("node").alias("b")))]
    found = components(links[0])
    for turn in range(STAR_ROUNDS):
        still = _open(members, found, hot)
        if turn == STAR_ROUNDS - 1 or still.isEmpty():
            break
        centre = still.groupBy("band").agg(F.min_by(F.struct("node", "component"), F.xxhash64("node", F.lit(turn))).alias("centre"))
        star = join_dealt(still, centre, "band", hot=hot).filter("component <> centre.component").select(F.least("node", "centre.node").alias("a"), F.greatest("node", "centre.node").alias("b"))
        links.append(check.links(star))
        discard(found, still)
        found = components(functools.reduce(DataFrame.union, links))
    discard(members)
    if not still.isEmpty():
        links += _rest(still, nodes, check)
        discard(found, texts)
        found = components(functools.reduce(DataFrame.union, links))
    discard(texts, nodes, still, *links)
    release(df.sparkSession)
    labelled = join_dealt(signed.select("doc_id", "text_key", "node", "n_shingles"), found, "node", "left")
    labelled = materialize(labelled.withColumn("component", F.when(F.col("n_shingles") > 0, F.coalesce("component", "node"))))
    discard(signed, found)
    smallest = materialize(labelled.filter("component is not null").groupBy("component").agg(F.min("doc_id").alias("smallest")))
    out = join_dealt(labelled, smallest, "component", "left").withColumn("component_id", F.when(F.col("n_shingles") > 0, F.col("smallest")).otherwise(F.col("doc_id")))
    kept = F.when(F.col("doc_id").isNull(), F.col("component_id").isNull()).otherwise(F.col("doc_id") == F.col("component_id"))
    return resting(out.select("doc_id", "text_key", F.coalesce("component", "node").alias("node"), "n_shingles", "component_id", kept.alias("kept")), labelled, smallest)


def _open(members: DataFrame, found: DataFrame, hot: list[tuple]) -> DataFrame:
    """Members, with their component so far, of buckets that hold more than one component; `hot` are the hot buckets."""
    labelled = members.join(found, "node", "left")  # a node is in BANDS buckets at most
    labelled = materialize(labelled.withColumn("component", F.coalesce("component", "node")).select("band", "node", "component"))
    several = materialize(labelled.groupBy("band").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count(F.lit(1)).alias("size")).filter("low < high").select("band", "size"))
    still = materialize(join_dealt(labelled, several, "band", hot=hot))
    discard(labelled, several)
    return still


def _blocks(members: DataFrame) -> DataFrame:
    """Members of buckets by pairs of blocks (i, j) of about BLOCK members, each in all pairs of its own block."""
    dealt = members.withColumn("blocks", F.ceil(F.col("size") / BLOCK)).withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("blocks")))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    return dealt.withColumn("i", F.least("chunk", "other")).withColumn("j", F.greatest("chunk", "other")).drop("blocks", "other", "size")


def _rest(still: DataFrame, nodes: DataFrame, check: _Verifier) -> list[DataFrame]:
    """Tables of links between different components in the same bucket: pairs of small buckets by a join; large ones in blocks, of sketches
    first, and then of the texts of members that are close to another. Full sets are compared in place, so no more rows come out
    of a block than it has members."""
    few = still.filter(F.col("size") <= SMALL_BUCKET).join(nodes.select("node", "sketch"), "node")
    x = few.select("band", F.col("node").alias("a"), F.col("component").alias("component_a"), F.col("sketch").alias("sketch_a"))
    y = few.select("band", F.col("node").alias("b"), F.col("component").alias("component_b"), F.col("sketch").alias("sketch_b"))
    close = (F.col("a") < F.col("b")) & (F.col("component_a") != F.col("component_b")) & (_differing("sketch_a", "sketch_b") <= MOST_DIFFERING)
    links = check.links(x.join(y, "band").filter(close).select("a", "b"))
    many = still.filter(F.col("size") > SMALL_BUCKET)
    if many.isEmpty():
        return [links]
    many = materialize(many.join(nodes.select("node", "bands", "sketch"), "node"))
    near = _blocks(many.drop("bands")).groupBy("band", "i", "j").applyInPandas(_near_in_block, "band long, node long").distinct()
    near_ones = materialize(many.drop("size").join(near, ["band", "node"]))
    sizes = near_ones.groupBy("band").agg(F.count(F.lit(1)).alias("size"))
    left = join_dealt(near_ones, sizes, "band").join(check.texts, "node")
    rule = check.rule
    found = _blocks(left).select("band", "i", "j", "chunk", "node", "component", "bands", "sketch", "text").groupBy("band", "i", "j").applyInPandas(lambda key, rows: _cross(key, rows, *rule), "a long, b long")
    found = materialize(found)
    discard(many, near_ones)
    return [links, found]


def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents by two-word shingles. Empty and null texts have no shingles and are their own; see near_duplicates()."""
    found = near_duplicates(read(spark, sf_dir, "documents"), width=2)
    return found.select("doc_id", "n_shingles", "component_id", "kept")


def keep_one(docs: DataFrame, width: int = 5, threshold: Fraction = Fraction(4, 5)) -> DataFrame:
    """`docs` with one document of each component: the one of the smallest doc_id. Rows of the same doc_id and text are
    one document and come out once if they are linked with anything or hold shingles; rows without shingles all stay."""
    found = near_duplicates(docs, width=width, threshold=threshold)
    key = [F.col("doc_id").alias("key_id"), F.col("text_key").alias("key_text")]
    gone = materialize(found.filter(~F.col("kept")).select(*key).distinct())
    twice = materialize(found.filter("kept and n_shingles > 0").groupBy(*key).count().filter("count > 1").select("key_id", "key_text"))
    discard(found)
    same = F.col("id").eqNullSafe(F.col("key_id")) & (F.col("digest") == F.col("key_text"))
    rest = packed(docs, {"id": col("doc_id"), "digest": F.coalesce(F.md5(col("text").cast("binary")), F.lit(""))}).join(gone, same, "left_anti")
    if not twice.isEmpty():
        rest = rest.join(twice, same, "left_anti").unionByName(rest.join(twice, same, "left_semi").dropDuplicates(["id", "digest"]))
    return resting(rest.select(*unpacked(docs.columns, [])), gone, twice)
