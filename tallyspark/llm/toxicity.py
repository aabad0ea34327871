"""Toxicity by multiple-instance learning: sentence scores, combined by noisy-or, trained from document labels."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StructField, StructType

from .common import col, numbered, read
from .langid import fold
from .wordhash import NOT_LETTER, U64, find_words, mix, text_chunks, word_hashes

#: Besides itself, a word counts by its first bytes, of each of these numbers, so that forms of a word that the sample lacks still
#: score. Words, and beginnings of each length, are hashed to FEATURE_BITS bits each.
STEM_BYTES, FEATURE_BITS = (4, 5, 6, 7), 18
_KIND_BITS = len(STEM_BYTES).bit_length()
FEATURES = 2 ** (FEATURE_BITS + _KIND_BITS)
#: The classifier is fitted on about this many labelled rows of each label, whole texts.
DOCS_PER_LABEL = 2500
STEPS, RATE, FIRST_BIAS = 200, 0.1, -6.0
#: Features of fewer sampled documents have no weight; weights shrink by SHRINK, and by SHRINK_RARE over a feature's documents.
LEAST_DOCUMENTS, SHRINK, SHRINK_RARE = 6, 1e-5, 3e-3
#: A sentence is called offending from this score on.
OFFENDING = 0.5
OUTPUTS = ["score", "predicted", "offending"]
_ENDS = np.zeros(256, bool)
_ENDS[[ord(c) for c in ".!?\n"]] = True


def sentences(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the sentences of some rows: their features, one after the other and each once a sentence; where each sentence's
    begin; and each sentence's first byte, last byte and row.

    Words are runs of letters; a feature is a word or its stem. Sentences end with . ! ? or a line; those without words do
    not count.
    """
    starts, ends = find_words(data, offsets, NOT_LETTER)
    row = np.searchsorted(offsets, starts, "right") - 1
    number = np.cumsum(_ENDS[data])[starts] if len(starts) else np.zeros(0, np.int64)
    first = np.ones(len(starts), bool)
    first[1:] = (number[1:] != number[:-1]) | (row[1:] != row[:-1])
    head = np.flatnonzero(first)
    own = np.cumsum(first).astype(U64) - U64(1) if len(starts) else np.zeros(0, U64)
    keys = [_keys(own, 0, word_hashes(data, starts, ends))]
    for kind, size in enumerate(STEM_BYTES, 1):
        long = np.flatnonzero(ends - starts > size)  # of shorter words it would be the word itself
        keys.append(_keys(own[long], kind, word_hashes(data, starts[long], starts[long] + size)))
    seen = np.unique(np.concatenate(keys))
    features = (seen & U64(FEATURES - 1)).astype(np.int32)
    begins = np.searchsorted(seen, np.arange(len(head), dtype=U64) << U64(FEATURE_BITS + _KIND_BITS))
    return features, begins, starts[head], ends[np.append(head[1:], len(starts)) - 1] if len(head) else head, row[head]


def _keys(sentence: np.ndarray, kind: int, hashes: np.ndarray) -> np.ndarray:
    return (sentence << U64(FEATURE_BITS + _KIND_BITS)) | U64(kind << FEATURE_BITS) | (hashes >> U64(64 - FEATURE_BITS))


@dataclass
class Model:
    bias: float
    weights: np.ndarray

    def sentence_odds(self, features: np.ndarray, begins: np.ndarray) -> np.ndarray:
        return self.bias + (np.add.reduceat(self.weights[features], begins) if len(begins) else np.zeros(0, np.float32))

    def documents(self, odds: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
        """Noisy-or: 1 - product of (1 - p). A row without sentences scores as one sentence without words."""
        clean = np.bincount(row, np.logaddexp(0, odds), n)
        clean[np.bincount(row, minlength=n) == 0] = np.logaddexp(0, self.bias)
        return -np.expm1(-clean)


def fit(features: np.ndarray, begins: np.ndarray, row: np.ndarray, label: np.ndarray, weight: np.ndarray) -> Model:
    """Adam on the weighted log loss of the documents' noisy-or, over all of the sample at each step; no randomness.

    Weights are not negative: a sentence offends by what it holds, and no clean word beside takes that back. Rare features
    shrink more, so a beginning that many forms of a word share is preferred to the forms.
    """
    model = Model(FIRST_BIAS, np.zeros(FEATURES, np.float32))
    if not len(begins) or not (0 < label.sum() < len(label)):
        return model
    size = np.diff(np.append(begins, len(features)))
    held = np.unique(features.astype(np.int64) * len(label) + np.repeat(row, size)) // len(label)
    used, documents = np.unique(held, return_counts=True)
    features = np.searchsorted(used, features)
    rare = documents < LEAST_DOCUMENTS
    w, moment, square = np.zeros(len(used) + 1), np.zeros(len(used) + 1), np.zeros(len(used) + 1)
    w[-1] = FIRST_BIAS
    shrink = SHRINK + SHRINK_RARE / documents
    weight = weight / weight.sum()
    for step in range(1, STEPS + 1):
        odds = w[-1] + np.add.reduceat(w[:-1][features], begins)
        clean = np.bincount(row, np.logaddexp(0, odds), len(label))
        push = np.where(label > 0, -1 / np.expm1(np.clip(clean, 1e-9, 500)), 1.0) * weight
        slope = push[row] / (1 + np.exp(np.clip(-odds, -500, 500)))
        grad = np.append(np.bincount(features, np.repeat(slope, size), len(used)), slope.sum())
        grad[:-1] += shrink * w[:-1]
        grad[:-1][rare] = 0
        moment = 0.9 * moment + 0.1 * grad
        square = 0.99 * square + 0.01 * grad**2
        w -= RATE * (moment / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-6)
        w[:-1] = np.maximum(w[:-1], 0)
    model.bias = float(w[-1])
    model.weights[used] = w[:-1]
    return model


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(place, label, text) to (place, label, features, begins) a row."""
    for batch in batches:
        for lo, hi, data, offsets in text_chunks(batch.column("text")):
            features, begins, _, _, row = sentences(data, offsets)
            cut = np.searchsorted(row, np.arange(hi - lo + 1))
            word = np.append(begins, len(features))[cut]
            part = batch.slice(lo, hi - lo)
            lists = ([features[word[r] : word[r + 1]] for r in range(hi - lo)], [begins[cut[r] : cut[r + 1]] - word[r] for r in range(hi - lo)])
            yield pa.RecordBatch.from_arrays([*[part.column(c) for c in ("place", "label")], *[pa.array(x, pa.list_(pa.int32())) for x in lists]], names=["place", "label", "features", "begins"])


def train(docs: DataFrame, labels: DataFrame, *, docs_per_label: int = DOCS_PER_LABEL) -> Model:
    """A model from documents (doc_id, text) and labels (doc_id, label; null labels, keys and texts teach nothing).

    Fitted on the driver on a bounded sample, about `docs_per_label` rows of each label by hash of the key; both labels weigh
    alike in sum, as toxic documents are few and a missed one counts as much as all clean ones of its share. Several labels
    of a document count as their maximum; rows repeated in key and text count each. The sampled keys are few, so they are
    broadcast, and only hashed features of their whole texts come to the driver.
    """
    one = labels.filter("doc_id is not null and label is not null").groupBy("doc_id").agg(F.max((F.col("label") > 0).cast("int")).alias("label"))
    share = {r.label: min(1.0, docs_per_label / r.n) for r in one.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    quota = F.when(F.col("label") > 0, share.get(1, 1.0)).otherwise(share.get(0, 1.0))
    draw = F.pmod(F.xxhash64("doc_id", F.lit("toxicity")), F.lit(1_000_000))
    chosen = one.filter(draw < quota * 1_000_000).select(F.col("doc_id").alias("__id"), "label")
    rows = docs.select("doc_id", "text").filter("text is not null").join(F.broadcast(chosen), F.col("doc_id") == F.col("__id"))
    rows = rows.select(F.xxhash64("doc_id", "text").alias("place"), "label", "text")
    table = rows.mapInArrow(_extract, "place long, label int, features array<int>, begins array<int>").toArrow()
    if not table.num_rows:
        return fit(np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0))
    table = table.sort_by("place").combine_chunks()  # whatever order tasks end in
    features, begins = (table[c].combine_chunks() for c in ("features", "begins"))
    label = table["label"].to_numpy()
    n, m = (np.diff(x.offsets.to_numpy()) for x in (features, begins))
    where = np.concatenate([[0], np.cumsum(n)])[:-1]
    return fit(features.flatten().to_numpy(), begins.flatten().to_numpy().astype(np.int64) + np.repeat(where, m), np.repeat(np.arange(len(m)), m), label, 1 / np.bincount(label, minlength=2)[label])


def score(df: DataFrame, model: Model, *, text: str = "text", keep: list[str]) -> DataFrame:
    """Columns `keep` of `df` with score (0 to 1), predicted (1 from 0.5 on) and offending: byte spans and scores of the
    sentences that score OFFENDING or more. Null texts score as empty ones. Whole texts are read. Equal texts get equal
    results; an empty table gives an empty result. Columns of `keep` named as an output are replaced."""
    keep = [c for c in keep if c.lower() not in OUTPUTS]
    shared = df.sparkSession.sparkContext.broadcast(model)  # FEATURES weights
    span = StructType([StructField("start", LongType()), StructField("end", LongType()), StructField("score", DoubleType())])
    spans = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in text_chunks(batch.column(len(keep))):
                features, begins, opens, closes, row = sentences(data, offsets)
                odds = shared.value.sentence_odds(features, begins)
                total = shared.value.documents(odds, row, hi - lo)
                found: list[list[dict]] = [[] for _ in range(hi - lo)]
                for s in np.flatnonzero(odds >= np.log(OFFENDING / (1 - OFFENDING))):
                    r = row[s]
                    found[r].append({"start": int(opens[s] - offsets[r]), "end": int(closes[s] - offsets[r]), "score": float(1 / (1 + np.exp(-float(odds[s]))))})
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([*[part.column(i) for i in range(len(keep))], pa.array(total, pa.float64()), pa.array((total >= 0.5).astype(np.int32)), pa.array(found, spans)], names=[*keep, *OUTPUTS])

    kept = [next(f for f in df.schema.fields if f.name == c) for c in keep]
    schema = StructType([*kept, StructField("score", DoubleType()), StructField("predicted", IntegerType()), StructField("offending", ArrayType(span))])
    return df.select(*numbered(keep), col(text).alias("text")).mapInArrow(run, schema)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity of every whole text of documents, learned from labels.toxic. Rows without key are not held out."""
    docs = read(spark, sf_dir, "documents")
    labels = read(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("label")).filter(fold(F.col("doc_id"), 5) != 0)
    held = docs.select("doc_id", "text", F.coalesce(fold(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out"))
    return score(held, train(docs, labels), keep=["doc_id", "held_out"])
