"""Language identification: known words by per-language log frequency, unseen words by ever shorter character n-grams."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .common import col, numbered, read
from .wordhash import U64, forget, mix, powers, runs

UNKNOWN = "und"
#: The model is fitted on about so many labelled rows of each language, drawn by hash of their row key: a share of SAMPLE rows,
#: but within these limits. Every language is learned, from whole texts; the model holds what those rows hold.
SAMPLE, LEAST_ROWS, MOST_ROWS = 40_000, 200, 4000
#: Frequencies are smoothed as if each language had so many more words (or n-grams), spread as over all languages.
POOLED = 1.0
GRAMS = (4, 3, 2, 1)
CHUNK_BYTES = 400_000
OUTPUTS = ["lang_pred", "score"]
_OPEN, _CLOSE = 2, 3


def _letters() -> tuple[np.ndarray, np.ndarray]:
    """By code point: is it a letter; can it stand in a word (letters and marks)."""
    kinds = [unicodedata.category(chr(c))[0] for c in range(0x110000)]
    kinds = np.array(kinds)
    return kinds == "L", (kinds == "L") | (kinds == "M")


_tables: dict = {}


def tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    if not _tables:
        _tables["t"] = (*_letters(), mix(np.arange(1, 0x110001, dtype=U64)) | U64(1))
    return _tables["t"]


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of lower-cased texts, a line feed after each, and offsets of the texts."""
    lower = [t.lower() for t in texts]
    data = np.frombuffer(("\n".join(lower) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
    return data, np.concatenate([[0], np.cumsum([len(t) + 1 for t in lower])])


def words_of(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edges = np.flatnonzero(np.diff(np.concatenate([[0], tables()[1][data].astype(np.int8), [0]])))
    return edges[::2], edges[1::2]


def _sums(data: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        out = np.zeros(len(data) + 1, U64)
        np.cumsum(tables()[2][data] * powers(len(data) + 1)[0][:-1], out=out[1:])
    return out


def _hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix((sums[ends] - sums[starts]) * powers(len(sums))[1][starts] + (ends - starts).astype(U64))


def token_hash(token: str) -> int:
    data = np.array([ord(c) for c in token], np.uint32)
    return int(_hashes(_sums(data), np.array([0]), np.array([len(data)]))[0])


def framed(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words with a mark before and after, one after the other, and where each begins (and the last ends)."""
    n = ends - starts + 2
    begin = np.concatenate([[0], np.cumsum(n)])
    at = np.arange(begin[-1]) + np.repeat(starts - 1 - begin[:-1], n)
    out = data[np.clip(at, 0, max(0, len(data) - 1))] if len(data) else np.zeros(0, np.uint32)
    out[begin[:-1]], out[begin[1:] - 1] = _OPEN, _CLOSE
    return out, begin


@dataclass
class Table:
    """Of words, or of n-grams of one length: sorted hashes; for each its languages, and what it adds to their logs over a word
    that the language lacks; and by language the log of what such a word loses against its frequency over all languages."""

    keys: np.ndarray
    cuts: np.ndarray
    langs: np.ndarray
    gains: np.ndarray
    lacking: np.ndarray

    @classmethod
    def of(cls, lang: np.ndarray, key: np.ndarray, n: np.ndarray, languages: int) -> Table:
        """(c + m q) / (N + m), with q a key's share over all languages and m = POOLED, over q: the same for every language but
        for the gain log((c + m q) / (m q)) where c > 0, and log(m / (N + m))."""
        order = np.lexsort((lang, key))
        lang, key, n = lang[order], key[order], n[order].astype(np.float64)
        keys, first = np.unique(key, return_index=True)
        cuts = np.append(first, len(key))
        share = np.add.reduceat(n, first) / n.sum() if len(key) else n
        pooled = POOLED * np.repeat(share, np.diff(cuts))
        mass = np.bincount(lang, n, languages)
        return cls(keys, cuts, lang.astype(np.int32), np.log((n + pooled) / pooled).astype(np.float32), np.log(POOLED / (mass + POOLED)))

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Place of each hash, or -1."""
        if not len(self.keys):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
        return np.where(self.keys[at] == hashes, at, -1)

    def add(self, total: np.ndarray, place: np.ndarray, doc: np.ndarray, weight: np.ndarray) -> None:
        """Adds the logs of keys, so weighted, to their documents' totals (documents, languages)."""
        docs, languages = total.shape
        many = np.diff(self.cuts)[place]
        at = np.arange(many.sum()) + np.repeat(self.cuts[place] - (np.cumsum(many) - many), many)
        cell = np.repeat(doc * languages, many) + self.langs[at]
        total += np.bincount(cell, self.gains[at] * np.repeat(weight, many), docs * languages).reshape(total.shape)
        total += np.bincount(doc, weight, docs)[:, None] * self.lacking


@dataclass
class Model:
    """Languages in code-point order, log shares of their rows, and tables of words (0) and of n-grams of each length."""

    languages: list[str]
    prior: np.ndarray
    tables: dict[int, Table] = field(default_factory=dict)

    @classmethod
    def of_table(cls, counts: pa.Table, docs: dict[str, int]) -> Model:
        """From columns lang, kind (0 or n), key and n, and the labelled rows of each language."""
        languages = sorted(docs)
        at = {name: i for i, name in enumerate(languages)}
        out = cls(languages, np.log(np.array([docs[x] for x in languages]) / max(1, sum(docs.values()))))
        names = counts["lang"].combine_chunks().dictionary_encode()
        names = names.combine_chunks() if isinstance(names, pa.ChunkedArray) else names
        lang = np.array([at[x] for x in names.dictionary.to_pylist()], np.int64)[names.indices.to_numpy()] if len(names) else np.zeros(0, np.int64)
        kind, key, n = (counts[c].to_numpy() for c in ("kind", "key", "n"))
        for k in (0, *GRAMS):
            of = kind == k
            out.tables[k] = Table.of(lang[of], key[of].view(U64), n[of], len(languages))
        return out

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """Language and score of each text. A word that some language knows counts by its log frequencies; of another, from
        each letter the longest n-gram that some language knows counts, and the word by their mean. The score is the
        posterior of the language, from the sum of the words' logs over the root of their number; of equal ones the
        first language in code-point order."""
        data, offsets = code_points(texts)
        letter = np.add.reduceat(tables()[0][data].astype(np.int64), offsets[:-1]) > 0 if len(texts) else np.zeros(0, bool)
        starts, ends = words_of(data)
        if not self.languages or not len(starts):
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        place = self.tables[0].find(_hashes(_sums(data), starts, ends))
        doc = np.searchsorted(offsets, starts, "right") - 1
        total, seen = np.zeros((len(texts), len(self.languages))), place >= 0
        self.tables[0].add(total, place[seen], doc[seen], np.ones(seen.sum()))
        if not seen.all():
            letters, begin = framed(data, starts[~seen], ends[~seen])
            sums, last = _sums(letters), np.repeat(begin[1:], np.diff(begin))
            own, weight = np.repeat(doc[~seen], np.diff(begin)), np.repeat(1 / np.diff(begin), np.diff(begin))
            left = np.arange(begin[-1])  # letters from which no n-gram is known yet
            for k in GRAMS:
                fits = left + k <= last[left]
                at = np.full(len(left), -1)
                at[fits] = self.tables[k].find(_hashes(sums, left[fits], left[fits] + k))
                hit = left[at >= 0]
                self.tables[k].add(total, at[at >= 0], own[hit], weight[hit])
                left = left[at < 0]
        n = np.bincount(doc, minlength=len(texts))
        odds = total / np.sqrt(np.maximum(n, 1))[:, None] + self.prior
        odds -= odds.max(1, keepdims=True)
        share = np.exp(odds) / np.exp(odds).sum(1, keepdims=True)
        best = share.argmax(1)
        return [self.languages[b] if ok else UNKNOWN for b, ok in zip(best, letter, strict=True)], np.where(letter, share[np.arange(len(texts)), best], 0.0)


def count_keys(texts: list[str]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(0 or n, hashes, counts) of the words of some texts, and of their n-grams of each length."""
    data, _ = code_points(texts)
    starts, ends = words_of(data)
    words, first, n = np.unique(_hashes(_sums(data), starts, ends), return_index=True, return_counts=True)
    yield 0, words, n
    letters, begin = framed(data, starts[first], ends[first])
    sums, last, many = _sums(letters), np.repeat(begin[1:], np.diff(begin)), np.repeat(n, np.diff(begin))
    for k in GRAMS:
        at = np.flatnonzero(np.arange(begin[-1]) + k <= last)
        keys, which = np.unique(_hashes(sums, at, at + k), return_inverse=True)
        yield k, keys, np.bincount(which, many[at], len(keys)).astype(np.int64)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, text) to (lang, kind, key, n), summed within runs of rows."""
    for batch in batches:
        for part in runs(batch, 1, CHUNK_BYTES):
            by_lang: dict[str, list[str]] = {}
            for lang, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                by_lang.setdefault(lang, []).append(text)
            for lang, texts in by_lang.items():
                for kind, keys, n in count_keys(texts):
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(np.full(len(keys), kind, np.int32)), pa.array(keys.view(np.int64)), pa.array(n)], names=["lang", "kind", "key", "n"])
    forget()


def train(labelled: DataFrame, *, row_key: str = "doc_id", sample: int = SAMPLE) -> Model:
    """A model from rows (row_key, text, lang) of every language there is. Rows without text or lang teach nothing; rows
    of equal key (null among them) and text are drawn alike.

    It is fitted on a bounded sample of whole labelled rows: of each language about `sample` over the number of languages,
    from LEAST_ROWS to MOST_ROWS. Only counts of those rows' words and n-grams come to the driver, as hashes.
    """
    usable = labelled.filter(col("text").isNotNull() & col("lang").isNotNull()).select(col(row_key).alias("key"), col("text").alias("text"), col("lang").alias("lang"))
    sizes = usable.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    docs = {r.lang: r.n for r in sizes.collect()}  # a row for each language
    quota = min(MOST_ROWS, max(LEAST_ROWS, sample // max(1, len(docs))))
    draw = F.pmod(F.xxhash64("key", F.hash("text"), F.lit("langid")), F.lit(1_000_000))
    all_of = [lang for lang, n in docs.items() if n <= quota]
    share = usable.sparkSession.createDataFrame([(lang, int(1e6 * quota / n)) for lang, n in docs.items() if n > quota], "of string, share long")
    few = usable.join(F.broadcast(usable.sparkSession.createDataFrame([(x,) for x in all_of], "of string")), F.col("lang") == F.col("of"), "left_semi")
    many = usable.join(F.broadcast(share), F.col("lang") == F.col("of")).filter(draw < F.col("share"))  # both broadcasts: a row for each language
    rows = few.select("lang", "text").unionAll(many.select("lang", "text"))
    counts = rows.mapInArrow(_count, "lang string, kind int, key long, n long").groupBy("lang", "kind", "key").agg(F.sum("n").alias("n"))
    return Model.of_table(counts.toArrow(), docs)


def predict(df: DataFrame, model: Model, *, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """`df` (its columns `keep`, all by default) with lang_pred and score. Whole texts are read; `und` and 0 for null or
    for texts without a letter, or if no language was learned. Equal texts get equal results; an empty table gives an empty
    result. Columns named as an output are replaced; others clash with nothing."""
    keep = [c for c in (df.columns if keep is None else keep) if c.lower() not in OUTPUTS]
    size = max(20_000, CHUNK_BYTES * 8 // max(8, len(model.languages)))
    shared = df.sparkSession.sparkContext.broadcast(model)  # bounded by the sample it was fitted on
    source = keep.index(text) if text in keep else len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in runs(batch, source, size):  # only such a run is held as Python strings
                names, scores = shared.value.predict([t or "" for t in part.column(source).to_pylist()])
                yield pa.RecordBatch.from_arrays([*[part.column(i) for i in range(len(keep))], pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=[*keep, *OUTPUTS])
        forget()

    schema = StructType([*[next(f for f in df.schema.fields if f.name == c) for c in keep], StructField("lang_pred", StringType()), StructField("score", DoubleType())])
    return df.select(*numbered(keep), *([] if source < len(keep) else [col(text).alias("text")])).mapInArrow(run, schema)


def fold(key: Column, folds: int) -> Column:
    """crc32 of the key as text, modulo `folds`; null for a null key."""
    return F.crc32(key.cast("string").cast("binary")) % folds


def learned(docs: DataFrame) -> Model:
    """The model that op6 and the pipeline use: fitted on the rows that are not held out."""
    return train(docs.filter(fold(F.col("doc_id"), 4) != 2).select("doc_id", "text", "lang"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every whole text of documents. `und` for null and letterless texts; rows without key are not held out."""
    docs = read(spark, sf_dir, "documents")
    held = docs.select("doc_id", "text", F.coalesce(fold(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out"))
    return predict(held, learned(docs), keep=["doc_id", "held_out"])
