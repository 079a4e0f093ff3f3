"""Language identification: multinomial naive Bayes over hashed character n-grams.

The classifier learns from a bounded sample of labelled rows, ``rows_per_lang`` of each language at most, taken by a hash
of doc_id (all rows where there are fewer). Its matrix of log-probabilities (``BUCKETS`` rows, one column for each
language, of which there may be ``MOST_LANGS``) is broadcast; a batch of texts is scored as a sparse matrix of n-gram
counts times that matrix, by gathering and segment sums. Every text counts whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import need, prepare, rows, trimmed, utf8, without_rows, written

BUCKETS, ORDERS, MOST_LANGS = 1 << 16, (2, 3), 1000
#: Characters of texts that are hashed at once.
_PIECE = 1 << 20
UNKNOWN = "und"
#: Letters, and numerals that aren't decimal digits.
_WORD = re.compile(r"[^\W\d_]")
_A, _B = np.uint32(0x9E3779B1), np.uint32(0x85EBCA77)


def has_letter(text: str) -> bool:
    """Whether the text has a character of a letter category (L), which numerals such as a half are not."""
    return any(m.group().isalpha() for m in _WORD.finditer(text))


def hashed(text: bytes) -> np.ndarray:
    """The buckets of a text's character n-grams (A-Z lower-cased, orders 2 and 3; a single character counts as one)."""
    c = np.frombuffer(text.decode("utf-8", "replace").encode("utf-32-le", "replace"), np.uint32)
    if len(c) < 2:
        return (c * _A) >> np.uint32(16)
    two = (c[:-1] * _A + c[1:]) * _B
    three = (two[:-1] + c[2:]) * _A
    return np.concatenate([two >> np.uint32(16), three >> np.uint32(16)])


def _pieces(text: bytes) -> Iterator[bytes]:
    """The text in pieces that overlap by two characters' n-grams; nearly always one piece."""
    if len(text) <= _PIECE:
        yield text
        return
    whole = text.decode("utf-8", "replace")
    for i in range(0, max(1, len(whole) - 2), _PIECE):
        yield whole[i : i + _PIECE + 2].encode()


@dataclass
class NaiveBayes:
    langs: list[str]
    log_prob: np.ndarray  # languages x buckets
    log_prior: np.ndarray

    @classmethod
    def fit(cls, langs: list[str], counts: np.ndarray, n_rows: np.ndarray, smoothing: float = 0.5) -> NaiveBayes:
        c = counts + smoothing
        return cls(langs, np.log(c / c.sum(axis=1, keepdims=True)), np.log(n_rows / n_rows.sum()) if len(langs) else np.zeros(0))

    def scores(self, texts: list[bytes]) -> np.ndarray:
        """Log-probabilities, texts x languages."""
        out = np.tile(self.log_prior, (len(texts), 1))
        at, size, grams = [], 0, []

        def add() -> None:
            n = np.array([len(g) for g in grams])
            owner = np.array(at)[n > 0]
            h = np.concatenate(grams) if len(grams) else np.zeros(0, np.uint32)
            starts = (np.cumsum(n) - n)[n > 0]
            if len(h):
                for k, column in enumerate(self.log_prob):
                    np.add.at(out[:, k], owner, np.add.reduceat(column[h], starts))

        for i, t in enumerate(texts):
            for piece in _pieces(t):
                at.append(i)
                grams.append(hashed(piece))
                size += len(grams[-1])
                if size > _PIECE:
                    add()
                    at, size, grams = [], 0, []
        add()
        return out

    def predict(self, texts: list[bytes]) -> tuple[list[int], np.ndarray]:
        """The best language's number and its posterior probability; -1 and 0 for a text without a letter."""
        if not self.langs:
            return [-1] * len(texts), np.zeros(len(texts))
        s = self.scores(texts)
        best = s.argmax(axis=1)
        p = 1 / np.exp(s - s.max(axis=1, keepdims=True)).sum(axis=1)
        lettered = np.array([has_letter(t.decode("utf-8", "replace")) for t in texts], bool)
        return np.where(lettered, best, -1).tolist(), np.where(lettered, p, 0.0)


def _count(langs: list[str]):
    """Batches of (lang, text) to one row of n-gram counts for each language that a task saw."""
    number = {x: i for i, x in enumerate(langs)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[int, np.ndarray] = {}
        seen: dict[int, int] = {}
        for b in batches:
            data, at = utf8(b.column(1))
            data = data.lower()
            for lang, i, j in zip(b.column(0).to_pylist(), at.tolist(), at[1:].tolist()):
                k = number[lang]
                for piece in _pieces(data[i:j]):
                    found = np.bincount(hashed(piece), minlength=BUCKETS)
                    counts[k] = counts[k] + found if k in counts else found
                seen[k] = seen.get(k, 0) + 1
        yield rows(pa.schema([("lang", pa.int32()), ("n", pa.int64()), ("counts", pa.binary())]), lang=list(seen), n=list(seen.values()), counts=[counts[k].astype("<i8").tobytes() for k in seen])

    return run


def fit(labelled: DataFrame, rows_per_lang: int = 4000, tasks: int = 8) -> NaiveBayes:
    """The classifier from rows (doc_id, text, lang) of which none is null in text or lang; no rows: it knows no language."""
    prepare(labelled.sparkSession)
    sizes = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).orderBy("lang").limit(MOST_LANGS + 1).collect()}
    if len(sizes) > MOST_LANGS:
        raise ValueError(f"more than {MOST_LANGS} languages")
    langs = list(sizes)
    if not langs:
        return NaiveBayes([], np.zeros((0, BUCKETS)), np.zeros(0))
    shares = F.create_map(*[F.lit(v) for k, n in sizes.items() for v in (k, min(1.0, rows_per_lang / n))])
    dice = F.pmod(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("langid")), F.lit(1 << 30)) / float(1 << 30)
    sample = labelled.where(dice < shares[F.col("lang")]).select("lang", F.col("text").cast("string").alias("text")).repartition(tasks)
    counts, n_rows = np.zeros((len(langs), BUCKETS)), np.full(len(langs), 1e-9)
    for r in sample.mapInArrow(trimmed(_count(langs)), "lang int, n long, counts binary").toLocalIterator():
        counts[r["lang"]] += np.frombuffer(r["counts"], "<i8")
        n_rows[r["lang"]] += r["n"]
    return NaiveBayes.fit(langs, counts, np.array([float(n) for n in sizes.values()]))


_PREDICTED = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())])


def predict(docs: DataFrame, model: NaiveBayes) -> DataFrame:
    """doc_id, text_hash, lang_pred and score (posterior probability, 0 to 1) of each row, from its whole text alone.

    Null texts and texts without a letter are ``und`` with score 0, and so is every text where nothing was learned.
    """
    need(docs, "doc_id", "text")
    spark = prepare(docs.sparkSession)
    shared = spark.sparkContext.broadcast((model.langs, model.log_prob, model.log_prior))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = NaiveBayes(*shared.value)
        names = [*m.langs, UNKNOWN]
        for b in batches:
            data, at = utf8(b.column(2))
            data = data.lower()
            best, p = m.predict([data[i:j] for i, j in zip(at.tolist(), at[1:].tolist())])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([names[k] for k in best], pa.string()), pa.array(p, pa.float64())], schema=_PREDICTED)

    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), F.col("text").cast("string").alias("text"))
    return named.mapInArrow(trimmed(run), "doc_id long, text_hash long, lang_pred string, score double")


def held_out(doc_id) -> object:
    """Rows that are never learned from: crc32 of doc_id as text is a multiple of 5 (null: the empty text)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 5 == 0


def labelled_rows(docs: DataFrame) -> DataFrame:
    need(docs, "doc_id", "text", "lang")
    return docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", "text", "lang")


def known_language(docs: DataFrame, least: float = 0.5, rows_per_lang: int = 4000) -> DataFrame:
    """docs without rows whose language can't be told: text null or without a letter, or posterior under ``least``.

    Rows that stay are unchanged, repeated rows included.
    """
    found = predict(docs, fit(labelled_rows(docs), rows_per_lang))
    drop = found.where((F.col("lang_pred") == UNKNOWN) | (F.col("score") < least)).select(F.col("doc_id").alias("k0"), F.col("text_hash").alias("k1")).distinct()
    return without_rows(docs, [F.col("doc_id").cast("long"), F.xxhash64("text")], written(drop, "rejected"))
