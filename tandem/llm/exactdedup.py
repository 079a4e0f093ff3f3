"""Exact duplicates by counting quotient filters.

A fingerprint (XXH64 of the text after lower-casing A-Z) is split into quotient and remainder; a filter keeps the sorted
remainders of each quotient with their counts. Each task builds a filter for each slice of the fingerprint space; the
filters of a slice merge without loss, as their sorted entries do. Only texts whose fingerprint counts more than one are
read again, and those are grouped by their bytes, so that no collision can make two texts equal.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, each_text, need, one_row_each, partitions, prepare, rows, trimmed, without_rows, written

#: Distinct fingerprints that a task holds before it passes its filters on.
HELD = 4_000_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class CountingQuotientFilter:
    """Sorted distinct keys of ``width`` bits with counts, kept as quotients, remainders and counters.

    occupied has a bit for each quotient, ends a bit for each entry that is the last of its quotient, remainders the low
    bits of each entry in whole bytes, counters a byte for each entry; larger counts are kept aside. Nothing is lost:
    ``items`` gives back the keys and counts.
    """

    def __init__(self, keys: np.ndarray, counts: np.ndarray, width: int):
        self.width, self.n = width, len(keys)
        self.q = min(width, max(3, int(self.n).bit_length()))
        r = width - self.q
        quotients = (keys >> np.uint64(r) if r < 64 else np.zeros_like(keys)).astype(np.int64)
        occupied = np.zeros(1 << self.q, bool)
        occupied[quotients] = True
        self.occupied = np.packbits(occupied)
        self.ends = np.packbits(np.append(np.diff(quotients) != 0, True)[: self.n])
        size = (r + 7) // 8
        low = keys & np.uint64((1 << r) - 1)
        self.remainders = low.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :size].tobytes()
        self.counters = np.minimum(counts, 255).astype(np.uint8)
        self.above = counts[counts >= 255].astype("<u8")

    def to_bytes(self) -> bytes:
        return np.array([self.width, self.n, len(self.above)], "<u8").tobytes() + self.occupied.tobytes() + self.ends.tobytes() + self.remainders + self.counters.tobytes() + self.above.tobytes()

    @staticmethod
    def items_of(data: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Sorted keys and their counts from a filter's bytes."""
        width, n, above = np.frombuffer(data, "<u8", 3).astype(int).tolist()
        q = min(width, max(3, int(n).bit_length()))
        r = width - q
        size = (r + 7) // 8
        cuts = np.cumsum([24, (1 << q) // 8, (n + 7) // 8, n * size, n, above * 8]).tolist()
        part = [data[a:b] for a, b in zip(cuts, cuts[1:])]
        quotients = np.flatnonzero(np.unpackbits(np.frombuffer(part[0], np.uint8)))
        ends = np.unpackbits(np.frombuffer(part[1], np.uint8), count=n)
        of = np.cumsum(ends) - ends
        low = np.zeros((n, 8), np.uint8)
        low[:, :size] = np.frombuffer(part[2], np.uint8).reshape(n, size)
        keys = low.view("<u8").ravel()
        if n and r < 64:
            keys = keys | (quotients[of].astype(np.uint64) << np.uint64(r))
        counts = np.frombuffer(part[3], np.uint8).astype(np.int64)
        counts[counts == 255] = np.frombuffer(part[4], "<u8").astype(np.int64)
        return keys, counts

    @classmethod
    def merged(cls, filters: list[bytes], width: int) -> CountingQuotientFilter:
        """One filter with the counts of all: entries meet in sorted order, equal ones add up."""
        keys, counts = zip(*map(cls.items_of, filters))
        return cls(*_summed(np.concatenate(keys), np.concatenate(counts)), width)


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return keys.astype(np.uint64), counts.astype(np.int64)
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return keys[first], np.add.reduceat(counts, first)


_TEXTS = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("fp", pa.int64()), ("text_sha256", pa.string())])
_FILTERS = pa.schema([("slice", pa.int32()), ("filter", pa.binary())])


def _read_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = list(each_text(b.column(2), lower=True))
        fps = np.fromiter((xxhash.xxh64_intdigest(t, 42) for t in texts), np.uint64, len(texts)).view(np.int64)
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fps), pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string())], schema=_TEXTS)


def _filters(bits: int):
    """Batches of fp to a filter for each slice (the top ``bits`` bits)."""

    def full(held: list[np.ndarray]) -> pa.RecordBatch:
        keys, counts = np.unique(np.concatenate(held), return_counts=True)
        cuts = np.searchsorted(keys >> np.uint64(64 - bits), np.arange((1 << bits) + 1, dtype=np.uint64)) if bits else np.array([0, len(keys)])
        mask = np.uint64((1 << (64 - bits)) - 1)
        found = [(s, CountingQuotientFilter(keys[a:b] & mask, counts[a:b], 64 - bits).to_bytes()) for s, (a, b) in enumerate(zip(cuts.tolist(), cuts[1:].tolist())) if a < b]
        return rows(_FILTERS, slice=[s for s, _ in found], filter=[f for _, f in found])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            held.append(b.column(0).to_numpy().view(np.uint64))
            n += len(held[-1])
            if n >= HELD:
                yield full(held)
                held, n = [], 0
        if n:
            yield full(held)

    return run


def _merge(bits: int):
    """Filters sorted by slice to the fingerprints that count more than one."""

    def repeated(s: int, filters: list[bytes]) -> pa.RecordBatch:
        keys, counts = CountingQuotientFilter.items_of(CountingQuotientFilter.merged(filters, 64 - bits).to_bytes())
        keys = keys[counts > 1] | (np.uint64(s << (64 - bits)) if bits else np.uint64(0))
        return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(counts[counts > 1])], names=["fp", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for b in batches:
            for s, f in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if s != now and held:
                    yield repeated(now, held)
                    held = []
                now = s
                held.append(f)
        if held:
            yield repeated(now, held)

    return run


def repeated_fingerprints(fps: DataFrame) -> DataFrame:
    """(fp, n) of the fingerprints (column fp, a 64-bit long) that occur more than once."""
    n = partitions(fps.sparkSession)
    bits = min(20, (n - 1).bit_length())
    filters = fps.select("fp").mapInArrow(trimmed(_filters(bits)), "slice int, filter binary")
    return filters.repartition(n, "slice").sortWithinPartitions("slice").mapInArrow(trimmed(_merge(bits)), "fp long, n long")


def exact_groups(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256, text_hash for each row of docs.

    Texts are equal when identical after lower-casing A-Z; null counts as empty. keep_id is the largest doc_id of the
    group. Repeated rows (one doc_id twice) count in group_size and share a decision. A null doc_id is never the one
    that stays beside another. Empty table: no rows. Further columns of docs are not looked at.
    """
    need(docs, "doc_id", "text")
    prepare(docs.sparkSession)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    read = written(named.mapInArrow(trimmed(_read_texts), "doc_id long, text_hash long, fp long, text_sha256 string"), "texts")
    again = written(repeated_fingerprints(read), "repeated")
    spellings = written(read.join(again, "fp", "left_semi").select(F.col("text_hash").alias("h")).distinct(), "spellings")
    small = spellings.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    twice = named.join(F.broadcast(spellings) if small else spellings.hint("merge"), F.col("text_hash") == F.col("h"), "left_semi")
    same = twice.groupBy(F.translate("text", UPPER, LOWER).alias("bytes")).agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    groups = written(same.select(F.sha2("bytes", 256).alias("sha"), "keep_id", "group_size"), "groups")
    out = read.join(groups, F.col("text_sha256") == F.col("sha"), "left")
    keep = F.when(F.col("sha").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return out.select("doc_id", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"), F.col("doc_id").eqNullSafe(keep).alias("kept"), "text_sha256", "text_hash")


def unique_texts(docs: DataFrame) -> DataFrame:
    """docs without exact copies: of equal texts the row with the largest doc_id stays, once, whole and unchanged."""
    found = written(exact_groups(docs), "exact")
    drop = found.where("not kept").select(F.col("doc_id").alias("k0"), F.col("text_hash").alias("k1")).distinct()
    text = F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))
    kept = without_rows(docs, [F.col("doc_id").cast("long"), text], written(drop, "dropped"))
    return one_row_each(kept, found.where("kept"), "text_sha256", text)
