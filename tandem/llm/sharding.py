"""Shards of near-equal bytes by a minimax contiguous partition.

Equal texts are one atomic group; groups follow each other by their smallest doc_id. The smallest capacity at which a
greedy pass needs no more than the allowed shards is found by binary search, and the cuts are made at that capacity.

The driver never holds the groups. It holds runs of them (a range of keys, its bytes, its number of groups), at first a
few thousand of equal width. Cutting between runs only gives a capacity that is too large by one run at most, so every
cut lies within known runs; those are split finer by a pass over the groups' sizes until they hold single groups.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import need, prepare, rows, running_sum, written

#: Runs that a pass makes, at most.
RUNS = 8192
_SUMS = pa.schema([("run", pa.int32()), ("size", pa.int64()), ("n", pa.int64())])


@dataclass
class Run:
    first: int  # keys, both included
    last: int
    size: int
    n: int


def shards_needed(ends: np.ndarray, capacity: int) -> int:
    """How many shards a greedy pass takes over atoms whose running sums are ``ends``; each atom fits the capacity."""
    n, start = 0, 0
    while start < ends[-1]:
        start = int(ends[np.searchsorted(ends, start + capacity, side="right") - 1])
        n += 1
    return n


def least_capacity(sizes: np.ndarray, shards: int) -> int:
    """The smallest capacity for which ``shards`` contiguous parts suffice; no atoms: 0."""
    if not len(sizes):
        return 0
    ends = np.cumsum(sizes)
    low, high = max(int(sizes.max()), -(-int(ends[-1]) // shards)), int(ends[-1])
    while low < high:
        middle = (low + high) // 2
        if shards_needed(ends, middle) <= shards:
            high = middle
        else:
            low = middle + 1
    return low


def _sums(starts: np.ndarray, stops: np.ndarray):
    """Batches of (key, size) to the size and number of keys in each interval, one row of each for a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size, n = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
        for b in batches:
            key, s = b.column(0).to_numpy(), b.column(1).to_numpy()
            i = np.searchsorted(starts, key, side="right") - 1
            inside = (i >= 0) & (key <= stops[i])
            np.add.at(size, i[inside], s[inside])
            np.add.at(n, i[inside], 1)
        some = np.flatnonzero(n)
        yield rows(_SUMS, run=some.tolist(), size=size[some].tolist(), n=n[some].tolist())

    return run


def _split(groups: DataFrame, runs: list[Run]) -> list[Run]:
    """The runs cut into intervals of equal width, RUNS at most in all, without empty ones."""
    parts = max(2, RUNS // len(runs))
    bounds = []
    for r in runs:
        width = -(-(r.last - r.first + 1) // parts)
        bounds += [(a, min(a + width - 1, r.last)) for a in range(r.first, r.last + 1, width)]
    starts, stops = (np.array(x, np.int64) for x in zip(*bounds))
    found = groups.select("key", "size").mapInArrow(_sums(starts, stops), "run int, size long, n long").groupBy("run").agg(F.sum("size").alias("size"), F.sum("n").alias("n"))
    return [Run(int(starts[r["run"]]), int(stops[r["run"]]), r["size"], r["n"]) for r in found.orderBy("run").collect()]


def cuts(groups: DataFrame, shards: int) -> list[int]:
    """The first keys of shards 1, 2, ... for a stored table of (key, size) with one row for each key."""
    ends = groups.agg(F.min("key").alias("a"), F.max("key").alias("b"), F.sum("size").alias("s"), F.count("*").alias("n")).first()
    if not ends["n"]:
        return []
    runs = _split(groups, [Run(ends["a"], ends["b"], ends["s"], ends["n"])])
    while True:
        sizes = np.array([r.size for r in runs], np.int64)
        high = least_capacity(sizes, shards)
        open_ = [r for r in runs if r.n > 1 and r.first < r.last]
        if not open_:
            break
        # A run's inner cut moved to its start lengthens a shard by that run at most, so no exact capacity is lower than:
        low = max(-(-int(sizes.sum()) // shards), high - max(r.size for r in open_))
        borders = np.concatenate([[0], np.cumsum(sizes)])
        windows, a, b = [], 0, 0
        for _ in range(shards):
            a = int(borders[np.searchsorted(borders, a + low, side="right") - 1])
            b = b + high
            windows.append((a, b))
        wanted = [i for i, r in enumerate(runs) if r.n > 1 and r.first < r.last and any(borders[i] < y and borders[i + 1] > x for x, y in windows)]
        if not wanted:
            break
        wanted_set, several = set(wanted[: RUNS // 2]), []
        finer = _split(groups, [runs[i] for i in wanted[: RUNS // 2]])
        for i, r in enumerate(runs):
            if i not in wanted_set:
                several.append(r)
        runs = sorted([*several, *finer], key=lambda r: r.first)
    found, filled = [], 0
    for r in runs:
        if filled and filled + r.size > high:
            found.append(r.first)
            filled = 0
        filled += r.size
    return found


def shard(docs: DataFrame, shards: int = 16) -> DataFrame:
    """doc_id, text_hash, size, text_crc32, shard, slot of each row of docs.

    size is the text's UTF-8 bytes plus 1 (null: 1), text_crc32 that of the bytes (null: of none). Rows of equal texts,
    nulls among them, share a shard; slot counts from 0 within the shard by doc_id. Rows without doc_id come last in
    their shard, and their groups are ordered as doc_id 0. Groups of different texts that share their smallest doc_id
    (a repeated id) are one atom. A group larger than the rest fills a shard by itself. Empty table: no rows.
    """
    need(docs, "doc_id", "text")
    prepare(docs.sparkSession)
    text = F.col("text").cast("string")
    read = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.xxhash64(text).alias("text_hash"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit(""))).alias("text_crc32"),
        F.coalesce(F.sha2(text, 256), F.lit("null")).alias("sha"),
    )
    read = written(read, "sizes")
    groups = written(read.groupBy("sha").agg(F.sum("size").alias("size"), F.coalesce(F.min("doc_id"), F.lit(0).cast("long")).alias("key")), "groups")
    atoms = written(groups.groupBy("key").agg(F.sum("size").alias("size")), "atoms")
    at = cuts(atoms, shards)
    number = F.lit(0)
    for k in at:
        number = number + (F.col("key") >= F.lit(k)).cast("int")
    placed = written(read.join(groups.select("sha", number.cast("int").alias("shard")), "sha").withColumn("one", F.lit(1).cast("long")), "placed")
    return running_sum(placed, ["shard"], ["doc_id", "text_hash"], "one", "slot").select("doc_id", "text_hash", "size", "text_crc32", "shard", "slot")
