"""Weights of account pairs, counted without a table of the message pairs.

Rows go into B blocks by user. The cell (i, j) of B x B gets the left rows of block i and the right rows of block j, so all pairs
of two users meet in one cell, which counts and returns their weights: no pair is shuffled, sorted or stored. Each row is written
to the shuffle once, packed, however many blocks there are; a cell reads the two blocks that it needs. In a cell right rows lie
by key and time, so a left row's window is one run of them. Of a run, a row
counts if its user's row before it lies outside, or else a message matched twice would count twice; where that first one is
the left message itself, the user's next one stands in. So each (left row, user) is counted once, without sorting pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from numbers import Integral

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Pairs that are in memory at once, and the slots for counts per pair above which counting sorts instead.
PAIRS, SLOTS = 1 << 18, 16
#: Rows packed together, and edges passed on together.
PACKED, EDGES = 1 << 17, 1 << 16

_WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_KEYS = (*_WHOLE, T.StringType, T.BinaryType, T.BooleanType, T.DateType)


def countable(rows: DataFrame, keys: Sequence[str], differ: Sequence[str]) -> bool:
    """Whether equality of Arrow values is that of Spark for these columns."""
    kinds = {f.name: f.dataType for f in rows.schema}
    plain = lambda k: isinstance(k, _KEYS) and getattr(k, "collation", None) in (None, "UTF8_BINARY") and not isinstance(k, (T.CharType, T.VarcharType))
    return all(plain(kinds[c]) for c in ("message_id", "user_id", *keys, *differ)) and isinstance(kinds["timestamp"], (*_WHOLE, T.FloatType, T.DoubleType))


def counted(rows: DataFrame, window: float, keys: Sequence[str] = (), least: int = 1, differ: Sequence[str] = ()) -> DataFrame:
    """(user_1, user_2, weight) of rows (message_id, user_id, timestamp, keys, differ): for each two users the different messages
    of the first that a message of the second, other by id and in all columns ``differ``, matches in the keys within the window.

    Null keys, times, ids and nulls in ``differ`` match nothing; a null user is a user. B grows with the root of
    spark.sql.shuffle.partitions, so a cell holds 1 / B of the rows twice.
    """
    if window < 0:
        raise ValueError("the window can't be negative")
    spark = rows.sparkSession
    blocks = max(4, math.ceil(math.sqrt(int(spark.conf.get("spark.sql.shuffle.partitions")))))
    whole = isinstance(rows.schema["timestamp"].dataType, _WHOLE) and isinstance(window, Integral)
    block = F.pmod(F.xxhash64("user_id"), F.lit(blocks)).cast("int").alias("block")
    time = F.col("timestamp").cast("long" if whole else "double").alias("t")
    named = [F.col(k).alias(f"{p}{i}") for p, cs in (("k", keys), ("d", differ)) for i, k in enumerate(cs)]
    used = rows.select(block, F.col("user_id").alias("u"), F.col("message_id").alias("m"), time, *named)
    for c in used.columns[2:]:
        used = used.where(F.col(c).isNotNull())
    packed = used.mapInArrow(_pack(blocks, whole), "block int, rows binary")
    kind = rows.schema["user_id"].dataType
    schema = T.StructType([T.StructField("user_1", kind), T.StructField("user_2", kind), T.StructField("weight", T.LongType(), False)])
    return met(packed, blocks).mapInArrow(_cell(int(window) if whole else float(window), whole, len(keys), len(differ), least), schema)


def met(packed: DataFrame, blocks: int) -> DataFrame:
    """(left, right), one of them null or both: a partition for each two blocks i and j of packed (block, rows), which gets the rows of i
    as left and those of j as right, each once.

    A Cartesian product reads a block's one shuffle file for each of its cells. Each block has a row of null besides, and only
    what meets such a row is passed on, or else every two rows of i and j would be.
    """
    none = packed.sparkSession.range(0, blocks, 1, 1).select(F.col("id").cast("int").alias("block"), F.lit(None).cast("binary").alias("rows"))
    dealt = packed.union(none).repartitionById(blocks, F.col("block"))
    left, right = (dealt.select(F.col("rows").alias(c)) for c in ("left", "right"))
    return left.hint("shuffle_replicate_nl").join(right, F.col("left").isNull() | F.col("right").isNull())


def _pack(blocks: int, whole: bool):
    """Batches of (block, u, m, t, ...) to a few compressed tables for each block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            held.append(b)
            size += len(b)
            if size >= PACKED:
                yield dealt(held)
                held, size = [], 0
        if size:
            yield dealt(held)

    def dealt(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held).combine_chunks()
        block = table.column(0).to_numpy()
        found, out = np.unique(block), []
        for k in found:
            one = table.filter(pa.array(block == k)).drop_columns("block").combine_chunks()
            if whole:  # steps take fewer bytes than times
                t = one.column("t").to_numpy()
                one = one.set_column(one.schema.get_field_index("t"), "t", pa.array(np.diff(t, prepend=t.dtype.type(0))))
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, one.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
                w.write_table(one)
            out.append(sink.getvalue().to_pybytes())
        return pa.RecordBatch.from_arrays([pa.array(found.astype(np.int32)), pa.array(out, pa.binary())], names=["block", "rows"])

    return run


def _codes(*columns: pa.ChunkedArray) -> tuple[list[np.ndarray], pa.Array]:
    """The columns as numbers that are equal where values are (nulls too), and the values by number."""
    both = pa.chunked_array([c for x in columns for c in x.chunks], columns[0].type)
    coded = pc.dictionary_encode(both, null_encoding="encode").combine_chunks()
    coded = coded.chunk(0) if isinstance(coded, pa.ChunkedArray) else coded
    numbers = coded.indices.to_numpy(zero_copy_only=False).astype(np.int32, copy=False)
    return np.split(numbers, np.cumsum([len(c) for c in columns])[:-1]), coded.dictionary


def _cell(window: float, whole: bool, n_keys: int, n_differ: int, least: int):
    """The blobs (left, right) of a cell to its edges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[list, list] = ([], [])
        for b in batches:
            for side, blob in ((side, x) for side in (0, 1) for x in b.column(side).drop_null()):
                one = pa.ipc.open_stream(pa.BufferReader(blob.as_buffer())).read_all()
                if whole:
                    t = np.cumsum(one.column("t").to_numpy())
                    one = one.set_column(one.schema.get_field_index("t"), "t", pa.array(t))
                held[side].append(one)
        if not (held[0] and held[1]):
            return
        left, right = (pa.concat_tables(x) for x in held)
        held[0].clear(), held[1].clear()
        sent: list[pa.RecordBatch] = []
        for users, u1, names, u2, n in _edges(left, right, window, whole, n_keys, n_differ, least):
            sent.append(pa.RecordBatch.from_arrays([users.take(pa.array(u1)), names.take(pa.array(u2)), pa.array(n)], names=["user_1", "user_2", "weight"]))
            if sum(map(len, sent)) >= EDGES:
                yield from pa.Table.from_batches(sent).combine_chunks().to_batches(max_chunksize=4 * EDGES)
                sent = []
        if sent:
            yield from pa.Table.from_batches(sent).combine_chunks().to_batches()

    return run


def _edges(left: pa.Table, right: pa.Table, window: float, whole: bool, n_keys: int, n_differ: int, least: int):
    """(users, u1, names, u2, weight) again and again; users and names are what the numbers u1 and u2 stand for."""
    (lu,), users = _codes(left.column("u"))
    (ru,), names = _codes(right.column("u"))
    (lm, rm), _ = _codes(left.column("m"), right.column("m"))
    differ = [_codes(left.column(f"d{i}"), right.column(f"d{i}"))[0] for i in range(n_differ)]
    lk, rk = np.zeros(len(lu), np.int64), np.zeros(len(ru), np.int64)
    for i in range(n_keys):
        (a, b), values = _codes(left.column(f"k{i}"), right.column(f"k{i}"))
        both = np.concatenate([lk, rk]) * len(values) + np.concatenate([a, b])
        both = np.unique(both, return_inverse=True)[1] if i else both
        lk, rk = both[: len(lu)], both[len(lu) :]
    lt, rt = left.column("t").to_numpy(), right.column("t").to_numpy()
    del left, right

    # right rows by key and time; a window is a run of them
    times, rank = np.unique(rt, return_inverse=True)
    place = rk * (len(times) + 1) + rank
    order = np.argsort(place, kind="stable")
    place, ru, rm = place[order], ru[order], rm[order]
    differ = [(a, b[order]) for a, b in differ]
    if whole:
        ends = np.iinfo(np.int64)
        since, until = np.where(lt < ends.min + window, ends.min, lt - window), np.where(lt > ends.max - window, ends.max, lt + window)
    else:
        since, until = lt - window, lt + window
    lo = np.searchsorted(place, lk * (len(times) + 1) + np.searchsorted(times, since, "left"), "left").astype(np.int32)
    hi = np.searchsorted(place, lk * (len(times) + 1) + np.searchsorted(times, until, "right"), "left").astype(np.int32)
    # the row of the same key and user before and after each right row
    by_user = np.lexsort((ru, rk[order]))
    same = (ru[by_user][1:] == ru[by_user][:-1]) & (rk[order][by_user][1:] == rk[order][by_user][:-1])
    before, after = np.full(len(ru), -1, np.int32), np.full(len(ru), len(ru), np.int32)
    before[by_user[1:][same]] = by_user[:-1][same]
    after[by_user[:-1][same]] = by_user[1:][same]
    del rank, place, order, by_user, same, times, since, until, lk, rk, lt, rt

    # left rows that meet any, by user and message; users with too few rows can't reach the weight
    keep = np.flatnonzero((hi > lo) & (np.bincount(lu, minlength=len(users))[lu] >= least))
    keep = keep[np.lexsort((lm[keep], lu[keep]))]
    lu, lm, lo, hi = lu[keep], lm[keep], lo[keep], hi[keep]
    differ = [(a[keep], b) for a, b in differ]
    if not len(lu):
        return
    new_user = np.diff(lu, prepend=-1) != 0
    new_message = new_user | (np.diff(lm, prepend=-1) != 0)
    message = np.cumsum(new_message) - 1
    repeated = np.bincount(message)[message] > 1
    any_repeated = bool(repeated.any())
    shared = len(np.intersect1d(lm, rm)) > 0
    total = np.concatenate([[0], np.cumsum((hi - lo).astype(np.int64))])

    def matched(a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        """Left row and right row of each (left row, user) of the left rows a to b."""
        n = hi[a:b] - lo[a:b]
        row = np.repeat(np.arange(b - a, dtype=np.int32), n)
        r = np.arange(len(row), dtype=np.int32)
        r += (lo[a:b] - (total[a:b] - total[a])).astype(np.int32)[row]
        first = before[r] < lo[a:b][row]
        if not first.all():
            row, r = row[first], r[first]
        row += np.int32(a)
        if not (shared or differ):
            return row, r
        out = _barred(row, r)
        if not out.any():
            return row, r
        more, stay = [], np.flatnonzero(~out)
        x, y = row[out], r[out]
        while len(x):
            y = after[y]
            inside = y < hi[x]
            x, y = x[inside], y[inside]
            out = _barred(x, y)
            more.append((x[~out], y[~out]))
            x, y = x[out], y[out]
        return np.concatenate([row[stay], *[m[0] for m in more]]), np.concatenate([r[stay], *[m[1] for m in more]])

    def _barred(row: np.ndarray, r: np.ndarray) -> np.ndarray:
        out = lm[row] == rm[r]
        for a, b in differ:
            out |= a[row] == b[r]
        return out

    def slots(a: int, b: int, base: int) -> np.ndarray:
        """(user - base) * len(names) + other user of each different message."""
        row, r = matched(a, b)
        slot = (lu[row] - base).astype(np.int64) * len(names) + ru[r]
        if any_repeated:
            again = repeated[row]
            if again.any():
                pair = np.unique(message[row[again]] * len(names) + ru[r[again]])
                of = lu[np.searchsorted(message, pair // len(names))]
                slot = np.concatenate([slot[~again], (of - base).astype(np.int64) * len(names) + pair % len(names)])
        return slot

    starts = np.append(np.flatnonzero(new_user), len(lu))
    at = 0
    while at < len(starts) - 1:
        a = starts[at]
        end = int(np.searchsorted(total[starts], total[a] + PAIRS, "right")) - 1
        if end > at:
            base, b = int(lu[a]), starts[end]
            slot = slots(a, b, base)
            span = (int(lu[b - 1]) - base + 1) * len(names)
            if span <= SLOTS * len(slot):
                n = np.bincount(slot, minlength=span).reshape(-1, len(names))
                one, two = np.nonzero(n >= max(1, least))
                n = n[one, two]
            else:
                found, n = np.unique(slot, return_counts=True)
                found, n = found[n >= least], n[n >= least]
                one, two = np.divmod(found, len(names))
            at = end
        else:  # one user with very many pairs, a few messages at a time
            base, b = int(lu[a]), starts[at + 1]
            n, cuts = np.zeros(len(names), np.int64), np.append(a + np.flatnonzero(new_message[a:b]), b)
            i = 0
            while i < len(cuts) - 1:
                j = max(i + 1, int(np.searchsorted(total[cuts], total[cuts[i]] + PAIRS, "right")) - 1)
                n += np.bincount(slots(cuts[i], cuts[j], base), minlength=len(names))
                i = j
            two = np.flatnonzero(n >= max(1, least))
            one, n = np.zeros(len(two), np.int64), n[two]
            at += 1
        if len(two):
            yield users, base + one, names, two, n.astype(np.int64)
