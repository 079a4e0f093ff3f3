"""Weights of account pairs by alike texts of a whole table, where no window divides it.

Equal token sets are one set. Sets are dealt out into B blocks by size, packed: of each its size, 32-bit hashes of its rarest tokens and
its tokens, compressed. The cell (i, j), i <= j, reads two blocks and finds the pairs between them in memory, a layer of like sizes
with another at a time. Two sets that must share a tokens share l of them within all but the last a - l of each, in any one order of
tokens; with the rarest first, few others do. So a cell counts what every two sets of two layers share there, for l some hundredths of
the size, and what is left is compared as whole sets of tokens at once, each pair in one cell. So a set is written to the shuffle once
and no pair is, however many there are. Nothing is capped: samples only say which tokens come last, and any choice leaves the result
right, as do equal hashes, which only add to a count. Sets are told apart by 64-bit hashes.

Weights need no pairs of messages: of each set and user the least and the greatest message id say whether another message is there.
"""

from __future__ import annotations

import math
import pickle
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StringType

from ..functions.text import jaccard
from ..sources.shared import forget, setting, trimmed, written
from .counting import met

#: One set in SAMPLE is looked at for frequent tokens, of which MOST are used.
SAMPLE, MOST = 8, 200_000
#: Two sets must share 1 + SHARED of the smaller one's size in their rarest tokens; the sizes of a layer are at most LAYER of the least.
SHARED, LAYER = 0.12, 1.2
#: Row or set ids up to which they are broadcast (8 bytes each).
BROADCAST_ROWS = 2_000_000
#: Sets packed together; counts, shared tokens and hashes of a layer that are in memory at once.
PACKED, SLOTS, PAIRS, HELD = 2048, 1 << 20, 1 << 20, 1 << 20
#: Pairs are passed on by squares of so many sets each way, with so many tokens at most unless a pair has more.
PASSED, TOKENS = 16, 1 << 17
#: Bytes of blobs that Spark sends a cell at once.
SENT = 8 << 20
#: Sets of one size are dealt out by so many of their ids' remainders.
PARTS = 1 << 20
_LESS = 1e-9  #: so that rounding only widens what is compared


def _packed(frequent: np.ndarray, ranks: np.ndarray, threshold: float, cuts: np.ndarray):
    """Batches of (node, hashes, tokens) to blobs by block: of each set there node, size and number of rarest tokens, those in one order
    of all sets, rarest first, and the tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, len(whole), PACKED):
                b = whole.slice(i, PACKED)
                yield dealt(b.column(0).to_numpy(), b.column(1), b.column(2))

    def dealt(node: np.ndarray, lists: pa.ListArray, tokens: pa.ListArray) -> pa.RecordBatch:
        flat, n = lists.flatten().to_numpy(), np.diff(lists.offsets.to_numpy())
        owner = np.repeat(np.arange(len(n)), n)
        rank = np.zeros(len(flat), np.int64)
        if len(frequent):
            at = np.minimum(np.searchsorted(frequent, flat), len(frequent) - 1)
            rank = np.where(frequent[at] == flat, ranks[at], 0)
        order = np.lexsort((flat, rank, owner))
        flat, pos = flat[order], np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)
        # one token more than the greatest number that _pairs looks at, for rounding
        first = pos < (n - np.ceil(n * threshold - _LESS).astype(np.int64) + _shared(n) + 1)[owner]
        flat, owner = flat[first].astype(np.uint32), owner[first]
        words, at = tokens.flatten().to_numpy(zero_copy_only=False), tokens.offsets.to_numpy() - tokens.offsets[0].as_py()
        shut = [zlib.compress(pickle.dumps(words[i:j].tolist()), 1) for i, j in zip(at, at[1:])]
        block = np.searchsorted(cuts, n + node % PARTS / PARTS, "right")
        found, blobs = np.unique(block), []
        for p in found:
            own = block == p
            sets = np.flatnonzero(own)
            mine, text = own[owner], [shut[i] for i in sets]
            k, length = np.bincount(owner[mine], minlength=len(n))[sets], np.array([len(x) for x in text], np.int64)
            parts = (np.array([len(sets), mine.sum()]), node[sets], n[sets].astype(np.int32), k.astype(np.int32), flat[mine], length)
            data = b"".join(x.tobytes() for x in parts)
            data, whole = pa.compress(data, "lz4_raw", asbytes=True), len(data)
            head = np.array([p, n[sets].min(), n[sets].max(), whole, len(data)], np.int64)
            blobs.append(b"".join([head.tobytes(), data, *text]))
        return pa.RecordBatch.from_arrays([pa.array(found.astype(np.int32)), pa.array(blobs, pa.binary())], names=["block", "rows"])

    return run


def _shared(n):
    """How many tokens two sets, the smaller of n tokens, must share among their rarest."""
    return 1 + np.floor(n * SHARED).astype(np.int64)


def _heads(blobs: list[bytes]) -> tuple[int, int, int]:
    """The number of their block, its least and its greatest size."""
    heads = np.array([np.frombuffer(x, np.int64, 3) for x in blobs])
    return int(heads[0, 0]), int(heads[:, 1].min()), int(heads[:, 2].max())


def _unpacked(blob: bytes) -> list[np.ndarray]:
    whole, shut = np.frombuffer(blob, np.int64, 2, 24).tolist()
    data, at = pa.decompress(pa.py_buffer(blob)[40 : 40 + shut], whole, "lz4_raw", asbytes=True), 16
    sets, tokens = np.frombuffer(data, np.int64, 2).tolist()
    out = []
    for kind, k in ((np.int64, sets), (np.int32, sets), (np.int32, sets), (np.uint32, tokens), (np.int64, sets)):
        out.append(np.frombuffer(data, kind, k, at))
        at += out[-1].nbytes
    return out


class _Block:
    """The sets of a block by size, cut into layers (start, end, tokens, the set of each from start on, its place there), by token."""

    def __init__(self, blobs: list[bytes]):
        parts = [_unpacked(x) for x in blobs]
        # where each set's tokens stand in the blobs, which are kept as they came
        within = np.repeat(np.arange(len(parts), dtype=np.int32), [len(x[0]) for x in parts])
        ends = np.concatenate([len(blob) - x[-1].sum() + np.cumsum(x[-1]) for blob, x in zip(blobs, parts)])
        node, n, k, token, length = (np.concatenate(x) for x in zip(*parts))
        del parts
        order = np.argsort(n, kind="stable")
        self.blobs, self.within, self.ends, self.length = blobs, within[order], ends[order], length[order]
        self.node, self.n, since, k = node[order], n[order].astype(np.int64), (np.cumsum(k, dtype=np.int64) - k)[order], k[order]
        self.layers, s, until = [], 0, np.cumsum(k, dtype=np.int64)
        while s < len(order):
            e = int(np.searchsorted(self.n, max(self.n[s], int(self.n[s] * LAYER)), "right"))
            e = min(e, max(s + 1, int(np.searchsorted(until, until[s] + HELD))))
            of = np.repeat(np.arange(e - s, dtype=np.int32), k[s:e])
            pos = (np.arange(len(of)) - np.repeat(np.cumsum(k[s:e], dtype=np.int64) - k[s:e], k[s:e])).astype(np.int32)
            # by token: sorting both in one number is faster than sorting places
            both = np.sort(token[since[s:e][of] + pos].astype(np.uint64) << np.uint64(32) | np.arange(len(of), dtype=np.uint64))
            at = (both & np.uint64(0xFFFFFFFF)).astype(np.int64)
            self.layers.append((s, e, (both >> np.uint64(32)).astype(np.uint32), of[at], pos[at]))
            s = e

    def tokens(self, i: int) -> list:
        blob = memoryview(self.blobs[self.within[i]])
        return pickle.loads(zlib.decompress(blob[self.ends[i] - self.length[i] : self.ends[i]]))


def _pairs(one: _Block, two: _Block, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Sets i of one and j of two, none smaller than those of one, that may be alike; within a block each two once."""
    for a, left in enumerate(one.layers):
        for right in two.layers[a if one is two else 0 :]:
            if one.n[left[1] - 1] >= threshold * two.n[right[0]] - _LESS:
                yield from _between(one.n, two.n, left, right, threshold, left is right)


def _between(one_n: np.ndarray, two_n: np.ndarray, left: tuple, right: tuple, threshold: float, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """_pairs of two layers."""
    (s, e, token, of, pos), (s2, e2, token2, of2, pos2) = left, right
    n, n2, share = one_n[s:e], two_n[s2:e2], threshold / (1 + threshold)
    must = lambda x, y: np.ceil(share * (x + y) - _LESS).astype(np.int64)
    least = int(min(must(n[0], n2[0]), _shared(n[0])))
    # the other set is no smaller than the one of the left, and no smaller than the threshold allows to the one of the right
    rest = must(n, np.maximum(n, n2[0])) - least
    rest2 = must(n2, np.maximum(np.ceil(threshold * n2 - _LESS).astype(np.int64), n[0])) - least
    used, used2 = pos < (n - rest)[of], pos2 < (n2 - rest2)[of2]
    token, of, token2, of2 = token[used], of[used], token2[used2], of2[used2]
    if not (len(token) and len(token2)):
        return
    starts = np.flatnonzero(np.concatenate([[True], token2[1:] != token2[:-1], [True]]))
    kinds = token2[starts[:-1]]
    at = np.minimum(np.searchsorted(kinds, token), len(kinds) - 1)
    there = np.flatnonzero(kinds[at] == token)
    by_set = (np.sort(of[there].astype(np.uint64) << np.uint64(32) | there.astype(np.uint64)) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    of, at = of[by_set].astype(np.int64), at[by_set]
    since, many = starts[at], starts[at + 1] - starts[at]
    total = np.concatenate([[0], np.cumsum(many)])
    width = e2 - s2
    step = max(1, SLOTS // width)
    ends = np.searchsorted(of, np.arange(0, e - s + step, step))
    for base, i, end in zip(range(0, e - s, step), ends, ends[1:]):
        count = None
        while i < end:
            j = min(end, max(i + 1, int(np.searchsorted(total, total[i] + PAIRS, "right")) - 1))
            slot = np.repeat(since[i:j] - (total[i:j] - total[i]), many[i:j])
            slot += np.arange(len(slot))
            slot = of2[slot] + np.repeat((of[i:j] - base) * width, many[i:j])
            more = np.bincount(slot, minlength=0 if i == ends[base // step] and j == end else step * width)
            count = more if count is None else count + more
            i = j
        if count is None:
            continue
        found = np.flatnonzero(count >= least)
        x, y = np.divmod(found, width)
        x += base
        may = count[found] + np.maximum(rest[x], rest2[y]) >= share * (n[x] + n2[y]) - _LESS
        if same:
            may &= x < y
        if may.any():
            yield x[may] + s, y[may] + s2


def _met(threshold: float, kind: pa.DataType | None):
    """The blobs (left, right) of a cell to the pairs (a, b) of sets that may be alike, each once, with their tokens; without a kind of
    those, to the pairs that are alike."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[list, list] = ([], [])
        for b in batches:
            for side in (0, 1):
                held[side].extend(x.as_py() for x in b.column(side).drop_null())
            if held[0] and held[1] and _heads(held[0][:1])[0] > _heads(held[1][:1])[0]:
                return
        if not (held[0] and held[1]):
            return
        (i, _, most), (j, least, _) = (_heads(x) for x in held)
        if i > j or most < threshold * least - _LESS:
            return
        del batches, b
        if i == j:
            held[0].clear()
        two = _Block(held[1])
        one = two if i == j else _Block(held[0])
        for x, y in _pairs(one, two, threshold):
            # by squares, so that a large group's sets are unpacked once for each square and not once for each pair
            order = np.lexsort((y // PASSED, x // PASSED))
            until, s = np.cumsum(one.n[x[order]] + two.n[y[order]]), 0
            while s < len(order):
                before = until[s - 1] if s else 0
                e = min(s + PASSED * PASSED, max(s + 1, int(np.searchsorted(until, before + TOKENS, "right"))))
                z = [i[order[s:e]] for i in (x, y)]
                s = e
                if kind is None:
                    sets = [{j: frozenset(block.tokens(j)) for j in np.unique(i).tolist()} for block, i in ((one, z[0]), (two, z[1]))]
                    both = [(sets[0][i], sets[1][j]) for i, j in zip(z[0].tolist(), z[1].tolist())]
                    alike = np.array([len(i & j) / len(i | j) >= threshold for i, j in both])
                    yield pa.RecordBatch.from_arrays([pa.array(one.node[z[0][alike]]), pa.array(two.node[z[1][alike]])], names=["a", "b"])
                    continue
                tokens = []
                for block, i in ((one, z[0]), (two, z[1])):
                    sets, at = np.unique(i, return_inverse=True)
                    tokens.append(pa.array([block.tokens(j) for j in sets], kind).take(pa.array(at)))
                yield pa.RecordBatch.from_arrays([pa.array(one.node[z[0]]), pa.array(two.node[z[1]]), *tokens], names=["a", "b", "at", "bt"])

    return run


def _cuts(n: np.ndarray, count: np.ndarray, blocks: int) -> np.ndarray:
    """Where blocks end, as sizes and parts of the sets of one size, such that none has much over 2 / blocks of the sets or of their tokens."""
    each = 1 + n * (count.sum() / max(1, (n * count).sum()))
    until = np.cumsum(each * count)
    aim = np.arange(1, blocks) / blocks * (until[-1] if len(n) else 0)
    at = np.searchsorted(until, aim)[: blocks - 1 if len(n) else 0]
    return np.unique(n[at] + 1 - (until[at] - aim[: len(at)]) / (each * count)[at])


def candidates(sets: DataFrame, threshold: float, compared: bool = False) -> DataFrame:
    """(a, b, at, bt), each two once: all pairs of the stored sets (node, tokens), nodes different, with a Jaccard similarity of at
    least threshold > 0, and few others, with their tokens. compared, for tokens that are strings: (a, b) of those pairs and no others."""
    spark = sets.sparkSession
    blocks = max(4, math.ceil(2 * math.sqrt(int(spark.conf.get("spark.sql.shuffle.partitions")))))
    hashed = sets.select("node", F.transform(F.array_distinct("tokens"), lambda x: F.xxhash64(x)).alias("hashes"), "tokens")
    sample = hashed.where(F.pmod("node", F.lit(SAMPLE)) == 0)
    often = sample.select(F.explode("hashes").alias("token")).groupBy("token").count().where("count > 1").orderBy(F.desc("count"), "token").limit(MOST).toArrow()
    token, count = (often.column(c).to_numpy() for c in ("token", "count"))
    by_token = np.argsort(token)
    sizes = sets.groupBy(F.size("tokens").alias("n")).count().orderBy("n").toArrow()
    cuts = _cuts(sizes.column("n").to_numpy(), sizes.column("count").to_numpy(), blocks)
    packed = hashed.mapInArrow(trimmed(_packed(token[by_token], count[by_token], threshold, cuts)), "block int, rows binary")
    kind = sets.schema["tokens"].dataType
    if compared:
        return met(packed, blocks).mapInArrow(trimmed(_met(threshold, None)), "a long, b long")
    return met(packed, blocks).mapInArrow(trimmed(_met(threshold, to_arrow_type(kind))), f"a long, b long, at {kind.simpleString()}, bt {kind.simpleString()}")


def weights(rows: DataFrame, least_jaccard: float, alike: Callable[[Column, Column], Column], threshold: float, symmetric: bool = False, least: int = 1) -> DataFrame:
    """(u1, u2, m1), repeats included: each message of rows (message_id, user_id, tokens) and the users of whom another message has
    alike(tokens of the first, tokens of the other) >= threshold. Sets that are alike must have a Jaccard similarity of
    least_jaccard > 0 or more. A null message id matches nothing; sets of fewer than least >= 1 tokens are not alike."""
    # sizes are compared once the tokens are stored: a condition on them would have Spark make them twice
    made = rows.where(F.col("message_id").isNotNull()).select("message_id", "user_id", F.xxhash64("tokens").alias("node"), F.size("tokens").alias("n"), "tokens")
    stored = written(made.withColumn("row", F.monotonically_increasing_id()), "alike-rows")
    large = stored.where(F.col("n") >= max(1, least))
    members = written(large.select("message_id", "user_id", "node", "row"), "alike-members")
    first = members.groupBy("node").agg(F.min("row").alias("first"), F.count("*").alias("k")).where("k > 1")
    again = written(members.join(first, "node").where("row <> first").select(F.col("row").alias("again"), F.col("node").alias("repeated")), "alike-again")
    few = again.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    sent = lambda x: F.broadcast(x) if few else x.hint("merge")
    sets = large.join(sent(again.select("again")), F.col("row") == F.col("again"), "left_anti").select("node", "tokens")
    one = sets.join(sent(again.select("repeated").distinct()), F.col("node") == F.col("repeated"), "left_semi")
    if symmetric and alike is jaccard and sets.schema["tokens"].dataType.elementType == StringType():
        # Jaccard itself: sets are compared where they lie, and no tokens are passed on
        both = candidates(sets, threshold, True).union(one.select("node", "node")).select("a", "b", F.lit(threshold <= 1).alias("there"))
    else:
        both = candidates(sets, least_jaccard).union(one.select("node", "node", "tokens", "tokens"))
        there, back = (alike(F.col(x), F.col(y)) >= threshold for x, y in (("at", "bt"), ("bt", "at")))
        # not filtered before it is stored: Spark would compare twice
        both = both.select("a", "b", there.alias("there"), *([] if symmetric else [back.alias("back")]))
    with setting(rows.sparkSession, "spark.sql.execution.arrow.maxBytesPerBatch", str(SENT)):
        links = written(both, "alike-links")
    forget(stored, again)
    ways = links.where("there").select("a", "b").union(links.where(("there" if symmetric else "back") + " and a <> b").select("b", "a"))
    users = members.groupBy("node", "user_id").agg(F.min("message_id").alias("least"), F.max("message_id").alias("most"))
    near = ways.join(users, F.col("b") == F.col("node")).groupBy("a", "user_id").agg(F.min("least").alias("least"), F.max("most").alias("most"))
    found = members.select("node", F.col("message_id").alias("m1"), F.col("user_id").alias("u1")).join(near.withColumnRenamed("user_id", "u2"), F.col("node") == F.col("a"))
    return found.where((F.col("least") != F.col("m1")) | (F.col("most") != F.col("m1"))).select("u1", "u2", "m1")
