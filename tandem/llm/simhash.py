"""SimHash near-duplicates, found by multi-index hashing.

A text's fingerprint is the bitwise majority of the XXH64 hashes of its word shingles. Two fingerprints link when they
differ in at most ``RADIUS`` = 3 of 64 bits. The fingerprint is cut into two segments of 32 bits; of any linked pair, one
segment differs in one bit at most. So each segment's ball of radius one is looked up in that segment's table, and
what is met there is verified over all 64 bits. Of two values that differ in one bit, only the one that has the bit set
asks (for the value without it), so a pair meets once in a segment and a fingerprint asks about 17 times, not 33.

Equal fingerprints are one node, whatever the number of copies. Where many fingerprints share a segment (a large group
of near copies), the place is dealt out again by balls over the other segment's halves, which again loses no pair: of
the three bits that may differ there, one of two halves has one at most. From each place only links that join what is
not yet joined are passed on, at most one fewer than the fingerprints there. No candidate, bucket or group is cut off.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import each_text, need, one_row_each, partitions, prepare, without_rows, written
from .components import components

RADIUS = 3
#: Places with more fingerprints than this are dealt out again by a second segment.
CROWDED = 256
#: Shingles that one 16-bit lane can count.
_LANE = 32768
FINGERPRINTS = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("fp", pa.int64())])
LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def shingle_hashes(text: bytes, words: int = 3, seed: int = 42) -> list[int]:
    """XXH64 of each shingle of a lower-cased text, repeats included; of the whole sequence if it has fewer words."""
    w = text.split()
    if not w:
        return []
    if len(w) <= words:
        return [xxhash.xxh64_intdigest(b" ".join(w), seed)]
    digest, joined = xxhash.xxh64_intdigest, b" ".join(w)
    lengths = np.fromiter(map(len, w), np.int64, len(w))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    return [digest(joined[i:j], seed) for i, j in zip(starts.tolist(), ends[words - 1 :].tolist())]


def majority(hashes: list[int], lengths: list[int]) -> np.ndarray:
    """The fingerprint of each text, given all texts' hashes in a row and how many belong to each; none: zero.

    Bits are counted in four 16-bit lanes of a word at once; longer texts are counted in pieces.
    """
    n, h = np.asarray(lengths, np.int64), np.fromiter(hashes, np.uint64, len(hashes))
    first = np.cumsum(n) - n
    pieces = (n + _LANE - 1) // _LANE
    owner = np.repeat(np.arange(len(n)), pieces)
    counts = np.zeros((len(n), 64), np.int64)
    if len(owner):
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        starts = first[owner] + nth * _LANE
        lanes = np.uint64(0x0001000100010001)
        for k in range(16):
            s = np.add.reduceat((h >> np.uint64(k)) & lanes, starts)
            for lane in range(4):
                np.add.at(counts[:, 16 * lane + k], owner, ((s >> np.uint64(16 * lane)) & np.uint64(0xFFFF)).astype(np.int64))
    return ((counts * 2 > n[:, None]).astype(np.uint64) << np.arange(64, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)


def _fingerprint_batches(words: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hashes: list[int] = []
            lengths = []
            for text in each_text(b.column(2), lower=True):
                h = shingle_hashes(text, words, seed)
                hashes += h
                lengths.append(len(h))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(majority(hashes, lengths).view(np.int64))], schema=FINGERPRINTS)

    return run


def fingerprints(docs: DataFrame, words: int = 3, seed: int = 42) -> DataFrame:
    """doc_id, text_hash (XXH64 of the text as it is), fp (64 bits as a long) for each row. Null text counts as empty."""
    need(docs, "doc_id", "text")
    prepare(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_fingerprint_batches(words, seed), "doc_id long, text_hash long, fp long")


# --- places where fingerprints meet -------------------------------------------------------------------------------

#: Kinds of rows at a place: bit 0 is set if the row asked by clearing a bit of the latest segment, bit 1 if of an earlier
#: one. Two rows are compared unless both have the same bit set: the row that asks meets those that stay as they are.
OWN, ASKED, ASKED_BEFORE = 0, 1, 2


def _ball(value, bits: int):
    """The value as it is, and with each of its set bits cleared: array of (v, asks)."""
    own = F.struct(value.alias("v"), F.lit(OWN).alias("asks"))
    masks = F.array(*[F.lit(1 << i).cast("long") for i in range(bits)])
    cleared = F.transform(F.filter(masks, lambda m: value.bitwiseAND(m) != 0), lambda m: F.struct(value.bitwiseXOR(m).alias("v"), F.lit(ASKED).alias("asks")))
    return F.concat(F.array(own), cleared)


def _part(fp, start: int, bits: int):
    return F.shiftrightunsigned(fp, start).bitwiseAND(F.lit((1 << bits) - 1).cast("long"))


def _segments(fp, bits: int):
    """Balls of the two halves of the lower ``bits`` bits: array of (part, v, asks)."""
    half = bits // 2

    def ball(part: int):
        return F.transform(_ball(_part(fp, part * half, half), half), lambda x: F.struct(F.lit(part).alias("part"), x["v"].alias("v"), x["asks"].alias("asks")))

    return F.concat(ball(0), ball(1))


def _joined(groups: list[tuple[np.ndarray, list[np.ndarray]]], radius: int) -> list[tuple[int, int]]:
    """Links between each group's first array and its others (and within the first, if it is among them) that join what
    a union-find over this place alone has not joined yet."""
    root: dict[int, int] = {}
    out = []

    def find(x: int) -> int:
        while (p := root.get(x, x)) != x:
            root[x] = x = root.get(p, p)
        return x

    for own, others in groups:
        for other in others:
            for i, x in enumerate(own):
                rest = other[i + 1 :] if other is own else other
                for y in rest[np.bitwise_count(rest ^ x) <= radius].tolist():
                    a, b = find(int(x)), find(y)
                    if a != b:
                        root[max(a, b)] = min(a, b)
                        out.append((int(x), y))
    return out


def _meet(radius: int):
    """Batches of (place, kind, fp), sorted by place, to links."""

    def place(kind: np.ndarray, fp: np.ndarray) -> list[tuple[int, int]]:
        own, asked, before, both = (np.unique(fp[kind == k]) for k in range(4))
        return _joined([(own, [own, asked, before, both]), (asked, [before])], radius)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[np.ndarray] = [np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.uint64)]
        for b in batches:
            key, kind, fp = (np.concatenate(x) for x in zip(kept, (b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2).to_numpy().view(np.uint64))))
            if not len(key):
                continue
            edges = np.concatenate([[0], np.flatnonzero(np.diff(key)) + 1])
            last, out = edges[-1], []
            if len(edges) > 1:  # only a place with two rows, of which one did not ask, can give a link
                still = np.add.reduceat((kind[:last] != 3).astype(np.int64), edges[:-1])
                lone = np.add.reduceat((kind[:last] == ASKED).astype(np.int64), edges[:-1])
                sizes = np.diff(edges)
                for i in np.flatnonzero((sizes > 1) & (still > 0) & (lone < sizes)).tolist():
                    out += place(kind[edges[i] : edges[i + 1]], fp[edges[i] : edges[i + 1]])
            kept = [key[last:], kind[last:], fp[last:]]
            if out:
                yield _links(out)
        out = place(kept[1], kept[2]) if len(kept[0]) > 1 else []
        if out:
            yield _links(out)

    return run


def _links(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    x = np.array(pairs, np.uint64).view(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x[:, i])) for i in range(2)], schema=LINKS)


def linked_fingerprints(fps: DataFrame, radius: int = RADIUS, crowded: int = CROWDED) -> DataFrame:
    """(a, b): links between different fingerprints of a stored table with a column fp of distinct values.

    The links have the same connected components as all pairs at most ``radius`` bits apart (0 to 3).
    """
    if not 0 <= radius <= 3:
        raise ValueError("radius must be from 0 to 3")
    fp = F.col("fp")
    at = fps.select("fp", F.explode(_segments(fp, 64)).alias("s")).select("fp", "s.part", "s.v", "s.asks")
    table = fps.select(F.explode(F.array(*[F.struct(F.lit(p).alias("hp"), _part(fp, 32 * p, 32).alias("hv")) for p in range(2)])).alias("s")).select("s.hp", "s.hv")
    hot = written(table.groupBy("hp", "hv").count().where(F.col("count") > crowded).select("hp", "hv"), "crowded")
    if hot.isEmpty():
        placed = at.select(F.xxhash64("part", "v").alias("place"), F.col("asks").alias("kind"), "fp")
    else:
        same = (F.col("part") == F.col("hp")) & (F.col("v") == F.col("hv"))
        rest = at.join(hot, same, "left_anti").select(F.xxhash64("part", "v").alias("place"), F.col("asks").alias("kind"), "fp")
        # In a crowded place the other segment differs in three bits at most, so one of its halves in one at most.
        other = F.when(F.col("part") == 0, _part(fp, 32, 32)).otherwise(_part(fp, 0, 32))
        again = at.join(hot, same, "left_semi").withColumn("other", other).withColumn("t", F.explode(_segments(F.col("other"), 32)))
        placed = rest.unionByName(again.select(F.xxhash64("part", "v", "t.part", "t.v").alias("place"), (F.col("asks") * ASKED_BEFORE + F.col("t.asks")).alias("kind"), "fp"))
    return placed.repartition(partitions(fps.sparkSession), "place").sortWithinPartitions("place").mapInArrow(_meet(radius), "a long, b long").distinct()


def near_duplicates(docs: DataFrame, words: int = 3, seed: int = 42, radius: int = RADIUS) -> DataFrame:
    """doc_id, text_hash, fp and component_id (the smallest doc_id reachable over links, its own included) of each row.

    Null and empty texts have fingerprint zero and link like any other; texts of any length count whole. Repeated rows
    stay, in the component of their text. A null doc_id stays null and names no component unless all its rows are null.
    An empty table gives an empty table; further columns of docs are not looked at.
    """
    rows = written(fingerprints(docs, words, seed), "fingerprints")
    nodes = written(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    linked = components(linked_fingerprints(nodes.select("fp"), radius))
    named = nodes.join(linked, nodes.fp == linked.node, "left").select("fp", "least", F.coalesce("component", "fp").alias("c"))
    least = named.groupBy("c").agg(F.min("least").alias("component_id"))
    of = named.select("fp", "c").join(least, "c").select("fp", "component_id")
    return rows.join(of, "fp").select("doc_id", "text_hash", "fp", "component_id")


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """docs without near-duplicates: of each component the row with the smallest doc_id stays, whole and unchanged.

    doc_id is taken for a key: of rows with one doc_id that would stay, or of those without any, one does. Where different
    texts may share a doc_id or have none, take nearcopies.one_of_each.
    """
    found = written(near_duplicates(docs, **options), "near")
    drop = found.where(~F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("k0"), F.col("text_hash").alias("k1")).distinct()
    kept = without_rows(docs, [F.col("doc_id").cast("long"), F.xxhash64("text")], written(drop, "dropped"))
    return one_row_each(kept, found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))), "component_id", F.xxhash64("text"))
