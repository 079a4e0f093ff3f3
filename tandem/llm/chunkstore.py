"""A content-addressed store of token ids.

Texts are encoded by the tokenizers library; a rolling hash over the ids cuts each document's stream into chunks, so that
copies and shared passages give equal chunks. A chunk is stored once, in a pack file, under its SHA-256. A document's
recipe lists its chunks; the recipes lie in ascending doc_id order with each document's place in the stream of all ids,
and with the Merkle root of its chunks' digests. Reading checks every chunk against its digest and every document
against its root.

A store is a folder in shared storage: ``packs/`` (ids as little-endian unsigned 16- or 32-bit integers, chunks one after
another), ``index`` (digest, pack, offset, length) and ``recipes`` (Parquet). Packs are named by the attempt that wrote
them; only the attempt whose rows Spark kept is in the index, so a lost executor leaves at most an unused file.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import count, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import each_text, filesystem, need, new_path, partitions, prepare, rows, running_sum, store_bytes, written

#: A chunk ends where these bits of the rolling hash are zero (1024 ids on average), or after this many ids.
CUT_BITS, LONGEST = 10, 8192
#: Ids over which the hash rolls.
WINDOW = 8
#: Words whose ids a worker remembers, and bytes of a pack.
WORDS, PACK = 1_200_000, 32 << 20
#: Marks at a word's end that are pre-tokens of their own after a letter or digit.
TAIL = b".,;:!?"
_TAIL = frozenset(TAIL)
_PLAIN = frozenset(b"abcdefghijklmnopqrstuvwxyz0123456789")
#: Stands between words that are encoded together; words that hold it are encoded alone.
MARK = "\x01"


class WordIds:
    """Ids of texts by the ids of their words: every word that white space bounds is encoded by the library once.

    The tokenizer's pre-tokens hold no white space and its normaliser looks at no context across it, so a text's ids are
    its words' ids in a row. At most WORDS words are remembered.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.mark = self._ids([MARK])[0]
        self.clear()

    def clear(self) -> None:
        self.known: dict[bytes, int] = defaultdict(count().__next__)  # numbers words in the order of their first look-up
        self.ids = np.zeros(0, np.int32)
        self.starts = self.lengths = np.zeros(0, np.int64)

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _encoded(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The words' ids in a row and how many are each word's; many words are encoded in one call."""
        texts = [w.decode("utf-8", "replace") for w in words]
        ids, lengths = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
        for i in range(0, len(texts), 512):
            some = texts[i : i + 512]
            if len(self.mark) == 1 and not any(MARK in t for t in some):
                flat = np.array(self._ids([f" {MARK} ".join(some)])[0], np.int32)
                marks = np.flatnonzero(flat == self.mark[0])
                if len(marks) == len(some) - 1:
                    ids.append(flat[flat != self.mark[0]])
                    lengths.append(np.diff(np.concatenate([[-1], marks, [len(flat)]])) - 1)
                    continue
            found = self._ids(some)
            ids.append(np.array([x for f in found for x in f], np.int32))
            lengths.append(np.array([len(f) for f in found], np.int64))
        return np.concatenate(ids), np.concatenate(lengths)

    def _learn(self) -> None:
        """Finds the ids of words numbered since the last call. A word that ends in marks after a letter or digit has
        the ids of its two parts in a row; parts that are new are numbered too."""
        known, first = self.known, len(self.lengths)
        new = list(islice(reversed(known), len(known) - first))
        listed: list[bytes] = []
        place: dict[bytes, int] = {}
        heads: list[int] = []
        tails: list[int] = []
        for w in reversed(new):
            tail = -1
            if w[-1] in _TAIL:
                stem = w.rstrip(TAIL)
                if stem and stem[-1] in _PLAIN:
                    end, w = w[len(stem) :], stem
                    if (tail := known.get(end, first)) >= first and (tail := place.get(end, -1)) < 0:
                        tail = place[end] = first + len(listed)
                        listed.append(end)
            if (head := known.get(w, first)) >= first and (head := place.get(w, -1)) < 0:
                head = place[w] = first + len(listed)
                listed.append(w)
            heads.append(head)
            tails.append(tail)
        for w in listed:
            if w not in known:
                known[w]  # looking it up numbers it
                heads.append(place[w])
                tails.append(-1)
        found, lengths = self._encoded(listed)
        # numbers below first are those of words known before; the last one stands for no ids
        known_lengths, n = self.lengths, len(self.ids)
        starts = np.concatenate([self.starts, n + np.cumsum(lengths) - lengths, [0]])
        lengths = np.concatenate([known_lengths, lengths, [0]])
        of = np.stack([np.array(heads, np.int64), np.array(tails, np.int64)], axis=1).ravel()
        added = _runs(np.concatenate([self.ids, found]), starts[of], lengths[of])
        more = lengths[of].reshape(-1, 2).sum(axis=1)
        self.ids = np.concatenate([self.ids, added])
        self.starts = np.concatenate([self.starts, n + np.cumsum(more) - more])
        self.lengths = np.concatenate([known_lengths, more])

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        """Each text's ids. A-Z is lower-cased first, as the tokenizer does itself, so that spellings meet."""
        if len(self.known) > WORDS:
            self.clear()
        places = []
        for t in texts:
            words = t.lower().split()
            places.append(np.fromiter(map(self.known.__getitem__, words), np.int64, len(words)))
        if len(self.known) > len(self.lengths):
            self._learn()
        return [_runs(self.ids, self.starts[x], self.lengths[x]) for x in places]


def _runs(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The runs of values that begin at starts, one after another."""
    ends = np.cumsum(lengths)
    return values[np.repeat(starts - ends + lengths, lengths) + np.arange(ends[-1] if len(ends) else 0)]


@lru_cache(maxsize=2)
def word_ids(path: str) -> WordIds:
    """One for each worker process, which Spark uses for many tasks."""
    return WordIds(path)


_GEAR = np.random.default_rng(7).integers(1, 1 << 32, 1 << 16, np.uint64).astype(np.uint32)
_ROLL = np.uint32(0x9E3779B1)


def chunk_ends(ids: np.ndarray) -> list[int]:
    """Where a document's chunks end; no ids: none. The hash at an id depends on the WINDOW ids up to it only."""
    if not len(ids):
        return []
    g = _GEAR[ids & 0xFFFF]
    h = g.copy()
    factor = np.uint32(1)
    for k in range(1, min(WINDOW, len(g))):
        factor = np.uint32(int(factor) * int(_ROLL) & 0xFFFFFFFF)
        h[k:] += g[:-k] * factor
    ends = (np.flatnonzero(h >> np.uint32(32 - CUT_BITS) == 0) + 1).tolist()
    out, last = [], 0
    for e in [*ends, len(ids)]:
        while e - last > LONGEST:
            last += LONGEST
            out.append(last)
        if e > last:
            out.append(e)
            last = e
    return out


def merkle_root(digests: list[bytes]) -> bytes:
    """The root over chunk digests: levels of pairs, an odd one goes up as it is; none: the digest of nothing."""
    level = digests or [hashlib.sha256(b"").digest()]
    while len(level) > 1:
        level = [hashlib.sha256(b"".join(level[i : i + 2])).digest() if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]


_MOVED = pa.schema([("deal", pa.int32()), ("doc_id", pa.int64()), ("text_hash", pa.int64()), ("n_tokens", pa.int64()), ("data", pa.binary()), ("chunk", pa.binary())])
_KEPT = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("n_tokens", pa.int64()), ("recipe", pa.binary()), ("digest", pa.binary()), ("pack", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])
_READ = pa.schema([("digest", pa.binary()), ("n", pa.int64()), ("crc", pa.int64())])


def _encode(path: str, end_id: int, width: int):
    """Batches of (doc_id, text_hash, text) to recipes (chunk null) and chunks that the task has not passed on yet."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, sent = word_ids(path), set()
        kind = np.dtype(f"<u{width}")
        for b in batches:
            deal, ids_, hashes, n, data, chunk = [], [], [], [], [], []

            def add(d, i, h, k, x, c):
                deal.append(d), ids_.append(i), hashes.append(h), n.append(k), data.append(x), chunk.append(c)

            for doc_id, text_hash, ids in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), encoder.encode(list(each_text(b.column(2))))):
                stream = np.append(ids, end_id).astype(kind)
                recipe, last = [], 0
                for e in chunk_ends(stream):
                    piece = stream[last:e].tobytes()
                    digest = hashlib.sha256(piece).digest()
                    recipe.append(digest)
                    last = e
                    if digest not in sent:
                        if len(sent) > WORDS:
                            sent.clear()
                        sent.add(digest)
                        add(int.from_bytes(digest[:3], "big"), None, None, None, digest, piece)
                add((text_hash ^ (doc_id or 0) * 0x9E3779B97F4A7C15) >> 20 & 0xFFFFFF, doc_id, text_hash, len(stream), b"".join(recipe), None)
            yield rows(_MOVED, deal=deal, doc_id=ids_, text_hash=hashes, n_tokens=n, data=data, chunk=chunk)

    return run


def _store(folder: str):
    """Writes the chunks of a partition to packs, each digest once; returns the index and passes recipes on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        held: list[bytes] = []
        index: list[tuple[bytes, int, int]] = []
        size = 0

        def pack() -> pa.RecordBatch:
            name = f"{uuid.uuid4().hex}.pack"
            store_bytes(f"{folder}/packs/{name}", b"".join(held))
            k = len(index)
            return rows(_KEPT, doc_id=[None] * k, text_hash=[None] * k, n_tokens=[None] * k, recipe=[None] * k, digest=[x[0] for x in index], pack=[name] * k, offset=[x[1] for x in index], length=[x[2] for x in index])

        for b in batches:
            is_recipe = b.column(5).is_null()
            r = b.filter(is_recipe)
            if len(r):
                none = [pa.nulls(len(r), _KEPT.field(i).type) for i in range(4, 8)]
                yield pa.RecordBatch.from_arrays([r.column(1), r.column(2), r.column(3), r.column(4), *none], schema=_KEPT)
            for digest, data in zip(b.column(4).to_pylist(), b.column(5).to_pylist()):
                if data is None or digest in seen:
                    continue
                seen.add(digest)
                index.append((digest, size, len(data)))
                held.append(data)
                size += len(data)
                if size >= PACK:
                    yield pack()
                    held, index, size = [], [], 0
        if held:
            yield pack()

    return run


def save(docs: DataFrame, path: str, end_id: int = 1, folder: str | None = None) -> str:
    """Encodes docs (doc_id, text; null text counts as empty) and stores them; returns the store's folder.

    Every document ends with end_id. Repeated rows and documents without doc_id (last in order) have recipes of their own.
    """
    need(docs, "doc_id", "text")
    spark = prepare(docs.sparkSession)
    folder = folder or new_path(spark, "store")
    from tokenizers import Tokenizer

    width = 2 if max(Tokenizer.from_file(path).get_vocab_size(), end_id + 1) <= 1 << 16 else 4
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), F.col("text").cast("string").alias("text"))
    moved = named.mapInArrow(_encode(path, end_id, width), "deal int, doc_id long, text_hash long, n_tokens long, data binary, chunk binary")
    kept = moved.repartition(partitions(spark), "deal").mapInArrow(_store(folder), "doc_id long, text_hash long, n_tokens long, recipe binary, digest binary, pack string, offset long, length long")
    both = written(kept, "kept")
    both.where("digest is not null").select("digest", "pack", "offset", "length", F.lit(width).alias("width")).write.parquet(f"{folder}/index")
    recipes = written(both.where("recipe is not null").select("doc_id", "text_hash", "n_tokens", "recipe"), "recipes")
    placed = running_sum(recipes, [], ["doc_id", "text_hash"], "n_tokens", "start")

    @F.pandas_udf("binary")
    def root(recipe):
        return recipe.map(lambda x: merkle_root([x[i : i + 32] for i in range(0, len(x), 32)]))

    placed.withColumn("root", root("recipe")).repartitionByRange(partitions(spark), "start").sortWithinPartitions("start").write.parquet(f"{folder}/recipes")
    return folder


def _read_chunks(folder: str, payload: bool):
    """Index rows, by pack, to what the packs hold: number of ids and CRC-32 of the ids as 32-bit integers, or the ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, f = None, None
        for b in batches:
            n, crc, data = [], [], []
            for digest, pack, offset, length, width in zip(*(c.to_pylist() for c in b.columns)):
                if pack != name:
                    if f is not None:
                        f.close()
                    fs, path = filesystem(f"{folder}/packs/{pack}")
                    name, f = pack, fs.open_input_file(path)
                piece = f.read_at(length, offset)
                if hashlib.sha256(piece).digest() != digest:
                    raise ValueError(f"a chunk of {pack} at {offset} differs from its digest")
                ids = np.frombuffer(piece, f"<u{width}").astype("<u4")
                n.append(len(ids))
                if payload:
                    data.append(ids.tobytes())
                else:
                    crc.append(zlib.crc32(ids.tobytes()))
            if payload:
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(data, pa.binary())], names=["digest", "ids"])
            else:
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(crc, pa.int64())], schema=_READ)
        if f is not None:
            f.close()

    return run


# CRC-32 of a row of chunks from the chunks' own, by multiplying polynomials modulo the CRC's.
_POLYNOMIAL = 0xEDB88320


def _times(a: int, b: int) -> int:
    out = 0
    for i in range(31, -1, -1):
        if a >> i & 1:
            out ^= b
        b = b >> 1 ^ (_POLYNOMIAL if b & 1 else 0)
    return out


@lru_cache(maxsize=20_000)
def _zeros(n_bytes: int) -> int:
    """x to the power of 8 n_bytes."""
    out, base, k = 1 << 31, 1 << 23, n_bytes
    while k:
        if k & 1:
            out = _times(out, base)
        base = _times(base, base)
        k >>= 1
    return out


def joined_crc(parts: list[tuple[int, int]]) -> int:
    """CRC-32 of pieces one after another, from (crc, bytes) of each; none: 0."""
    out = 0
    for crc, n in parts:
        out = _times(out, _zeros(n)) ^ crc
    return out


def _by_document(folder: str, read: DataFrame) -> DataFrame:
    """Recipes with what was read of their chunks, in order: doc_id, text_hash, start, n_tokens, root, recipe, chunks."""
    spark = read.sparkSession
    recipes = spark.read.parquet(f"{folder}/recipes")
    digest = F.transform(F.sequence(F.lit(0), (F.length("recipe") / 32).cast("int") - 1), lambda i: F.struct(i.alias("i"), F.substring("recipe", i * 32 + 1, F.lit(32)).alias("digest")))
    parts = recipes.select("start", F.explode(digest).alias("c")).select("start", "c.i", "c.digest")
    of = parts.join(read, "digest", "left").groupBy("start").agg(F.sort_array(F.collect_list(F.struct("i", *[c for c in read.columns if c != "digest"], "digest"))).alias("chunks"))
    return recipes.join(of, "start", "left")


def read_summary(spark, folder: str) -> DataFrame:
    """doc_id, text_hash, start, n_tokens, ids_crc32 of each document, from the store's files.

    Every chunk is read once from its pack and checked against its digest; a document's chunks must give its Merkle root
    and its number of ids.
    """
    index = spark.read.parquet(f"{folder}/index").select("digest", "pack", "offset", "length", "width")
    read = index.mapInArrow(_read_chunks(folder, False), "digest binary, n long, crc long")

    @F.pandas_udf("long")
    def crc(recipe, root, n_tokens, n, crc, digests):
        out = []
        for r, t, total, ns, cs, ds in zip(recipe, root, n_tokens, n, crc, digests):
            if b"".join(ds) != r or merkle_root(list(ds)) != t or sum(ns) != total:
                raise ValueError("a document's chunks do not give its recipe")
            out.append(joined_crc([(int(c), 4 * int(k)) for c, k in zip(cs, ns)]))
        import pandas as pd

        return pd.Series(out, dtype="int64")

    whole = _by_document(folder, read)
    return whole.select("doc_id", "text_hash", "start", "n_tokens", crc("recipe", "root", "n_tokens", "chunks.n", "chunks.crc", "chunks.digest").alias("ids_crc32"))


def read_documents(spark, folder: str) -> DataFrame:
    """doc_id, start, ids (array of long) of each document, put together from its chunks and checked as in read_summary."""
    index = spark.read.parquet(f"{folder}/index").select("digest", "pack", "offset", "length", "width")
    read = index.mapInArrow(_read_chunks(folder, True), "digest binary, ids binary")

    @F.pandas_udf("array<long>")
    def ids(root, parts, digests):
        def one(t, p, d):
            if merkle_root(list(d)) != t:
                raise ValueError("a document's chunks do not give its root")
            return np.frombuffer(b"".join(p), "<u4").astype(np.int64)

        import pandas as pd

        return pd.Series([one(*x) for x in zip(root, parts, digests)])

    return _by_document(folder, read).select("doc_id", "start", ids("root", "chunks.ids", "chunks.digest").alias("ids"))
