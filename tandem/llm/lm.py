"""Language-model scores from an Elias-Fano trie of words and word pairs.

Level 1 holds the words of the training texts (as 64-bit hashes in order; a word's place is its id) and their running
counts. Level 2 holds, for each word, the ids of the words that followed it, as one monotone sequence relative to the
word's place (frequent words have more room, so that values lie evenly), pointers to where each word's successors begin, and for each pair the discounted relative frequency as an
8-bit code of its logarithm. A pair is found by a successor search for its relative value.

p(w | u) = (c(u w) - D) / c(u) + D n(u) / c(u) p(w), where n(u) counts different successors and p(w) = (c(w) + 1) /
(N + V + 1) is the add-one probability; an unseen u leaves p(w). A text begins after an end and closes with one. D is
estimated in each shard from its pairs seen once and twice; every pair counts, none is pruned.

Both levels are built by shards: tasks count their texts and pass on sorted runs (Elias-Fano coded), a shard merges those
and writes a file to the shared folder. A word's pairs may lie in several shards, in proportion to its count, so that no
word, however frequent, makes a large one. Scoring maps the files into memory; the driver holds a few numbers of each.
"""

from __future__ import annotations

import json
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import each_text, load_array, need, new_path, partitions, prepare, rows, store_bytes
from .eliasfano import EliasFano, pack, unpack

#: Distinct words or pairs that a task holds before it passes them on; bytes of text that are looked at together.
HELD_WORDS, HELD_TOKENS, BLOCK = 1_000_000, 6_000_000, 8 << 20
#: The end of a text; no word has these bytes.
END = b"\xff"
#: Codes of log10 of a discounted relative frequency: from 0 down, 255 steps.
STEP = 12.0 / 255
#: A word's successors are spread over as many times V values as it has occurrences by this many, so that a frequent
#: word's lie no closer than others'.
SPREAD = 64
_RUNS = pa.schema([("shard", pa.int32()), ("n", pa.int64()), ("about", pa.string()), ("run", pa.binary()), ("counts", pa.binary())])
_RUNS_SQL = "shard int, n long, about string, run binary, counts binary"
_SHARDS_SQL = "shard int, meta string"
_U = np.uint64


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def _run(shard: int, values: np.ndarray, counts: np.ndarray) -> tuple:
    """A sorted run as a row: values coded relative to the first, counts in one byte each with the larger ones aside."""
    base, universe = int(values[0]), int(values[-1] - values[0]) + 1
    data, ends = pack(EliasFano.arrays(values - values[0], universe))
    large = np.flatnonzero(counts > 254)
    small = np.minimum(counts, 255).astype(np.uint8)
    return shard, len(values), json.dumps([base, universe, ends]), data, small.tobytes() + counts[large].astype("<u8").tobytes()


def _values(n: int, about: str, data: bytes, counts: bytes) -> tuple[np.ndarray, np.ndarray]:
    base, universe, ends = json.loads(about)
    found = EliasFano(n, universe, *unpack(np.frombuffer(data, "<u8"), ends)).values() + _U(base)
    c = np.frombuffer(counts, np.uint8, n).astype(np.int64)
    c[c == 255] = np.frombuffer(counts, "<u8", offset=n).astype(np.int64)
    return found, c


def _added(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return keys[first], np.add.reduceat(counts, first)


def _merged(batches: Iterator[pa.RecordBatch], write) -> Iterator[pa.RecordBatch]:
    """Runs, sorted by shard, to one row for each shard: what write(shard, values, counts) says of its file."""

    def done(shard: int, held: list) -> pa.RecordBatch:
        values, counts = zip(*(_values(*x) for x in held))
        meta = write(shard, *_added(np.concatenate(values), np.concatenate(counts)))
        return rows(pa.schema([("shard", pa.int32()), ("meta", pa.string())]), shard=[shard], meta=[json.dumps(meta)])

    now, held = None, []
    for b in batches:
        for shard, *x in zip(*(c.to_pylist() for c in b.columns)):
            if shard != now and held:
                yield done(now, held)
                held = []
            now = shard
            held.append(x)
    if held:
        yield done(now, held)


def _file(folder: str, parts: list[np.ndarray]) -> dict:
    data, ends = pack(parts)
    uri = f"{folder}/{uuid.uuid4().hex}.level"
    store_bytes(uri, data)
    return {"uri": uri, "ends": ends}


# --- level 1: words ------------------------------------------------------------------------------------------------


def _count_words(bits: int):
    base = 64 - bits

    def runs(found: Counter) -> pa.RecordBatch:
        keys, counts = _added(word_hashes(list(found)), np.fromiter(found.values(), np.int64, len(found)))
        cuts = np.searchsorted(keys >> _U(base), np.arange((1 << bits) + 1, dtype=np.uint64)) if bits else np.array([0, len(keys)])
        mask = _U((1 << base) - 1)
        out = [_run(s, keys[a:b] & mask, counts[a:b]) for s, (a, b) in enumerate(zip(cuts.tolist(), cuts[1:].tolist())) if a < b]
        return rows(_RUNS, **dict(zip(_RUNS.names, map(list, zip(*out)))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        for b in batches:
            for t in each_text(b.column(0), lower=True):
                found.update(t.split())
            found[END] += b.num_rows
            if len(found) > HELD_WORDS:
                yield runs(found)
                found = Counter()
        if found:
            yield runs(found)

    return run


class Words:
    """Level 1: ids, counts and widths of words, by their hashes."""

    def __init__(self, bits: int, shards: list[dict]):
        self.bits, self.first, self.ahead = bits, {}, {}
        self.keys: dict[int, EliasFano] = {}
        self.sums: dict[int, EliasFano] = {}
        self.widths: dict[int, EliasFano] = {}
        self.order = [m["shard"] for m in shards]
        self.V = self.N = self.width = 0
        for m in shards:
            parts = unpack(load_array(m["uri"], "<u8"), m["ends"])
            s = m["shard"]
            self.keys[s] = EliasFano(m["n"], 1 << (64 - bits), *parts[:3])
            self.sums[s] = EliasFano(m["n"] + 1, m["total"] + 1, *parts[3:6])
            self.widths[s] = EliasFano(m["n"] + 1, m["width"] + 1, *parts[6:9])
            self.first[s], self.ahead[s] = self.V, self.width
            self.V += m["n"]
            self.N += m["total"]
            self.width += m["width"]
        self.firsts = np.array([self.first[s] for s in self.order], np.int64)

    def _of(self, s: int, i: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(count, width, widths of all words before) of places in a shard."""
        ahead = self.widths[s].access(i).astype(np.int64)
        count = (self.sums[s].access(i + 1) - self.sums[s].access(i)).astype(np.int64)
        return count, self.widths[s].access(i + 1).astype(np.int64) - ahead, ahead + self.ahead[s]

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, ...]:
        """(id or -1, count, width, widths before) of words."""
        out = np.zeros((4, len(hashes)), np.int64)
        out[0] = -1
        shard = (hashes >> _U(64 - self.bits)).astype(np.int64) if self.bits else np.zeros(len(hashes), np.int64)
        for s, at in _by_shard(shard):
            if s in self.keys:
                i = self.keys[s].find(hashes[at] & _U((1 << (64 - self.bits)) - 1))
                at, i = at[i >= 0], i[i >= 0]
                out[0, at] = i + self.first[s]
                out[1, at], out[2, at], out[3, at] = self._of(s, i)
        return tuple(out)

    def by_id(self, ids: np.ndarray) -> tuple[np.ndarray, ...]:
        """(count, width, widths before) of ids."""
        out = np.zeros((3, len(ids)), np.int64)
        for k, at in _by_shard(np.searchsorted(self.firsts, ids, side="right") - 1):
            out[0, at], out[1, at], out[2, at] = self._of(self.order[k], ids[at] - self.firsts[k])
        return tuple(out)


def _by_shard(shard: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(shard.astype(np.int32), kind="stable")
    cuts = np.flatnonzero(np.append(True, np.diff(shard[order]) != 0)).tolist() if len(order) else []
    for a, b in zip(cuts, [*cuts[1:], len(order)]):
        yield int(shard[order[a]]), order[a:b]


# --- level 2: pairs ------------------------------------------------------------------------------------------------


def _shard_of(ahead: np.ndarray, width: np.ndarray, word: np.ndarray, known: Words, shards: int) -> np.ndarray:
    """A pair's shard: where it lies in the widths of all words, which grows with (u, w)."""
    place = ahead.astype(np.float64) + width.astype(np.float64) * (word.astype(np.float64) / known.V)
    return np.minimum((place * (shards / known.width)).astype(np.int64), shards - 1)


def _relative(ahead: np.ndarray, width: np.ndarray, word: np.ndarray, base: int, n_words: int) -> np.ndarray:
    """A pair's value in its shard: u's place by widths, V values each, and w at its share of them."""
    return (ahead - base).astype(np.uint64) * _U(n_words) + word.astype(np.uint64) * width.astype(np.uint64)


class Texts:
    """The distinct words of a block of texts and, for each token in turn, the numbers of its word and of the one before."""

    def __init__(self, texts: list[bytes]):
        number = {END: 0}
        parts = [np.zeros(1, np.int32)]
        self.lengths = []
        for t in texts:
            words = t.split()
            self.lengths.append(len(words) + 1)
            for w in words:
                if w not in number:
                    number[w] = len(number)
            parts.append(np.fromiter(map(number.__getitem__, words), np.int32, len(words)))
            parts.append(np.zeros(1, np.int32))
        flat = np.concatenate(parts)
        self.words, self.before, self.token = list(number), flat[:-1], flat[1:]


def _blocks(column_batches: Iterator[tuple], size: int) -> Iterator[tuple[list, list[bytes]]]:
    held, texts, n = [], [], 0
    for keys, found in column_batches:
        for k, t in zip(keys, found):
            held.append(k)
            texts.append(t)
            n += len(t) + 32
            if n >= size:
                yield held, texts
                held, texts, n = [], [], 0
    if held:
        yield held, texts


def _count_pairs(bits: int, level1: list[dict], shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Words(bits, level1)
        held: list[np.ndarray] = []
        n = 0

        def runs() -> pa.RecordBatch:
            keys, counts = np.unique(np.concatenate(held), return_counts=True)
            u, w = (keys // _U(known.V)).astype(np.int64), (keys % _U(known.V)).astype(np.int64)
            new = np.append(True, np.diff(u) != 0)
            of = np.cumsum(new) - 1
            _, width, ahead = known.by_id(u[new])
            shard = _shard_of(ahead[of], width[of], w, known, shards)
            cuts = np.searchsorted(shard, np.arange(shards + 1))
            out = [_run(s, keys[a:b], counts[a:b]) for s, (a, b) in enumerate(zip(cuts.tolist(), cuts[1:].tolist())) if a < b]
            return rows(_RUNS, **dict(zip(_RUNS.names, map(list, zip(*out)))))

        for _, texts in _blocks(((range(b.num_rows), each_text(b.column(0), lower=True)) for b in batches), BLOCK):
            x = Texts(texts)
            ids = known.find(word_hashes(x.words))[0]
            held.append(ids[x.before].astype(np.uint64) * _U(known.V) + ids[x.token].astype(np.uint64))
            n += len(x.token)
            if n >= HELD_TOKENS:
                yield runs()
                held, n = [], 0
        if held:
            yield runs()

    return run


def _write_pairs(folder: str, known: Words):
    """Merges a shard's pairs and writes its level: relative values, pointers, codes."""

    def write(shard: int, keys: np.ndarray, counts: np.ndarray) -> dict:
        u, w = (keys // _U(known.V)).astype(np.int64), keys % _U(known.V)
        first, last = int(u[0]), int(u[-1])
        n1, n2 = int((counts == 1).sum()), int((counts == 2).sum())
        d = min(0.95, max(0.1, n1 / (n1 + 2 * n2) if n1 else 0.5))
        count, width, ahead = known.by_id(np.arange(first, last + 1))
        universe = int(ahead[-1] + width[-1] - ahead[0]) * known.V
        if universe >= 1 << 63:
            raise ValueError("a shard's pairs span too many values: use more shards")
        starts = np.searchsorted(u, np.arange(first, last + 2))
        codes = np.clip(np.rint(-np.log10((counts - d) / count[u - first]) / STEP), 0, 255).astype(np.uint8)
        padded = np.zeros(-(-len(codes) // 8) * 8, np.uint8)
        padded[: len(codes)] = codes
        values = _relative(ahead[u - first], width[u - first], w, int(ahead[0]), known.V)
        parts = [*EliasFano.arrays(values, universe), *EliasFano.arrays(starts.astype(np.uint64), len(keys) + 1), padded.view("<u8")]
        return {"shard": shard, "n": len(keys), "universe": universe, "base": int(ahead[0]), "first": first, "last": last, "d": d, **_file(folder, parts)}

    return write


class Pairs:
    """Level 2: discounted relative frequencies of pairs, and the weight that a word's unseen successors share."""

    def __init__(self, n_words: int, shards: list[dict]):
        self.V, self.shards = n_words, {}
        for m in shards:
            parts = unpack(load_array(m["uri"], "<u8"), m["ends"])
            keys = EliasFano(m["n"], m["universe"], *parts[:3])
            starts = EliasFano(m["last"] - m["first"] + 2, m["n"] + 1, *parts[3:6])
            self.shards[m["shard"]] = (m["first"], m["last"], m["d"], m["base"], keys, starts, parts[6].view(np.uint8))
        self.order = sorted(self.shards)
        self.values = 10.0 ** (-np.arange(256) * STEP)

    def seen(self, shard: np.ndarray, u: np.ndarray, ahead: np.ndarray, width: np.ndarray, w: np.ndarray) -> np.ndarray:
        """The discounted relative frequency of each pair of ids; 0 for pairs that never occurred."""
        out = np.zeros(len(u))
        for s, at in _by_shard(shard):
            if s not in self.shards:
                continue
            first, last, _, base, keys, _, codes = self.shards[s]
            at = at[(u[at] >= first) & (u[at] <= last)]
            i = keys.find(_relative(ahead[at], width[at], w[at], base, self.V))
            out[at[i >= 0]] = self.values[codes[i[i >= 0]]]
        return out

    def spared(self, u: np.ndarray) -> np.ndarray:
        """For each id (ascending), the sum over shards of D times its different successors there, by the pointers."""
        out = np.zeros(len(u))
        for s in self.order:
            first, last, d, _, _, starts, _ = self.shards[s]
            a, b = np.searchsorted(u, [first, last + 1])
            if a < b:
                i = u[a:b] - first
                out[a:b] += d * (starts.access(i + 1) - starts.access(i)).astype(np.float64)
        return out


# --- the operator --------------------------------------------------------------------------------------------------


def held_out(doc_id: Column) -> Column:
    """Rows that are never learned from: crc32 of doc_id as text leaves 2 by 7 (null: the empty text)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 7 == 2


def train(texts: DataFrame) -> dict:
    """Builds both levels from a column text; returns the model: a few numbers for each shard, files in the shared folder.

    Null texts count as empty (an end only). Without rows the model knows no word.
    """
    spark = prepare(texts.sparkSession)
    texts = texts.select(F.col("text").cast("string").alias("text"))
    n = partitions(spark)
    bits = min(16, (n - 1).bit_length())
    folder = new_path(spark, "lm")

    def words(shard: int, keys: np.ndarray, counts: np.ndarray) -> dict:
        sums = np.append(0, np.cumsum(counts)).astype(np.uint64)
        widths = np.append(0, np.cumsum(-(-counts // SPREAD))).astype(np.uint64)
        parts = [*EliasFano.arrays(keys, 1 << (64 - bits)), *EliasFano.arrays(sums, int(sums[-1]) + 1), *EliasFano.arrays(widths, int(widths[-1]) + 1)]
        return {"shard": shard, "n": len(keys), "total": int(sums[-1]), "width": int(widths[-1]), **_file(folder, parts)}

    runs = texts.mapInArrow(_count_words(bits), _RUNS_SQL).repartition(n, "shard").sortWithinPartitions("shard")
    level1 = sorted((json.loads(r["meta"]) for r in runs.mapInArrow(lambda b: _merged(b, words), _SHARDS_SQL).collect()), key=lambda m: m["shard"])
    model = {"bits": bits, "shards": n, "level1": level1, "level2": [], "V": sum(m["n"] for m in level1), "N": sum(m["total"] for m in level1)}
    if not model["N"]:
        return model

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _merged(batches, _write_pairs(folder, Words(bits, level1)))

    runs = texts.mapInArrow(_count_pairs(bits, level1, n), _RUNS_SQL).repartition(n, "shard").sortWithinPartitions("shard")
    model["level2"] = sorted((json.loads(r["meta"]) for r in runs.mapInArrow(merge, _SHARDS_SQL).collect()), key=lambda m: m["shard"])
    return model


_SCORED = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])


def score(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, text_hash, n_tokens, n_known, base_score, score of each row of docs, whose texts count whole.

    Scores are log10 probabilities. Null and empty texts are scored as an end alone; rows repeat as in docs.
    """
    need(docs, "doc_id", "text")
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, pairs = Words(model["bits"], model["level1"]), Pairs(model["V"], model["level2"])
        columns = ((zip(b.column(0).to_pylist(), b.column(1).to_pylist()), each_text(b.column(2), lower=True)) for b in batches)
        for keys, texts in _blocks(columns, BLOCK):
            x = Texts(texts)
            ids, counts, width, ahead = known.find(word_hashes(x.words))
            alone = (counts + 1) / (known.N + known.V + 1)
            spared = np.ones(len(ids))
            seen = np.flatnonzero(ids >= 0)
            seen = seen[np.argsort(ids[seen])]
            spared[seen] = pairs.spared(ids[seen]) / np.maximum(counts[seen], 1)
            p = spared[x.before] * alone[x.token]
            both = np.flatnonzero((ids[x.before] >= 0) & (ids[x.token] >= 0))
            if len(both):
                a, b = x.before[both], x.token[both]
                shard = _shard_of(ahead[a], width[a], ids[b], known, model["shards"])
                p[both] += pairs.seen(shard, ids[a], ahead[a], width[a], ids[b])
            starts = np.cumsum(x.lengths) - x.lengths
            total = lambda v: np.add.reduceat(v, starts)
            yield rows(
                _SCORED, doc_id=[k[0] for k in keys], text_hash=[k[1] for k in keys], n_tokens=x.lengths,
                n_known=total((counts > 0)[x.token].astype(np.int64)), base_score=total(np.log10(alone)[x.token]), score=total(np.log10(np.minimum(p, 1.0))),
            )

    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), F.col("text").cast("string").alias("text"))
    return named.mapInArrow(run, "doc_id long, text_hash long, n_tokens long, n_known long, base_score double, score double")
