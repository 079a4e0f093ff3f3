"""Byte-level BPE: ranked merges folded over the byte arrays of distinct words by Spark's higher-order functions.

In each task, texts are cut into words by the tokenizer's pattern, and words that the task has not met before are listed
ahead of the texts that hold them. The byte arrays of those that are no piece yet go through one ``aggregate``: an element
packs the rank of the pair it starts, its place and its own id; a step finds the smallest, merges that pair and looks up
the two pairs beside it in the literal rank map. The map is a sparse table of (left id, right id) laid out in one literal
array, each left id's row moved by an offset so that no two entries fall together; Spark's own map literals are searched
entry by entry, which 50,000 ranks do not allow. Behind it, words' ids are put together to texts' ids, and texts are
decoded by concatenating pieces. Nothing is shuffled: words and texts follow each other through one task.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import each_text, need, prepare, trimmed

#: Bytes of text that are cut together, words in a row of a list, and words after which a task forgets those it listed.
BLOCK, CHUNK, WORDS = 4 << 20, 1024, 500_000
#: Bytes of a word up to which merges are folded in the JVM, where a step looks at all that is left of the word. Longer
#: ones (runs of letters without a blank) go through a heap, so that time stays near their length.
LONG = 2048
#: White space by Unicode, which \\s means in the tokenizers' own library (Python's classes differ).
SPACE = r"\t-\r \x85\xa0  -     　"
_TRAILS = regex.compile(rf"[{SPACE}]\Z")
#: Marks that no word goes on from, and characters that are no white space at a piece's end.
_MARKS = frozenset(bytes([c]) for c in b".,;:!?)]}$#*%&")
_VISIBLE = frozenset(map(chr, range(33, 127)))
NONE = 65536  #: the rank of a pair that doesn't merge


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f) if a}


def word_pattern(pattern: str) -> regex.Pattern:
    r"""The pattern with \s and \S spelt out."""
    return regex.compile(regex.sub(r"\[\^\\s", f"[^{SPACE}", pattern).replace(r"\S", f"[^{SPACE}]").replace(r"\s", f"[{SPACE}]"))


# --- the literal rank map ------------------------------------------------------------------------------------------


@lru_cache(maxsize=4)
def rank_slots(path: str) -> tuple[list[int], list[int]]:
    """(slots, shifts): the pair (a, b) of ids that join to a piece lies at slot shifts[a] + b as a << 17 | rank. Other slots
    hold NONE, or what belongs to another left id. Rows with many pairs are laid out first, each at the first free offset."""
    ranks = read_ranks(path)
    if len(ranks) >= NONE or sorted(ranks.values()) != list(range(len(ranks))) or any(bytes([i]) not in ranks for i in range(256)):
        raise ValueError("ranks must hold all 256 bytes, count from 0 without gaps and be fewer than 65536")
    pairs: dict[int, list[tuple[int, int]]] = {}
    for piece, rank in ranks.items():
        for i in range(1, len(piece)):
            a, b = ranks.get(piece[:i]), ranks.get(piece[i:])
            if a is not None and b is not None:
                pairs.setdefault(a, []).append((b, rank))
    n, free = len(ranks), 0
    used, slots, shifts = np.zeros(64 * n, bool), np.full(64 * n, NONE, np.int64), np.zeros(n, np.int64)
    for a, row in sorted(pairs.items(), key=lambda x: (-len(x[1]), x[0])):
        b, rank = np.array(row).T
        least, wide = int(b.min()), 64
        free += int(np.argmin(used[free:]))
        at = max(free, least)
        while True:
            offsets = np.flatnonzero(~used[at : at + wide]) + at - least
            fits = np.flatnonzero(~used[offsets[:, None] + b].any(axis=1))
            if len(fits):
                break
            at, wide = at + wide, min(4096, wide * 2)
        shifts[a] = offsets[fits[0]]
        used[shifts[a] + b] = True
        slots[shifts[a] + b] = a << 17 | rank
    return slots[: int(shifts.max()) + n].tolist(), shifts.tolist()


@lru_cache(maxsize=4)
def starts(path: str) -> list[int]:
    """What a word's places start as, by their codes: two bytes in a row (rank of the pair above 30 bits, id of the first),
    behind them the last byte of a word."""
    ranks = read_ranks(path)
    single = [ranks[bytes([i])] for i in range(256)]
    pairs = [ranks.get(bytes([i, j]), NONE) << 30 | single[i] for i in range(256) for j in range(256)]
    return pairs + [NONE << 30 | x for x in single]


def codes(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the words' places in a row, and how many each word has."""
    flat = np.frombuffer(b"".join(words), np.uint8).astype(np.int32)
    out = flat << 8
    out[:-1] |= flat[1:]
    n = np.fromiter(map(len, words), np.int64, len(words))
    last = np.cumsum(n) - 1
    out[last] = 65536 + flat[last]
    return out, n


def merged_by_heap(word: bytes, ranks: dict[bytes, int]) -> tuple[int, ...]:
    """The ids of one word: pairs wait in a heap by (rank, place)."""
    n = len(word)
    piece: list[bytes | None] = [word[i : i + 1] for i in range(n)]
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap: list[tuple[int, int, bytes]] = []

    def push(i: int) -> None:
        if i >= 0 and after[i] < n:
            both = piece[i] + piece[after[i]]
            if (r := ranks.get(both)) is not None:
                heapq.heappush(heap, (r, i, both))

    for i in range(n - 1):
        push(i)
    while heap:
        _, i, both = heapq.heappop(heap)
        if piece[i] is None or after[i] >= n or piece[i] + piece[after[i]] != both:
            continue
        j = after[i]
        piece[i], piece[j], after[i] = both, None, after[j]
        if after[j] < n:
            before[after[j]] = i
        push(i)
        push(before[i])
    return tuple(ranks[p] for p in piece if p is not None)


def _literal(values: list[int]) -> Column:
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def _bound(x: Column, f: Callable[[Column], Column]) -> Column:
    """f(x) with x evaluated once; unlike ``transform`` over one element, ``aggregate`` copies no array on the way."""
    return F.aggregate(F.array().cast("array<int>"), x, lambda a, _: a, f)


def merged(words: Column, path: str) -> Column:
    """The ids of words: array of arrays of ids, from arrays of the words' codes. The tables stand in the plan once."""
    slots, shifts = rank_slots(path)
    return _bound(_literal(slots), lambda s: _bound(_literal(shifts), lambda m: _bound(_literal(starts(path)), lambda t: _folded(words, s, m, t))))


def _folded(words: Column, slots: Column, shifts: Column, start: Column) -> Column:
    """Elements hold a pair's rank above 30 bits, the place of its first byte above 16, the id of its left piece below.
    Of pairs of the least rank the first in the word is merged, as the library does."""
    long = lambda x: F.lit(x).cast("long")
    own = lambda x: x.bitwiseAND(long(0xFFFF))
    none, here, low = long(NONE << 30), long((1 << 30) - (1 << 16)), long((1 << 30) - 1)

    def rank(a: Column, b: Column) -> Column:
        """A pair's rank, in place: the slot without the left id is the rank if the slot is the pair's, else NONE or more."""
        return F.shiftleft(F.get(slots, b + F.get(shifts, a)).bitwiseXOR(F.shiftleft(a, 17)), 30)

    def step(state: Column, _: Column) -> Column:
        def join(least: Column) -> Column:
            def at(i: Column) -> Column:  # i counts from 1
                def with_id(new: Column) -> Column:
                    right = F.when(i + 1 < F.size(state), rank(new, own(F.get(state, i + 1)))).otherwise(none)
                    before = lambda x: _bound(own(x), lambda o: x.bitwiseAND(low).bitwiseOR(rank(o, new)))
                    changed = lambda x, k: F.when(k > i, x).when(k < i - 2, x).when(k == i, long(-1)).when(k == i - 1, least.bitwiseAND(here).bitwiseOR(new).bitwiseOR(right)).otherwise(before(x))
                    return F.array_remove(F.transform(state, changed), long(-1))

                return _bound(F.shiftright(least, 30), with_id)

            return F.when(least < none, _bound(F.array_position(state, least).cast("int"), at)).otherwise(state)

        return _bound(F.array_min(state), join)

    def fold(word: Column) -> Column:
        n = F.size(word)
        first = F.transform(word, lambda x, i: F.get(start, x).bitwiseOR(F.shiftleft(i.cast("long"), 16)))
        ends = lambda s: F.transform(s, lambda x: own(x).cast("int"))
        return F.when(n < 2, ends(first)).otherwise(F.aggregate(F.sequence(F.lit(2), n), first, step, ends))

    return F.transform(words, fold)


# --- texts to words, words to texts --------------------------------------------------------------------------------

_PLACED = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("first", pa.bool_()), ("words", pa.list_(pa.list_(pa.int32()))), ("known", pa.list_(pa.list_(pa.int32()))), ("of", pa.binary())])
_PLACED_SQL = "doc_id long, text_hash long, first boolean, words array<array<int>>, known array<array<int>>, of binary"


class _Index(dict):
    """Numbers keys in the order of their first look-up."""

    def __missing__(self, key):
        n = self[key] = len(self)
        return n


def _runs(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The runs of values that begin at starts, one after another."""
    ends = np.cumsum(lengths)
    return values[np.repeat(starts - ends + lengths, lengths) + np.arange(ends[-1] if len(ends) else 0)]


def _nested(lengths: np.ndarray, values: np.ndarray) -> pa.Array:
    """One array of arrays."""
    inner = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(lengths)), pa.int32()), pa.array(values, pa.int32()))
    return pa.ListArray.from_arrays(pa.array([0, len(lengths)], pa.int32()), inner)


class _Cutter:
    """The words of texts, by number, and the words that were not listed yet.

    A text is cut at single blanks first and each distinct piece is cut into words once: no word spans a blank but at its
    start. Where white space stands before a blank that doesn't hold, and the pattern is applied to the whole text. A first
    piece has no blank before it and is marked by a byte UTF-8 lacks. ``plain`` says that the pattern makes one word of a
    blank and ASCII letters, and another of one mark behind them.
    """

    def __init__(self, pattern: str):
        self.find = word_pattern(pattern).findall
        self.plain = self.find(" ab") == [" ab"] and all(self.find(f" ab{chr(m[0])}") == [" ab", chr(m[0])] for m in _MARKS)
        self.clear()

    def clear(self) -> None:
        self.word, self.listed = _Index(), 0
        self.piece, self.cut = _Index(), 0
        self.counts, self.flat, self.trails = array("i"), array("i"), bytearray()

    def _learn(self) -> None:
        word, find = self.word, self.find
        for p in list(self.piece)[self.cut :]:
            trail = 0
            if self.plain and p.isalpha():  # ASCII letters alone are one word, and one mark after them is another
                self.flat.append(word[b" " + p])
                n = 1
            elif self.plain and p[-1:] in _MARKS and p[:-1].isalpha():
                self.flat.append(word[b" " + p[:-1]])
                self.flat.append(word[p[-1:]])
                n = 2
            else:
                s = (p[1:] if p[:1] == b"\xff" else b" " + p).decode("utf-8", "replace")
                trail = int(s[-1:] not in _VISIBLE and _TRAILS.search(s) is not None)
                found = [word[w.encode()] for w in find(s)]
                self.flat.extend(found)
                n = len(found)
            self.counts.append(n)
            self.trails.append(trail)
        self.cut = len(self.piece)

    def places(self, texts: list[bytes]) -> list[np.ndarray]:
        """Each text's words by number."""
        of = []
        for t in texts:
            cut = (b"\xff" + t).split(b" ")
            of.append(np.fromiter(map(self.piece.__getitem__, cut), np.int32, len(cut)))
        self._learn()
        n, flat, trails = np.array(self.counts, np.int64), np.array(self.flat, np.int32), np.array(self.trails, bool)
        starts = np.cumsum(n) - n
        word = self.word
        return [np.array([word[w.encode()] for w in self.find(t.decode("utf-8", "replace"))], np.int32) if trails[x[:-1]].any() else _runs(flat, starts[x], n[x]) for t, x in zip(texts, of)]

    def new_words(self) -> list[bytes]:
        found = list(self.word)[self.listed :]
        self.listed = len(self.word)
        return found


def _cut(path: str, pattern: str, most_bytes: int | None = None, most_words: int | None = None) -> Callable:
    """Batches of (doc_id, text_hash, text) to rows that list words the task meets first (those that need merging by their
    codes, the others by their ids), each followed by rows of the texts that hold them. first: earlier lists are forgotten."""
    most_bytes, most_words = most_bytes or BLOCK, most_words or WORDS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks, cutter = read_ranks(path), _Cutter(pattern)

        def block(ids: list, hashes: list, texts: list[bytes]) -> Iterator[pa.RecordBatch]:
            if len(cutter.word) > most_words or len(cutter.piece) > 2 * most_words:
                cutter.clear()
            first = not cutter.listed
            placed = cutter.places(texts)
            words = cutter.new_words()
            for i in range(0, len(words) or int(first), CHUNK):
                some = words[i : i + CHUNK]
                done = [(r,) if (r := ranks.get(w)) is not None else merged_by_heap(w, ranks) if len(w) > LONG else None for w in some]
                values, lengths = codes([w if d is None else b"\0" for w, d in zip(some, done)])  # a known word stands as one byte
                known = [() if d is None else d for d in done]
                yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.array([first and i == 0]), _nested(lengths, values), pa.array([known], _PLACED.field("known").type), pa.nulls(1, pa.binary())], schema=_PLACED)
            for i in range(0, len(ids), 256):
                k = len(ids[i : i + 256])
                yield pa.RecordBatch.from_arrays([pa.array(ids[i : i + k], pa.int64()), pa.array(hashes[i : i + k], pa.int64()), *[pa.nulls(k, _PLACED.field(c).type) for c in ("first", "words", "known")], pa.array([x.astype("<u4").tobytes() for x in placed[i : i + k]], pa.binary())], schema=_PLACED)

        ids, hashes, texts, size = [], [], [], 0
        for b in batches:
            for d, h, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), each_text(b.column(2))):
                ids.append(d)
                hashes.append(h)
                texts.append(t)
                size += len(t) + 64
                if size >= most_bytes:
                    yield from block(ids, hashes, texts)
                    ids, hashes, texts, size = [], [], [], 0
        if ids:
            yield from block(ids, hashes, texts)

    return run


class _Words:
    """Ids of the words that were listed so far, by their numbers."""

    def __init__(self):
        self.clear()

    def clear(self) -> None:
        self.values, self.lengths = np.zeros(0, np.int32), np.zeros(0, np.int64)
        self.starts = np.zeros(0, np.int64)

    def add(self, values: np.ndarray, lengths: np.ndarray) -> None:
        self.values, self.lengths = np.concatenate([self.values, values]), np.concatenate([self.lengths, lengths])
        self.starts = np.cumsum(self.lengths) - self.lengths


def _put_together(schema: pa.Schema, words: Callable[[], _Words]) -> Callable:
    """Rows of _cut, with words as ids, to batches of (doc_id, text_hash, and what words() gives for texts' words)."""

    def ids_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        inner = column.flatten()
        return inner.flatten().to_numpy(zero_copy_only=False).astype(np.int32), np.diff(inner.offsets.to_numpy()).astype(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, held = words(), []

        def learn() -> None:
            if held:
                known.add(*(np.concatenate(x) for x in zip(*held)))
                held.clear()

        for b in batches:
            firsts = b.column(2).to_pylist()
            i = 0
            while i < len(firsts):
                if firsts[i] is None:  # texts, up to the next list of words
                    n = next((j for j in range(i, len(firsts)) if firsts[j] is not None), len(firsts)) - i
                    learn()
                    texts = b.slice(i, n)
                    out = known.finish(np.frombuffer(x, "<u4").astype(np.int64) for x in each_text(texts.column(5)))
                    yield pa.RecordBatch.from_arrays([texts.column(0), texts.column(1), *out], schema=schema)
                    i += n
                    continue
                if firsts[i]:
                    held.clear()
                    known.clear()
                values, lengths = ids_of(b.column(3).slice(i, 1))
                done, n = ids_of(b.column(4).slice(i, 1))
                if n.any():  # known words stand as one byte among those that were merged
                    every, at = np.concatenate([values, done]), np.cumsum(lengths) - lengths
                    at, lengths = np.where(n > 0, len(values) + np.cumsum(n) - n, at), np.where(n > 0, n, lengths)
                    values = _runs(every, at, lengths)
                held.append((values, lengths))
                i += 1

    return run


def _placed(docs: DataFrame, path: str, pattern: str, most_bytes: int | None = None, most_words: int | None = None) -> DataFrame:
    need(docs, "doc_id", "text")
    spark = prepare(docs.sparkSession)
    spark.conf.set("spark.sql.maxPlanStringLength", "20000")  # the rank map is in the plan, and the driver keeps plans' texts
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), F.col("text").cast("string").alias("text"))
    return named.mapInArrow(trimmed(_cut(path, pattern, most_bytes, most_words)), _PLACED_SQL).select("doc_id", "text_hash", "first", merged(F.col("words"), path).alias("words"), "known", "of")


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, text_hash and ids (array of int) of each row's whole text, as the tokenizer would, without special tokens.

    Null and empty texts have no ids. Very long texts count whole, and so do very long words. Rows repeat as they do in docs,
    ties among them; doc_id may be null; an empty table gives no rows. Further columns of docs, whatever their names, are not
    looked at.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("ids", pa.list_(pa.int32()))])

    class Ids(_Words):
        def finish(self, places):
            found = [_runs(self.values, self.starts[x], self.lengths[x]) for x in places]
            return [pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, found)]), pa.int32()), pa.array(np.concatenate(found), pa.int32()))]

    return _placed(docs, path, pattern).mapInArrow(trimmed(_put_together(schema, Ids)), "doc_id long, text_hash long, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """Adds decoded (binary) to rows with ids: the pieces' bytes one after another. Null ids: null; no ids: empty."""
    prepare(encoded.sparkSession)

    @F.pandas_udf("binary")
    def joined(ids):
        pieces = {r: p for p, r in read_ranks(path).items()}
        return ids.map(lambda x: None if x is None else b"".join([pieces[i] for i in x]))

    return encoded.withColumn("decoded", joined("ids"))


def digests(docs: DataFrame, path: str, pattern: str, most_bytes: int | None = None, most_words: int | None = None) -> DataFrame:
    """doc_id, text_hash, n_tokens, ids_sha256 (of decimal ids joined by commas), decoded_sha256 (of the decoded bytes).

    The same as from encode and decode, in every case those name; ids and pieces are joined for each distinct word once.
    most_bytes and most_words (BLOCK and WORDS if not given) bound a task's memory against its time; results don't depend on them.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])
    sha = lambda x: hashlib.sha256(x).hexdigest()

    class Spelt(_Words):
        def __init__(self):
            self.piece = {r: p for p, r in read_ranks(path).items()}
            super().__init__()

        def clear(self) -> None:
            self.lengths, self.spelt, self.decoded = np.zeros(0, np.int64), [], []

        def add(self, values, lengths) -> None:
            self.lengths = np.concatenate([self.lengths, lengths])
            ends = np.cumsum(lengths).tolist()
            ids, piece = values.tolist(), self.piece
            for a, b in zip([0, *ends], ends):
                w = ids[a:b]
                self.spelt.append(",".join(map(str, w)).encode())
                self.decoded.append(b"".join([piece[i] for i in w]))

        def finish(self, places):
            n, a, b = [], [], []
            for x in places:
                of = x.tolist()
                n.append(int(self.lengths[x].sum()))
                a.append(sha(b",".join(map(self.spelt.__getitem__, of))))
                b.append(sha(b"".join(map(self.decoded.__getitem__, of))))
            return [pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())]

    return _placed(docs, path, pattern, most_bytes, most_words).mapInArrow(trimmed(_put_together(schema, Spelt)), "doc_id long, text_hash long, n_tokens long, ids_sha256 string, decoded_sha256 string")
