"""Language models, language ID, licenses, shards and mixes against direct readings of their definitions."""

import re
import zlib
from collections import Counter, defaultdict
from math import log10

import numpy as np
import pytest

from tandem.llm import langid, licenses, lm, mixing, sharding
from tandem.llm.eliasfano import EliasFano


def crc(doc_id):
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode())


def test_elias_fano():
    dice = np.random.default_rng(1)
    for n, u in ((0, 10), (1, 1), (5, 5), (1000, 1 << 60), (5000, 6000), (3000, 1 << 20), (64, 1 << 63)):
        v = np.unique(dice.integers(0, u, n).astype(np.uint64)) if n < u else np.arange(n, dtype=np.uint64)
        e = EliasFano(len(v), u, *EliasFano.arrays(v, u))
        assert (e.values() == v).all() and (e.access(np.arange(len(v))) == v).all()
        asked = np.concatenate([v, dice.integers(0, u, 500).astype(np.uint64)])
        at = {x: i for i, x in enumerate(v.tolist())}
        assert e.find(asked).tolist() == [at.get(x, -1) for x in asked.tolist()]


def test_lm_scores(docs, odd, nothing):
    both = docs.select("doc_id", "text").unionByName(odd.select("doc_id", "text"))
    rows = [(r["doc_id"], (r["text"] or "").encode().lower().split() + [b"\xff"]) for r in both.collect()]
    c, pairs = Counter(), Counter()
    for d, t in rows:
        if crc(d) % 7 != 2:
            c.update(t)
            pairs.update(zip([b"\xff", *t], t))
    n, v, followers = sum(c.values()), len(c), Counter(u for u, _ in pairs)
    model = lm.train(both.where(~lm.held_out(both.doc_id)))
    assert (model["N"], model["V"], sum(m["n"] for m in model["level2"])) == (n, v, len(pairs))
    got = sorted(lm.score(both, model).collect(), key=lambda r: (r["n_tokens"], r["base_score"]))
    want = []
    for _, t in rows:
        alone = [(c[w] + 1) / (n + v + 1) for w in t]
        # D is estimated in each shard: within its range, the score lies between those of the two ends
        ends = []
        for d in (min(m["d"] for m in model["level2"]), max(m["d"] for m in model["level2"])):
            p = [(max(pairs[u, w] - d, 0) + d * followers[u] * a) / c[u] if c[u] else a for u, w, a in zip([b"\xff", *t], t, alone)]
            ends.append(sum(map(log10, p)))
        want.append((len(t), sum(c[w] > 0 for w in t), sum(map(log10, alone)), *sorted(ends)))
    want.sort(key=lambda x: (x[0], x[2]))
    for g, w in zip(got, want, strict=True):
        assert (g["n_tokens"], g["n_known"]) == w[:2] and g["base_score"] == pytest.approx(w[2], abs=1e-6)
        room = 0.12 * w[0] + 0.05
        assert w[3] - room <= g["score"] <= w[4] + room
    held = [(r["base_score"], r["score"]) for r in lm.score(docs.where(lm.held_out(docs.doc_id)), model).collect()]
    assert sum(s for _, s in held) > sum(b for b, _ in held)
    empty = lm.train(nothing)
    assert (empty["N"], lm.score(nothing, model).count()) == (0, 0)
    assert all(r["n_known"] == 0 and r["score"] == r["base_score"] for r in lm.score(odd, empty).collect())


def test_language(docs, odd, nothing):
    model = langid.fit(langid.labelled_rows(docs))
    assert model.langs == sorted(model.langs)
    truth = {r["doc_id"]: r["lang"] for r in docs.collect()}
    got = langid.predict(docs, model).collect()
    held = [r for r in got if crc(r["doc_id"]) % 5 == 0 and r["lang_pred"] != "und"]
    assert len(held) > 20 and sum(r["lang_pred"] == truth[r["doc_id"]] for r in held) >= 0.9 * len(held)
    assert all(0 <= r["score"] <= 1 for r in got)
    other = {(r["doc_id"], r["text_hash"]): r["lang_pred"] for r in langid.predict(odd, model).collect()}
    no_letter = {i for (i, _), lang in other.items() if lang == "und"}
    assert {None, 1, 2, 6, 7} == no_letter
    kept = langid.known_language(docs)
    assert kept.columns == docs.columns and kept.count() >= 0.95 * docs.count()
    assert langid.known_language(odd).columns == odd.columns and langid.known_language(nothing).count() == 0
    assert langid.predict(nothing, model).count() == 0
    assert {r["lang_pred"] for r in langid.predict(odd, langid.fit(langid.labelled_rows(nothing))).collect()} == {"und"}


def test_pieces_count_each_ngram_once():
    text = "".join(chr(97 + i * i % 26) for i in range(langid._PIECE + 1000)).encode()
    whole = np.bincount(langid.hashed(text), minlength=langid.BUCKETS)
    parts = sum(np.bincount(langid.hashed(p), minlength=langid.BUCKETS) for p in langid._pieces(text))
    assert abs(int(whole.sum()) - int(parts.sum())) <= 1


BREAK = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def scanned(text):
    words = BREAK.findall((text or "").translate(str.maketrans(licenses.UPPER, licenses.LOWER)))
    s = " " + " ".join(words) + " "
    base = [(label, i) for phrase, label in licenses.BASE.items() for p in [phrase.split()] for i in range(len(words)) if words[i : i + len(p)] == p]
    found = [(r["rule"], r["label"], r["priority"], a, a + m.group().count(" ") - 1) for r in licenses.rules() for m in re.finditer(r["regex"], s) for a in [s[: m.start()].count(" ")]]

    def beaten(d, e):
        if e[3] > d[4] or d[3] > e[4]:
            return False
        longer = e[3] <= d[3] and e[4] >= d[4] and e[4] - e[3] > d[4] - d[3]
        return e[2] > d[2] or (e[2] == d[2] and (longer or (e[3:] == d[3:] and e[0] < d[0])))

    return len(words), sorted(base), sorted(d for d in found if not any(beaten(d, e) for e in found))


LICENSED = [
    "Released under the MIT License. Released UNDER THE\nMIT LICENSE!", "Licensed under the Apache License, Version 2.0.", "CC BY-NC 4.0 and cc by nc", "GNU General Public License, version 3, or the BSD 3-Clause License",
    "SPDX-License-Identifier: GPL-3.0-only", "mit license", "mit der Lizenz", "under the themit license", "All Rights Reserved", "cc by nc nd 4.0 cc by", "the apache license version 2 apache license version 2 0", "under the mit license " * 300,
]


def test_licenses(spark, docs, odd, nothing):
    assert len(licenses.rules()) >= 300 and len({r["regex"] for r in licenses.rules()}) > 300
    extra = spark.createDataFrame([(10_000 + i, t) for i, t in enumerate(LICENSED)], "doc_id long, text string")
    both = docs.select("doc_id", "text").unionByName(odd.select("doc_id", "text")).unionByName(extra)
    texts = sorted((scanned(r["text"]) for r in both.collect()), key=repr)
    got = [(r["n_words"], sorted((b["label"], b["first"]) for b in r["base"]), sorted(tuple(d) for d in r["detections"])) for r in licenses.scan(both).collect()]
    assert sorted(got, key=repr) == texts
    labels = {r["doc_id"]: {d["label"] for d in r["detections"]} for r in licenses.scan(extra).collect()}
    assert labels[10_000] == {"mit"} and labels[10_001] == {"apache-2"} and labels[10_003] == {"gpl-3", "bsd-3-clause"} and labels[10_004] == {"gpl-3"} and not labels[10_006]
    assert licenses.scan(nothing).count() == 0


@pytest.mark.parametrize("shards", [1, 3, 16, 500])
def test_shards(docs, odd, shards):
    both = docs.select("doc_id", "text").unionByName(odd.select("doc_id", "text"))
    rows = both.collect()
    size = lambda t: len((t or "").encode()) + 1
    first, group = {}, defaultdict(int)
    for r in rows:
        group[r["text"]] += size(r["text"])
        if r["doc_id"] is not None:
            first[r["text"]] = min(first.get(r["text"], 1 << 62), r["doc_id"])
    atoms = defaultdict(int)
    for t, s in group.items():
        atoms[first.get(t, 0)] += s
    keys = sorted(atoms)
    capacity = sharding.least_capacity(np.array([atoms[k] for k in keys]), shards)
    want, n, filled = {}, 0, 0
    for k in keys:
        if filled and filled + atoms[k] > capacity:
            n, filled = n + 1, 0
        want[k] = n
        filled += atoms[k]
    got = sharding.shard(both, shards).collect()
    fill, slots = Counter(), defaultdict(list)
    for r in got:
        fill[r["shard"]] += r["size"]
        slots[r["shard"]].append((r["slot"], r["doc_id"] is None, r["doc_id"] or 0))
    assert len(got) == len(rows) and max(fill.values()) == capacity and max(fill) == n < shards
    for s in slots.values():
        s.sort()
        assert [x[0] for x in s] == list(range(len(s))) and [x[1:] for x in s] == sorted(x[1:] for x in s)
    of = defaultdict(set)
    for r in got:
        of[r["text_crc32"], r["size"]].add(r["shard"])
    assert all(len(x) == 1 for x in of.values())


def test_least_capacity():
    dice = np.random.default_rng(4)
    for _ in range(50):
        sizes, k = dice.integers(1, 30, dice.integers(1, 12)), int(dice.integers(1, 6))
        best = [0] + [1 << 60] * len(sizes)
        for _ in range(k):
            best = [0] + [min(max(best[j], int(sizes[j:i].sum())) for j in range(i)) for i in range(1, len(sizes) + 1)]
        assert sharding.least_capacity(sizes, k) == best[-1]


def test_targets(spark):
    """Water filled by hand: capped sources give their excess to the others, again and again."""
    dice = np.random.default_rng(6)
    for n in (1, 2, 7, 20):
        sizes = {f"s{i:02}": int(dice.integers(0, 1000)) if i % 4 else int(dice.integers(0, 10)) for i in range(n)}
        weights = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(sorted(sizes))}
        left, open_, goal = 1.5 * sum(sizes.values()), set(sizes), {}
        while open_:
            w = sum(weights[s] for s in open_)
            over = {s for s in open_ if weights[s] * left / w >= 2 * sizes[s] - 1e-9}
            if not over:
                goal |= {s: weights[s] * left / w for s in open_}
                break
            goal |= {s: 2.0 * sizes[s] for s in over}
            left -= sum(2 * sizes[s] for s in over)
            open_ -= over
        got = {r["source"]: r["target"] for r in mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
        assert got == pytest.approx(goal)


def test_mix(docs, odd, nothing):
    both = docs.select("doc_id", "text", "source").unionByName(odd.select("doc_id", "text", "source"))
    got = mixing.mix(both).collect()
    assert len(got) == both.count()
    taken, target = Counter(), {}
    for r in got:
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
    assert all(taken[s] == int(target[s]) for s in target)
    assert sorted(map(repr, got)) == sorted(map(repr, mixing.mix(both.repartition(7)).collect()))
    copies = {(r["doc_id"], r["text_hash"]): r["copies"] if r["size"] else 1 for r in got}
    out = mixing.mixed(docs)
    assert out.columns == docs.columns
    assert mixing.mix(nothing).count() == mixing.mixed(nothing).count() == 0
    assert mixing.mixed(odd).columns == odd.columns
    single = Counter(r["doc_id"] for r in mixing.mixed(docs).collect())
    assert max(single.values()) <= 2 and copies


def test_letters_are_those_of_unicode():
    import sys
    import unicodedata

    for c in map(chr, range(sys.maxunicode + 1)):
        assert langid.has_letter(f"1 {c}\u00bd") == unicodedata.category(c).startswith("L")
