"""Exact and near duplicates against brute force."""

import hashlib
import random

import numpy as np
import pytest
import xxhash

from tandem.llm import exactdedup, simhash
from tandem.llm.common import written
from tandem.llm.components import components


def low(text):
    return (text or "").encode().lower()


def test_exact_groups(spark, docs, odd, nothing):
    both = docs.select("doc_id", "text").unionByName(odd.select("doc_id", "text"))
    groups = {}
    for r in both.collect():
        groups.setdefault(low(r["text"]), []).append(r["doc_id"])
    want = sorted((d or -1, max((x for x in ids if x is not None), default=None) or -1, len(ids), hashlib.sha256(t).hexdigest()) for t, ids in groups.items() for d in ids)
    got = exactdedup.exact_groups(both).collect()
    assert sorted((r["doc_id"] or -1, r["keep_id"] or -1, r["group_size"], r["text_sha256"]) for r in got) == want
    assert all(r["kept"] == (r["doc_id"] == r["keep_id"]) for r in got)
    assert exactdedup.exact_groups(nothing).count() == 0


def test_unique_texts(odd, nothing):
    kept = exactdedup.unique_texts(odd)
    assert kept.columns == odd.columns and exactdedup.unique_texts(nothing).columns == odd.columns
    rows = kept.collect()
    texts = [low(r["text"]) for r in rows]
    assert "same TEXT here" in {r["text"] for r in rows} and b"same text here" in texts
    assert len(texts) == len(set(texts)) and {low(r["text"]) for r in odd.collect()} - set(texts) <= set()


def test_quotient_filters():
    dice = np.random.default_rng(2)
    for width in (5, 60, 64):
        parts = [dice.integers(0, 1 << min(width, 10), 300).astype(np.uint64) << np.uint64(max(0, width - 10)) for _ in range(3)] + [np.full(700, 3, np.uint64)]
        filters = [exactdedup.CountingQuotientFilter(*np.unique(p, return_counts=True), width).to_bytes() for p in parts]
        keys, counts = exactdedup.CountingQuotientFilter.items_of(exactdedup.CountingQuotientFilter.merged(filters, width).to_bytes())
        want = np.unique(np.concatenate(parts), return_counts=True)
        assert (keys == want[0]).all() and (counts == want[1]).all()


def fingerprint(text, words=3):
    w = low(text).split()
    shingles = [b" ".join(w[i : i + words]) for i in range(len(w) - words + 1)] or ([b" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def component_sets(fps, links):
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        root[find(a)] = find(b)
    sets = {}
    for f in fps:
        sets.setdefault(find(f), set()).add(f)
    return sorted(map(sorted, sets.values()))


def linked(fps):
    a = np.array(fps, np.int64).view(np.uint64)
    return [(fps[i], fps[j]) for i in range(len(a)) for j in (i + 1 + np.flatnonzero(np.bitwise_count(a[i + 1 :] ^ a[i]) <= 3)).tolist()]


@pytest.fixture(scope="module")
def clustered():
    """Clusters around centres, and one whose members share half of their bits."""
    dice, fps = random.Random(3), {0, (1 << 64) - 1}
    for _ in range(30):
        centre = dice.getrandbits(64)
        for _ in range(20):
            fps.add(centre ^ sum({1 << dice.randrange(64) for _ in range(dice.choice([0, 1, 2, 3, 5]))}))
    centre = dice.getrandbits(64)
    for _ in range(400):
        fps.add(centre ^ sum({1 << dice.randrange(32) for _ in range(dice.randint(0, 8))}) ^ (dice.random() < 0.3 and 1 << dice.randrange(32, 64)))
    return [f - (1 << 64) if f >> 63 else f for f in fps]


@pytest.mark.parametrize("crowded", [1 << 40, 64, 4])
def test_links(spark, clustered, crowded):
    """The same components as all pairs, whether or not places are dealt out again."""
    df = written(spark.createDataFrame([(f,) for f in clustered], "fp long"), "t")
    got = [(r["a"], r["b"]) for r in simhash.linked_fingerprints(df, 3, crowded).collect()]
    assert set(map(frozenset, got)) <= set(map(frozenset, linked(clustered)))
    assert component_sets(clustered, got) == component_sets(clustered, linked(clustered))


def test_near_duplicates(docs, odd, nothing):
    both = docs.select("doc_id", "text").unionByName(odd.select("doc_id", "text")).collect()
    of = {}
    for r in both:
        of.setdefault(fingerprint(r["text"]), []).append(r["doc_id"])
    signed = {f - (1 << 64) if f >> 63 else f: ids for f, ids in of.items()}
    want = []
    for c in component_sets(list(signed), linked(list(signed))):
        least = min(x for f in c for x in signed[f] if x is not None) if any(x is not None for f in c for x in signed[f]) else None
        want += [(d or -1, f, least) for f in c for d in signed[f]]
    got = simhash.near_duplicates(docs.select("doc_id", "text").unionByName(odd.select("doc_id", "text"))).collect()
    key = lambda x: (x[0], x[1], -1 if x[2] is None else x[2])
    assert sorted(((r["doc_id"] or -1, r["fp"], r["component_id"]) for r in got), key=key) == sorted(want, key=key)
    assert simhash.near_duplicates(nothing).count() == 0


def test_long_texts_are_counted_in_pieces():
    text = b" ".join(b"w%d" % (i * i % 977) for i in range(70_000))
    h = simhash.shingle_hashes(text)
    assert simhash.majority([*h, *h[:2]], [len(h), 0, 2]).tolist()[0] == fingerprint(text.decode())
    assert simhash.majority([], [0, 0]).tolist() == [0, 0]


def test_one_of_each(odd, nothing):
    kept = simhash.one_of_each(odd, words=5)
    assert kept.columns == odd.columns
    ids = [r["doc_id"] for r in kept.collect() if r["doc_id"] is not None]
    assert len(ids) == len(set(ids)) and 3 in ids and 4 not in ids
    assert simhash.one_of_each(nothing).count() == 0


def test_components(spark):
    dice = random.Random(1)
    links = [(dice.randrange(300), dice.randrange(300)) for _ in range(200)] + [(1000, i) for i in range(1001, 1200)] + [(i, i + 1) for i in range(2000, 2100)]
    want = {x: min(c) for c in component_sets({x for p in links for x in p if p[0] != p[1]}, [p for p in links if p[0] != p[1]]) for x in c}
    got = components(spark.createDataFrame(links, "a long, b long")).collect()
    assert {r["node"]: r["component"] for r in got} == want and len(got) == len(want)
