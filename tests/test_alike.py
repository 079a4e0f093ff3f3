"""Alike texts of a whole table: against brute force, and without trying all pairs."""

import random
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from test_counting import shuffled

from tandem.functions import text
from tandem.operators.alike import _cuts, candidates
from tandem.operators.similar import similarity_network


def _rows():
    """Groups of edited sets, small and large, exact copies, repeated and null message ids, a null user, an empty set."""
    dice, out = random.Random(3), []
    for n in (1, 3, 12, 40, 700):
        for _ in range(4):
            base = [f"w{dice.randrange(30 * n)}" for _ in range(n)]
            for _ in range(6):
                t = {dice.choice(["x", f"e{dice.randrange(99)}", w]) if dice.random() < dice.choice([0, 0.05, 0.2]) else w for w in base}
                out.append((f"m{len(out) - dice.choice([0, 0, 0, 1])}", dice.choice([None, "a", "b", "c", "d"]), dice.randrange(1000), sorted(t | {"common"})))
    return [*out, *out[3:9], (None, "a", 1, ["w1"]), ("e", "b", 2, []), ("f", "c", 2, [])]


def test_whole_table_without_all_pairs(spark):
    rows = _rows()
    df = spark.createDataFrame(rows, "message_id string, user_id string, timestamp long, tokens array<string>")
    tried = spark.sparkContext.accumulator(0)

    def own(a, b):
        tried.add(1)
        return len({*a} & {*b}) / len({*a} | {*b}) if a or b else None

    one = F.udf(own, "double")
    similarity = lambda a, b: one(a, b)
    similarity.least_jaccard = lambda threshold: threshold
    for threshold, least in ((0.8, 0), (0.5, 5), (1.0, 0)):
        for f in (None, similarity, text.jaccard):
            want = defaultdict(set)
            for m, u, _, a in rows:
                for n, v, _, b in rows:
                    a_, b_ = set(a), set(b)
                    if None not in (m, n) and m != n and a and b and (f or min(len(a), len(b)) >= least) and len(a_ & b_) / len(a_ | b_) >= threshold:
                        want[u, v].add(m)
            got = similarity_network(df, 1000, threshold, min_size=least, similarity=f)
            assert {(r[0], r[1]): r[2] for r in got.collect()} == {k: len(x) for k, x in want.items()}
    assert 0 < tried.value < len(rows) ** 2


def test_pairs_are_not_shuffled(spark):
    """Near copies without end: every two are alike, in blocks of one size and of several, and no pair goes through a shuffle."""
    common = [f"w{i}" for i in range(60)]
    sets = [(i, sorted([*common[: 52 + i % 7], f"x{i}"])) for i in range(300)] + [(1000 + i, [f"y{i}"]) for i in range(40)]
    df = spark.createDataFrame(sets, "node long, tokens array<string>").coalesce(1)
    want = {frozenset((a, b)) for a, s in sets for b, t in sets if a < b and len({*s} & {*t}) >= 0.8 * len({*s} | {*t})}
    found = candidates(df, 0.8)
    got = found.collect()
    assert len(want) == 300 * 299 // 2 and len(got) == len({frozenset((r["a"], r["b"])) for r in got})
    assert want <= {frozenset((r["a"], r["b"])) for r in got} and shuffled(found) < 40
    tokens = dict(sets)
    assert all(r["at"] == tokens[r["a"]] and r["bt"] == tokens[r["b"]] for r in got)


def test_large_sets_that_share_little_are_ruled_out(spark):
    """Sets of thousands of tokens, a tenth of which any two share: all pairs share one of their rarest tokens, and none is alike but two."""
    dice = random.Random(5)
    sets = [(i, sorted(f"w{x}" for x in dice.sample(range(60_000), 6000))) for i in range(40)]
    sets.append((40, sorted([*sets[7][1][:5000], *(f"x{i}" for i in range(500))])))
    sets += [(100 + i, sorted(f"w{x}" for x in dice.sample(range(300), 40))) for i in range(400)]
    df = spark.createDataFrame(sets, "node long, tokens array<string>").repartition(4)
    got = {frozenset((r["a"], r["b"])) for r in candidates(df, 0.5).select("a", "b").collect()}
    whole = {i: set(s) for i, s in sets}
    want = {frozenset((a, b)) for a in whole for b in whole if a < b and len(whole[a] & whole[b]) >= 0.5 * len(whole[a] | whole[b])}
    assert frozenset((7, 40)) in want and want <= got
    assert len([p for p in got if max(p) < 100]) < 10


def test_blocks_hold_like_shares_of_sets_and_tokens():
    n, count = np.array([1, 2, 50, 60, 7000]), np.array([5000, 10, 900, 1000, 30])
    for blocks in (1, 4, 15):
        cuts = _cuts(n, count, blocks)
        key = np.repeat(n, count) + np.concatenate([np.arange(k) / k for k in count])
        block = np.searchsorted(cuts, key, "right")
        for weight in (np.ones(len(key)), np.repeat(n, count)):
            assert np.bincount(block, weights=weight).max() <= 2.1 / blocks * weight.sum() + weight.max()
    assert len(_cuts(n[:0], count[:0], 4)) == 0


def test_compared_in_cells_no_tokens_leave(spark):
    """For Jaccard itself only the pairs that are alike come back, those just below the threshold not, and without their tokens."""
    sets = [(i, sorted([*(f"w{x}" for x in range(38 + i % 3)), *(f"x{i}_{x}" for x in range(10))])) for i in range(60)]
    df = spark.createDataFrame(sets, "node long, tokens array<string>")
    whole = {i: set(s) for i, s in sets}
    want = sorted((a, b) for a in whole for b in whole if a < b and len(whole[a] & whole[b]) / len(whole[a] | whole[b]) >= 2 / 3)
    found = candidates(df, 2 / 3, compared=True)
    assert found.columns == ["a", "b"] and 0 < len(want) < 60 * 59 // 2
    assert sorted((min(r), max(r)) for r in found.collect()) == want
