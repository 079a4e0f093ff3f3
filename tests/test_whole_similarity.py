"""Similarity networks over a whole table against brute force, alike texts far apart included."""

from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tandem.functions import text
from tandem.plans import catalogue

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name, threshold, least", [("co_similar_docs", 0.8, 1), ("co_similar_min_size", 0.5, 30), ("co_similar_own_function", 0.8, 1)])
def test_whole(spark, name, threshold, least):
    rows = catalogue.text_posts(spark, SF).select("message_id", "user_id", "timestamp", text.tokens(F.col("message")).alias("tokens")).collect()
    rows = [(r["message_id"], r["user_id"], r["timestamp"], frozenset(r["tokens"])) for r in rows if len(r["tokens"]) >= least]
    edges, farthest = defaultdict(set), 0
    for m, u, t, a in rows:
        for n, v, s, b in rows:
            if m != n and len(a & b) >= threshold * len(a | b) - 1e-9:
                edges[u, v].add(m)
                farthest = max(farthest, abs(t - s))
    assert farthest > 50
    got = {(r["user_1"], r["user_2"]): r["weight"] for r in catalogue.queries()[f"{name}_whole"](spark, SF).collect()}
    assert got == {k: len(x) for k, x in edges.items()}
