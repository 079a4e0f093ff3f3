"""Weights counted in cells against brute force, and that no table of pairs is made on the way."""

import math
import random

import pytest

from tandem.operators import counting
from tandem.operators.cooccur import cooccurrence
from tandem.plans import catalogue


def brute(rows, window, least=1, differ=False):
    found = {}
    for m1, u1, t1, k1, j1, n1 in rows:
        for m2, u2, t2, k2, j2, n2 in rows:
            if None in (m1, m2, k1, k2, j1, j2, t1, t2) or m1 == m2 or (k1, j1) != (k2, j2) or abs(t1 - t2) > window:
                continue
            if not differ or (None not in (n1, n2) and n1 != n2):
                found.setdefault((u1, u2), set()).add(m1)
    return {(*p, len(s)) for p, s in found.items() if len(s) >= least}


@pytest.mark.parametrize("pairs, slots", [(1 << 18, 16), (40, 16), (40, 0)])
def test_cells(pairs, slots):
    """One message in several rows and of several users, null users, very many pairs of one user, all in small pieces."""
    import pyarrow as pa

    dice = random.Random(pairs + slots)
    rows = [(f"m{dice.randrange(120)}", dice.choice([None, *"aaaabcdef"]), dice.randrange(60), dice.choice("xyz"), dice.randrange(2), dice.choice("pq")) for _ in range(220)]
    t = pa.table([list(c) for c in zip(*rows)], names=["m", "u", "t", "k0", "k1", "d0"])
    before = counting.PAIRS, counting.SLOTS
    counting.PAIRS, counting.SLOTS = pairs, slots
    try:
        for least, n in ((1, 0), (1, 1), (3, 0)):
            got = {(users[int(a)].as_py(), names[int(b)].as_py(), int(w)) for users, x, names, y, z in counting._edges(t, t, 7, True, 2, n, least) for a, b, w in zip(x, y, z)}
            assert got == brute(rows, 7, least, bool(n))
    finally:
        counting.PAIRS, counting.SLOTS = before


def test_frame(spark):
    dice = random.Random(3)
    rows = [(dice.choice([None, *(f"m{i}" for i in range(90))]), dice.choice([None, "a", "b", "c"]), dice.choice([None, *range(50)]), dice.choice([None, "x", "y"]), dice.choice([None, 1, 2]), dice.choice([None, "p", "q"])) for _ in range(150)]
    df = spark.createDataFrame(rows, "message_id string, user_id string, timestamp long, k string, j int, n string")
    for options in ({}, {"differ": ["n"]}):
        assert {tuple(r) for r in cooccurrence(df, 5, ["k", "j"], **options).collect()} == brute(rows, 5, differ=bool(options))
    none = df.where("false")
    assert cooccurrence(none, 5, ["k"]).count() == 0 and cooccurrence(none, 5, ["k"]).dtypes == [("user_1", "string"), ("user_2", "string"), ("weight", "bigint")]


@pytest.mark.parametrize("name", ["co_post_w60", "co_post_w600", "co_link_raw", "co_reply_w1d", "co_retweet_w1d", "co_retweet_bucketed", "co_retweet_no_loops", "custom_network"])
def test_no_table_of_pairs(spark, name):
    plan = catalogue.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Aggregate" not in plan


def shuffled(df):
    """Rows that the final plan of a frame that has run wrote to shuffle files."""

    def walk(node):
        if node.nodeName().endswith("QueryStage"):
            return walk(node.plan())
        own = node.metrics().apply("shuffleRecordsWritten").value() if node.nodeName() == "Exchange" else 0
        below = node.children()
        return own + sum(walk(below.apply(i)) for i in range(below.size()))

    return walk(df._jdf.queryExecution().executedPlan().executedPlan())


@pytest.mark.parametrize("partitions", ["4", "30", "150"])
def test_rows_are_shuffled_once(spark, partitions):
    """However many blocks there are, what is packed goes to the shuffle once, with a mark for each block."""
    dice = random.Random(5)
    rows = [(f"m{i}", f"u{dice.randrange(40)}", dice.randrange(90), dice.choice("xyz"), 1, None) for i in range(300)]
    df = spark.createDataFrame(rows, "message_id string, user_id string, timestamp long, k string, j int, n string").coalesce(1)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        got = cooccurrence(df, 5, ["k", "j"])
        assert {tuple(r) for r in got.collect()} == brute(rows, 5)
        assert shuffled(got) <= 2 * max(4, math.ceil(math.sqrt(int(partitions))))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_graphml_counts_network_once(spark, tmp_path, monkeypatch):
    """Edges are stored before ordering and the nodes read them, and the store is gone afterwards."""
    from pyspark.sql import functions as F

    from tandem.operators import outputs

    stored, gone = [], []
    monkeypatch.setattr(outputs, "written", lambda df, name, f=outputs.written: stored.append(f(df, name)) or stored[-1])
    monkeypatch.setattr(outputs, "forget", lambda *t, f=outputs.forget: gone.extend(t) or f(*t))
    rows = [(f"m{i}", f"u{i % 4}", f"n{i % 4}", "r", f"text\n{i}", i) for i in range(12)]
    m = spark.createDataFrame(rows, "message_id string, user_id string, username string, repost_id string, message string, timestamp long")
    network = cooccurrence(m, 3, ["repost_id"])
    path = tmp_path / "n.graphml"
    outputs.write_graphml(network, "co_retweet", m, str(path))
    want = {(r["user_1"], r["user_2"]) for r in network.where(F.col("user_1") != F.col("user_2")).collect()}
    assert stored == gone and len(stored) == 1
    assert path.read_text().count("<edge ") == len(want) and path.read_text().count("<node ") == 4
