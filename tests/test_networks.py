"""Networks against values worked out by hand and against a direct reading of their definition."""

import random

import pytest
from pyspark.sql import functions as F

from tandem.functions import text
from tandem.operators import graph
from tandem.operators.cooccur import cooccurrence
from tandem.plans import networks
from tandem.sources import messages, store

REPOSTS = [
    (0, 0, 0, 0), (1, 1, 0, 59), (2, 2, 1, 60), (3, 3, 1, 70), (4, 2, 2, 70), (5, 3, 2, 131), (6, 4, 3, 30), (7, 5, 3, 89),
    (8, 4, 4, 40), (9, 5, 4, 41), (10, 10, 5, 42), (11, 10, 5, 52), (12, 11, 6, 42), (13, 12, 6, 300), (14, 0, 0, 1),
]


@pytest.fixture(scope="module")
def reposts(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("csv") / "in.csv"
    lines = ["message_id,user_id,username,repost_id,reply_id,message,timestamp,urls"]
    lines += [f'{m},uid{u},username{u},rtid{r},,Example tweet from uid{u},{t},""' for m, u, r, t in REPOSTS]
    path.write_bytes(b"\xef\xbb\xbf" + "\n".join(lines).encode())
    return store.first_messages(messages.read_csv(spark, [str(path)])).cache()


def edges(df):
    return {(r["user_1"].removeprefix("uid"), r["user_2"].removeprefix("uid"), r["weight"]) for r in df.collect()}


@pytest.mark.parametrize(("window", "least", "loops", "n"), [(1, 1, False, 2), (1, 1, True, 3), (1, 2, False, 0), (1, 2, True, 1), (60, 1, False, 6), (60, 1, True, 7)])
def test_node_counts(reposts, window, least, loops, n):
    network = networks.co_retweet(reposts, window, least)
    assert graph.endpoints(graph.edges(network, "co_retweet", loops)).count() == n


def test_direction_matters(reposts):
    one = edges(networks.co_retweet(reposts, 60, 1))
    assert one == {("0", "0", 2), ("0", "1", 2), ("1", "0", 1), ("10", "10", 2), ("2", "3", 1), ("3", "2", 1), ("4", "5", 2), ("5", "4", 2)}
    assert edges(networks.co_retweet(reposts, 60, 2)) == {e for e in one if e[2] >= 2}
    assert networks.co_post(reposts, 1).count() == 13
    assert networks.co_post(reposts, 60).count() == 59


MIXED = [
    ("a1", "u1", "n1", "", "p1", "Hello @bob World", 0, "http://x/1 http://x/2"), ("a2", "u2", "n2", "", "p1", "hello   world", 10, "http://x/1"),
    ("a3", "u2", "n2b", "", "", "HELLO world @z", 10.5, "http://x/1"), ("a4", "u1", "n1", "", "p2", "the cat sat on the mat", 100, ""),
    ("a5", "u3", "n3", "", "p2", "the cat sat on the mat slowly", 160, ""), ("a6", "u3", "n3", "a1", "", "Hello @bob World", 5, "http://x/1"),
    ("a7", "u1", "n1", "a1", "", "Hello @bob World", 65, ""), ("a2", "u9", "n9", "", "p1", "same id as an earlier row", 11, "http://x/9 http://x/1"),
    ("a8", "u4", "n4", "", "", "@only", 20, ""), ("a9", "u2", "n2", "", "", "@other", 30, ""),
]


@pytest.fixture(scope="module")
def mixed(spark):
    return messages.from_rows(spark, [(*r[:7], r[7].split(" ")) for r in MIXED])


def as_set(df):
    return {tuple(r) for r in df.select("user_1", "user_2", "weight").collect()}


def test_mixed_networks(mixed):
    m, urls = store.first_messages(mixed).cache(), store.message_urls(mixed).cache()
    assert m.count() == 9
    assert {(r["message_id"], r["url"], r["user_id"]) for r in urls.collect()} == {
        ("a1", "http://x/1", "u1"), ("a1", "http://x/2", "u1"), ("a2", "http://x/1", "u2"), ("a3", "http://x/1", "u2"), ("a4", "", "u1"), ("a5", "", "u3"), ("a2", "http://x/9", "u9"), ("a8", "", "u4"), ("a9", "", "u2")
    }
    assert as_set(networks.co_retweet(m, 60)) == {("u1", "u3", 1), ("u3", "u1", 1)}
    assert as_set(networks.co_tweet(m, 60)) == {("u1", "u2", 1), ("u2", "u1", 2), ("u2", "u2", 2), ("u2", "u4", 1), ("u4", "u2", 1)}
    assert as_set(networks.co_reply(m, 60)) == {("u1", "u2", 1), ("u1", "u3", 1), ("u2", "u1", 1), ("u3", "u1", 1)}
    dropped = {("u1", "u2", 1), ("u2", "u1", 2), ("u2", "u2", 2)}
    assert as_set(networks.co_link(urls, 60)) == dropped | {("u1", "u3", 1), ("u2", "u4", 1), ("u3", "u1", 1), ("u4", "u2", 1)}
    assert as_set(networks.co_link(store.message_urls(mixed, keep_empty=False), 60)) == dropped
    alike = {("u1", "u2", 1), ("u1", "u3", 1), ("u2", "u1", 2), ("u2", "u2", 2), ("u3", "u1", 1)}
    for tokenizer in (text.tokens, text.word_tokens):
        assert as_set(networks.co_similar_tweet(m, 60, 0.8, min_document_size=1, tokenizer=tokenizer)) == alike
    assert as_set(networks.co_similar_tweet(m, 60, 0.8, similarity=text.jaccard)) == alike
    assert networks.co_tweet(m, 0).count() == networks.co_post(m, 0).count() == 0
    nodes = {r["user_id"]: tuple(r)[1:] for r in graph.nodes(m, 2).collect()}
    assert nodes == {
        "u1": ("n1", "the cat sat on the mat", "Hello @bob World"), "u2": ("n2b", "@other", "HELLO world @z"),
        "u3": ("n3", "the cat sat on the mat slowly", "Hello @bob World"), "u4": ("n4", "@only", ""),
    }


def brute(rows, window, key):
    found = {}
    for m1, u1, t1, k1 in rows:
        for m2, u2, t2, k2 in rows:
            if m1 != m2 and t1 - window <= t2 <= t1 + window and (not key or (k1 is not None and k1 == k2)):
                found.setdefault((u1, u2), set()).add(m1)
    return {(*p, len(s)) for p, s in found.items()}


@pytest.mark.parametrize("kind", ["whole", "tenths", "epoch", "border"])
@pytest.mark.parametrize("window", [0, 1, 60])
def test_random_rows(spark, kind, window):
    dice = random.Random(f"{kind}{window}")
    at = {
        "whole": lambda: float(dice.randint(-300, 300)), "tenths": lambda: dice.randint(-900, 900) / 10,
        "epoch": lambda: 1.6e9 + dice.randint(0, 4000) / 8, "border": lambda: dice.choice([59.99999999999999, 60.0, 120.0, 0.0, -60.0, 119.99999999999999, 180.0]),
    }[kind]
    rows = [(f"m{i}", f"u{dice.randint(0, 9)}", at(), dice.choice([None, "a", "b", "c"])) for i in range(150)]
    df = spark.createDataFrame(rows, "message_id string, user_id string, timestamp double, k string")
    assert as_set(cooccurrence(df, window)) == brute(rows, window, False)
    for bucketed in (False, True):
        assert as_set(cooccurrence(df, window, ["k"], bucketed=bucketed)) == brute(rows, window, True)
    least = {e for e in brute(rows, window, True) if e[2] >= 2}
    assert as_set(cooccurrence(df, window, ["k"], 2)) == least
    whole = df.withColumn("timestamp", (F.col("timestamp") * 1000).cast("long"))
    ms = [(m, u, int(t * 1000), k) for m, u, t, k in rows]
    assert as_set(cooccurrence(whole, window * 1000)) == brute(ms, window * 1000, False)


def test_similarity_random(spark):
    dice = random.Random(5)
    rows = [(f"m{i}", f"u{i % 7}", float(i), sorted({dice.choice("abcdefghij") for _ in range(dice.randint(0, 8))})) for i in range(120)]
    df = spark.createDataFrame(rows, "message_id string, user_id string, timestamp double, tokens array<string>")
    from tandem.operators.similar import similarity_network

    for threshold in (0.5, 0.8, 1.0):
        found = {}
        for m1, u1, t1, a in rows:
            for m2, u2, t2, b in rows:
                if m1 != m2 and abs(t1 - t2) <= 30 and a and b and len(set(a) & set(b)) / len(set(a) | set(b)) >= threshold:
                    found.setdefault((u1, u2), set()).add(m1)
        assert as_set(similarity_network(df, 30, threshold)) == {(*p, len(s)) for p, s in found.items()}


def test_components_and_custom(spark, reposts):
    e = graph.edges(networks.co_retweet(reposts, 60), "co_retweet")
    found = {r["user_id"]: r["component"] for r in graph.weak_components(e).collect()}
    assert found == {"uid0": "uid0", "uid1": "uid0", "uid2": "uid2", "uid3": "uid2", "uid4": "uid4", "uid5": "uid4"}
    sql = """select a.user_id as user_1, b.user_id as user_2, count(distinct a.message_id) as weight from m a join m b
        on a.repost_id = b.repost_id and abs(a.timestamp - b.timestamp) <= :w and a.message_id <> b.message_id group by 1, 2"""
    assert edges(networks.custom(spark, {"m": reposts}, sql, w=60)) == edges(networks.co_retweet(reposts, 60))
    with pytest.raises(ValueError, match="unknown"):
        graph.edges(e, "other")
    with pytest.raises(ValueError, match="must select"):
        networks.custom(spark, {"m": reposts}, "select 1 as x")
