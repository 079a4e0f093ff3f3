"""Edge and node tables, and weakly connected components."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import written

NETWORKS = ("co_retweet", "co_tweet", "co_reply", "co_link", "co_similar_tweet", "co_post")


def edges(network: DataFrame, edge_type: str, loops: bool = False) -> DataFrame:
    """(user_1, user_2, weight, edge_type), without loops unless asked for."""
    if edge_type not in NETWORKS:
        raise ValueError(f"unknown network {edge_type}; known are {', '.join(NETWORKS)}")
    out = network if loops else network.where("user_1 <> user_2")
    return out.select("user_1", "user_2", "weight", F.lit(edge_type).alias("edge_type"))


def nodes(messages: DataFrame, n_messages: int = 10) -> DataFrame:
    """user_id, username (the greatest) and message_0 ... of each user: the most recent texts, latest first.

    Ties in time by message_id; null times last; '' beyond a user's messages, null where a message has no text. Each
    task keeps only a user's latest ones before the shuffle is sorted; names and texts are gathered in one pass.
    """
    names = messages.groupBy("user_id").agg(F.max("username").alias("username"))
    if n_messages <= 0:
        return names
    # the largest come first: an ascending message_id among equal times needs the order below
    from pyspark.sql import Window

    latest = Window.partitionBy("user_id").orderBy(F.col("timestamp").desc_nulls_last(), F.col("message_id").asc())
    top = messages.select("user_id", "timestamp", "message_id", "message").withColumn("_n", F.row_number().over(latest)).where(F.col("_n") <= n_messages)
    wide = top.groupBy("user_id").agg(F.count("*").alias("_k"), *[F.max(F.when(F.col("_n") == i + 1, F.col("message"))).alias(f"message_{i}") for i in range(n_messages)])
    padded = [F.when(F.col("_k") <= i, F.lit("")).otherwise(F.col(f"message_{i}")).alias(f"message_{i}") for i in range(n_messages)]
    return names.join(wide.select("user_id", *padded), "user_id")


def endpoints(edge_rows: DataFrame) -> DataFrame:
    """user_id of every account with an edge."""
    return edge_rows.select(F.col("user_1").alias("user_id")).union(edge_rows.select("user_2")).distinct()


def graph(network: DataFrame, edge_type: str, messages: DataFrame, loops: bool = False, n_messages: int = 10) -> tuple[DataFrame, DataFrame]:
    """(edges, nodes), nodes only of accounts with an edge."""
    e = edges(network, edge_type, loops)
    return e, nodes(messages.join(endpoints(e), "user_id", "left_semi"), n_messages)


def weak_components(edge_rows: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(user_id, component): the smallest account reachable over edges in either direction.

    In turn every account points its larger neighbours, then itself and its smaller ones, to the smallest it knows, until
    nothing changes; each round ends in a table in the shared folder.
    """
    alone = endpoints(edge_rows)
    now = written(edge_rows.where("user_1 <> user_2").select(F.greatest("user_1", "user_2").alias("a"), F.least("user_1", "user_2").alias("b")).distinct(), "links")
    before = None
    for _ in range(most_rounds):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        small = large.join(large.groupBy("a").agg(F.min("b").alias("m")), "a")
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(small.select("a", F.col("m").alias("b")))
        now = written(small.where("a <> b").distinct(), "links")
        mark = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if mark == before or mark["n"] == 0:
            break
        before = mark
    else:
        raise RuntimeError("components: no end after the allowed rounds")
    return alone.join(now.select(F.col("a").alias("user_id"), F.col("b").alias("_c")), "user_id", "left").select("user_id", F.coalesce("_c", "user_id").alias("component"))
