"""The six networks. Each takes message rows and returns (user_1, user_2, weight) as one lazy plan, loops included."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators.cooccur import cooccurrence
from ..operators.similar import similarity_network


def co_retweet(messages: DataFrame, time_window: float, min_edge_weight: int = 1, bucketed: bool | None = None) -> DataFrame:
    """Accounts that repost the same message."""
    return cooccurrence(messages, time_window, ["repost_id"], min_edge_weight, bucketed=bucketed)


def co_tweet(messages: DataFrame, time_window: float, min_edge_weight: int = 1, preprocessor: Callable[[Column], Column] = text.normalise, bucketed: bool | None = None) -> DataFrame:
    """Accounts that post the same text, after the preprocessor, in originals."""
    rows = messages.where("repost_id is null").select("message_id", "user_id", "timestamp", preprocessor(F.col("message")).alias("text"))
    return cooccurrence(rows, time_window, ["text"], min_edge_weight, bucketed=bucketed)


def co_reply(messages: DataFrame, time_window: float, min_edge_weight: int = 1, bucketed: bool | None = None) -> DataFrame:
    """Accounts that reply to the same message."""
    return cooccurrence(messages.where("repost_id is null"), time_window, ["reply_id"], min_edge_weight, bucketed=bucketed)


def co_post(messages: DataFrame, time_window: float, min_edge_weight: int = 1) -> DataFrame:
    """Accounts that post anything, reposts included, at about the same time."""
    return cooccurrence(messages, time_window, [], min_edge_weight)


def co_link(urls: DataFrame, time_window: float, min_edge_weight: int = 1, resolved: bool = False, bucketed: bool | None = None) -> DataFrame:
    """Accounts that share the same link, from rows (message_id, url or resolved_url, timestamp, user_id)."""
    return cooccurrence(urls, time_window, ["resolved_url" if resolved else "url"], min_edge_weight, bucketed=bucketed)


def co_similar_tweet(
    messages: DataFrame,
    time_window: float,
    similarity_threshold: float = 0.9,
    min_edge_weight: int = 1,
    min_document_size: int = 0,
    similarity: Callable[[Column, Column], Column] | None = None,
    tokenizer: Callable[[Column], Column] = text.tokens,
) -> DataFrame:
    """Accounts that post similar texts, in originals."""
    rows = messages.where("repost_id is null and message is not null").select("message_id", "user_id", "timestamp", tokenizer(F.col("message")).alias("tokens"))
    return similarity_network(rows, time_window, similarity_threshold, min_edge_weight, min_document_size, similarity)


def custom(spark: SparkSession, tables: dict[str, DataFrame], sql: str, functions: dict[str, tuple[Callable, str]] | None = None, **parameters) -> DataFrame:
    """A network by one's own SQL over tables given by name, which must select user_1, user_2 and weight.

    functions: name to (function, SQL type of its result), for use in the SQL; parameters stand as :name in it.
    """
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
    for name, (f, kind) in (functions or {}).items():
        spark.udf.register(name, f, kind)
    out = spark.sql(sql, args=parameters)
    if not {"user_1", "user_2", "weight"} <= set(out.columns):
        raise ValueError("the query must select user_1, user_2 and weight")
    return out.select("user_1", "user_2", "weight")
