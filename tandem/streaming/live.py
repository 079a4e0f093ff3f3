"""Networks over a stream of messages: pairs within the window, each once, as far as lateness allows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def live_pairs(messages: DataFrame, key: str, window_seconds: float, lateness: str = "10 minutes") -> DataFrame:
    """(m1, u1, t1, m2, u2, t2) for a stream with message_id, user_id, a timestamp column ``at`` and the key.

    Both sides of the self-join keep rows for the window and the lateness only. Counting different m1 of an account pair,
    as the batch networks do, is left to the sink (see live_weights).
    """
    side = lambda n: messages.where(F.col(key).isNotNull()).select(
        F.col("message_id").alias(f"m{n}"), F.col("user_id").alias(f"u{n}"), F.col("at").alias(f"t{n}"), F.col(key).alias(f"k{n}")
    ).withWatermark(f"t{n}", lateness)
    w = F.expr(f"interval {window_seconds} seconds")
    on = (F.col("k1") == F.col("k2")) & F.col("t2").between(F.col("t1") - w, F.col("t1") + w) & (F.col("m1") != F.col("m2"))
    return side(1).join(side(2), on).select("m1", "u1", "t1", "m2", "u2", "t2")


def live_weights(pairs: DataFrame, least: int = 1) -> DataFrame:
    """(user_1, user_2, weight) of pairs gathered so far, for use in foreachBatch or over a sink's table."""
    from ..operators.cooccur import weighted

    return weighted(pairs, least)
