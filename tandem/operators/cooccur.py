"""Pairs of rows that share keys and lie within a time window, and account pairs weighted by them.

Networks are counted without a table of pairs (counting). What follows makes the pairs, for predicates of one's own, streams
and column types that can't be counted.

A window of W is found by buckets 2W wide: a left row lies in one, a right row in those that its own window touches, one
or two. So the join is an equi-join on (keys, bucket), which Spark can shuffle, spill and split when skewed, and the exact
condition is checked on what meets. No pair meets twice.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .counting import countable, counted

PairPredicate = Callable[[DataFrame], Column]


def _bucketed(rows: DataFrame, window: float, side: int) -> DataFrame:
    """Adds _b: the bucket of a left row (side 1), each bucket that a right row's window touches (side 2)."""
    whole = isinstance(rows.schema[f"t{side}"].dataType, (T.LongType, T.IntegerType))
    t = F.col(f"t{side}")
    if whole:
        width, slack = F.lit(int(2 * window)).cast("long"), F.lit(int(window)).cast("long")
        start = lambda x: x - F.pmod(x, width)
        step = width
    else:  # in doubles t + W may round up to a time that lies beyond
        width, slack = F.lit(2.0 * window), F.lit(1.001 * window)
        start = lambda x: F.floor(x / width).cast("long")
        step = F.lit(1).cast("long")
    if side == 1:
        return rows.withColumn("_b", start(t))
    return rows.where(t.isNotNull()).withColumn("_b", F.explode(F.sequence(start(t - slack), start(t + slack), step)))


def band_pairs(left: DataFrame, right: DataFrame, window: float, keys: Sequence[str] = (), bucketed: bool | None = None) -> DataFrame:
    """left (m1, u1, t1, ...) and right (m2, u2, t2, ...) rows with equal keys, |t2 - t1| <= window and m1 <> m2.

    Null keys, times and ids match nothing. bucketed: by default only where there are no keys, since a key's rows are
    mostly few; for keys with very many rows, buckets divide them.
    """
    if window < 0:
        raise ValueError("the window can't be negative")
    if bucketed is None:
        bucketed = not keys
    inside = F.col("t2").between(F.col("t1") - F.lit(window), F.col("t1") + F.lit(window)) & (F.col("m1") != F.col("m2"))
    for k in keys:
        left, right = left.withColumnRenamed(k, f"_{k}1"), right.withColumnRenamed(k, f"_{k}2")
    same = [F.col(f"_{k}1") == F.col(f"_{k}2") for k in keys]
    if window == 0:
        same.append(F.col("t1") == F.col("t2"))
    elif bucketed:
        left, right = _bucketed(left, window, 1), _bucketed(right, window, 2).withColumnRenamed("_b", "_b2")
        same.append(F.col("_b") == F.col("_b2"))
    on = inside
    for s in same:
        on = on & s
    drop = [x for k in keys for x in (f"_{k}1", f"_{k}2")] + ["_b", "_b2"]
    return left.join(right, on).drop(*drop)


def sides(rows: DataFrame, keys: Sequence[str], extra: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Two sides of a self-join over rows (message_id, user_id, timestamp, keys and extra columns)."""

    def side(n: int) -> DataFrame:
        named = [F.col("message_id").alias(f"m{n}"), F.col("user_id").alias(f"u{n}"), F.col("timestamp").alias(f"t{n}")]
        return rows.select(*named, *keys, *[F.col(c).alias(f"{c}{n}") for c in extra])

    return side(1), side(2)


def active_users(rows: DataFrame, least: int) -> DataFrame:
    """user_id of those with at least ``least`` rows; no others can reach that weight as user_1."""
    return rows.groupBy("user_id").agg(F.count("*").alias("n_rows")).where(F.col("n_rows") >= least)


def weighted(pairs: DataFrame, least: int = 1) -> DataFrame:
    """(user_1, user_2, weight): different messages m1 of user_1 that a message of user_2 matches, if at least ``least``."""
    distinct = pairs.select(F.col("u1").alias("user_1"), F.col("u2").alias("user_2"), "m1").distinct()
    return distinct.groupBy("user_1", "user_2").agg(F.count("*").alias("weight")).where(F.col("weight") >= least)


def cooccurrence(
    rows: DataFrame,
    window: float,
    keys: Sequence[str] = (),
    min_edge_weight: int = 1,
    pair_predicate: PairPredicate | None = None,
    extra: Sequence[str] = (),
    bucketed: bool | None = None,
    differ: Sequence[str] = (),
) -> DataFrame:
    """A directed network of accounts whose messages share ``keys`` within the window: (user_1, user_2, weight).

    rows has message_id, user_id, timestamp, the keys, and columns ``extra`` that pair_predicate may compare: it gets
    the pairs (columns c1 and c2 for each extra c) and returns a condition. Messages match only if the columns ``differ``
    all have different values. Loops (user_1 = user_2) are included. Without a pair_predicate no pairs are made, so that
    ``bucketed``, which says how they are found, has no effect.
    """
    if pair_predicate is None and countable(rows, keys, differ):
        return counted(rows, window, keys, min_edge_weight, differ)
    extra = [*extra, *(c for c in differ if c not in extra)]
    for k in keys:
        rows = rows.where(F.col(k).isNotNull())
    left, right = sides(rows, keys, extra)
    if min_edge_weight > 1:
        left = left.join(active_users(rows, min_edge_weight).select("user_id"), F.col("u1") == F.col("user_id"), "left_semi")
    pairs = band_pairs(left, right, window, keys, bucketed)
    for c in differ:
        pairs = pairs.where(F.col(f"{c}1") != F.col(f"{c}2"))
    if pair_predicate is not None:
        pairs = pairs.where(pair_predicate(pairs))
    return weighted(pairs, min_edge_weight)
