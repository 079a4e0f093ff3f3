"""Pairs within a time window whose token sets are alike.

For a threshold above 0, two sets can only be as similar if they share one of their few rarest tokens (a prefix of each)
and are of similar size. So pairs are looked up by (bucket, prefix token) and verified in full; none is lost. Where the window
spans the table, alike does the same without a table of what meets.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import jaccard
from .alike import weights
from .cooccur import active_users, band_pairs, sides, weighted

_LESS = 1e-9  #: so that rounding only widens the prefix


def rare_first(rows: DataFrame) -> DataFrame:
    """rows with ``rare``: the tokens of each, rarest of all rows first, ties by token."""
    of = rows.select("message_id", F.explode("tokens").alias("token"))
    often = of.groupBy("token").agg(F.count("*").alias("often"))
    ranked = of.join(often, "token").groupBy("message_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("often", "token"))), lambda x: x["token"]).alias("rare"))
    return rows.join(ranked, "message_id")


def similar_pairs(rows: DataFrame, window: float, threshold: float) -> DataFrame:
    """Pairs (m1, u1, t1, m2, u2, t2) of rows (message_id, user_id, timestamp, tokens) with Jaccard >= threshold > 0."""
    rows = rows.where((F.size("tokens") > 0) & F.col("message_id").isNotNull())
    n = F.size("rare")
    prefix = F.slice("rare", F.lit(1), (n - F.ceil(n * threshold - _LESS) + 1).cast("int"))
    short = rare_first(rows).withColumn("n", n).withColumn("token", F.explode(prefix)).select("message_id", "user_id", "timestamp", "token", "n")
    left, right = sides(short, ["token"], ["n"])
    size = (F.col("n2") >= F.col("n1") * threshold - _LESS) & (F.col("n1") >= F.col("n2") * threshold - _LESS)
    met = band_pairs(left, right, window, ["token"], bucketed=True).where(size).select("m1", "u1", "t1", "m2", "u2", "t2").distinct()
    token = lambda k: rows.select(F.col("message_id").alias(f"m{k}"), F.col("tokens").alias(f"tokens{k}"))
    whole = met.join(token(1), "m1").join(token(2), "m2")
    return whole.where(jaccard(F.col("tokens1"), F.col("tokens2")) >= threshold).drop("tokens1", "tokens2")


def _spans(rows: DataFrame, window: float) -> bool:
    """Whether all times lie within the window of each other."""
    first, last = rows.agg(F.min("timestamp"), F.max("timestamp")).first()
    return first is not None and first + window >= last and last - window <= first


def similarity_network(
    rows: DataFrame, window: float, threshold: float, min_edge_weight: int = 1, min_size: int = 0, similarity: Callable[[Column, Column], Column] | None = None
) -> DataFrame:
    """(user_1, user_2, weight) of rows (message_id, user_id, timestamp, tokens) that are alike within the window.

    Two empty sets are not alike. A similarity of one's own, or a threshold of 0 or less, is tried on all pairs of the
    window; Jaccard above 0 uses the prefixes. Sets under min_size are similar by 0 to any.

    If the window spans all rows, tables are stored at once, and a similarity of one's own is spared most pairs if it has an
    attribute ``least_jaccard``: a function of the threshold to the least Jaccard similarity of two sets that are alike.
    """
    bound = threshold if similarity is None else getattr(similarity, "least_jaccard", lambda t: 0)(threshold)
    if bound > 0 and _spans(rows, window):
        timed = rows.where(F.col("timestamp").isNotNull())
        return weighted(weights(timed, bound, similarity or jaccard, threshold, similarity is None, min_size if similarity is None else 1), min_edge_weight)
    if similarity is None and threshold > 0:
        sized = rows.where(F.size("tokens") >= max(1, min_size))
        return weighted(similar_pairs(sized, window, threshold), min_edge_weight)
    from ..functions.text import jaccard_of_size

    alike = similarity or jaccard_of_size(min_size)
    left, right = sides(rows.where("tokens is not null"), [], ["tokens"])
    if min_edge_weight > 1:
        left = left.join(active_users(rows, min_edge_weight).select("user_id"), F.col("u1") == F.col("user_id"), "left_semi")
    return weighted(band_pairs(left, right, window).where(alike(F.col("tokens1"), F.col("tokens2")) >= threshold), min_edge_weight)
