"""Mixing sources to target weights: each source's rows in hash-random order, cut where its budget of words ends.

Targets come from the sources' sizes (one row a source). The rows are sorted by range within their source, sums before
each row are made range by range, and each source is taken whole as often as its budget holds it, then up to the word
at which the budget ends. A source that holds most rows is cut into ranges like any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import free_names, need, prepare, running_sum, written

WEIGHTS = (5, 2, 1)
WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """source, source_size, target of each source, from (source, source_size).

    Sources by code point, null last, take the weights in turn and share 150 % of all sizes; a target stops at twice its
    source's size and the excess goes to the others by weight. Sources whose cap is low for their weight fill up first:
    in order of cap by weight, a source is capped if its cap is no more than its share of what the earlier ones left.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(x).cast("long") for x in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    ranked = sizes.withColumn("nth", F.row_number().over(order)).withColumn("w", w)
    filling = Window.orderBy((F.col("source_size").cast("double") / F.col("w")), "nth")
    before, after = filling.rowsBetween(Window.unboundedPreceding, -1), filling.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    every = Window.partitionBy()
    x = ranked.withColumn("all", F.sum("source_size").over(every)).withColumn("full", F.coalesce(F.sum("source_size").over(before), F.lit(0))).withColumn("left", F.sum("w").over(after))
    x = x.withColumn("capped", 4 * F.col("source_size") * F.col("left") <= F.col("w") * (3 * F.col("all") - 4 * F.col("full")))
    x = x.withColumn("full", F.coalesce(F.sum(F.when(F.col("capped"), F.col("source_size"))).over(every), F.lit(0))).withColumn("left", F.sum(F.when(~F.col("capped"), F.col("w"))).over(every))
    share = (F.col("w") * (3 * F.col("all") - 4 * F.col("full"))).cast("double") / (2 * F.col("left")).cast("double")
    return x.select("source", "source_size", F.when(F.col("capped"), (2 * F.col("source_size")).cast("double")).otherwise(share).alias("target"))


def mix(docs: DataFrame, seed: str = "") -> DataFrame:
    """doc_id, text_hash, size, source_size, target, taken, copies of each row of docs.

    size counts words (null text: 0); taken is how many words the mix takes, repeats counted; copies how often the row's
    whole text is in the mix if the row at which a budget ends is taken whole. Rows follow each other by the MD5 of seed
    and doc_id, ties by doc_id, so a rerun takes the same. Repeated rows are rows of their own. A source of size 0 has
    target 0. An empty table gives an empty table.
    """
    need(docs, "doc_id", "text", "source")
    prepare(docs.sparkSession)
    key = F.md5(F.concat(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    text = F.col("text").cast("string")
    sized = written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), F.col("source").cast("string").alias("source"), n_words(text).alias("size"), key.alias("key")), "sized")
    goal = written(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size"))), "targets").withColumnRenamed("source", "of")
    summed = running_sum(sized, ["source"], ["key", "doc_id", "text_hash"], "size", "before")
    x = summed.join(goal, F.col("source").eqNullSafe(F.col("of")), "left")
    x = x.withColumn("budget", F.floor("target").cast("long"))
    x = x.withColumn("times", F.expr("case when source_size > 0 then budget div source_size else 0L end"))
    x = x.withColumn("rest", F.col("budget") - F.col("times") * F.col("source_size"))
    part = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), F.col("rest") - F.col("before")))
    return x.select("doc_id", "text_hash", "source", "size", "source_size", "target", (F.col("times") * F.col("size") + part).alias("taken"), (F.col("times") + (part > 0).cast("long")).alias("copies"))


def mixed(docs: DataFrame, seed: str = "") -> DataFrame:
    """The mix itself: each row of docs as often as it is taken, whole; the row at which a source's budget ends counts as taken.

    Rows without words take no budget and are in the mix once. Repeated rows are taken as often as the one most taken.
    """
    found = mix(docs, seed)
    n = F.when(F.col("size") == 0, F.lit(1).cast("long")).otherwise(F.col("copies"))
    own, of, key, its, times, nth = free_names(docs, 6)
    wanted = found.groupBy(F.col("doc_id").alias(key), F.col("text_hash").alias(its)).agg(F.max(n).alias(times)).where(F.col(times) > 0)
    named = docs.select("*", F.col("doc_id").cast("long").alias(own), F.xxhash64("text").alias(of))
    joined = named.join(wanted, F.col(own).eqNullSafe(F.col(key)) & (F.col(of) == F.col(its)))
    return joined.select("*", F.explode(F.sequence(F.lit(1).cast("long"), F.col(times))).alias(nth)).select(*[docs[c] for c in docs.columns])
