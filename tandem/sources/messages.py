"""Readers. Each returns the eight input columns and three that order rows by arrival."""

from __future__ import annotations

from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.ids import snowflake_seconds
from .schema import ARRIVAL, INPUT, INPUT_COLUMNS, as_input

_ORDER = "_source int, _file string, _line bigint"


def _arrival(df: DataFrame, source: int) -> DataFrame:
    """Files that can't be split are read in order by one task, so that ids rise along the lines."""
    return df.withColumn("_source", F.lit(source)).withColumn("_file", F.input_file_name()).withColumn("_line", F.monotonically_increasing_id())


def _union(frames: list[DataFrame]) -> DataFrame:
    if not frames:
        raise ValueError("no input files")
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def read_csv(spark: SparkSession, paths: Iterable[str]) -> DataFrame:
    """UTF-8 CSV files with a header line whose names don't matter: columns count by position.

    ``urls`` is split at single blanks, so that an empty field gives one empty URL. A timestamp that is no number fails.
    """
    raw = T.StructType([T.StructField(c, T.StringType()) for c in INPUT_COLUMNS])
    frames = []
    for i, path in enumerate(paths):
        df = spark.read.csv(path, schema=raw, header=True, enforceSchema=True, multiLine=True, quote='"', escape='"', encoding="UTF-8")
        df = _arrival(df, i)
        text = {c: F.coalesce(c, F.lit("")) for c in ("message_id", "user_id", "username", "message", "urls")}
        df = df.withColumns(text).withColumn("timestamp", F.col("timestamp").cast("double")).withColumn("urls", F.split("urls", " "))
        frames.append(as_input(df))
    return _union(frames)


def from_rows(spark: SparkSession, rows: Iterable[tuple]) -> DataFrame:
    """Tuples of the eight columns; ids of any type become strings, falsy repost and reply ids null, urls None an empty list."""

    def typed(i: int, r: tuple):
        s = lambda x: None if x is None else str(x)
        m, u, name, repost, reply, text, t, urls = r
        return (s(m), s(u), s(name), s(repost or None), s(reply or None), s(text), float(t), [str(x) for x in urls or []], 0, "", i)

    schema = T.StructType([*INPUT.fields, T.StructField("_source", T.IntegerType()), T.StructField("_file", T.StringType()), T.StructField("_line", T.LongType())])
    return spark.createDataFrame([typed(i, r) for i, r in enumerate(rows)], schema)


def from_table(df: DataFrame, order: Column | None = None) -> DataFrame:
    """Any DataFrame with the eight columns; ``order`` says what came first (default: the rows' places)."""
    placed = df.withColumn("_source", F.lit(0)).withColumn("_file", F.lit("")).withColumn("_line", order.cast("bigint") if order is not None else F.monotonically_increasing_id())
    return as_input(placed)


def _lines(spark: SparkSession, paths: Iterable[str]) -> DataFrame:
    return _union([_arrival(spark.read.text(p), i) for i, p in enumerate(paths)]).where(F.length(F.trim("value")) > 0)


_URLS = "urls array<struct<expanded_url: string>>"
_V1 = f"""id bigint, id_str string, user struct<id_str: string, screen_name: string>, full_text string, text string,
    extended_tweet struct<full_text: string, entities: struct<{_URLS}>>, retweeted_status struct<id_str: string>,
    in_reply_to_status_id_str string, entities struct<{_URLS}>"""
_TWEET = f"""id string, author_id string, author struct<username: string>, text string,
    referenced_tweets array<struct<type: string, id: string>>, entities struct<{_URLS}>"""
_USERS = "struct<users: array<struct<id: string, username: string>>>"


def _v1(lines: DataFrame) -> DataFrame:
    x = lines.withColumn("t", F.from_json("value", _V1)).where("t.id_str is not null and t.user.id_str is not null")
    text = F.coalesce("t.full_text", "t.extended_tweet.full_text", "t.text")
    urls = F.transform(F.coalesce("t.extended_tweet.entities.urls", "t.entities.urls", F.array().cast("array<struct<expanded_url: string>>")), lambda u: u["expanded_url"])
    return as_input(
        x.select(
            F.col("t.id_str").alias("message_id"), F.col("t.user.id_str").alias("user_id"), F.col("t.user.screen_name").alias("username"),
            F.col("t.retweeted_status.id_str").alias("repost_id"), F.col("t.in_reply_to_status_id_str").alias("reply_id"), text.alias("message"),
            snowflake_seconds(F.coalesce(F.col("t.id"), F.col("t.id_str").cast("bigint"))).alias("timestamp"), urls.alias("urls"), *ARRIVAL,
        )
    )


def _names(authors: Column, ids: Column, names: Column) -> Column:
    """Each author's name: that of the first user of the page with the id, if any."""

    @F.pandas_udf("array<string>")
    def found(authors: pd.Series, ids: pd.Series, names: pd.Series) -> pd.Series:
        def one(a, i, n):
            if a is None:
                return None
            of = {} if i is None else dict(zip(reversed(i.tolist()), reversed(n.tolist())))
            of.pop(None, None)
            return [of.get(x) for x in a]

        return pd.Series([one(*x) for x in zip(authors, ids, names)], dtype=object)

    return found(authors, ids, names)


def _v2(lines: DataFrame) -> DataFrame:
    """Pages (data, includes) and tweets that are flat already."""
    page = lines.withColumn("p", F.from_json("value", f"data string, includes {_USERS}")).withColumn("data", F.coalesce("p.data", "value"))
    items = F.when(F.col("data").startswith("["), F.from_json("data", f"array<struct<{_TWEET}>>")).otherwise(F.array(F.from_json("data", _TWEET)))
    page = page.select(*ARRIVAL, "p.includes.users", items.alias("items"))
    # names are found for a page at once, so that no post carries its page's users along or goes through them
    names = _names(F.col("items.author_id"), F.col("users.id"), F.col("users.username"))
    page = page.select(*ARRIVAL, "items", names.alias("names"))
    x = page.select(*ARRIVAL, F.posexplode(F.arrays_zip("items", "names")).alias("_nth", "z")).select(*ARRIVAL, "_nth", F.col("z.items").alias("t"), F.col("z.names").alias("author")).where("t.id is not null and t.author_id is not null")
    author = F.col("author")
    last = lambda kind: F.get(F.reverse(F.filter("t.referenced_tweets", lambda r: r["type"] == kind)), F.lit(0))["id"]
    urls = F.transform(F.coalesce("t.entities.urls", F.array().cast("array<struct<expanded_url: string>>")), lambda u: u["expanded_url"])
    return as_input(
        x.select(
            F.col("t.id").alias("message_id"), F.col("t.author_id").alias("user_id"), F.coalesce(author, "t.author.username").alias("username"),
            last("retweeted").alias("repost_id"), last("replied_to").alias("reply_id"), F.col("t.text").alias("message"),
            snowflake_seconds(F.col("t.id").cast("bigint")).alias("timestamp"), urls.alias("urls"), "_source", "_file", (F.col("_line") * 100_000 + F.col("_nth")).alias("_line"),
        )
    )


def read_posts_json(spark: SparkSession, paths: Iterable[str]) -> DataFrame:
    """JSON lines of posts in either API shape, told apart line by line; lines of neither shape are an error.

    First shape: one post a line (text from full_text, the extended post, or text). Second shape: pages or flat posts.
    Of several references of a kind the last counts; quotes don't.
    """
    lines = _lines(spark, paths).withColumn("k", F.from_json("value", "id_str string, data string, author_id string, meta string, errors string"))
    kind = F.when(F.col("k.data").isNotNull() | F.col("k.author_id").isNotNull(), 2).when(F.col("k.id_str").isNotNull(), 1).when(F.col("k.meta").isNotNull() | F.col("k.errors").isNotNull(), 0)
    lines = lines.withColumn("kind", F.coalesce(kind, F.raise_error(F.concat(F.lit("not a post: "), F.substring("value", 1, 80))).cast("int")))
    first = _v1(lines.where("kind = 1")).withColumn("_line", F.col("_line") * 100_000)
    return first.unionByName(_v2(lines.where("kind = 2")))


def read_likes_json(spark: SparkSession, paths: Iterable[str], profiles: DataFrame | None = None) -> DataFrame:
    """Pages that list who liked or reposted a post, or what a user liked; one kind in a load.

    The clock counts a path's entries from 0 while pages of that path follow each other, and starts anew at another path;
    for what a user liked it is always 0. ``profiles`` (user_id, username) names those users; a null name there means the
    profile is gone. Pages are few, so that one ordered window over them is no burden.
    """
    page = "`__twarc` struct<url: string>, data array<struct<id: string, username: string>>"
    x = _lines(spark, paths).withColumn("p", F.from_json("value", page)).withColumn("path", F.parse_url(F.col("p.`__twarc`.url"), F.lit("PATH")))
    parts = F.split("path", "/")
    x = x.withColumn("kind", F.element_at(parts, -1)).withColumn("subject", F.get(parts, F.size(parts) - 2))
    kinds = [r["kind"] for r in x.select("kind").distinct().limit(5).collect()]
    if any(k not in ("liking_users", "liked_tweets", "retweeted_by") for k in kinds):
        raise ValueError("only pages of liking_users, liked_tweets and retweeted_by can be read")
    if len(kinds) > 1:
        raise TypeError("pages of different endpoints can't be mixed in one load")
    arrival = Window.orderBy(*ARRIVAL)
    changed = (F.lag("path").over(arrival).isNull() | (F.lag("path").over(arrival) != F.col("path"))).cast("int")
    x = x.withColumn("changed", changed).withColumn("run", F.sum("changed").over(arrival.rowsBetween(Window.unboundedPreceding, 0)))
    x = x.withColumn("before", F.coalesce(F.sum(F.size(F.coalesce("p.data", F.array().cast("array<struct<id: string, username: string>>")))).over(Window.partitionBy("run").orderBy(*ARRIVAL).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    x = x.select("*", F.posexplode("p.data").alias("nth", "o"))
    if kinds == ["liked_tweets"]:
        if profiles is not None:
            named = profiles.select(F.col("user_id").cast("string").alias("_u"), F.coalesce("username", F.concat("user_id", F.lit("_profile_unavailable"))).alias("_name"))
            x = x.join(named, F.col("subject") == F.col("_u"), "left").withColumn("name", F.coalesce("_name", "subject"))
        else:
            x = x.withColumn("name", F.col("subject"))
        user, name, post, clock = F.col("subject"), F.col("name"), F.col("o.id"), F.lit(0.0)
    else:
        user, name, post, clock = F.col("o.id"), F.col("o.username"), F.col("subject"), (F.col("before") + F.col("nth")).cast("double")
    none = F.lit(None).cast("string")
    return as_input(
        x.select(
            F.concat_ws("_", post, user).alias("message_id"), user.alias("user_id"), name.alias("username"), post.alias("repost_id"), none.alias("reply_id"), none.alias("message"),
            clock.alias("timestamp"), F.array().cast("array<string>").alias("urls"), "_source", "_file", (F.col("_line") * 100_000 + F.col("nth")).alias("_line"),
        )
    )
