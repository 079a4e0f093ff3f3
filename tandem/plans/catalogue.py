"""Every operator as a query over the driver's tables, with the SQL that says the same.

Messages are made from events (SQL below, the same for Spark and DuckDB but for JSON and times) and from documents. Times
are whole microseconds, or the document's number.
"""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import ids, text
from ..operators import cooccur, graph, links, outputs
from ..sources import messages as sources
from ..sources import store
from ..sources.shared import new_path
from . import networks

DAY, MINUTE = 86_400_000_000, 60_000_000
#: A window of doc_ids that spans any table.
WHOLE = 1 << 40

_POSTS = """
select cast(event_id as {string}) as message_id, cast(user_id as {string}) as user_id, concat('user_', cast(user_id as {string})) as username,
  case when event_type = 'view' then k end as repost_id, case when event_type = 'click' then k end as reply_id,
  concat(event_type, ' ', k) as message, us as timestamp, case when event_type = 'purchase' then concat('http://example.com/', k) end as url
from (select *, {k} as k, {us} as us from events) e
"""
POSTS_SPARK = _POSTS.format(string="string", k="get_json_object(props, '$.k')", us="timestampdiff(microsecond, timestamp_ntz'1970-01-01 00:00:00', ts)")
POSTS = _POSTS.format(string="varchar", k="json_extract_string(props, '$.k')", us="epoch_us(ts)")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(POSTS_SPARK.replace("from events", "from {events}"), events=_table(spark, sf_dir, "events"))


def text_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _table(spark, sf_dir, "documents")
    none = F.lit(None).cast("string")
    return d.select(F.col("doc_id").cast("string").alias("message_id"), F.col("source").alias("user_id"), F.col("source").alias("username"), none.alias("repost_id"), none.alias("reply_id"), F.col("text").alias("message"), F.col("doc_id").alias("timestamp"))


TEXT_POSTS = "select cast(doc_id as varchar) as message_id, source as user_id, text as message, doc_id as timestamp from documents"


def urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return posts(spark, sf_dir).where("repost_id is null and url is not null").select("message_id", "url", "timestamp", "user_id")


URLS = f"select message_id, url, timestamp, user_id from ({POSTS}) where repost_id is null and url is not null"


def resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stand-in for what HTTP would answer: link k leads to k modulo 10."""
    k = F.element_at(F.split("url", "/"), -1).cast("int")
    return urls(spark, sf_dir).select("url").distinct().select("url", F.concat(F.lit("http://r.example.com/"), (k % 10).cast("string")).alias("resolved_url"))


RESOLVED_URLS = f"""select distinct message_id, 'http://r.example.com/' || cast(cast(split_part(url, '/', 4) as int) % 10 as varchar) as url, timestamp, user_id from ({URLS})"""


def _edges_sql(rows: str, match: str, window: int, least: int = 1, loops: bool = True) -> str:
    return f"""
with r as ({rows})
select a.user_id as user_1, b.user_id as user_2, count(distinct a.message_id) as weight
from r a join r b on {match} and b.timestamp between a.timestamp - {window} and a.timestamp + {window} and a.message_id <> b.message_id
{"" if loops else "where a.user_id <> b.user_id"}
group by 1, 2 having count(distinct a.message_id) >= {least}
"""


NORMAL = r"trim(regexp_replace(regexp_replace(lower({}), '@\S*', '', 'g'), '\s+', ' ', 'g'))"
TOKENS = r"list_sort(list_distinct(regexp_extract_all(regexp_replace(lower({}), '@\S*', '', 'g'), '[\p{{L}}\p{{M}}\p{{N}}_]+|[^\s\p{{L}}\p{{M}}\p{{N}}_]')))"
JACCARD = "len(list_intersect({a}, {b})) / (len({a}) + len({b}) - len(list_intersect({a}, {b})))"

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def _query(sql: str | None = None):
    def keep(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return keep


# --- networks ------------------------------------------------------------------------------------------------------


@_query(_edges_sql(POSTS, "a.repost_id = b.repost_id", DAY))
def co_retweet_w1d(spark, sf_dir):
    return networks.co_retweet(posts(spark, sf_dir), DAY)


@_query(_edges_sql(POSTS, "a.repost_id = b.repost_id", DAY, 2))
def co_retweet_w1d_min2(spark, sf_dir):
    return networks.co_retweet(posts(spark, sf_dir), DAY, 2)


@_query(_edges_sql(POSTS, "a.repost_id = b.repost_id", DAY))
def co_retweet_bucketed(spark, sf_dir):
    return networks.co_retweet(posts(spark, sf_dir), DAY, bucketed=True)


@_query(f"select *, 'co_retweet' as edge_type from ({_edges_sql(POSTS, 'a.repost_id = b.repost_id', DAY, 1, False)})")
def co_retweet_no_loops(spark, sf_dir):
    return graph.edges(networks.co_retweet(posts(spark, sf_dir), DAY), "co_retweet")


@_query(_edges_sql(POSTS, "a.repost_id = b.repost_id", 0))
def co_retweet_w0(spark, sf_dir):
    return networks.co_retweet(posts(spark, sf_dir), 0)


@_query(_edges_sql(f"select * from ({POSTS}) where repost_id is null", "a.reply_id = b.reply_id", DAY))
def co_reply_w1d(spark, sf_dir):
    return networks.co_reply(posts(spark, sf_dir), DAY)


@_query(_edges_sql(URLS, "a.url = b.url", DAY))
def co_link_raw(spark, sf_dir):
    return networks.co_link(urls(spark, sf_dir), DAY)


@_query(_edges_sql(RESOLVED_URLS, "a.url = b.url", DAY))
def co_link_resolved(spark, sf_dir):
    found = links.resolved_message_urls(urls(spark, sf_dir), resolved(spark, sf_dir))
    return networks.co_link(found, DAY, resolved=True)


@_query(_edges_sql(POSTS, "true", MINUTE))
def co_post_w60(spark, sf_dir):
    return networks.co_post(posts(spark, sf_dir), MINUTE)


@_query(_edges_sql(POSTS, "true", 10 * MINUTE))
def co_post_w600(spark, sf_dir):
    return networks.co_post(posts(spark, sf_dir), 10 * MINUTE)


@_query(_edges_sql(f"select *, {NORMAL.format('message')} as norm from ({TEXT_POSTS})", "a.norm = b.norm", 1000))
def co_tweet_docs(spark, sf_dir):
    return networks.co_tweet(text_posts(spark, sf_dir), 1000)


_TOKENISED = f"select *, {TOKENS.format('message')} as toks from ({TEXT_POSTS})"


@_query(_edges_sql(_TOKENISED, f"len(a.toks) > 0 and len(b.toks) > 0 and {JACCARD.format(a='a.toks', b='b.toks')} >= 0.8", 50))
def co_similar_docs(spark, sf_dir):
    return networks.co_similar_tweet(text_posts(spark, sf_dir), 50, 0.8)


@_query(_edges_sql(_TOKENISED, f"len(a.toks) >= 30 and len(b.toks) >= 30 and {JACCARD.format(a='a.toks', b='b.toks')} >= 0.5", 50))
def co_similar_min_size(spark, sf_dir):
    return networks.co_similar_tweet(text_posts(spark, sf_dir), 50, 0.5, min_document_size=30)


@_query(_edges_sql(_TOKENISED, f"len(a.toks) > 0 and len(b.toks) > 0 and {JACCARD.format(a='a.toks', b='b.toks')} >= 0.8", 10))
def co_similar_own_function(spark, sf_dir):
    return networks.co_similar_tweet(text_posts(spark, sf_dir), 10, 0.8, similarity=text.jaccard)


# The same over the whole table: no SQL, for that compares all pairs of texts; tests compare with brute force.


@_query()
def co_similar_docs_whole(spark, sf_dir):
    return networks.co_similar_tweet(text_posts(spark, sf_dir), WHOLE, 0.8)


@_query()
def co_similar_min_size_whole(spark, sf_dir):
    return networks.co_similar_tweet(text_posts(spark, sf_dir), WHOLE, 0.5, min_document_size=30)


@_query()
def co_similar_own_function_whole(spark, sf_dir):
    return networks.co_similar_tweet(text_posts(spark, sf_dir), WHOLE, 0.8, similarity=text.jaccard)


@_query(_edges_sql(POSTS, "a.repost_id = b.repost_id and a.username <> b.username", DAY))
def custom_network(spark, sf_dir):
    return cooccur.cooccurrence(posts(spark, sf_dir), DAY, ["repost_id"], differ=["username"])


@_query(_edges_sql(POSTS, "a.reply_id = b.reply_id", DAY, 2))
def custom_sql_network(spark, sf_dir):
    sql = """select a.user_id as user_1, b.user_id as user_2, count(distinct a.message_id) as weight
        from own_posts a join own_posts b on a.reply_id = b.reply_id and b.timestamp between a.timestamp - :w and a.timestamp + :w
        where a.message_id <> b.message_id group by 1, 2 having count(distinct a.message_id) >= :least"""
    return networks.custom(spark, {"own_posts": posts(spark, sf_dir)}, sql, w=DAY, least=2)


# --- functions -----------------------------------------------------------------------------------------------------


@_query(f"select doc_id, {NORMAL.format('text')} as norm from documents")
def normalise_text(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", text.normalise(F.col("text")).alias("norm"))


@_query(f"select item_id, array_to_string({TOKENS.format('text')}, ' ') as tokens from benchmark")
def tokenize_text(spark, sf_dir):
    return _table(spark, sf_dir, "benchmark").select("item_id", F.array_join(text.tokens(F.col("text")), " ").alias("tokens"))


@_query(f"with t as (select item_id, {TOKENS.format('text')} as t from benchmark) select a.item_id, round({JACCARD.format(a='a.t', b='b.t')}, 9) as jaccard from t a join t b on b.item_id = a.item_id + 1")
def jaccard_pairs(spark, sf_dir):
    t = _table(spark, sf_dir, "benchmark").select("item_id", text.tokens(F.col("text")).alias("t"))
    b = t.select((F.col("item_id") - 1).alias("item_id"), F.col("t").alias("u"))
    return t.join(b, "item_id").select("item_id", F.round(text.jaccard(F.col("t"), F.col("u")), 9).alias("jaccard"))


@_query("select event_id, ((event_id * 4194304 * 1500 + 77) >> 22) / 1000.0 as seconds from events")
def snowflake_time(spark, sf_dir):
    return _table(spark, sf_dir, "events").select("event_id", ids.snowflake_seconds(F.col("event_id") * 4194304 * 1500 + 77).alias("seconds"))


# --- store and pruning ---------------------------------------------------------------------------------------------


def _users_sql(rows: str) -> str:
    return f"select user_id, count(*) as n_rows from ({rows}) group by 1 having count(*) >= 2"


@_query(_users_sql(POSTS))
def user_selection_post(spark, sf_dir):
    return cooccur.active_users(posts(spark, sf_dir), 2)


@_query(_users_sql(f"select * from ({POSTS}) where repost_id is null and reply_id is not null"))
def user_selection_reply(spark, sf_dir):
    return cooccur.active_users(posts(spark, sf_dir).where("repost_id is null and reply_id is not null"), 2)


@_query(_users_sql(f"select * from ({POSTS}) where repost_id is not null"))
def user_selection_repost(spark, sf_dir):
    return cooccur.active_users(posts(spark, sf_dir).where("repost_id is not null"), 2)


@_query(_users_sql(URLS))
def user_selection_link(spark, sf_dir):
    return cooccur.active_users(urls(spark, sf_dir), 2)


def _raw(spark, sf_dir) -> DataFrame:
    """Posts twice: the second time each id comes back with another text and another link."""
    p = posts(spark, sf_dir).withColumn("urls", F.when(F.col("url").isNull(), F.array(F.lit(""))).otherwise(F.array("url"))).withColumn("_seq", F.col("message_id").cast("bigint"))
    again = p.withColumn("message", F.concat("message", F.lit(" again"))).withColumn("urls", F.concat("urls", F.array(F.lit("http://again.example.com")))).withColumn("_seq", F.col("_seq") + 10**12)
    both = p.unionByName(again)
    return sources.from_table(both, F.col("_seq"))


@_query(f"select message_id, user_id, message, cast(timestamp as double) as timestamp from ({POSTS})")
def dedupe_messages(spark, sf_dir):
    return store.first_messages(_raw(spark, sf_dir)).select("message_id", "user_id", "message", "timestamp")


_EXPLODED = f"""select message_id, coalesce(url, '') as url, user_id from ({POSTS}) where repost_id is null
  union all select message_id, 'http://again.example.com' as url, user_id from ({POSTS}) where repost_id is null"""


@_query(_EXPLODED)
def explode_urls(spark, sf_dir):
    return store.message_urls(_raw(spark, sf_dir)).select("message_id", "url", "user_id")


@_query(f"select distinct url from ({URLS}) where cast(split_part(url, '/', 4) as int) % 2 = 1")
def pending_urls(spark, sf_dir):
    known = resolved(spark, sf_dir).where("cast(element_at(split(url, '/'), -1) as int) % 2 = 0")
    return store.pending_urls(urls(spark, sf_dir), known)


@_query(f"with u as (select distinct url from ({URLS})) select url, case when cast(split_part(url, '/', 4) as int) % 2 = 0 then 'new' else url end as resolved_url from u")
def upsert_resolved(spark, sf_dir):
    old = urls(spark, sf_dir).select("url").distinct().select("url", F.col("url").alias("resolved_url"))
    new = old.where("cast(element_at(split(url, '/'), -1) as int) % 2 = 0").select("url", F.lit("new").alias("resolved_url"))
    return links.upsert(old, new, "url")


# --- graph tables --------------------------------------------------------------------------------------------------

_PADDED = ", ".join(f"case when count(*) <= {i} then '' else max(case when n = {i + 1} then message end) end as message_{i}" for i in range(10))


@_query(
    f"""with p as (select *, row_number() over (partition by user_id order by timestamp desc nulls last, message_id) as n from ({POSTS}))
    select user_id, max(username) as username, {_PADDED} from (select * from p where n <= 10) group by user_id"""
)
def node_table_top10(spark, sf_dir):
    return graph.nodes(posts(spark, sf_dir), 10)


@_query(f"with e as ({_edges_sql(POSTS, 'a.repost_id = b.repost_id', DAY, 1, False)}) select user_1 as user_id from e union select user_2 from e")
def graph_nodes(spark, sf_dir):
    return graph.endpoints(graph.edges(networks.co_retweet(posts(spark, sf_dir), DAY), "co_retweet"))


@_query(
    f"""with recursive e as ({_edges_sql(POSTS, 'a.repost_id = b.repost_id', DAY // 24, 1, False)}),
    l as (select user_1 as a, user_2 as b from e union select user_2, user_1 from e),
    reach as (select a, a as b from l union select reach.a, l.b from reach join l on reach.b = l.a)
    select a as user_id, min(b) as component from reach group by a"""
)
def weak_components(spark, sf_dir):
    return graph.weak_components(graph.edges(networks.co_retweet(posts(spark, sf_dir), DAY // 24), "co_retweet"))


@_query(
    """with e as (select event_id, event_type as path, lag(event_type) over (order by event_id) as before from events),
    r as (select *, sum(case when path = before then 0 else 1 end) over (order by event_id) as run from e)
    select event_id, row_number() over (partition by run order by event_id) - 1 as clock from r"""
)
def logical_clock(spark, sf_dir):
    order = Window.orderBy("event_id")
    e = _table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("path"))
    new = F.coalesce((F.lag("path").over(order) != F.col("path")).cast("int"), F.lit(1))
    runs = e.withColumn("new", new).withColumn("run", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.select("event_id", (F.row_number().over(Window.partitionBy("run").orderBy("event_id")) - 1).cast("bigint").alias("clock"))


# --- sources and sinks ---------------------------------------------------------------------------------------------


@_query(f"select message_id, user_id, username, repost_id, reply_id, message, cast(timestamp as double) as timestamp, coalesce(url, '') as url from ({POSTS})")
def csv_roundtrip(spark, sf_dir):
    path = new_path(spark, "csv")
    p = posts(spark, sf_dir).select("message_id", "user_id", "username", "repost_id", "reply_id", "message", "timestamp", "url")
    p.write.option("header", True).option("quoteAll", True).option("escape", '"').csv(path)
    return sources.read_csv(spark, [path]).select("message_id", "user_id", "username", "repost_id", "reply_id", "message", "timestamp", F.get("urls", F.lit(0)).alias("url"))


_SNOWFLAKE = f"select cast(cast(message_id as bigint) * 4194304 as varchar) as message_id, user_id, username, repost_id, reply_id, message, cast(message_id as bigint) / 1000.0 as timestamp, url from ({POSTS})"


@_query(_SNOWFLAKE)
def json_first_shape(spark, sf_dir):
    path = new_path(spark, "json")
    big = F.col("message_id").cast("bigint") * 4194304
    line = F.struct(
        big.alias("id"), big.cast("string").alias("id_str"), F.struct(F.col("user_id").alias("id_str"), F.col("username").alias("screen_name")).alias("user"), F.lit("short").alias("text"), F.col("message").alias("full_text"),
        F.when(F.col("repost_id").isNotNull(), F.struct(F.col("repost_id").alias("id_str"))).alias("retweeted_status"), F.col("reply_id").alias("in_reply_to_status_id_str"),
        F.when(F.col("url").isNotNull(), F.struct(F.array(F.struct(F.col("url").alias("expanded_url"))).alias("urls"))).alias("entities"),
    )
    posts(spark, sf_dir).select(F.to_json(line)).write.text(path)
    return sources.read_posts_json(spark, [path]).select("message_id", "user_id", "username", "repost_id", "reply_id", "message", "timestamp", F.get("urls", F.lit(0)).alias("url"))


@_query(_SNOWFLAKE)
def json_second_shape(spark, sf_dir):
    path = new_path(spark, "json")
    big = (F.col("message_id").cast("bigint") * 4194304).cast("string")
    ref = lambda kind, c: F.when(F.col(c).isNotNull(), F.struct(F.lit(kind).alias("type"), F.col(c).alias("id")))
    tweet = F.struct(
        big.alias("id"), F.col("user_id").alias("author_id"), F.col("message").alias("text"), F.array_compact(F.array(ref("retweeted", "repost_id"), ref("replied_to", "reply_id"))).alias("referenced_tweets"),
        F.when(F.col("url").isNotNull(), F.struct(F.array(F.struct(F.col("url").alias("expanded_url"))).alias("urls"))).alias("entities"),
    )
    user = F.struct(F.col("user_id").alias("id"), "username")
    pages = posts(spark, sf_dir).groupBy((F.col("message_id").cast("bigint") % 50).alias("page")).agg(F.collect_list(tweet).alias("data"), F.collect_set(user).alias("users"))
    pages.select(F.to_json(F.struct("data", F.struct("users").alias("includes")))).write.text(path)
    return sources.read_posts_json(spark, [path]).select("message_id", "user_id", "username", "repost_id", "reply_id", "message", "timestamp", F.get("urls", F.lit(0)).alias("url"))


@_query()
def graphml_export(spark, sf_dir):
    """Counts of the elements of a GraphML file that was written (by the driver, where exports go)."""
    import tempfile

    with tempfile.TemporaryDirectory() as d:
        path = str(Path(d) / "network.graphml")
        p = posts(spark, sf_dir)
        outputs.write_graphml(networks.co_retweet(p, DAY, 2), "co_retweet", p, path)
        found = dict.fromkeys(("node", "edge", "key"), 0)
        with Path(path).open("rb") as f:
            while lines := f.read(1 << 24):
                lines += f.readline()  # a line holds whole tags
                for k in found:
                    found[k] += lines.count(f"<{k} ".encode())
    return spark.createDataFrame(list(found.items()), "element string, n long")


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
