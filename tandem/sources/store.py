"""The message store: a folder of Parquet tables with a version.

messages holds the first row of each message_id, message_url the first of each (message_id, url). URLs come from the rows
as they arrived, so that a repeated message still brings the URLs that its first row lacked; reposts bring none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .schema import ARRIVAL, FORMAT_VERSION, RESOLVED

_URL = "message_id string, url string, timestamp double, user_id string"


def first_messages(raw: DataFrame) -> DataFrame:
    """One row of each message_id, the first by arrival; rows without user_id are left out, null ids all stay."""
    first = Window.partitionBy("message_id").orderBy(*ARRIVAL)
    known = raw.where("user_id is not null").drop("urls")
    one = known.where("message_id is not null").withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
    return one.unionByName(known.where("message_id is null"))


def message_urls(raw: DataFrame, keep_empty: bool = True) -> DataFrame:
    """One row of each (message_id, url) of originals, the first by arrival. keep_empty: the URL '' counts as one."""
    x = raw.where("repost_id is null").select("message_id", F.posexplode("urls").alias("_nth", "url"), "timestamp", "user_id", *ARRIVAL)
    x = x.where("url is not null") if keep_empty else x.where("url is not null and url <> ''")
    first = Window.partitionBy("message_id", "url").orderBy(*ARRIVAL, "_nth")
    return x.withColumn("_n", F.row_number().over(first)).where("_n = 1").select("message_id", "url", "timestamp", "user_id")


def pending_urls(urls: DataFrame, resolved: DataFrame | None) -> DataFrame:
    """URLs that no row of resolved has an answer for."""
    every = urls.select("url").distinct()
    return every if resolved is None else every.join(resolved.where("resolved_url is not null").select("url"), "url", "left_anti")


class Store:
    """A store at a path; made on first use. Tables are read anew at each call."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        version = self._read("metadata")
        if version is not None:
            found = {r["property"]: r["value"] for r in version.collect()}
            if found.get("version") != str(FORMAT_VERSION):
                raise ValueError(f"the store at {path} has format {found.get('version')}, not {FORMAT_VERSION}")
            need = {"message_id", "user_id", "username", "repost_id", "reply_id", "message", "timestamp"}
            messages = self._read("messages")
            if messages is not None and not need <= set(messages.columns):
                raise ValueError(f"the store at {path} has another layout")

    def _exists(self, name: str) -> bool:
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}/_SUCCESS")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def _read(self, name: str) -> DataFrame | None:
        return self.spark.read.parquet(f"{self.path}/{name}") if self._exists(name) else None

    def append(self, raw: DataFrame, keep_empty_urls: bool = True, only_empty: bool = False) -> None:
        """Adds rows of the input schema; what is stored already stays as it is."""
        stored, urls = self._read("messages"), self._read("message_url")
        if only_empty and stored is not None and not stored.isEmpty():
            raise ValueError("this input needs an empty store")
        new, new_urls = first_messages(raw).drop(*ARRIVAL), message_urls(raw, keep_empty_urls)
        if stored is not None:
            new = new.join(stored.select("message_id"), "message_id", "left_anti")
        if urls is not None:
            new_urls = new_urls.join(urls.select("message_id", "url"), ["message_id", "url"], "left_anti")
        columns = ["message_id", "user_id", "username", "repost_id", "reply_id", "message", "timestamp"]
        # what is appended must not be read from where it is written to
        from .shared import written

        if stored is not None:
            new, new_urls = written(new.select(columns), "append"), written(new_urls, "append")
        new.select(columns).write.mode("append").parquet(f"{self.path}/messages")
        new_urls.write.mode("append").parquet(f"{self.path}/message_url")
        if not self._exists("metadata"):
            self.spark.createDataFrame([("version", str(FORMAT_VERSION))], "property string, value string").coalesce(1).write.parquet(f"{self.path}/metadata")

    def messages(self) -> DataFrame:
        found = self._read("messages")
        if found is None:
            raise ValueError(f"no messages at {self.path}")
        return found

    def message_urls(self) -> DataFrame:
        found = self._read("message_url")
        return self.spark.createDataFrame([], _URL) if found is None else found

    def resolved(self) -> DataFrame | None:
        return self._read("resolved_url")

    def resolved_message_urls(self) -> DataFrame:
        found = self._read("resolved_message_url")
        if found is None:
            raise ValueError("no URL of this store is resolved yet; run resolve_urls first")
        return found

    def put(self, name: str, df: DataFrame) -> DataFrame:
        """Replaces a derived table; the new one is complete before the old one goes."""
        from .shared import written

        complete = written(df, name)
        complete.write.mode("overwrite").parquet(f"{self.path}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.path}/{name}")

    def network(self, name: str) -> DataFrame:
        found = self._read(f"{name}_network")
        if found is None:
            raise ValueError(f"no network {name} at {self.path}")
        return found

    def empty_resolved(self) -> DataFrame:
        return self.spark.createDataFrame([], RESOLVED)
