"""Schemas of messages as they come in and as they are stored."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

FORMAT_VERSION = 1

#: Columns by position, as CSV files have them.
INPUT_COLUMNS = ("message_id", "user_id", "username", "repost_id", "reply_id", "message", "timestamp", "urls")

_S = T.StringType()
INPUT = T.StructType([*[T.StructField(c, _S) for c in INPUT_COLUMNS[:6]], T.StructField("timestamp", T.DoubleType()), T.StructField("urls", T.ArrayType(_S))])
EDGES = T.StructType([T.StructField("user_1", _S), T.StructField("user_2", _S), T.StructField("weight", T.LongType())])
RESOLVED = T.StructType([T.StructField("url", _S), T.StructField("resolved_url", _S), T.StructField("ssl_verified", T.BooleanType()), T.StructField("resolved_status", _S)])

#: Orders rows by arrival: the argument, the file within it, the line within that.
ARRIVAL = ("_source", "_file", "_line")


def empty_to_null(c: Column) -> Column:
    """Ids that are the empty string mean none."""
    return F.nullif(c, F.lit(""))


def as_input(df: DataFrame) -> DataFrame:
    """The eight input columns with their types: ids as strings, empty repost and reply ids as null, time as double."""
    columns = [F.col(f.name).cast(f.dataType).alias(f.name) for f in INPUT]
    rest = [c for c in df.columns if c in ARRIVAL]
    typed = df.select(*columns, *rest)
    return typed.withColumn("repost_id", empty_to_null(F.col("repost_id"))).withColumn("reply_id", empty_to_null(F.col("reply_id")))
