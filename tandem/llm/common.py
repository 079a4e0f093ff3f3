"""What the corpus operators share: shared storage, Arrow batches of text, running sums, size-checked joins.

Rows move between Spark and Python as Arrow batches only. Everything that one task leaves for another goes through
Spark's shuffle or through the folder that ``spark.checkpoint.dir`` names.
"""

from __future__ import annotations

import atexit
import io
import os
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.shared import forget, new_path, shared_dir, trimmed, written  # noqa: F401  the operators take them from here

#: Rows up to which a key set is broadcast (16 bytes each, so 32 MB at most); larger sets are joined by a shuffle.
BROADCAST_ROWS = 2_000_000
#: Rows and bytes of an Arrow batch: documents may be long, and several batches are in memory at once.
BATCH_ROWS, BATCH_BYTES = 1024, 8 << 20


def prepare(spark: SparkSession) -> SparkSession:
    """Sets small Arrow batches and makes this package importable in Python workers on other machines."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    context = spark.sparkContext
    if getattr(context, "_tandem_shipped", None) is None:
        package = Path(__file__).resolve().parents[1]
        packed = io.BytesIO()
        with zipfile.ZipFile(packed, "w") as z:
            for p in sorted(package.rglob("*.py")):
                z.write(p, str(p.relative_to(package.parent)))
        folder = tempfile.mkdtemp(prefix="tandem-package-")  # on the driver, which serves it to the executors
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        path = os.path.join(folder, "tandem_package.zip")
        Path(path).write_bytes(packed.getvalue())
        context.addPyFile(path)
        context._tandem_shipped = True
    return spark


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """The pyarrow file system and path of a place in the shared folder."""
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else "file://" + os.path.abspath(uri))


def load_array(uri: str, kind) -> np.ndarray:
    """A stored array: memory-mapped where the shared folder is mounted, read into memory from any other store."""
    fs, path = filesystem(uri)
    if isinstance(fs, pafs.LocalFileSystem):
        return np.memmap(path, kind, "r") if os.path.getsize(path) else np.zeros(0, kind)
    with fs.open_input_file(path) as f:
        return np.frombuffer(f.read(), kind)


def store_bytes(uri: str, data: bytes) -> None:
    """Writes a file whole under another name and then moves it, so that a repeated task leaves the same file."""
    fs, path = filesystem(uri)
    fs.create_dir(os.path.dirname(path), recursive=True)
    part = f"{path}.{uuid.uuid4().hex}.part"
    with fs.open_output_stream(part) as f:
        f.write(data)
    fs.move(part, path)


def utf8(column: pa.Array) -> tuple[bytes, np.ndarray]:
    """The texts of a string or binary column as one byte string and their offsets; null counts as empty."""
    n = len(column)
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if n == 0:
        return b"", np.zeros(1, np.int64)
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if column.null_count:
        empty = b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else ""
        column = pc.fill_null(column, empty)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if large else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    return (memoryview(data)[at[0] : at[-1]].tobytes() if data is not None else b""), at - at[0]


def each_text(column: pa.Array, lower: bool = False) -> Iterator[bytes]:
    """The texts as UTF-8, lower-cased in A-Z if asked for."""
    data, at = utf8(column)
    if lower:
        data = data.lower()
    ends = at.tolist()
    return (data[a:b] for a, b in zip(ends, ends[1:]))


def rows(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)


def blocks(batches: Iterable[pa.RecordBatch], most_bytes: int) -> Iterator[pa.Table]:
    """Batches put together up to a size."""
    held, size = [], 0
    for b in batches:
        held.append(b)
        size += b.nbytes
        if size >= most_bytes:
            yield pa.Table.from_batches(held)
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def running_sum(df: DataFrame, group: list[str], order: list[str], value: str, out: str) -> DataFrame:
    """Adds the sum of ``value`` over the rows before each one in its group, without bringing a group into one task.

    Rows are sorted by range over (group, order); each range is summed by itself, and the sums of the earlier ranges of
    the group are added. ``df`` should be a stored table, for it is read twice. A group may hold all rows: ranges cut it.
    Rows that tie in group and order lie in one range, in any order.
    """
    spark = df.sparkSession
    keys = [F.col(c).asc_nulls_last() for c in [*group, *order]]
    ranged = written(df.repartitionByRange(partitions(spark), *keys).withColumn("_range", F.spark_partition_id()), "ranges")
    inside = Window.partitionBy("_range", *group).orderBy(*[F.col(c).asc_nulls_last() for c in order]).rowsBetween(Window.unboundedPreceding, -1)
    sums = ranged.groupBy("_range", *group).agg(F.sum(value).alias("_sum"))
    ahead = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("_range", *group, F.coalesce(F.sum("_sum").over(ahead), F.lit(0)).alias("_ahead"))
    a, b = ranged.alias("a"), offsets.alias("b")
    same = F.col("a._range") == F.col("b._range")
    for c in group:
        same = same & F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    local = a.withColumn("_before", F.coalesce(F.sum(value).over(inside), F.lit(0))).alias("a")
    return local.join(b, same, "left").select("a.*", (F.col("_before") + F.col("_ahead")).alias(out)).drop("_before", "_range")


def free_names(df: DataFrame, n: int) -> list[str]:
    """Column names that df doesn't have, in any case."""
    taken = {c.lower() for c in df.columns}
    return [x for x in (f"_tandem{i}" for i in range(n + len(taken))) if x not in taken][:n]


def _same(a: list[str], b: list[str]) -> Column:
    on = F.lit(True)
    for x, y in zip(a, b):
        on = on & F.col(x).eqNullSafe(F.col(y))
    return on


def without_rows(df: DataFrame, keys: list[Column], drop: DataFrame, bound: int = BROADCAST_ROWS) -> DataFrame:
    """The rows of df whose keys are not in ``drop`` (its columns in order): broadcast up to ``bound`` keys, else shuffled."""
    names = free_names(df, 2 * len(keys))
    own, other = names[: len(keys)], names[len(keys) :]
    small = drop.limit(bound + 1).count() <= bound
    drop = drop.toDF(*other)
    named = df.select("*", *[k.alias(n) for k, n in zip(keys, own)])
    return named.join(F.broadcast(drop) if small else drop.hint("merge"), _same(own, other), "left_anti").drop(*own)


def one_row_each(df: DataFrame, keyed: DataFrame, by: str, text_hash: Column) -> DataFrame:
    """df with one row of each (doc_id, by), nulls included. keyed: a stored table with a row (doc_id, text_hash, by) for each
    row of df, where text_hash is what the column of that name gives in df. Only what is repeated there is looked for in df."""
    again = keyed.groupBy("doc_id", by).count().where("count > 1").toDF("_d", "_b", "_n")
    same = F.col("doc_id").eqNullSafe(F.col("_d")) & F.col(by).eqNullSafe(F.col("_b"))
    again = written(keyed.join(again, same, "left_semi").select("doc_id", "text_hash", by).distinct(), "repeated")
    if again.isEmpty():
        return df
    keys, names = [F.col("doc_id").cast("long"), text_hash], free_names(df, 5)
    single = without_rows(df, keys, again.select("doc_id", "text_hash"))
    named = df.select("*", *[k.alias(n) for k, n in zip(keys, names)])
    several = named.join(again.toDF(*names[2:]), _same(names[:2], names[2:4]))
    return single.unionByName(several.dropDuplicates([names[0], names[4]]).drop(*names))


def need(df: DataFrame, *names: str) -> None:
    missing = [c for c in names if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
