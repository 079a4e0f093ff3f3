"""Ordered lines of text from all tasks to one file of the driver."""

from __future__ import annotations

from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from ..sources.shared import forget, setting, written

#: Bytes of lines that are packed together.
PACKED = 4 << 20


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of lines to compressed runs of them, numbered by partition and place in it."""
    part = TaskContext.get().partitionId()
    for at, b in enumerate(batches):
        data = b"".join(b.column(0).cast(pa.binary()).to_pylist())
        columns = [pa.array([part], pa.int32()), pa.array([at], pa.int64()), pa.array([len(data)], pa.int64()), pa.array([pa.compress(data, "zstd", asbytes=True)], pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, names=["part", "at", "size", "lines"])


def write_lines(lines: DataFrame, f: BinaryIO) -> None:
    """The lines of a table of one column, ends included, in its order. All tasks make and pack them at once; the driver gets a partition of
    packed ones at a time."""
    with setting(lines.sparkSession, "spark.sql.execution.arrow.maxBytesPerBatch", str(PACKED)):
        stored = written(lines.mapInArrow(_packed, "part int, at long, size long, lines binary"), "lines")
    for r in stored.orderBy("part", "at").select("size", "lines").toLocalIterator():
        f.write(pa.decompress(r["lines"], r["size"], "zstd"))
    forget(stored)
