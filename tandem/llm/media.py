"""Media columns: payloads as PNG images in tar shards, addressed by their content.

A payload is a text's UTF-8 bytes with zero bytes up to a positive multiple of 64: the samples of an 8-bit grey image 64
wide. Each payload is stored once, as a member named by its SHA-256, in the tar shard of the task that read it. Rows
carry digest, shard, offset and length, so that a range read fetches one member; reading its first 33 bytes is enough for
the metadata columns.

Which row stores a payload (the smallest doc_id with that text) is settled from digests before any shard is written, so
that payloads need no shuffle. Shards are named by the attempt that wrote them, and only those whose rows Spark kept are
referred to: a lost executor leaves at most an unused file.
"""

from __future__ import annotations

import hashlib
import struct
import tarfile
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import each_text, filesystem, need, new_path, partitions, prepare, rows, without_rows, written

WIDTH, SHARD = 64, 256 << 20
#: Bytes that hold a PNG's signature and header.
HEADER = 33
_SIGNATURE = b"\x89PNG\r\n\x1a\n"


def payload_of(text: bytes) -> bytes:
    return text + b"\0" * (-len(text) % WIDTH or (0 if text else WIDTH))


def _part(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def encode_png(payload: bytes) -> bytes:
    """The payload's bytes as samples, rows unfiltered."""
    height = len(payload) // WIDTH
    lines = np.zeros((height, WIDTH + 1), np.uint8)
    lines[:, 1:] = np.frombuffer(payload, np.uint8).reshape(height, WIDTH)
    return _SIGNATURE + _part(b"IHDR", struct.pack(">IIBBBBB", WIDTH, height, 8, 0, 0, 0, 0)) + _part(b"IDAT", zlib.compress(lines.tobytes(), 6)) + _part(b"IEND", b"")


def read_header(head: bytes) -> tuple[int, int, int]:
    """(width, height, bits) from an image's first 33 bytes."""
    if head[:8] != _SIGNATURE or head[12:16] != b"IHDR" or struct.unpack(">I", head[29:33])[0] != zlib.crc32(head[12:29]):
        raise ValueError("not the head of a PNG image")
    width, height, bits, colour = struct.unpack(">IIBB", head[16:26])
    if colour != 0:
        raise ValueError("not a grey image")
    return width, height, bits


def decode_png(data: bytes) -> bytes:
    """The samples of an image of encode_png."""
    width, height, bits = read_header(data[:HEADER])
    at, parts = HEADER, []
    while at < len(data):
        n = struct.unpack(">I", data[at : at + 4])[0]
        kind, body = data[at + 4 : at + 8], data[at + 8 : at + 8 + n]
        if struct.unpack(">I", data[at + 8 + n : at + 12 + n])[0] != zlib.crc32(kind + body):
            raise ValueError("a part of an image is damaged")
        if kind == b"IDAT":
            parts.append(body)
        at += 12 + n
    lines = np.frombuffer(zlib.decompress(b"".join(parts)), np.uint8).reshape(height, width * bits // 8 + 1)
    if lines[:, 0].any():
        raise ValueError("rows are filtered")
    return lines[:, 1:].tobytes()


def feature_of(payload: bytes, height: int) -> str:
    """Whole numbers about the samples: size, extremes, thousandths of the mean, and how many lie in each eighth."""
    x = np.frombuffer(payload, np.uint8)
    eighths = "/".join(map(str, np.bincount(x >> 5, minlength=8).tolist()))
    return f"{WIDTH}x{height} min={x.min()} max={x.max()} mean={int(x.sum(dtype=np.int64)) * 1000 // len(x)} eighths={eighths}"


_DIGESTS = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("n_bytes", pa.int64()), ("digest", pa.binary())])
_PLACES = pa.schema([("digest", pa.binary()), ("shard", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])
_META = pa.schema([("digest", pa.binary()), ("width", pa.int32()), ("height", pa.int32()), ("bits", pa.int32())])
_FOUND = pa.schema([("digest", pa.binary()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.binary()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.binary()), ("feature", pa.string())])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = list(each_text(b.column(2)))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([len(t) for t in texts], pa.int64()), pa.array([hashlib.sha256(payload_of(t)).digest() for t in texts], pa.binary())], schema=_DIGESTS)


def _store(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        name, out, at = "", None, 0

        def close() -> None:
            out.write(b"\0" * 1024)
            out.close()

        for b in batches:
            found = []
            for t in each_text(b.column(0)):
                payload = payload_of(t)
                digest = hashlib.sha256(payload).digest()
                if digest in seen:
                    continue
                seen.add(digest)
                if out is not None and at > SHARD:
                    close()
                    out = None
                if out is None:
                    name, at = f"{uuid.uuid4().hex}.tar", 0
                    fs, path = filesystem(f"{folder}/{name}")
                    fs.create_dir(path.rpartition("/")[0], recursive=True)
                    out = fs.open_output_stream(path)
                data = encode_png(payload)
                member = tarfile.TarInfo(f"{digest.hex()}.png")
                member.size = len(data)
                head = member.tobuf(tarfile.USTAR_FORMAT)
                out.write(head + data + b"\0" * (-len(data) % 512))
                found.append((digest, name, at + len(head), len(data)))
                at += len(head) + len(data) + -len(data) % 512
            if found:
                yield rows(_PLACES, **dict(zip(_PLACES.names, map(list, zip(*found)))))
        if out is not None:
            close()

    return run


def store(docs: DataFrame, folder: str | None = None) -> tuple[DataFrame, DataFrame, str]:
    """Stores every payload of docs once; returns (rows, places, folder).

    rows: doc_id, text_hash, n_bytes (of the text), digest of each row of docs, as they repeat there; null text counts as
    empty. places: digest, shard, offset, length, one row of each digest. Digests are 32 bytes.
    """
    need(docs, "doc_id", "text")
    spark = prepare(docs.sparkSession)
    folder = folder or new_path(spark, "media")
    text = F.col("text").cast("string")
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    read = written(named.mapInArrow(_digests, "doc_id long, text_hash long, n_bytes long, digest binary"), "digests")
    # of a payload's rows, those that are not its smallest (doc_id, text_hash) don't store it
    least = read.groupBy("digest").agg(F.min(F.struct("doc_id", "text_hash")).alias("x")).select(F.col("digest").alias("d"), F.col("x.doc_id").alias("i"), F.col("x.text_hash").alias("h"))
    other = ~(F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("text_hash") == F.col("h")))
    drop = written(read.join(least, F.col("digest") == F.col("d")).where(other).select(F.col("doc_id").alias("k0"), F.col("text_hash").alias("k1")).distinct(), "others")
    keep = without_rows(named, [F.col("doc_id"), F.col("text_hash")], drop)
    placed = written(keep.select("text").mapInArrow(_store(folder), "digest binary, shard string, offset long, length long"), "places")
    one = placed.groupBy("digest").agg(F.min(F.struct("shard", "offset", "length")).alias("x")).select("digest", "x.*")
    return read, one, folder


def _range_reads(folder: str, make, schema: pa.Schema):
    """Places, by shard, to what make(read) gives for each, where read(offset, n) reads within the member."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, f = None, None
        for b in batches:
            found = []
            for digest, shard, offset, length in zip(*(c.to_pylist() for c in b.columns)):
                if shard != name:
                    if f is not None:
                        f.close()
                    fs, path = filesystem(f"{folder}/{shard}")
                    name, f = shard, fs.open_input_file(path)
                found.append((digest, *make(digest, lambda n, f=f, at=offset, size=length: f.read_at(min(n, size), at), length)))
            if found:
                yield rows(schema, **dict(zip(schema.names, map(list, zip(*found)))))
        if f is not None:
            f.close()

    return run


def _by_shard(places: DataFrame) -> DataFrame:
    return places.select("digest", "shard", "offset", "length").repartitionByRange(partitions(places.sparkSession), "shard", "offset").sortWithinPartitions("shard", "offset")


def metadata(places: DataFrame, folder: str) -> DataFrame:
    """digest, width, height, bits of each payload, from range reads of the images' heads alone."""
    make = lambda digest, read, length: read_header(read(HEADER))
    return _by_shard(places).mapInArrow(_range_reads(folder, make, _META), "digest binary, width int, height int, bits int")


def features(places: DataFrame, folder: str) -> DataFrame:
    """What is computed from the stored bytes of each payload, checked against its digest and its head's size."""

    def make(digest, read, length):
        _, height, _ = read_header(read(HEADER))
        data = read(length)
        payload = decode_png(data)
        sha = hashlib.sha256(payload).digest()
        if sha != digest or len(payload) != WIDTH * height:
            raise ValueError("a stored payload differs from its digest")
        return len(payload), sha, zlib.crc32(payload[-WIDTH:]), len(data), hashlib.sha256(data).digest(), feature_of(payload, height)

    return _by_shard(places).mapInArrow(_range_reads(folder, make, _FOUND), "digest binary, payload_bytes long, payload_sha256 binary, tail_crc32 long, media_bytes long, media_sha256 binary, feature string")


def media_columns(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and, from the stored bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256,
    feature of each row of docs; also digest, shard, offset, length and the header's width and height. Digests are in hex."""
    read, places, folder = store(docs)
    places = written(places, "index")
    found = written(features(places, folder).join(metadata(places, folder), "digest").join(places, "digest"), "features")
    whole = read.join(found, "digest").drop("bits", "text_hash")
    return whole.withColumns({c: F.lower(F.hex(c)) for c in ("digest", "payload_sha256", "media_sha256")})
