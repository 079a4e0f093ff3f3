"""The token store, byte-level BPE and media columns against the libraries themselves."""

import hashlib
import os
import tarfile
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

from tandem.llm import bpe, chunkstore, media

WORDS, BYTES = P.path("word_bpe_49k.json"), P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(WORDS)
    t.encode_special_tokens = True
    return lambda text: [*t.encode(text or "", add_special_tokens=False).ids, 1]


def test_store(spark, docs, odd, nothing, library):
    both = docs.select("doc_id", "text").where("doc_id > 20").unionByName(odd.select("doc_id", "text"))
    folder = chunkstore.save(both, WORDS)
    got = sorted(chunkstore.read_summary(spark, folder).collect(), key=lambda r: r["start"])
    read = {r["start"]: list(r["ids"]) for r in chunkstore.read_documents(spark, folder).collect()}
    want = sorted(([r["doc_id"], library(r["text"])] for r in both.collect()), key=lambda x: (x[0] is None, x[0] or 0))
    assert [r["doc_id"] for r in got] == [d for d, _ in want]
    assert sorted(map(tuple, read.values())) == sorted(tuple(i) for _, i in want)
    start = 0
    for r in got:
        ids = read[r["start"]]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    index = spark.read.parquet(f"{folder}/index")
    assert index.count() == index.select("digest").distinct().count()
    assert chunkstore.read_summary(spark, chunkstore.save(nothing, WORDS)).count() == 0


def test_damage_is_found(spark, odd):
    folder = chunkstore.save(odd, WORDS)
    packs = folder.removeprefix("file://") + "/packs"
    name = f"{packs}/{os.listdir(packs)[0]}"
    data = bytearray(open(name, "rb").read())
    data[0] ^= 1
    open(name, "wb").write(data)
    with pytest.raises(Exception, match="differs from its digest"):
        chunkstore.read_summary(spark, folder).collect()


def test_chunks():
    ids = np.random.default_rng(1).integers(0, 49_000, 60_000)
    ends = chunkstore.chunk_ends(ids)
    assert ends[-1] == len(ids) and 20 < len(ends) < 200 and max(np.diff([0, *ends])) <= chunkstore.LONGEST
    moved = chunkstore.chunk_ends(np.concatenate([[5, 6, 7], ids]))
    assert len({e - 3 for e in moved} & set(ends)) > len(ends) * 0.8
    assert max(np.diff([0, *chunkstore.chunk_ends(np.zeros(50_000, int))])) <= chunkstore.LONGEST
    assert chunkstore.chunk_ends(ids[:0]) == [] and chunkstore.chunk_ends(ids[:1]) == [1]
    pieces = [b"abc", b"", b"x" * 1000, b"\0"]
    assert chunkstore.joined_crc([(zlib.crc32(p), len(p)) for p in pieces]) == zlib.crc32(b"".join(pieces))
    two = lambda a, b: hashlib.sha256(a + b).digest()
    assert chunkstore.merkle_root([b"a", b"b", b"c"]) == two(two(b"a", b"b"), b"c")


def test_byte_bpe(spark, docs, odd, nothing):
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(BYTES), special_tokens={})
    both = docs.select("doc_id", "text").unionByName(odd.select("doc_id", "text"))
    texts = sorted((r["text"] or "") for r in both.collect())
    encoded = bpe.encode(both, BYTES, P.PATTERN)
    rows = bpe.decode(encoded, BYTES).collect()
    assert sorted(bytes(r["decoded"]) for r in rows) == sorted(t.encode() for t in texts)
    assert sorted(tuple(r["ids"]) for r in rows) == sorted(tuple(enc.encode_ordinary(t)) for t in texts)
    want = sorted((len(i), hashlib.sha256(",".join(map(str, i)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()) for t in texts for i in [enc.encode_ordinary(t)])
    assert sorted((r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in bpe.digests(both, BYTES, P.PATTERN).collect()) == want
    assert bpe.encode(nothing, BYTES, P.PATTERN).count() == 0


def test_blocks_follow_each_other(spark, docs, monkeypatch):
    """Several blocks in a task, several lists of words in a block, and words forgotten between blocks."""
    batches = [b for b in docs.select("doc_id", "doc_id", "text").toArrow().to_batches(max_chunksize=37)]
    monkeypatch.setattr(bpe, "BLOCK", 40_000)
    monkeypatch.setattr(bpe, "CHUNK", 100)
    monkeypatch.setattr(bpe, "WORDS", 300)
    cut = list(bpe._cut(BYTES, P.PATTERN)(iter(batches)))
    assert sum(b.column(2).to_pylist().count(True) for b in cut) > 3
    listed = [x for b in cut for x in b.column(3).to_pylist() if x]
    assert all(len(x) <= 100 for x in listed)


def test_media(spark, docs, odd, nothing):
    both = docs.select("doc_id", "text").unionByName(odd.select("doc_id", "text"))
    want = []
    for r in both.collect():
        t = (r["text"] or "").encode()
        p = t + b"\0" * (64 if not t else -len(t) % 64)
        png = media.encode_png(p)
        want.append((len(t), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]), len(png), hashlib.sha256(png).hexdigest()))
    got = media.media_columns(both).collect()
    assert sorted((r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"], r["media_bytes"], r["media_sha256"]) for r in got) == sorted(want)
    assert all((r["width"], r["height"] * 64, r["length"], r["digest"]) == (64, r["payload_bytes"], r["media_bytes"], r["payload_sha256"]) for r in got)
    assert media.media_columns(nothing).count() == 0
    rows, places, folder = media.store(both)
    members = []
    for name in os.listdir(folder.removeprefix("file://")):
        with tarfile.open(f"{folder.removeprefix('file://')}/{name}") as tar:
            for m in tar.getmembers():
                payload = media.decode_png(tar.extractfile(m).read())
                assert m.name == hashlib.sha256(payload).hexdigest() + ".png"
                members.append(m.name)
    assert len(members) == len(set(members)) == places.count() == len({w[2] for w in want})
