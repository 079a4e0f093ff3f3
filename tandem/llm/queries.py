"""One query for each corpus operator, over whole tables, with its production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chunkstore, exactdedup, langid, licenses, lm, media, mixing, sharding, simhash


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = chunkstore.save(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    return chunkstore.read_summary(spark, folder).select("doc_id", "start", "n_tokens", "ids_crc32")


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exactdedup.exact_groups(documents(spark, sf_dir)).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op3_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = media.media_columns(documents(spark, sf_dir))
    return found.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "digest", "offset", "length", "width", "height")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op5_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = lm.train(docs.where(~lm.held_out(F.col("doc_id"))))
    found = lm.score(docs, model)
    return found.select("doc_id", lm.held_out(F.col("doc_id")).alias("held_out"), "n_tokens", "n_known", F.lit(model["N"]).cast("long").alias("train_tokens"), "base_score", "score")


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    found = langid.predict(docs, langid.fit(langid.labelled_rows(docs)))
    return found.select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sharding.shard(documents(spark, sf_dir), 16)
    return found.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = licenses.scan(documents(spark, sf_dir))
    joined = lambda labels: F.array_join(F.sort_array(F.array_distinct(labels)), ",")
    return x.select(
        "doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min("base.first").cast("long").alias("first_word"),
        F.array_max("base.first").cast("long").alias("last_word"),
        joined(F.col("base.label")).alias("base_labels"),
        joined(F.concat("base.label", "detections.label")).alias("labels"),
        F.coalesce(F.array_max("detections.priority") / 100.0, F.lit(0.0)).alias("score"),
    )


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.digests(documents(spark, sf_dir), path, public_tokenizers.PATTERN).drop("text_hash")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_token_store, op2_exact_dedup, op3_media, op4_simhash, op5_lm, op6_language, op7_sharding, op8_licenses, op9_mixing, op10_byte_bpe, pipeline)}


def oracle_sql() -> dict[str, str]:
    return {"op2_exact_dedup": OP2_SQL, "op9_mixing": OP9_SQL}


OP2_SQL = """
with t as (
  select doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as norm from documents
)
select doc_id, max(doc_id) over g as keep_id, count(*) over g as group_size, doc_id = max(doc_id) over g as kept, sha256(norm) as text_sha256
from t window g as (partition by norm)
"""

OP9_SQL = r"""
with sized as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as size, md5(coalesce(cast(doc_id as varchar), '')) as key from documents
), totals as (
  select source, cast(sum(size) as bigint) as source_size from sized group by source
), ranked as (
  select *, row_number() over (order by source nulls last) as nth, [5, 2, 1][(row_number() over (order by source nulls last) - 1) % 3 + 1] as w,
    cast(sum(source_size) over () as bigint) as total
  from totals
), filled as (
  select *, 4 * source_size * sum(w) over (f rows between current row and unbounded following)
    <= w * (3 * total - 4 * coalesce(sum(source_size) over (f rows between unbounded preceding and 1 preceding), 0)) as capped
  from ranked window f as (order by source_size / w, nth)
), rest as (
  select *, cast(coalesce(sum(source_size) filter (capped) over (), 0) as bigint) as taken_up, cast(sum(w) filter (not capped) over () as bigint) as w_left from filled
), goal as (
  select source as of_source, source_size,
    case when capped then cast(2 * source_size as double) else cast(w * (3 * total - 4 * taken_up) as double) / cast(2 * w_left as double) end as target
  from rest
), summed as (
  select *, coalesce(sum(size) over (partition by source order by key, doc_id rows between unbounded preceding and 1 preceding), 0) as before
  from sized join goal on source is not distinct from of_source
), cut as (
  select *, case when source_size > 0 then cast(floor(target) as bigint) // source_size else 0 end as times, cast(floor(target) as bigint) as budget from summed
)
select doc_id, cast(size as bigint) as size, source_size, target,
  cast(times * size + greatest(0, least(size, budget - times * source_size - before)) as bigint) as taken
from cut
"""
