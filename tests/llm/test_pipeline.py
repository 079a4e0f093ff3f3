"""The pipeline's stages and the queries of the corpus operators."""

import duckdb
import pytest

import corpus_pipeline
from tandem.llm import queries

SF = "/root/testdata/sf0.001"


def test_stages(spark, docs):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language", "exact", "near", "mixture", "tokens"]
    now, ids = docs, {r["doc_id"] for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = spark.createDataFrame(stage(spark, now, SF).toPandas(), docs.schema)
        assert now.columns == docs.columns
        kept = [r["doc_id"] for r in now.select("doc_id").collect()]
        assert set(kept) <= ids
        if name != "mixture":
            assert len(kept) == len(set(kept))
        ids = set(kept)
    assert sorted(r["doc_id"] for r in corpus_pipeline.run(spark, SF).select("doc_id").collect()) == sorted(r["doc_id"] for r in now.collect())


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, name):
    c = duckdb.connect()
    c.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    df = queries.queries()[name](spark, SF)
    columns = sorted(df.columns)
    found = c.execute(queries.oracle_sql()[name])
    at = [d[0] for d in found.description]
    assert sorted(repr(tuple(r[x] for x in columns)) for r in df.collect()) == sorted(repr(tuple(r[at.index(x)] for x in columns)) for r in found.fetchall())


def test_names(spark):
    found = queries.queries()
    assert all(any(n.startswith(f"op{i}_") for n in found) for i in range(1, 11)) and "pipeline" in found
