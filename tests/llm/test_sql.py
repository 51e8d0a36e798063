"""The registered queries against their SQL in another engine."""

import duckdb
import pytest

from tokenledger.llm.oracles import ORACLES
from tokenledger.llm.queries import QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, sf_dir, name):
    duck = duckdb.connect()
    for table in ("documents", "labels", "embeddings", "conversations", "pages"):
        duck.execute(f"create view {table} as select * from '{sf_dir}/{table}.parquet'")
    result, expected = QUERIES[name](spark, sf_dir), duck.execute(ORACLES[name])
    columns = [d[0] for d in expected.description]
    assert sorted(result.columns) == sorted(columns)
    ours = sorted(map(str, (tuple(r[c] for c in sorted(columns)) for r in result.collect())))
    theirs = sorted(map(str, (tuple(r[columns.index(c)] for c in sorted(columns)) for r in expected.fetchall())))
    assert ours and ours == theirs


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_gives_every_document(spark, sf_dir, name):
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id").distinct()
    assert QUERIES[name](spark, sf_dir).select("doc_id").distinct().exceptAll(documents).count() == 0
    assert QUERIES[name](spark, sf_dir).select("doc_id").distinct().count() == documents.count()
