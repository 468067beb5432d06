"""Queries and pipeline on the smallest data set."""

from pathlib import Path

import duckdb
import pytest

import corpus_pipeline
from sojourn.llm.queries import QUERIES, SQL

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="test data not present")


def test_every_operator_has_its_query():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, name):
    duck = duckdb.connect()
    for path in DATA.glob("*.parquet"):
        duck.sql(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    got, want = QUERIES[name](spark, str(DATA)), duck.sql(SQL[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    at = [want.columns.index(c) for c in columns]
    assert sorted(tuple(map(repr, (r[c] for c in columns))) for r in got.collect()) == sorted(tuple(repr(r[i]) for i in at) for r in want.fetchall())


def test_pipeline_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, before = docs.columns, {r.doc_id for r in docs.collect()}
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(DATA))
        out.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        ids = {r.doc_id for r in docs.select("doc_id").collect()}
        assert ids and ids <= before
        before = ids
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
    rows = docs.collect()
    assert sorted(r.start for r in rows)[0] == 0 and sum(r.n_tokens for r in rows) == max(r.start + r.n_tokens for r in rows)
    again = corpus_pipeline.run(spark, str(DATA)).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, rows))
