"""The registered queries against their SQL, and the pipeline against its stages by brute force."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from plumbline.llm.queries import QUERIES
from plumbline.llm.sql import SQL
from tests.llm.test_documents import brute_classes, brute_passages, brute_quality

SF = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")


def test_registered():
    assert {f"op{n}" for n in range(1, 14)} == {name.split("_")[0] for name in QUERIES}
    assert set(QUERIES) | {"pipeline"} <= set(entry.queries()) and set(SQL) <= set(entry.oracle_sql())


@needs_tables
@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "labels", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    result = con.execute(SQL[name])
    columns = [c[0] for c in result.description]
    df = QUERIES[name](spark, SF)
    assert sorted(df.columns) == sorted(columns)

    def norm(row):
        return tuple(round(v, 6) + 0.0 if isinstance(v, float) else v for v in row)

    want = sorted((norm(r) for r in result.fetchall()), key=str)
    assert sorted((norm(r) for r in df.select(*columns).collect()), key=str) == want


@needs_tables
def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    good = stages["quality_rules"](spark, docs, SF)
    kept = [(i, t) for i, t in rows if brute_quality(i, t)[-1]]
    assert sorted(r["doc_id"] for r in good.collect()) == sorted(i for i, _ in kept)
    one = stages["near_duplicates"](spark, good, SF)
    want = sorted(min(kept[i][0] for i in group) for group in brute_classes(kept))
    assert sorted(r["doc_id"] for r in one.collect()) == want
    left = [(i, t) for i, t in kept if i in set(want)]
    cut = stages["repeated_passages"](spark, one, SF)
    sizes = {i: n - gone for i, n, gone, _ in brute_passages(left, 35)}
    assert {r["doc_id"]: len(r["text"].encode().split()) for r in cut.collect()} == sizes
    clean = stages["benchmark_leaks"](spark, cut, SF)
    assert clean.columns == cut.columns == one.columns == docs.columns and clean.count() <= cut.count()
    out = corpus_pipeline.run(spark, SF)
    assert sorted(r["doc_id"] for r in out.collect()) == sorted(r["doc_id"] for r in clean.collect())
