"""The pipeline, and each registered query that SQL can express, on the smallest tables."""

import os

import pytest

duckdb = pytest.importorskip("duckdb")
import corpus_pipeline  # noqa: E402
from sessionmill.llm import queries  # noqa: E402

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="driver tables are absent")


def test_one_query_for_each_operator():
    numbers = sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES)
    assert numbers == list(range(1, 14))
    assert [s for s, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "ngram_jaccard", "decontamination", "packing"]


def test_stages_keep_the_columns_and_take_effect(spark, make, odd_rows, tmp_path):
    leak = "the answer to the question of all questions is simply that one. forty two it is."
    folder = str(tmp_path)
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    rows = [(i, t, "en" if i and i % 2 else "de") for i, t in odd_rows if i != 13] + [(40, f"before {leak} after", "en")]
    docs, left = make(rows), []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns, name
        docs = spark.createDataFrame(out.collect(), docs.schema)
        left.append(sorted(str(r.doc_id) for r in docs.collect()))
    assert left[0] == sorted(str(i) for i, t, _ in rows if any(map(str.isalpha, t or "")))
    assert left[1] == sorted(["2", "3", "7", "8", "8", "10", "40"])  # one row of each text, the largest id
    assert left[2] == sorted(["2", "7", "8", "8", "10", "40"])  # 3 is a near copy of 2
    assert left[3] == sorted(["2", "7", "8", "8", "10"])
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, folder).collect()
    assert {str(r.doc_id) for r in packed} == set(left[3])


def test_pipeline_and_sql(spark):
    assert corpus_pipeline.run(spark, DATA).count() > 0
    con = duckdb.connect()
    for table in sorted(f.removesuffix(".parquet") for f in os.listdir(DATA) if f.endswith(".parquet")):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{DATA}/{table}.parquet'")
    for name, sql in queries.ORACLE.items():
        got = queries.QUERIES[name](spark, DATA)
        want = con.execute(sql)
        assert sorted(map(str, (r.asDict() for r in got.collect()))) == sorted(str(dict(zip([d[0] for d in want.description], r))) for r in want.fetchall())
