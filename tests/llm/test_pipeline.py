"""Registered queries against their SQL, and the pipeline against its stages by brute force."""

import os

import duckdb
import pytest

import __spark_entry__ as registry
import corpus_pipeline
from bendpoint.llm import langid, queries

from ..test_registry import lines
from .test_native import brute_hits, brute_lines
from .test_near import fingerprint, reach

SF = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the given tables")


@needs_data
@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    got, want = queries.QUERIES[name](spark, SF).toPandas(), con.execute(queries.SQL[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert lines(got) == lines(want)


@needs_data
def test_all_queries_are_registered():
    assert {f"op{i}_" for i in range(1, 14)} == {f"{q.split('_')[0]}_" for q in registry.queries() if q[:2] == "op" and q[2].isdigit()}
    assert registry.queries()["pipeline"] is corpus_pipeline.run


@needs_data
def test_pipeline_stages_by_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    con = duckdb.connect()
    items = con.execute(f"SELECT item_id, text FROM '{SF}/benchmark.parquet'").fetchall()
    columns = docs.columns
    names = [n for n, _ in corpus_pipeline.STAGES]
    for name, stage in corpus_pipeline.STAGES:
        before = [(r.doc_id, r.text) for r in docs.collect()]
        out = stage(spark, docs, SF)
        if name == names[-1]:
            assert sorted({r.doc_id for r in out.collect()}) == sorted(d for d, _ in before)
            break
        assert out.columns == columns
        docs = spark.createDataFrame(out.collect(), docs.schema)
        after = sorted((r.doc_id, r.text) for r in docs.collect())
        if name == "language_id":
            assert {d for d, t in before if any(c.isalpha() for c in t or "")} == {d for d, _ in after}
        elif name == "line_dedup":
            assert after == sorted((d, t) for d, t, _, _ in brute_lines(before))
        elif name == "simhash_near_dedup":
            prints = [fingerprint(t) for _, t in before]
            near = [(i, j) for i in range(len(prints)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 4]
            groups = reach(len(prints), near)
            least = {g: min(d for (d, _), x in zip(before, groups, strict=True) if x == g) for g in groups}
            assert [d for d, _ in after] == sorted(least.values())
        elif name == "decontamination":
            clean = {r[0] for r in brute_hits(before, items) if not r[-1]}
            assert {d for d, _ in after} == clean


@needs_data
def test_stages_keep_own_columns_and_take_odd_tables(spark):
    """Columns named like an operator's results, nulls, empty texts and empty tables."""
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = ["lang_pred", "score", "N_Lines", "n_dropped", "n_words", "n_hit", "n_items", "items", "contaminated"]
    odd = [(-1, None, None, None, None), (-2, "", "en", None, 0), (None, "of the and is", "en", "s", 3)]
    rich = docs.unionByName(spark.createDataFrame(odd, docs.schema)).withColumns(
        {c: F.concat(F.lit(f"{c} of "), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))) for c in names}
    )
    for name, stage in corpus_pipeline.STAGES[:-1]:
        for table in (rich, rich.limit(0)):
            out = stage(spark, table, SF)
            assert out.columns == rich.columns, name
            got = out.collect()
            assert bool(got) == (table is rich)
            assert all(r[c] == f"{c} of {'none' if r.doc_id is None else r.doc_id}" for r in got for c in names)


@needs_data
def test_held_out_language(spark):
    out = queries.op2_langid(spark, SF).filter("held_out")
    truth = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    right = out.join(truth, "doc_id").filter("lang = lang_pred").count()
    assert right >= 0.95 * out.count() and langid.UNKNOWN == "und"
