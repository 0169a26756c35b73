"""Queries on tables whose keys or groups are larger than those of the test data."""

import duckdb
import pytest
from pyspark.sql import functions as F

from quillspark.operators import documents, tabular
from quillspark.plans.catalogue import ORACLE_SQL, QUERIES


def compared(spark, at, name, **tables):
    """The rows of a query and of its SQL over tables written to a folder, as sorted lists."""
    con = duckdb.connect()
    for t, df in tables.items():
        df.coalesce(2).write.parquet(f"{at}/{t}.parquet")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{at}/{t}.parquet/*.parquet'")
    df = QUERIES[name](spark, str(at))
    want = con.execute(ORACLE_SQL[name])
    columns = [d[0] for d in want.description]
    return sorted(repr([r[c] for c in columns]) for r in df.collect()), sorted(repr(list(r)) for r in want.fetchall())


def test_masked_documents_keep_long_page_numbers(spark, tmp_path):
    part = spark.createDataFrame([(k,) for k in (-1234567, 0, 7, 999, 1000, 99_999, 100_000, 1_199_999, 123_456_789_012)], "p_partkey bigint")
    got, want = compared(spark, tmp_path, "m4_masked_documents", part=part)
    assert got == want and "page 1199999 of ••••••2345" in "".join(got)


def test_pairs_of_null_keys_are_made_in_many_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tabular, "PAIRS", 50_000, raising=False)
    customer, supplier = spark.range(3_000).select(F.col("id").alias("c_custkey")), spark.range(4_900).select(F.col("id").alias("s_suppkey"))
    got, want = compared(spark, tmp_path, "j1_merge_nullsafe", customer=customer, supplier=supplier)
    assert got == want and len(got) == 600 * 700 + 2_057
    out = QUERIES["j1_merge_nullsafe"](spark, str(tmp_path))
    assert out.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0] <= 2 * 50_000


@pytest.mark.parametrize("how", ["inner", "left", "right", "outer", "left_semi", "left_anti"])
@pytest.mark.parametrize("sizes", [(300, 40), (30, 400), (300, 0), (1, 9_000)])
def test_merge_of_null_keys_in_every_kind(spark, monkeypatch, how, sizes):
    """Equal rows, too, and few on one side: as the plain join on keys that are equal or both null."""
    monkeypatch.setattr(tabular, "PAIRS", 4_000, raising=False)
    key = lambda n, first: F.when(F.col("id") >= n, F.col("id") - n + first)
    left = spark.range(sizes[0] + 9).select((F.col("id") % 7).alias("v"), key(sizes[0], 1).alias("k"))
    right = spark.range(sizes[1] + 9).select(key(sizes[1], 5).alias("j"), (F.col("id") % 5).cast("string").alias("v"))
    got, want = tabular.merge(left, right, "k", "j", how), left.join(right, left["k"].eqNullSafe(right["j"]), how)
    assert got.dtypes == want.dtypes
    assert sorted(repr(tuple(r)) for r in got.collect()) == sorted(repr(tuple(r)) for r in want.collect())


@pytest.mark.parametrize("name", ["j4_mrz_against_visual", "j5_figures_against_words", "p34_date_order"])
def test_fields_are_not_broadcast_for_checks(spark, sf, name):
    """However small Spark takes them for: a broadcast is held by every executor."""
    assert "Broadcast" not in QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()


def test_checks_with_types_that_repeat_or_lack(spark):
    shape = "document_id string, field string, raw_value string, normalized_value string, confidence double, review_required boolean, review_reasons array<string>"
    rows = [(d, f, v, v, 0.9, False, []) for d in ("a", "b", None) for f, v in (("date_of_issue", "2020-01-01"), ("valid_till", "2019-01-01"), ("date", "2030-01-01"))]
    types = spark.createDataFrame([("a", "driving_licence"), ("a", "driving_licence"), ("c", "passport"), (None, "driving_licence")], "document_id string, document_type string")
    out = documents.cross_field_checks(spark.createDataFrame(rows, shape), types, F.lit("2025-06-30").cast("date")).collect()
    assert len(out) == 9
    assert [(r.document_id, r.field, r.confidence, r.review_reasons) for r in out if r.review_required] == [("a", "valid_till", 0.6, ["valid-till date is not after the issue date"])]
