"""Every registered audit query against its SQL on the smallest tables."""

import hashlib

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from auditlake import check_queries, file_queries, project_queries, report_queries, sink_queries, waiver_queries  # noqa: F401
from auditlake.operators import joins as J
from auditlake.operators import rollups as R
from auditlake.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents pages conversations".split()


def rows(frame: pd.DataFrame) -> list[tuple]:
    frame = frame[sorted(frame.columns)].astype(object)
    text = lambda v: "NULL" if v is None or v is pd.NA or v != v else f"{v:.6g}" if isinstance(v, float) else str(v)
    return sorted(tuple(map(text, r)) for r in frame.itertuples(index=False))


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def test_queries_over_made_texts_are_registered():
    assert {report_queries.order_verdicts.__name__, project_queries.module_edges.__name__} <= set(QUERIES) == set(ORACLE)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_matches_sql(spark, duck, name):
    assert rows(QUERIES[name](spark, SF).toPandas()) == rows(duck.execute(ORACLE[name]).df())


def test_previous_key_over_gaps_and_blocks(spark):
    keys = [0, 1, 2, 7, 8, 20, 21, 22, 40]
    got = J.with_previous(spark.createDataFrame([(k,) for k in [*keys, 7, None]], "k long"), "k", "p", width=4).collect()
    assert sorted((r.k, r.p) for r in got if r.p is not None) == list(zip(keys[1:], keys)) and len(got) == len(keys)


def test_field_changes_takes_many_runs(spark):
    side = lambda x: spark.createDataFrame([(r, f, x(r)) for r in range(5) for f in "ab"], "run long, field string, value string")
    got = J.field_changes(side(lambda r: f"{r}"), side(lambda r: f"{r + r % 2}"), ["run"]).collect()
    assert sorted((r.run, r.field, r.changed) for r in got) == [(r, f, r % 2 == 1) for r in range(5) for f in "ab"]


@pytest.mark.parametrize("name", ["range_drilldown", "group_digest", "group_digest_turns", "duplicate_owner_rows"])
def test_groups_are_not_gathered_into_a_row(spark, name):
    assert "collect_" not in QUERIES[name](spark, SF)._jdf.queryExecution().toString()


def test_ordered_digest_over_batches(spark):
    data = [(k, i, None if i % 5 == 0 else f"é{i}") for k in (1, 2, None) for i in range(40)] + [(3, 0, None)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rows_ = spark.createDataFrame(data, "k int, i int, t string").repartition(5)
        got = {r.k: r.digest for r in R.ordered_digest(rows_, ["k"], [F.col("i")], F.col("t"), "|").collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    whole = hashlib.sha256("|".join(f"é{i}" for i in range(40) if i % 5).encode()).hexdigest()
    assert got == {1: whole, 2: whole, None: whole, 3: None}


def test_reconcile_keeps_every_customer(spark, duck):
    every = {k for (k,) in duck.execute("select c_custkey from customer union select o_custkey from orders").fetchall()}
    assert {r.k for r in QUERIES["reconcile_both_all"](spark, SF).collect()} == every
