"""Every registered query next to its SQL, on the smallest tables, and the driver contract."""

import os

import pytest

import __spark_entry__ as contract
from codestrata.operators import skew
from tests import oracle

FOLDER = contract.SMOKE_DIR
LARGER = "/root/testdata/sf0.01"
NEED_MORE_ROWS = {"keys_only_in_old", "paths_of", "shared_links"}
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables not mounted")


@pytest.fixture(scope="module")
def duck():
    pytest.importorskip("duckdb")
    return {folder: oracle.connect(folder) for folder in (FOLDER, LARGER)}


def check(spark, duck, name):
    folder = LARGER if name in NEED_MORE_ROWS else FOLDER
    problem, _, count = oracle.compare(spark, duck[folder], folder, name, contract.queries()[name], contract.oracle_sql().get(name))
    assert problem is None
    assert count > 0


@pytest.mark.parametrize("name", sorted(contract.queries()))
def test_query_matches_sql(spark, duck, name):
    check(spark, duck, name)


# Queries whose plans change when keys are hot or joins are not broadcast.
SKEWED = """batches carry_scope cursor findings_adjudicated history_after_change history_lookup history_skip_until history_skipped_steps
    history_take_while ir_rw_counts op_diff op_renames resolve_names snapshot_diff_dups tree_paths unresolved""".split()


@pytest.mark.parametrize("name", SKEWED)
def test_query_matches_sql_when_every_key_is_hot(spark, duck, monkeypatch, name):
    monkeypatch.setattr(skew, "HOT_ROWS", 0)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        check(spark, duck, name)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10485760")


def test_entry(spark):
    assert contract.entry(spark).count() > 0


def test_every_sql_has_a_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())


def test_pivot_reads_two_columns_and_no_more(spark):
    plan = contract.entry(spark)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<lang:string,source:string>" in plan or "ReadSchema: struct<source:string,lang:string>" in plan
    assert "IsNotNull(source)" in plan
    assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan
