"""Every registered query against its SQL twin, on whole tables."""

from __future__ import annotations

import duckdb
import pytest
from pyspark.sql import SparkSession

import __spark_entry__ as entry
from plumbline.plans.catalog import ORACLES, QUERIES
from tests.compare import connect, difference

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def twins() -> duckdb.DuckDBPyConnection:
    return connect(FOLDER)


def test_every_twin_has_its_query() -> None:
    assert set(entry.oracle_sql()) <= set(entry.queries())
    without = set(QUERIES) - set(ORACLES)
    assert without == {"check_ml_outlier", "profile_full", "profile_approximate"}


def test_entry(spark: SparkSession) -> None:
    rows = entry.entry(spark).collect()
    assert {r["check_id"] for r in rows} == set(range(1, 13))
    assert [r["status"] for r in rows if r["check_id"] == 11] == ["error"]


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_twin(spark: SparkSession, twins: duckdb.DuckDBPyConnection, name: str) -> None:
    assert difference(entry.queries()[name](spark, FOLDER), twins, entry.oracle_sql()[name]) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_runs(spark: SparkSession, name: str) -> None:
    assert entry.queries()[name](spark, FOLDER).count() >= 0


def test_reliability_lists_every_sla(spark: SparkSession) -> None:
    folder = "/root/testdata/sf0.01"
    got = [r["sla_id"] for r in QUERIES["reliability"](spark, folder).collect()]
    assert len(got) > 100 and sorted(got) == sorted(r["sla_id"] for r in QUERIES["sla_evaluations"](spark, folder).collect())
