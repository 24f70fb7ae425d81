"""Every registered query against its SQL, on the smallest tables."""

import pytest
from compare import connect, differences

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
QUERIES = entry.queries()
SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, con, name):
    assert differences(QUERIES[name](spark, FOLDER), con, SQL[name]) == []


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs_without_sql(spark, name):
    assert QUERIES[name](spark, FOLDER).count() > 0


def test_sql_belongs_to_queries():
    assert set(SQL) <= set(QUERIES)


def test_entry(spark):
    df = entry.entry(spark)
    assert "n_events" in df.columns and df.count() > 0


def test_zero_event_records_are_read_from_written_shards(spark, monkeypatch):
    from eventlens.sources import shards

    paths, read = [], shards.read_shards
    monkeypatch.setattr(shards, "read_shards", lambda s, path, *rest: paths.append(path) or read(s, path, *rest))
    assert QUERIES["stored_zero_event_records"](spark, FOLDER).first()["n_without_events"] == 0
    assert len(paths) == 1 and shards.read_manifest(spark, paths[0]).count() > 0
