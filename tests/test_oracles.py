"""Every scenery query against its SQL on the smallest tables."""

import math

import duckdb
import pytest

from tests.conftest import DATA
from tessera.jobs.registry import ORACLES, QUERIES


#: Queries whose data the smallest tables lack.
NEED_MORE = {"p6_bbox_overlap", "v1_duplicate_names", "v2_shared_frequencies", "v11_airport_size_limit"}


def connected(folder):
    con = duckdb.connect()
    for f in folder.glob("*.parquet"):
        con.sql(f"CREATE VIEW {f.stem} AS SELECT * FROM read_parquet('{f}')")
    return con


@pytest.fixture(scope="module")
def sql():
    folders = [DATA, DATA.parent / "sf0.01"]
    return {folder: connected(folder) for folder in folders}, folders


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = lambda x: None if isinstance(x, float) and math.isnan(x) else x
    return sorted((tuple(plain(v[i]) for i in order) for v in values), key=repr)


#: Order-dependent operators, which SQL cannot express; other tests compare them with brute force.
GREEDY = {"k2_remove_near_duplicate_features", "k7_douglas_peucker", "g6_merge_near_junctions", "g6_edges_of_merged_junctions", "w20_water_depth"}


def test_every_query_has_sql():
    assert set(QUERIES) - set(ORACLES) == GREEDY


@pytest.mark.parametrize("name", sorted(GREEDY))
def test_greedy_query_runs(spark, name):
    assert QUERIES[name](spark, str(DATA)).count() > 0


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, sql, name):
    connections, folders = sql
    folder = folders[name in NEED_MORE]
    found = QUERIES[name](spark, str(folder))
    wanted = connections[folder].sql(ORACLES[name])
    assert sorted(found.columns) == sorted(wanted.columns)
    got = rows(found.columns, [tuple(r) for r in found.collect()])
    want = rows(wanted.columns, wanted.fetchall())
    assert len(got) == len(want)
    assert want, "an oracle without rows proves nothing"
    for a, b in zip(got, want):
        for x, y in zip(a, b):
            assert x == y or (isinstance(x, float) and abs(x - y) <= 1e-6 * max(1, abs(x)))
