"""Every registered query of the library against DuckDB over the same files."""

import os

import duckdb
import pytest

from lodeframe.plans import registry

SF = "/root/testdata/sf0.001"
QUERIES, ORACLE = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    made = duckdb.connect()
    for f in os.listdir(SF):
        made.execute(f"create view {f.split('.')[0]} as select * from read_parquet('{SF}/{f}')")
    return made


def plain(rows, names):
    at = sorted(range(len(names)), key=lambda k: names[k])
    return sorted((tuple(round(r[k], 5) if isinstance(r[k], float) else r[k] for k in at) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_oracle(spark, duck, name):
    got = QUERIES[name](spark, SF)
    want = duck.execute(ORACLE[name])
    names = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(names)
    assert plain([tuple(r) for r in got.collect()], got.columns) == plain(want.fetchall(), names)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0
