import duckdb
import pytest

from compare import compare, views
from strideline.plans import catalog

SF = "/root/testdata/sf0.01"
SQL = catalog.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    return views(SF)


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, duck, name):
    said = compare(spark, duck, catalog.queries()[name], SQL[name], SF)
    assert said is None, said


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(SQL)))
def test_runs(spark, name):
    assert catalog.queries()[name](spark, "/root/testdata/sf0.01").collect()


def stream(path, moves):
    """A folder with an events table: one user's moves (type, value) in time order."""
    rows = ", ".join(f"({k}, TIMESTAMP '2024-01-01' + INTERVAL {k} MINUTE, 7, '{kind}', {value}::DOUBLE, '{{\"k\": 1}}')" for k, (kind, value) in enumerate(moves))
    duckdb.sql(f"COPY (SELECT * FROM (VALUES {rows}) e(event_id, ts, user_id, event_type, value, props)) TO '{path}/events.parquet'")
    return str(path)


def test_a_path_of_exactly_100(spark, tmp_path):
    """A step clear of the junction when the path reaches 100 is not yet one of 100.005 or more."""
    sf = stream(tmp_path, [("error", 0), ("purchase", 70), ("click", 30), ("signup", 10.12)])
    said = compare(spark, views(sf), catalog.queries()["directions_pathlen"], SQL["directions_pathlen"], sf)
    assert said is None, said
