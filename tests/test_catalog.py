"""Every query with SQL is compared with DuckDB on the small tables."""

import math

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if hasattr(v, "tolist") and not hasattr(v, "isoformat"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    if isinstance(v, bool):
        return v
    if isinstance(v, (int, float)):
        return float(f"{float(v):.9g}")
    if hasattr(v, "isoformat"):
        return v.isoformat().removesuffix("T00:00:00").replace("T", " ")
    return str(v)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


OWN = [n for n in entry.catalog.oracle_sql()]


@pytest.mark.parametrize("name", OWN)
def test_against_sql(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    c = duck.execute(entry.oracle_sql()[name])
    names = [d[0] for d in c.description]
    want = rows(names, c.fetchall())
    assert sorted(df.columns) == sorted(names)
    assert got == want


def test_every_query_has_sql():
    assert set(entry.catalog.queries()) == set(entry.catalog.oracle_sql())


def test_entry_has_rows(spark):
    df = entry.entry(spark)
    assert df.columns[:2] == ["day", "data_source_id"] and df.count() > 0


def test_all_missing_fields_are_counted(spark):
    from tracemill.plans.traces import _normalised
    from tracemill.schema import TARGET_FIELDS

    n, want = _normalised(spark, SF), {}
    for target in ("session", "model_call", "tool_call"):
        data = getattr(n, target).select(*TARGET_FIELDS[target]).collect()
        want |= {f"{target}.{f}": k for f in TARGET_FIELDS[target] if (k := sum(r[f] is None for r in data))}
    got = {r["field"]: r["n"] for r in entry.queries()["fields_missing"](spark, SF).collect()}
    assert got == want and len(got) > 4
