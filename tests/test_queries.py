"""Every core query against its SQL on the smallest test tables, and the rows of the rest."""

import glob
import math
import os

import pytest

from bohagi.plans.queries import ORACLES, QUERIES

TABLES = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(TABLES), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for p in glob.glob(f"{TABLES}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from read_parquet('{p}')")
    return con


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "null"
    if isinstance(v, (bool, str)):
        return repr(v)
    return repr(round(float(v), 6))


def rows(names, values):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in values)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, TABLES)
    got = duck.execute(ORACLES[name])
    names = [c[0] for c in got.description]
    assert sorted(names) == sorted(df.columns)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(names, got.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_has_rows(spark, name):
    assert QUERIES[name](spark, TABLES).count() > 0


def test_round_trip_of_labels(spark):
    assert QUERIES["decode_round_trip"](spark, TABLES).where("text <> decoded").count() == 0


def test_suppression_against_brute_force(spark):
    from bohagi.plans.queries import _boxes

    e, p = _boxes(spark, TABLES)
    pages = {}
    for r in p.collect():
        pages.setdefault(r["page"], []).append((-r["confidence"], r["idx"], tuple(r["bbox"])))
    for r in e.collect():
        pages.setdefault(r["page"], []).append((-0.45, r["idx"] + 1000, tuple(r["bbox"])))
    want = set()
    for page, boxes in pages.items():
        kept = []
        for _, i, a in sorted(boxes):
            if not any(over(a, b) >= 0.9 for _, b in kept):
                kept.append((i, a))
        want |= {(page, i) for i, _ in kept}
    assert {(r["page"], r["idx"]) for r in QUERIES["suppress_regions"](spark, TABLES).collect()} == want


def over(a, b):
    i = max(0.0, min(a[2], b[2]) - max(a[0], b[0])) * max(0.0, min(a[3], b[3]) - max(a[1], b[1]))
    return i / max(1.0, (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - i)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
