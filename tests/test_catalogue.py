"""Every catalogue query against its SQL in DuckDB, on the smallest tables."""

import math
import os

import duckdb
import pytest

from lodestrata.plans import catalogue, kernel_queries, series_queries

QUERIES = catalogue.QUERIES | {n: kernel_queries.QUERIES[n] for n in kernel_queries.ORACLES} | {n: series_queries.QUERIES[n] for n in series_queries.ORACLES}
ORACLES = catalogue.ORACLES | kernel_queries.ORACLES | series_queries.ORACLES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return c


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, bool):
        return v
    if hasattr(v, "isoformat"):
        return v.isoformat()[:26]
    return float(v) if isinstance(v, (int, float)) or type(v).__name__ == "Decimal" else v


def close(a, b):
    return a == b or isinstance(a, float) and isinstance(b, float) and math.isclose(a, b, rel_tol=1e-4, abs_tol=2e-5)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_against_sql(spark, sf_dir, db, name):
    df = QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=lambda r: tuple((x is None, str(round(x, 1)) if isinstance(x, float) else str(x)) for x in r))
    cur = db.execute(ORACLES[name])
    names = [x[0] for x in cur.description]
    assert sorted(names) == columns
    want = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in cur.fetchall()), key=lambda r: tuple((x is None, str(round(x, 1)) if isinstance(x, float) else str(x)) for x in r))
    assert len(got) == len(want)
    # numbers may differ in the last digit that is kept, which also moves a row among its neighbours
    wrong = [(a, b) for a, b in zip(got, want, strict=True) if not all(close(x, y) for x, y in zip(a, b, strict=True))]
    assert len(wrong) <= 0.002 * len(got), wrong[:3]
