"""Paths of combinatorial splits: every group once, every test group of every fold once."""

from itertools import combinations

import pytest

from lodestrata.operators import evaluation as E


@pytest.mark.parametrize(("n", "k"), [(6, 2), (5, 1), (6, 3), (4, 4)])
def test_paths(spark, n, k):
    rows = [tuple(r) for r in E.paths(spark, n, k).select("path", "grp", "fold").collect()]
    folds = list(combinations(range(n), k))
    assert sorted((f, g) for _, g, f in rows) == sorted((f, g) for f, c in enumerate(folds) for g in c)
    by_path = {}
    for p, g, _ in rows:
        by_path.setdefault(p, []).append(g)
    assert len(by_path) == len(folds) * k // n and all(sorted(g) == list(range(n)) for g in by_path.values())


def test_returns_come_from_the_fold_that_tests_them(spark):
    dates = spark.sql("select date_add(date'2024-01-01', cast(id as int)) as date from range(31)")
    rows = E.combinations(dates, 6, 2).where("role = 'test'").selectExpr("'s' as strategy", "fold", "date", "cast(fold as double) as r")
    got = E.path_returns(rows, "r", 6, 2, ("strategy",))
    assert got.count() == 5 * 31 and got.select("path", "date").distinct().count() == 5 * 31
    tested = {(r["fold"], r["date"]) for r in rows.collect()}
    assert all((int(r["r"]), r["date"]) in tested for r in got.collect())
