"""Every grouped query runs on the smallest tables and gives rows of the schema it declares, without clashing columns."""

import pytest

from lodestrata.plans import kernel_queries


@pytest.mark.parametrize("name", sorted(kernel_queries.QUERIES))
def test_runs(spark, sf_dir, name):
    df = kernel_queries.QUERIES[name](spark, sf_dir)
    assert len(set(df.columns)) == len(df.columns)
    assert df.count() > 0


def test_futures_curve_follows_the_fronts(spark, sf_dir):
    rows = kernel_queries.QUERIES["futures_curve"](spark, sf_dir).orderBy("root", "date").collect()
    for a, b in zip(rows, rows[1:], strict=False):
        if a["root"] == b["root"] and a["front"] and b["front"]:
            assert b["roll"] == (a["front"] != b["front"])
            if not b["roll"]:
                assert abs(b["ret_front"] - (b["front_px"] / a["front_px"] - 1)) < 1e-9
    assert all(r["second"] is None or r["second"] > r["front"] for r in rows)
