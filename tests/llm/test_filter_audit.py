"""The replay of filters against a plain loop over documents and orders."""

import re
from collections import defaultdict
from itertools import permutations

from lodestrata.llm import filter_audit as fa


def brute(docs, labels):
    least = {}
    for d, t, _ in docs:
        if d is not None:
            least[t or ""] = min(d, least.get(t or "", d))
    good, toxic = {d for d, q, _ in labels if q == 1} - {None}, {d for d, _, x in labels if x == 1} - {None}
    counts = defaultdict(lambda: [0] * 6)
    shapley = defaultdict(int)
    for d, t, source in docs:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {
            "A": len(w) < 200,
            "B": 100 * len(set(w)) < 50 * len(w),
            "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t),
            "D": bool(re.search("[#$%&*|]", t)),
            "E": d is not None and least[t] < d,
        }
        for p in permutations("ABCDE"):
            gone = False
            for step, x in enumerate(p, 1):
                c = counts[source or "", "".join(p), step]
                here = fails[x] and not gone
                c[2] += fails[x] and gone
                c[3] += fails[x] and sum(fails.values()) == 1
                gone |= here
                c[0] += not gone
                c[1] += here
                c[4] += here and d in good
                c[5] += here and d in toxic
                shapley[source or "", x] += here
    return {(part, o, step, *c, shapley[part, o[step - 1]]) for (part, o, step), c in counts.items()}


def test_replay(spark):
    same = "w x y z " * 60
    long = " ".join(f"word{i}" for i in range(250))
    texts = [None, "", "a", "a", long, long, long + " #", long.upper(), same, same, "A" + "a" * 49, "A" + "a" * 48, "Ä" * 9 + "|", long.replace("1", "%")]
    docs = [(100 - i, t, ["s1", None, "", "s2"][i % 4]) for i, t in enumerate(texts)]
    docs += [(None, long, "s1"), (None, None, "s3"), (87, long, "s1"), (87, long, "s1")]
    labels = [(d, i % 2, i % 3) for i, (d, _, _) in enumerate(docs)] + [(100, 1, None), (None, 1, 1), (5000, 1, 1)]
    left = spark.createDataFrame([(*d, "", "") for d in docs], "doc_id long, text string, source string, part string, fails string").repartition(3)
    right = spark.createDataFrame([(*x, 1) for x in labels], "doc_id long, quality int, toxic int, part int")
    got = fa.filter_audit(left, right)
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(set(rows)) == 4 * 600
    want = brute(docs, labels)
    assert set(rows) == want, (sorted(set(rows) - want)[:3], sorted(want - set(rows))[:3])
    assert got.columns == "part filter_order step kept removed redundant unique_fails good_lost toxic_lost shapley".split()


def test_empty(spark):
    docs, labels = spark.createDataFrame([], "doc_id long, text string, source string"), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert fa.filter_audit(docs, labels).count() == 0
    one = spark.createDataFrame([(1, "a b", "s")], docs.schema)
    assert fa.filter_audit(one, labels).where("good_lost > 0 or toxic_lost > 0").isEmpty()


def test_combines_inside_tasks(spark, sf_dir):
    """Only counts by part, order and step leave the tasks that replay, and the orders are broadcast."""
    flagged = spark.range(1).selectExpr("'s' as part", "array(true, false, true, false, false) as fails", "true as good", "false as toxic")
    plan = fa.replay(flagged)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastNestedLoopJoin" in plan and "partial_count" in plan and "CartesianProduct" not in plan
