import datetime as dt
import random

import pytest

from corpusloom.operators.snapshot_diff import snapshot_changes, tree_depth

JOBS = "job_id string, plugin string, status string, created_at timestamp"
ITEMS = "report_row_id bigint, job_id string, item_id string, snapshot_hash string, received_at timestamp"
DAY = dt.datetime(2025, 1, 1)


def at(n):
    return DAY + dt.timedelta(days=n)


def brute(jobs, items):
    done = {j: (p, c) for j, p, s, c in jobs if s == "completed" and j is not None}
    members = {}
    for rid, j, i, h, r in items:
        if j in done and i is not None:
            d = members.setdefault(j, {})
            d.setdefault(i.strip().lower(), [])
            if h is not None and h.strip():
                d[i.strip().lower()].append((r, rid, h.strip().lower()))
    out = set()
    for plugin in {p for p, _ in done.values()}:
        order = sorted((c, j) for j, (p, c) in done.items() if p == plugin)
        for (_, a), (_, b) in zip(order, order[1:]):
            old = {k: max(v)[2] if v else None for k, v in members.get(a, {}).items()}
            new = {k: max(v)[2] if v else None for k, v in members.get(b, {}).items()}
            out |= {(b, k, "added") for k in new.keys() - old.keys()}
            out |= {(b, k, "removed") for k in old.keys() - new.keys()}
            out |= {(b, k, "changed") for k in old.keys() & new.keys() if old[k] and new[k] and old[k] != new[k]}
    return out


@pytest.mark.parametrize("depth", [None, 1, 3])
def test_against_brute_force(spark, depth):
    random.seed(7)
    jobs = [(f"j{n}", "ab"[n % 2], random.choice(["completed", "completed", "failed"]), at(random.randint(0, 30))) for n in range(14)]
    jobs += jobs[:3]
    items = []
    for n in range(900):
        hot = random.random() < 0.3
        item = "hot" if hot else f"I{random.randint(0, 60)}"
        items.append((n, f"j{random.randint(0, 15)}", random.choice([item, f" {item} ", item.lower()]), random.choice([None, "", "x", "X", "y"]), at(n % 17)))
    frame = snapshot_changes(spark.createDataFrame(items, ITEMS), spark.createDataFrame(jobs, JOBS), depth)
    rows = [tuple(r) for r in frame.collect()]
    assert len(rows) == len(set(rows))
    assert set(rows) == brute(jobs, items)


def test_nulls_ties_empty_and_clashing_columns(spark):
    jobs = spark.createDataFrame([("a", None, "completed", at(1)), ("b", None, "completed", at(1)), (None, "p", "completed", at(1))], JOBS)
    jobs = jobs.selectExpr("*", "1 AS seq", "2 AS node", "3 AS item_id", "4 AS pairs")
    items = spark.createDataFrame(
        [(1, "a", "I", "h1", None), (2, "b", "i ", "H2", None), (3, "b", None, "h", None), (4, None, "z", "h", None), (5, "b", "", "h", None)], ITEMS
    ).selectExpr("*", "'x' AS plugin", "'y' AS best", "'z' AS change_kind", "0 AS last_seq")
    assert {tuple(r) for r in snapshot_changes(items, jobs).collect()} == {("b", "i", "changed"), ("b", "", "added")}
    assert snapshot_changes(items.limit(0), jobs).count() == 0
    assert snapshot_changes(items, jobs.limit(0)).count() == 0


def test_empty_snapshot_removes_and_adds(spark):
    jobs = spark.createDataFrame([(j, "p", "completed", at(n)) for n, j in enumerate("abc")], JOBS)
    items = spark.createDataFrame([(1, "a", "i", "h", at(1)), (2, "c", "i", "h", at(1))], ITEMS)
    assert {tuple(r) for r in snapshot_changes(items, jobs).collect()} == {("b", "i", "removed"), ("c", "i", "added")}


def test_depth_follows_rows():
    assert [tree_depth(n) for n in (0, 1000, 10**6, 10**12)] == [1, 1, 3, 8]
