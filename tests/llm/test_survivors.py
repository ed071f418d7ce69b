import random

import pytest
from pyspark.sql import functions as F

from corpusloom.llm.survivors import dominance_layers, missing_count, survivor_records, survivor_sources

SCHEMA = "report_row_id bigint, item_id string, missing_fields array<string>, checked_at string, title string, content_hash string, artifact_dir string"
TIMES = ["2025-01-01T00:00:00Z", "2025-01-01 01:00:00+01:00", "1735689600", "2025-02-01", "n/a", "", None]
INSTANT = {TIMES[0]: 0, TIMES[1]: 0, TIMES[2]: 0, TIMES[3]: 1}


def brute(rows):
    groups, out = {}, set()
    for r in rows:
        if r[1] is not None:
            n = 10**9 if r[2] is None else len({x.strip().lower() for x in r[2] if x is not None and x.strip()})
            groups.setdefault(r[1].strip().lower(), []).append((n, -INSTANT.get(r[3], -1), r[0], r))
    for key, rs in groups.items():
        if len(rs) > 1:
            rs.sort(key=lambda x: x[:3])
            out.add((key, "record", rs[0][2]))
            for i, f in ((4, "title"), (5, "content_hash"), (6, "artifact_dir")):
                hit = next((x[2] for x in rs if x[3][i] is not None and x[3][i].strip()), None)
                if hit is not None:
                    out.add((key, f, hit))
    return out


def rows(n):
    random.seed(n)
    pick = lambda: random.choice([None, "", " ", "x", "y"])
    names = [None, [], ["a"], ["A", " a"], ["a", "b"], ["b", None, ""], ["a", "b", "c"]]
    return [
        (i, random.choice(["hot", " HOT", f"k{random.randint(0, 40)}", None, ""]), random.choice(names), random.choice(TIMES), pick(), pick(), pick())
        for i in range(n)
    ]


@pytest.mark.parametrize("n", [0, 1, 600])
def test_against_brute_force(spark, n):
    data = rows(n)
    frame = spark.createDataFrame(data, SCHEMA).selectExpr("*", "1 AS n", "2 AS record", "3 AS key", "4 AS cells")
    got = [tuple(r) for r in survivor_sources(frame).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(data)


FIELDS = ((4, "title"), (5, "content_hash"), (6, "artifact_dir"))


def by_layers(rows):
    """Cells and their layers by peeling; of each field the first layer's lexicographically first cell."""
    groups, out = {}, {}
    for r in rows:
        if r[1] is not None:
            n = 2**31 - 1 if r[2] is None else len({x.strip().lower() for x in r[2] if x is not None and x.strip()})
            offers = tuple(bool(r[i] and r[i].strip()) for i, _ in FIELDS)
            groups.setdefault(r[1].strip().lower(), []).append((n, -INSTANT.get(r[3], -1), r[7], r[0], offers, r))
    for key, rs in groups.items():
        if len(rs) < 2:
            continue
        cells = {}
        for x in rs:
            cells.setdefault((x[0], x[2], x[4]), []).append(x)
        left, layers = [min(x, key=lambda y: (y[1], y[3])) for x in cells.values()], []
        while left:
            front = [x for x in left if not any(all(a <= b for a, b in zip(y[:3], x[:3])) and y[:3] != x[:3] for y in left)]
            layers.append(sorted(front, key=lambda x: (x[0], x[1], x[3])))
            left = [x for x in left if x not in front]
        out[key] = {"record": (layers[0][0][3], 1)}
        for i, f in FIELDS:
            out[key][f] = next(((x[5][i], k) for k, layer in enumerate(layers, 1) for x in layer if x[5][i] and x[5][i].strip()), (None, None))
        out[key]["layer_of"] = {x[3]: k for k, layer in enumerate(layers, 1) for x in layer}
    return out


def doubted(n):
    data = rows(n)
    # hot items whose complete rows offer little, so that fields come from deeper layers
    data += [(5000 + i, f"deep{i % 7}", ["a"] * (i // 7 % 5) and [f"m{j}" for j in range(i // 7 % 5)], TIMES[(i // 35 + 3) % 4], *(None if i // 7 % 5 < k else "v" for k in (1, 2, 3))) for i in range(140)]
    return [(*r, random.choice([0, 1, 2])) for r in data]


def test_records(spark):
    data = doubted(300)
    frame = spark.createDataFrame(data, SCHEMA + ", doubts int").selectExpr("*", "1 AS n", "2 AS best", "3 AS cells")
    by_id = {r[0]: r for r in data}
    want, layers = {}, by_layers(data)
    for key, field, rid in brute([r[:7] for r in data]):
        want.setdefault(key, {})[field] = rid
    got = survivor_records(frame, doubts=F.col("doubts")).collect()
    assert {r["item_id"] for r in got} == set(want) == set(layers)
    for r in got:
        w = want[r["item_id"]]
        assert r["report_row_id"] == w["record"] and r["layer"] == layers[r["item_id"]]["layer_of"][w["record"]]
        for i, f in FIELDS:
            assert r[f] == (by_id[w[f]][i] if f in w else None)
            assert r[f"{f}_layer"] == (layers[r["item_id"]]["layer_of"][w[f]] if f in w else None)
    deep = set()
    for r in survivor_records(frame, doubts=F.col("doubts"), policy="layers").collect():
        w = layers[r["item_id"]]
        assert (r["report_row_id"], r["layer"]) == w["record"]
        for _, f in FIELDS:
            assert (r[f], r[f"{f}_layer"]) == w[f]
            deep.add(r[f"{f}_layer"])
    assert {1, 2, 3} <= deep
    assert survivor_records(frame.limit(0)).count() == 0


def test_layers(spark):
    cells = [(0, 5, 1), (1, 3, 0), (2, 3, 0), (2, 4, 0), (3, 3, 0), (3, 9, 9), (3, 9, 9)]
    frame = spark.createDataFrame([(cells,)], "c array<struct<n:int,late:bigint,doubts:int>>")
    # by hand: (1,3,0) is later than the first; (2,3,0) lies behind it, (2,4,0) and (3,3,0) behind that; the last, equals, behind all
    assert frame.select(dominance_layers(F.col("c"))).first()[0] == [1, 1, 2, 3, 3, 4, 4]


def test_missing_count(spark):
    data = [(None,), ([],), (["a", " A ", None, ""],), (["a", "b"],)]
    frame = spark.createDataFrame(data, "m array<string>")
    assert [r[0] for r in frame.select(missing_count(F.col("m"))).collect()] == [2**31 - 1, 0, 1, 2]
