import math
import random

import pytest

from corpusloom.llm import mixing

DOCS = "doc_id bigint, text string, source string"
PLANS = "mix_id string, size_ratio double"
TARGETS = "mix_id string, source string, target_weight double, max_repeats int"


def test_budgets_meet_limits_and_sum():
    random.seed(1)
    for _ in range(100):
        n = random.randint(1, 9)
        w = [random.choice([0.0, random.random()]) for _ in range(n)]
        m = [random.choice([0.0, random.random() * 100]) for _ in range(n)]
        wanted = random.random() * 150
        got = mixing.capped_budgets(w, m, wanted)
        open_ = [i for i in range(n) if w[i] > 0 and m[i] > 0]
        assert all(g <= x + 1e-6 for g, x in zip(got, m))
        assert math.isclose(sum(got), min(wanted, sum(m[i] for i in open_)), abs_tol=1e-6)
        free = [got[i] / w[i] for i in open_ if got[i] < m[i] - 1e-6]
        assert not free or max(free) - min(free) < 1e-6  # those below their limit keep to the weights
        assert all(got[i] == 0 for i in range(n) if i not in open_)


def test_temperature():
    sizes = [900.0, 90.0, 10.0, 0.0]
    assert mixing.temperature_weights(sizes, 0)[:3] == [pytest.approx(1 / 3)] * 3 and mixing.temperature_weights(sizes, 1)[3] == 0
    x = mixing.bisect_exponent(sizes, 500, [s * 4 for s in sizes])
    shares = mixing.temperature_weights(sizes, x)
    assert max(s * 500 / (4 * z) for s, z in zip(shares, sizes) if z) == pytest.approx(1, abs=1e-6) and 0 < x < 1
    y = mixing.bisect_exponent(sizes, 1, [1e9] * 4, entropy=0.8)
    assert -sum(w * math.log(w) for w in mixing.temperature_weights(sizes, y) if w) == pytest.approx(0.8, abs=1e-6)
    assert mixing.bisect_exponent(sizes, 1e9, [1.0] * 4) == 1.0


@pytest.fixture(scope="module")
def docs(spark):
    random.seed(6)
    rows = [(n, "word " * random.randint(1, 40), "big" if n % 3 else f"s{n % 5}") for n in range(3000)]
    rows += [(5000, None, "s1"), (5001, "", "tiny"), (5002, "only one here", "tiny"), (5003, "x", None)]
    return spark.createDataFrame(rows, DOCS).selectExpr("*", "1 AS n_tokens", "2 AS block", "3 AS repeats")


def test_shares(spark, docs):
    plans = spark.createDataFrame([("m", 0.6), ("n", 0.05), ("none", None)], PLANS)
    targets = spark.createDataFrame(
        [("m", "big", 3.0, 1), ("m", "s1", 1.0, 4), ("m", "tiny", 9.0, 2), ("m", "absent", 1.0, 9), ("m", "s2", None, 9), ("m", "s3", 0.0, 9), ("m", "s4", 1.0, 0), ("n", "big", 1.0, 1), ("n", "s0", 1.0, 1), ("none", "big", 1.0, 1), ("other", "big", 1.0, 1)], TARGETS
    )
    report = {(r["mix_id"], r["source"]): r for r in mixing.share_report(docs, plans, targets).collect()}
    total = {r["mix_id"]: r["mix_tokens"] for r in report.values()}
    assert report["m", "tiny"]["most_repeats"] == 2 and report["m", "tiny"]["tokens"] == 2 * report["m", "tiny"]["size_tokens"]
    for k in ("absent", "s2", "s3", "s4"):
        assert report["m", k]["tokens"] == 0
    big, s1 = report["m", "big"], report["m", "s1"]
    assert big["tokens"] / s1["tokens"] == pytest.approx(3, rel=0.01) or big["tokens"] >= 0.99 * big["size_tokens"]
    assert abs(total["m"] - report["m", "big"]["wanted_tokens"]) < 0.02 * total["m"]
    assert report["n", "big"]["reached_share"] == pytest.approx(0.5, abs=0.01)
    assert report["none", "big"]["tokens"] == 0 and ("other", "big") not in report


def test_choice_keeps_to_the_budget(spark, docs):
    plans = spark.createDataFrame([("m", 0.5)], PLANS)
    targets = spark.createDataFrame([("m", "big", 1.0, 1), ("m", "s0", 1.0, 5)], TARGETS)
    sizes = mixing.document_sizes(docs)
    budgets = {r["source"]: r for r in mixing.mix_budgets(mixing.source_totals(sizes), plans, targets).collect()}
    rows = mixing.mixed(docs, plans, targets).collect()
    assert len({r["doc_id"] for r in rows}) == len(rows)
    for source, b in budgets.items():
        got = sum(r["n_tokens"] * r["repeats"] for r in rows if r["source"] == source)
        assert got <= b["budget"] + 1e-6 and b["budget"] - got < 60
        assert max(r["repeats"] for r in rows if r["source"] == source) <= b["max_repeats"]


def test_empty(spark, docs):
    plans, targets = spark.createDataFrame([("m", 1.0)], PLANS), spark.createDataFrame([("m", "big", 1.0, 1)], TARGETS)
    assert mixing.mixed(docs.limit(0), plans, targets).count() == 0
    assert mixing.mixed(docs, plans.limit(0), targets).count() == 0
    assert mixing.mixed(docs, plans, targets.limit(0)).count() == 0
