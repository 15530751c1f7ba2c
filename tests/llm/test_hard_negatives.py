import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyframe.llm import hard_negatives

ROWS = "vec_id long, embedding array<float>, label int"


def brute(rows, anchors, positives=5, negatives=5, low=80, high=100, most=2**31 - 1):
    """Every anchor against every row, in Python's whole numbers."""
    kept = {}
    for i, v, k in rows:
        if i is None or k is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        top = min(most, int(math.sqrt(2.0**62 / max(1, len(v)))))
        whole = [max(-top, min(top, math.floor(256 * float(np.float32(x))))) for x in v]
        kept[i] = min(kept.get(i, (str(k), whole)), (str(k), whole))
    score = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for i in filter(anchors, kept):
        label, v = kept[i]
        ranked = sorted((-score(v, w), j, k) for j, (k, w) in kept.items() if j != i)
        for s, j, _ in [r for r in ranked if r[2] == label][:positives]:
            fits = [r for r in ranked if r[2] != label and low * -s <= 100 * -r[0] <= high * -s]
            out += [(i, j, n, m, -s, -t) for n, (t, m, _) in enumerate(fits[:negatives], 1)]
    return sorted(out)


def mined(spark, rows, every=5, **more):
    return sorted(map(tuple, hard_negatives.mine(spark.createDataFrame(rows, ROWS), F.col("id") % every == 0, **more).collect()))


@pytest.fixture
def small_lists(monkeypatch):
    for name, value in (("LIST_ROWS", 12), ("LIST_PART", 16), ("ANCHOR_BLOCK", 20)):
        monkeypatch.setattr(hard_negatives, name, value)


@pytest.mark.parametrize("dims,spread", [(6, 3), (3, 1), (16, 40)])
def test_equals_brute_force(spark, small_lists, dims, spread):
    draw = np.random.default_rng(dims)
    rows = [(k, (draw.integers(-spread, spread + 1, dims) / 16).tolist(), int(draw.integers(0, 4))) for k in range(300)]
    rows += [(300 + k, rows[7][1], k % 3) for k in range(100)]  # a quarter of the rows is one vector
    found = mined(spark, rows)
    assert len(found) > 100
    assert found == brute(rows, lambda i: i % 5 == 0)
    assert mined(spark, rows, every=50, positives=2, negatives=9, low=50, high=90) == brute(rows, lambda i: i % 50 == 0, 2, 9, 50, 90)


def test_clustered_rows_skip_lists(spark, small_lists):
    draw = np.random.default_rng(1)
    centres = draw.normal(size=(12, 8))
    rows = [(k, (centres[k % 12] + draw.normal(size=8) * 0.01).tolist(), k % 2 if k % 12 else 2) for k in range(360)]
    assert mined(spark, rows) == brute(rows, lambda i: i % 5 == 0)
    points = hard_negatives.one_by_id(hard_negatives.quantised(spark.createDataFrame(rows, ROWS), "vec_id", "embedding", "label"))
    lists, index, width = hard_negatives.build(points)
    queries = lists.where("id % 5 = 0").withColumn("scores", F.lit(None).cast("array<long>"))
    asked = hard_negatives._asked(queries, index, width, 80, 100).withColumn("floors", F.array(F.lit(60000).cast("long")))
    left = [len(r.lists) for r in hard_negatives._reaching(asked, index, width).collect()]
    assert max(left) < (index.size > 0).sum() - hard_negatives.FIRST_LISTS
    # no score lies outside its list's bounds
    vectors = {r.id: (np.array(r.v), r.list) for r in lists.collect()}
    for i in range(0, 360, 40):
        least, most = index.bounds(vectors[i][0][None, :])
        for v, at in vectors.values():
            assert least[0, at] <= vectors[i][0] @ v <= most[0, at]


def test_rows_that_take_no_part_and_repeats(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.5], 1), (1, [1.0, 0.5], 1), (2, [0.9, 0.5], 2), (3, [0.9, 0.5], 0), (3, [5.0, 5.0], 2), (3, [0.9, 0.5], 0)]
    rows += [(4, None, 1), (5, [1.0, None], 1), (6, [nan, 1.0], 1), (7, [inf, 1.0], 2), (8, [1.0, 1.0], None), (None, [1.0, 0.5], 2), (10, [-1.0, -0.5], 2), (15, [0.0, 0.0], 2), (20, [0.0, 0.0], 2), (25, [], 3), (30, [0.8, 0.5, 3.0], 2)]
    found = mined(spark, rows)
    assert found == brute(rows, lambda i: i % 5 == 0)
    assert [r[3] for r in found if r[:2] == (0, 1)] == [2, 3, 30]


def test_huge_components_stay_exact(spark):
    rows = [(0, [3e38, 1e9], 1), (1, [3e38, 1e9], 1), (2, [3e38, 2e6], 2), (3, [-3e38, 1e9], 2), (4, [1e6, 1e6], 2), (5, [1e6, 1e6], 1)]
    assert mined(spark, rows) == brute(rows, lambda i: i % 5 == 0)


def test_empty_tables_and_clashing_names(spark):
    none = spark.createDataFrame([], ROWS)
    assert hard_negatives.mine(none, F.lit(True)).collect() == []
    rows = [(k, [1.0, k / 8], k % 2) for k in range(12)]
    odd = spark.createDataFrame(rows, ROWS).select("*", F.lit("x").alias("id"), F.lit(1).alias("score"), F.lit(2).alias("list"))
    found = hard_negatives.mine(odd, F.col("id") % 5 == 0)
    assert sorted(map(tuple, found.collect())) == brute(rows, lambda i: i % 5 == 0)
    with pytest.raises(ValueError):
        hard_negatives.mine(none, F.lit(True), low=90, high=80)
