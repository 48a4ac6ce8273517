"""Mined negatives against a plain comparison of all pairs."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from geocairn.llm import hard_negatives as hn

KIND = "vec_id long, embedding array<float>, label int"


def vectors(seed=3, n=150):
    rng = random.Random(seed)
    draw = lambda: [rng.randrange(-3, 6) / 8 for _ in range(4)]  # noqa: E731  many ties
    rows = [(i, draw(), rng.randrange(3)) for i in range(n)]
    common = [0.5, 0.25, 0.25, 0.125]
    rows += [(i, common, i % 2) for i in range(n, n + 60)]
    rows += [(10, draw(), 1), (10, draw(), 1), (7, common, 0), (7, common, 0), (None, draw(), 1), (300, None, 1),
             (301, draw(), None), (302, [1.0, None, 0.0, 0.0], 1), (303, [math.nan, 1.0, 0.0, 0.0], 1),
             (304, [math.inf, 1.0, 0.0, 0.0], 1), (305, [], 1), (310, [0.5], 1), (306, [0.5, 0.5, 0.5, 0.5, 9.0], 2),
             (320, [0.0] * 4, 2), (-5, draw(), 2), (-10, draw(), 2)]
    return rows


def brute(rows, every=10):
    good = [(i, [math.floor(256 * x) for x in v], c) for i, v, c in rows if i is not None and v is not None and c is not None
            and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, u, label in good:
        if a % every:
            continue
        scored = [(-sum(x * y for x, y in zip(u, v)), i, c) for i, v, c in good if i != a]
        positives = sorted((s, i) for s, i, c in scored if c == label)[:5]
        for s, p in positives:
            fits = sorted((t, i) for t, i, c in scored if c != label and 50 * -s <= 100 * -t <= 95 * -s)
            out += [(a, p, k, i, -s, -t) for k, (t, i) in enumerate(fits[:3], 1)]
    return sorted(out)


@pytest.mark.parametrize("bound,parts", [(1 << 25, 1), (1 << 25, 6), (3_000, 4)])
def test_equals_all_pairs(spark, bound, parts, monkeypatch):
    monkeypatch.setattr(hn, "ANCHOR_BYTES", bound)  # several passes
    monkeypatch.setattr(hn, "_SCORES", 400)  # several blocks a task
    rows = vectors()
    df = spark.createDataFrame(rows, KIND).repartition(parts).withColumn("anchor", F.lit("clash")).withColumn("id", F.lit("clash"))
    got = hn.hard_negatives(df, F.col("vec_id") % 10 == 0)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    want = brute(rows)
    assert sorted(map(tuple, got.collect())) == want and len(want) > 100


def test_no_rows_and_no_anchors(spark):
    assert hn.hard_negatives(spark.createDataFrame([], KIND), F.col("vec_id") % 10 == 0).count() == 0
    df = spark.createDataFrame([(1, [1.0], 0), (2, [1.0], 0), (3, [0.7], 1)], KIND)
    assert hn.hard_negatives(df, F.col("vec_id") % 10 == 0).count() == 0
    assert hn.hard_negatives(df, F.lit(None).cast("boolean")).count() == 0


@pytest.mark.parametrize("scale", [1, 2 ** 8, 2 ** 20, 2 ** 22])
def test_products_are_exact_at_every_size(scale):
    rng = np.random.default_rng(5)
    a, b = (np.floor(rng.uniform(-100, 100, (n, 7)) * scale) for n in (5, 9))
    want = [[sum(int(x) * int(y) for x, y in zip(u, v)) for v in b] for u in a]
    assert hn.products(a, b).astype(object).astype(int).tolist() == want
    assert hn.products(a * 2.0 ** 60, b * 2.0 ** 60).max() == (1 << 63) - 1
