"""Hard negatives: brute force over random, tied and awkward vectors, for several block sizes."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from barweave.llm import negatives

SCHEMA = "vec_id bigint, embedding array<float>, label int, block string, score double"


def brute(rows, every, k, low, high):
    seen = {(i, label, tuple(int(np.floor(256 * np.float64(np.float32(c)))) for c in v)) for i, v, label in rows
            if i is not None and label is not None and v and all(c is not None and math.isfinite(c) for c in v)}
    out = []
    for i, label, v in seen:
        if i % every:
            continue
        scored = [(-sum(a * b for a, b in zip(v, w)), j, other) for j, other, w in seen if j != i]
        same = sorted((s, j) for s, j, other in scored if other == label)[:k]
        for s, j in same:
            window = sorted((t, n) for t, n, other in scored if other != label and low * -s <= -100 * t <= high * -s)[:k]
            out += [(i, j, rank + 1, n, -s, -t) for rank, (t, n) in enumerate(window)]
    return sorted(out)


def table(spark, rows):
    floats = [None if v is None else [None if c is None else float(c) for c in v] for _, v, _ in rows]
    return spark.createDataFrame([(i, v, label, "x", 0.0) for (i, _, label), v in zip(rows, floats)], SCHEMA)


@pytest.mark.parametrize("seed,least,most", [(1, 1, 7), (2, 1024, 1 << 16), (3, 5, 40)])
def test_equals_brute_force(spark, seed, least, most):
    rng = random.Random(seed)
    rows = []
    for i in range(260):
        label = 0 if rng.random() < 0.4 else rng.randrange(5)  # one label holds about half of all rows
        base = [rng.choice([-1, -0.5, 0, 0.25, 0.5, 1]) for _ in range(12)]  # coarse values: many ties
        rows.append((i - 40, base if rng.random() < 0.8 else rows[-1][1] if rows else base, label))
    rows += [(300, None, 1), (301, [], 1), (302, [1.0, None], 1), (303, [float("nan")] * 12, 2), (304, [float("inf")] * 12, 2), (305, [1.0] * 12, None)]
    rows += [(None, [1.0] * 12, 1), rows[10], rows[10], (306, [0.5, 0.5], 3), (rows[20][0], [0.25] * 12, rows[20][2]), (307, [0.0] * 12, 4)]
    got = negatives.hard_negatives(table(spark, rows), F.col("vec_id") % 10 == 0, low=60, high=100, least=least, most=most)
    assert sorted(tuple(r) for r in got.collect()) == brute(rows, 10, 5, 60, 100)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def test_large_group_of_copies_and_lone_labels(spark):
    rows = [(i, [0.5, 0.25, -0.5, 1.0], i % 2) for i in range(300)] + [(1000, [0.5, 0.25, -0.5, 0.99], 9)]
    got = negatives.hard_negatives(table(spark, rows), F.col("vec_id") % 100 == 0, least=16, most=16)
    assert sorted(tuple(r) for r in got.collect()) == brute(rows, 100, 5, 80, 100)


def test_empty_and_unusable_tables(spark):
    for rows in ([], [(0, None, 1), (100, [float("nan")], 2), (None, [1.0], 1)]):
        got = negatives.hard_negatives(table(spark, rows), F.col("vec_id") % 100 == 0)
        assert got.collect() == [] and dict(got.dtypes)["rank"] == "int"


def test_bitmap_shrinks_to_what_can_still_matter():
    """The scan reads the anchor's largest dimension first and returns exact scores although most rows are left out early."""
    rng = np.random.default_rng(5)
    rows = rng.integers(-20, 20, (500, 32)).astype(float)
    rows[:, 7] = rng.integers(-4000, 4000, 500)
    anchor = np.zeros(32)
    anchor[7], anchor[3] = 900, 2
    block = negatives.Fragments(np.arange(500), np.array(["a"] * 500, object), rows)
    scores = rows @ anchor
    (found,) = block.scan(anchor, np.ones(500, bool), np.array([-np.inf]), np.array([np.inf]), 5)
    assert list(found[1]) == list(np.lexsort((np.arange(500), -scores))[:5]) and list(found[2]) == sorted(scores, reverse=True)[:5]
    low, high = np.sort(scores)[100], np.sort(scores)[300]
    (found,) = block.scan(anchor, np.ones(500, bool), np.array([low]), np.array([high]), 5)
    inside = np.flatnonzero((scores >= low) & (scores <= high))
    assert list(found[1]) == list(inside[np.lexsort((inside, -scores[inside]))[:5]])
