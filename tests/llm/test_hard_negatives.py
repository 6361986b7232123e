import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from strataflow.llm import hard_negatives
from strataflow.llm.hard_negatives import hilbert_keys

SCHEMA = "vec_id long, embedding array<float>, label int, rank int, score string"


def brute(rows):
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of plain loops."""
    kept = []
    for i, v, label in rows:
        if i is None or label is None or v is None or any(c is None or not math.isfinite(c) for c in v):
            continue
        kept.append((i, [math.floor(256 * float(np.float32(c))) for c in v], (label + 1) % 10 if i % 7 == 0 else label))
    out = []
    for a, (i, x, label) in enumerate(kept):
        if i % 100:
            continue
        scored = [(-sum(p * q for p, q in zip(x, y)), j, m) for b, (j, y, m) in enumerate(kept) if b != a]
        scored.sort()
        for s, j, m in [r for r in scored if r[2] == label][:5]:
            fits = [r for r in scored if r[2] != label and 30 * -s <= 100 * -r[0] <= 90 * -s][:10]
            out += [(i, j, n, r[1], -s, -r[0]) for n, r in enumerate(fits, 1)]
    return sorted(out)


def given(spark, rows):
    return spark.createDataFrame([(i, v, label, 0, "x") for i, v, label in rows], SCHEMA)


def found(df):
    return sorted(tuple(r[c] for c in ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")) for r in df.collect())


@pytest.mark.parametrize("dims, bits", [(2, 4), (3, 3), (5, 2)])
def test_the_curve_visits_every_cell_by_single_steps(dims, bits):
    cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), -1).reshape(-1, dims)
    keys = hilbert_keys(cells, bits)
    assert len(set(keys)) == len(cells)
    path = cells[sorted(range(len(cells)), key=keys.__getitem__)]
    assert (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


def clustered(n, dims, seed, hot=0.0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 1, (12, dims))
    x = centres[rng.integers(0, 12, n)] + rng.normal(0, 0.25, (n, dims))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[rng.random(n) < hot] = x[0]
    return [(k, v.astype(np.float32).tolist(), int(m)) for k, (v, m) in enumerate(zip(x, rng.integers(0, 10, n)))]


def test_equals_brute_force_with_ties_and_small_blocks(spark, monkeypatch):
    rows = clustered(1500, 8, 1, hot=0.3)
    want = brute(rows)
    assert len(want) > 300
    assert found(hard_negatives.hard_negatives(given(spark, rows))) == want
    for name, value in (("BOX", 2), ("GROUP", 4), ("LANE", 9)):
        monkeypatch.setattr(hard_negatives, name, value)
    monkeypatch.setattr(hard_negatives.candidate_blocks, "__defaults__", (16,))
    assert found(hard_negatives.hard_negatives(given(spark, rows))) == want


def test_zone_maps_spare_blocks_of_other_clusters(spark, monkeypatch):
    """Only blocks whose bounds reach a window are wanted, and none that holds a result is left out."""
    rows = [(i, v, label % 2) for i, v, label in clustered(4000, 6, 2)]
    valid = hard_negatives._valid(given(spark, rows))
    layout = hard_negatives.Layout(hard_negatives._spread(valid))
    blocks = hard_negatives.candidate_blocks(valid, layout, 64)
    anchors = hard_negatives.anchors_of(blocks, layout)
    assert anchors.count() == 40
    monkeypatch.setattr(hard_negatives, "BOX", 1)
    own = anchors.withColumns({"least": F.array("reach"), "most": F.array(F.lit(hard_negatives.EXACT))})
    boxes = hard_negatives._boxes(own, layout, 1, 40)
    wanted = hard_negatives.wanted_blocks(boxes, blocks, layout).count()
    assert wanted < 0.5 * boxes.select("grp").distinct().count() * blocks.count()


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    v = [0.5, 0.25, -0.5]
    rows = [
        (0, v, 1),
        (100, v, 1),
        (100, v, 1),  # a repeated row
        (100, [0.5, 0.25, 0.0], 1),
        (200, [-0.5, -0.25, 0.5], 1),  # positives with negative scores only
        (300, [], 4),
        (400, None, 1),
        (500, v, None),
        (None, v, 1),
        (1, [nan, 0.1, 0.1], 2),
        (2, [inf, 0.1, 0.1], 2),
        (3, [None, 0.1, 0.1], 2),
        (4, [0.25], 2),  # ends in zeros
        (5, [0.4, 0.0, 0.0], 2),
        (7, [0.3, 0.1, 0.0], 1),  # counts as label 2
        (8, [0.3, 0.1, 0.0], 2),
        (9, [0.3, 0.1, 0.0], 3),
        (10, [0.3, 0.1, 0.0], 3),
    ]
    want = brute(rows)
    assert {r[0] for r in want} == {0, 100}
    assert found(hard_negatives.hard_negatives(given(spark, rows))) == want
    assert hard_negatives.hard_negatives(given(spark, [])).count() == 0
    assert hard_negatives.hard_negatives(given(spark, [(1, [], 1), (100, [], 1)])).count() == 0


def test_scores_beyond_exact_numbers_fail(spark):
    with pytest.raises(ValueError):
        hard_negatives.hard_negatives(given(spark, [(0, [1e9], 1)]))
