import math
import random

import numpy as np
import pytest

from ledgerline.llm import bond_negatives as bond

SCHEMA = "vec_id long, embedding array<float>, label int"
COLUMNS = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def vectors(n, dims, labels, seed):
    rng = random.Random(seed)
    return [(i, [rng.gauss(0.05, 0.3) for _ in range(dims)], rng.randrange(labels)) for i in range(n)]


def expected(rows, every=50):
    found = {}
    for vec_id, vector, label in rows:
        if vec_id is None or label is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        cells = [math.floor(256 * float(np.float32(x))) for x in vector]
        found[vec_id] = min(found.get(vec_id, (label, cells)), (label, cells))
    found = {i: ((label + 1) % 10 if i % 7 == 0 else label, cells) for i, (label, cells) in found.items()}
    out = []
    for anchor, (label, cells) in found.items():
        if anchor % every:
            continue
        scored = sorted((-sum(a * b for a, b in zip(cells, other, strict=False)), i, kind)
                        for i, (kind, other) in found.items() if i != anchor)
        for score, positive, _ in [s for s in scored if s[2] == label][:5]:
            inside = [(-s, i) for s, i, kind in scored if kind != label and 50 * -score <= 100 * -s <= 95 * -score][:3]
            out += [(anchor, positive, rank, i, -score, s) for rank, (s, i) in enumerate(inside, 1)]
    return sorted(out)


def mined(spark, rows, every=50, schema=SCHEMA):
    found = bond.hard_negatives(spark.createDataFrame(rows, schema), every)
    return sorted(tuple(r[c] for c in COLUMNS) for r in found.collect())


def test_all_blocks_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(bond, "BLOCK_ROWS", 64)
    monkeypatch.setattr(bond, "BLOCK_ANCHORS", 3)
    rows = vectors(400, 24, 4, 1)
    want = expected(rows, 10)
    assert len(want) > 300 and mined(spark, rows, 10) == want


def test_nulls_ties_short_vectors_and_repeated_rows(spark):
    same = [0.5, 0.25, -0.5, 0.125]
    rows = [(i, same, i % 3) for i in range(60)]  # equal scores: ties by id
    rows += [(100 + i, [x * (0.4 + i / 50) for x in same], 5) for i in range(30)]
    rows += [(200, None, 1), (201, [0.1, None, 0.2, 0.3], 1), (202, [float("nan")] * 4, 1), (203, [float("inf")] * 4, 2),
             (204, same, None), (None, same, 1), (205, [0.9], 1), (206, [], 2), (250, same, 0), (250, same, 0),
             (300, [-x for x in same], 3), (350, [0.0] * 4, 4), (351, [0.0] * 4, 5)]
    assert mined(spark, rows) == expected(rows)


def test_extra_columns_and_empty_tables(spark):
    rows = vectors(60, 8, 3, 2)
    wide = [(*r, "clash", "clash", "clash") for r in rows]
    assert mined(spark, wide, 10, SCHEMA + ", cells string, anchor string, block string") == expected(rows, 10)
    assert mined(spark, [], 10) == []
    assert mined(spark, rows[1:9], 10) == []  # no anchor


def test_scores_beyond_doubles_stay_exact(spark):
    rows = [(i, [float(2 ** 20 + i), 1.0 / 256 * (i + 1)], i % 2) for i in range(12)]
    assert mined(spark, rows, 6) == expected(rows, 6)


def test_too_large_components_are_an_error(spark):
    with pytest.raises(Exception, match="too large"):
        mined(spark, [(0, [1e20], 1), (1, [1e20], 2)])


def test_scan_lets_go_of_rows_before_the_last_dimension():
    rng = np.random.default_rng(3)
    cells = rng.integers(-20, 20, (40, 500))
    cells[0] = rng.integers(-900, 900, 500)
    block = bond.Block(np.arange(500).tobytes(), np.zeros(500, np.int64).tobytes(), [c.tobytes() for c in cells])
    anchor = rng.integers(-20, 20, 40)
    anchor[0] = 800
    seen = []

    def keep(lower, upper):
        assert (lower <= upper).all()
        seen.append(len(lower))
        return bond.best(5)(lower, upper)

    rows, scores = bond.scan(anchor, block, np.arange(500), keep)
    want = np.sort(anchor @ cells)[-5:]
    assert seen[0] == 500 and seen[-1] < 100
    assert sorted(scores)[-5:] == want.tolist()
    assert (scores == (anchor @ cells)[rows]).all()


@pytest.mark.parametrize("score", [0, 1, 7, 199, 200, 65536])
def test_windows_are_whole_scores_within_the_bounds(score):
    least, most = bond.window_of(score)
    assert [s for s in range(score + 2) if 50 * score <= 100 * s <= 95 * score] == list(range(least, most + 1))
