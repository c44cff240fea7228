"""Hard negatives against plain whole-number scoring of all rows."""

import math
import random

import pytest

from tallybook.llm import op12_hard_negatives as op12

SCHEMA = "vec_id long, embedding array<float>, label int, score string, dim string"


def table(seed=1):
    r = random.Random(seed)
    centres = [[r.gauss(0, 1) for _ in range(12)] for _ in range(5)]
    rows = []
    for i in range(600):
        c = r.randrange(5)
        v = [x + r.gauss(0, 0.9) for x in centres[c]]
        k = r.choice([1, 1, 1, 0.1, 30])
        rows.append((i, [k * x for x in v], c, "clash", "clash"))
    same = rows[7][1]
    rows += [(1000 + i, same, i % 3, None, None) for i in range(120)]
    rows += [(3000, None, 1, None, None), (3050, [1.0, None] + [0.0] * 10, 1, None, None), (3100, [math.nan] + [0.0] * 11, 1, None, None), (3150, [math.inf] * 12, 2, None, None)]
    rows += [(3200, [0.0] * 12, 1, None, None), (3250, [3e38] * 12, 1, None, None), (3251, [2e38] * 12, 1, None, None), (3252, [1e38] * 12, 3, None, None), (3300, rows[3][1], None, None, None), (None, rows[3][1], 1, None, None)]
    rows += [(3350, [1.0, 2.0, 3.0], 1, None, None), (3351, [2.0, 2.0, 3.0], 1, None, None), (3352, [1.0, 1.0, 2.0], 2, None, None), (3400, [], 1, None, None), (3401, [], 1, None, None)]
    return rows


def brute(rows):
    kept = []
    for i, v, c, *_ in rows:
        if i is None or c is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        kept.append((i, [math.floor(256 * float(f"{x}")) for x in v], (c + 1) % 10 if i % 7 == 0 else c))
    out = set()
    for a, q, c in kept:
        if a % 50:
            continue
        scored = sorted((-min(max(sum(x * y for x, y in zip(q, p)), -(2**63)), 2**63 - 1), i, d) for i, p, d in kept if i != a and len(p) == len(q))
        for s, i, d in [x for x in scored if x[2] == c][:5]:
            fit = [x for x in scored if x[2] != c and -50 * s <= -100 * x[0] <= -95 * s][:3]
            out |= {(a, i, k + 1, x[1], -s, -x[0]) for k, x in enumerate(fit)}
    return out


@pytest.mark.parametrize("sizes", [{}, {"block": 16, "chunk": 3, "cell_blocks": 2, "cell_chunks": 2}])
def test_hard_negatives(spark, sizes):
    import numpy as np

    rows = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], *rest) for i, v, *rest in table()]
    want = brute(rows)
    assert len(want) > 100
    out = op12.hard_negatives(spark.createDataFrame(rows, SCHEMA).repartition(3), **sizes)
    got = [tuple(r) for r in out.collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_bounds_hold_all_scores():
    import numpy as np

    r = np.random.default_rng(3)
    refs = r.normal(size=(4, 8))
    refs /= np.linalg.norm(refs, axis=1)[:, None]
    make = lambda n: op12.Pack(op12.Pack.made(list(range(n)), [v.astype("<i4").tobytes() for v in np.floor(r.normal(size=(n, 8)) * r.choice([1, 50, 4000], (n, 1)))], 8, refs), 8)
    one, other = make(40), make(70)
    exact = one.q @ other.q.T
    up, down = op12.row_bounds(one, other)
    top, bottom = op12.pack_bounds(one, other)
    assert (exact <= up).all() and (exact >= down).all() and exact.max() <= top and exact.min() >= bottom
    assert (up - down < 1.99 * one.norms[:, None] * other.norms).mean() > 0.5


def test_no_rows(spark):
    assert op12.hard_negatives(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0
    assert op12.hard_negatives(spark.createDataFrame([(50, None, 1), (100, [1.0], None)], "vec_id long, embedding array<float>, label int")).count() == 0
