import random

import numpy as np
import pytest

from colloquy.plans import evaluation


def test_slopes_from_sums(spark):
    """Against a fit of the later half, for odd and even numbers of samples, ties at the middle and null values."""
    rnd, rows, want = random.Random(1), [], {}
    for k in range(30):
        n = rnd.choice([1, 2, 3, 4, 5, 8, 9, 40])
        points = [(t / 7, rnd.random() * 50 + t / 900) for t in rnd.sample(range(100_000), n)]
        late = sorted(points)[n // 2 :]
        rows += [(k, t, v) for t, v in points]
        want[k] = (float(np.polyfit(*zip(*late), 1)[0] * 3600) if len(late) >= 3 else 0.0, len(late))
    rows += [(None, float(t), float(t)) for t in range(6)] + [(90, 1.0, float(v)) for v in range(10)] + [(91, float(t), None if t == 8 else 2.0 * t) for t in range(10)] + [(91, None, 5.0)]
    want |= {None: (3600.0, 3), 90: (0.0, 5), 91: (7200.0, 5)}
    got = {r.k: r for r in evaluation.late_slope(spark.createDataFrame(rows, "k long, t double, v double"), "k", "t", "v").collect()}
    assert got.keys() == want.keys()
    assert all(got[k].n == n and got[k].per_hour == pytest.approx(slope, abs=2e-4) for k, (slope, n) in want.items())
