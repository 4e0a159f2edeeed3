import numpy as np
import pytest

from colloquy.operators import pruned
from colloquy.operators.vectors import pair_similarity

SCHEMA = "id long, speaker_id long, centroid array<double>"


def voices(n_speakers, n, spread, seed, dims=12, styles=8):
    rnd = np.random.default_rng(seed)
    rows = []
    for s in range(n_speakers):
        middles = rnd.normal(0, 1, (styles, dims))
        for k in range(n):
            v = middles[k % styles] + rnd.normal(0, spread, dims)
            rows.append((s * 10_000 + k, s, (v / np.linalg.norm(v) * (1 + 0.1 * (k % 3 == 0))).tolist()))
    return rows


@pytest.mark.parametrize("spread,most", [(0.05, 0.35), (1.5, 1.0)])
def test_extremes_equal_all_products(spark, monkeypatch, spread, most):
    monkeypatch.setattr(pruned, "TILE", 40)
    monkeypatch.setattr(pruned, "CHUNK", 100)
    rows = voices(7, 150, spread, 3) + [(10**6, 3, [0.0] * 12), (10**6 + 1, 90, [1.0] + [0.0] * 11), (10**6 + 2, None, [1.0] * 12), (5, 0, rows_of_one(spread))]
    df = spark.createDataFrame(rows, SCHEMA)
    found, share = pruned.pair_extremes(df)
    want = {(r.a, r.b): r for r in pair_similarity(df).filter("a < b").collect()}
    got = {(r.a, r.b): r for r in found.collect()}
    assert got.keys() == want.keys() and share <= most
    assert all(got[k].low == pytest.approx(w.low, abs=1e-12) and got[k].high == pytest.approx(w.high, abs=1e-12) for k, w in want.items())
    both = {(r.a, r.b): r for r in pruned.between_similarity(df).collect()}
    assert all(both[k].pairs == w.pairs and both[k].mean == pytest.approx(w.mean, abs=1e-12) for k, w in want.items())


def rows_of_one(spread):
    return [0.3 * spread] * 12


def test_bounds_hold():
    rnd = np.random.default_rng(2)
    for spread in (0.01, 0.3, 2.0):
        x, y = (rnd.normal(0, 1, 6) + rnd.normal(0, spread, (30, 6)) for _ in range(2))
        heads = []
        for v in (x, y):
            length = np.linalg.norm(v, axis=1)
            unit = v / length[:, None]
            middle = unit.mean(0) / np.linalg.norm(unit.mean(0))
            heads.append({"middle": middle[None], "angle": np.array([np.arccos(np.clip(unit @ middle, -1, 1)).max()]), "least": length.min()[None], "most": length.max()[None]})
        low, high = pruned.bounds(*heads)
        assert low[0, 0] <= (x @ y.T).min() and (x @ y.T).max() <= high[0, 0]
