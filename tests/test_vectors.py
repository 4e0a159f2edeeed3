import tracemalloc

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from colloquy.operators import vectors

SF = "/root/testdata/sf0.001"
SCHEMA = "id long, speaker_id long, centroid array<float>"


def prints_of(n, seed, dims=8):
    """Random unit vectors as floats; every fifth is a copy of one voice, every seventh of another."""
    x = np.random.default_rng(seed).normal(0, 1, (n, dims))
    x[::5], x[::7] = x[0] + 1, x[1] - 1
    x = (x / np.linalg.norm(x, axis=1)[:, None]).astype(np.float32)
    return [(k, k % 4, v.tolist()) for k, v in enumerate(x)]


def best_of_all(rows, threshold, favoured, bonus):
    x = np.array([r[2] for r in rows], np.float32).astype(float)
    want = []
    for k in range(len(rows)):
        sims = np.array([-np.inf if j == k else float(np.einsum("j,j->", x[k], x[j])) for j in range(len(rows))])
        able = [j for j in range(len(rows)) if sims[j] >= threshold - (bonus if rows[j][1] == favoured else 0)]
        best = min((j for j in able if sims[j] >= max(sims[able]) - 1e-12), default=None)
        want.append((k, best, None if best is None else rows[best][1], None if best is None else round(sims[best], 9), round(sims.max(), 9)))
    return want


def test_frozen_match_holds_small_squares():
    """a task's similarities stay in squares, however many probes and prints meet in it."""
    rnd = np.random.default_rng(1)
    x, y = rnd.normal(0, 1, (3_000, 4)), rnd.normal(0, 1, (5_000, 4))
    tracemalloc.start()
    found = vectors._answers(np.arange(3_000), x, np.arange(5_000), np.arange(5_000) % 7, y, (0.35, 3, 0.1, True))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    sims = x @ y.T
    sims[np.arange(3_000), np.arange(3_000)] = -np.inf
    assert np.allclose(found.column("best_sim").to_numpy(), sims.max(1)) and (found.column("print").to_numpy() == sims.argmax(1)).all()
    assert most < 60e6  # all similarities at once take 120 MB, and their copies as much again


@pytest.mark.parametrize("broadcast", [1 << 20, 0])
def test_copies_give_their_first(spark, monkeypatch, broadcast):
    """equal prints tie wherever their blocks and squares stand: the least id wins."""
    monkeypatch.setattr(vectors, "BROADCAST_BYTES", broadcast)
    monkeypatch.setattr(vectors, "BLOCK_PRINTS", 20)
    monkeypatch.setattr(vectors, "BLOCK_PROBES", 30)
    monkeypatch.setattr(vectors, "PRODUCT", 13)
    rows = prints_of(120, 4)
    df = spark.createDataFrame(rows, SCHEMA)
    got = vectors.match_frozen(df, df, 0.6, 3, 0.1, others_only=True).select("probe", "print", "speaker_id", F.round("sim", 9), F.round("best_sim", 9))
    assert sorted(map(tuple, got.collect())) == best_of_all(rows, 0.6, 3, 0.1)


def test_parts_do_not_grow_with_pairs():
    """F1, F3 to F6: what is sent of a vector stays the same from 0.1 to 6 GB of prints."""
    assert {vectors.parts(n, 64, vectors.PAIR_BLOCK) for n in (51_282, 102_564, 615_384)} == {vectors.PARTS}
    assert vectors.parts(10**8, 64, 1) * vectors.PART_BYTES >= 10**8 * 512 and vectors.parts(0, 0, 1_024) == 1


@pytest.mark.parametrize("broadcast", [1 << 20, 0])
@pytest.mark.parametrize("query", ["assignment_errors", "threshold_sweep"])
def test_columns_of_blocks_stay(spark, monkeypatch, query, broadcast):
    """what is made of a match in blocks needs some of its columns only; the blocks keep all of theirs."""
    monkeypatch.setattr(vectors, "BROADCAST_BYTES", broadcast)
    monkeypatch.setattr(vectors, "BLOCK_PRINTS", 100)
    want = duckdb.sql(vectors.SQL[query].replace("FROM embeddings", f"FROM '{SF}/embeddings.parquet'"))
    assert sorted(map(tuple, vectors.QUERIES[query](spark, SF).collect())) == sorted(want.fetchall())


@pytest.mark.parametrize("product,gathered", [(7, 5), (1_024, 1 << 20)])
def test_pairs_travel_by_parts(spark, monkeypatch, product, gathered):
    """prints are sent once a part, of which there are few, and squares and gathering change no figure."""
    monkeypatch.setattr(vectors, "PRODUCT", product)
    monkeypatch.setattr(vectors, "GATHERED", gathered)
    monkeypatch.setattr(vectors, "PAIR_BLOCK", 10)
    monkeypatch.setattr(vectors, "PARTS", 3)
    rows = prints_of(90, 2)
    held = spark.createDataFrame([*rows, (999, None, [1.0] * 8)], SCHEMA)
    x, who = np.array([r[2] for r in rows], np.float32).astype(float), np.array([r[1] for r in rows])
    i, j = np.triu_indices(len(x), 1)
    sims, pairs = (x[i] * x[j]).sum(1), np.sort(np.stack([who[i], who[j]]), axis=0)
    want = {(a, b): sims[(pairs[0] == a) & (pairs[1] == b)] for a in range(4) for b in range(a, 4)}
    for found, keys in ((vectors.pair_similarity(held), want), (vectors.inside_similarity(held), [(a, a) for a in range(4)])):
        got = {(r.a, r.b): r for r in found.collect()}
        assert set(got) == set(keys)
        assert all(r.pairs == len(want[k]) and (r.low, r.mean, r.high) == pytest.approx((want[k].min(), want[k].mean(), want[k].max())) for k, r in got.items())
    sent = vectors._tiles(vectors._numbers(held.filter("speaker_id IS NOT NULL"), "id", "speaker_id"), F.lit(vectors.parts(90, 8, vectors.PAIR_BLOCK)).cast("long"))
    assert sent.count() == 3 * 90 and dict(sent.dtypes)["centroid"] == "array<float>"
