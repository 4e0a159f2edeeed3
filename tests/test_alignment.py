import random

from colloquy.functions import steps
from colloquy.operators import alignment


def test_equals_the_live_aligner(spark):
    rnd, rows, want, silent = random.Random(7), [], {}, 0
    for stream in range(8):
        live, out, lag = steps.Aligner(60), [], rnd.random()
        for seq in range(rnd.choice([1, 5, 120])):
            channel = rnd.choice(["mic", "system"]) if rnd.random() < 0.4 else ["mic", "system"][int(lag < 0.5) ^ (seq // 17 % 2)]
            x = [rnd.uniform(-0.9, 0.9) for _ in range(rnd.choice([0, 1, 7, 40, 300]))]
            rows.append((stream, seq, channel, x if x or rnd.random() < 0.5 else None))
            before = sum(live.debt.values())
            out += live.feed(channel, x)
            silent += sum(live.debt.values()) < before
        want[stream] = out + live.flush()
    rows.append((0, 1000, "other", [0.5] * 10))
    df = spark.createDataFrame(rows, "stream long, seq long, channel string, samples array<double>").repartition(5)
    for block in (50, 10_000):
        got = {s: [] for s in want}
        for r in sorted(alignment.align_samples(df, 60, block).collect()):
            assert len(got[r.stream]) == r.block * block
            got[r.stream] += r.samples
        assert got == want and silent > 20


def test_empty(spark):
    assert alignment.align_samples(spark.createDataFrame([(1, 0, "mic", [])], "stream long, seq long, channel string, samples array<double>"), 5).count() == 0
