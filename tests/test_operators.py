import functools
import itertools
import math
import os
import random
import statistics

import pytest
from pyspark.sql import functions as F

from colloquy import catalogue
from colloquy.functions import steps, text
from colloquy.operators import lifecycle, recency, relational, signal, transcripts, vectors
from colloquy.plans import evaluation
from colloquy.streaming import folds

SF = "/root/testdata/sf0.001"


def one(spark, expression, *values):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], "x string").select(expression(F.col("x"))).collect()]


def test_clock_marks(spark):
    df = spark.createDataFrame([(x,) for x in (0.0, 65.0, 3600.0, 3661.0, -10.0, 9.9)], "x double")
    assert [r[0] for r in df.select(transcripts.clock(F.col("x"))).collect()] == ["00:00", "01:05", "1:00:00", "1:01:01", "00:00", "00:09"]
    assert [r[0] for r in df.filter("x >= 0").select(transcripts.mmss(F.col("x"))).collect()] == ["00:00", "01:05", "60:00", "61:01", "00:09"]


def test_hints(spark):
    silent = [None, "", "SKIP", "skip.", "`SKIP`", "*skip*", "SKIP because", "Ok.", "—"]
    assert one(spark, text.parse_hint, *silent) == [None] * len(silent)
    spoken = {"Подсказка: уточните срок": "Уточните срок", "We should not skip this": "We should not skip this", "**Ask about the budget**": "Ask about the budget", "SKIP, but ask them about the deadline": "SKIP, but ask them about the deadline"}
    assert one(spark, text.parse_hint, *spoken) == list(spoken.values())


def test_sse_and_resets(spark):
    lines = [
        'data: {"choices":[{"delta":{"content":"Hi"},"finish_reason":"stop"}]}', "data: [DONE]", ": ping", 'data: {"choices":[]}', 'data: {"choices":[{"delta":{"content":"Hi","reasoning":""}}]}',
        'data: {"choices":[{"delta":{"content":"a","reasoning":"b"}}]}', 'data: {"choices":[{"delta":{"content":null,"reasoning":"b"}}]}', 'data:{"choices":[{"delta":{"content":"x"}}]}', None,
    ]
    want = [("text", "Hi", "stop"), ("", "", None), ("", "", None), ("", "", None), ("text", "Hi", None), ("text", "a", None), ("reasoning", "b", None), ("", "", None), ("", "", None)]
    assert [tuple(g) for g in one(spark, text.sse_parts, *lines)] == want
    assert one(spark, text.reset_seconds, "1.2s", "120ms", "2m59.56s", "7.66s", None) == pytest.approx([1.2, 0.12, 179.56, 7.66, 0])


def brute_distance(a, b):
    """Fewest edits by trying all of them, remembered."""

    @functools.cache
    def least(i, j):
        if i == len(a) or j == len(b):
            return len(a) - i + len(b) - j
        return least(i + 1, j + 1) if a[i] == b[j] else 1 + min(least(i + 1, j + 1), least(i + 1, j), least(i, j + 1))

    return least(0, 0)


def test_word_errors(spark):
    rnd = random.Random(1)
    words = ["a", "b", "ещё", "漢字", "x y", ""] + [f"w{k}" for k in range(300)]
    rows = [([rnd.choice(words[: rnd.choice([3, 6, 306])]) for _ in range(rnd.randrange(25))], [rnd.choice(words[: rnd.choice([3, 6, 306])]) for _ in range(rnd.randrange(25))]) for _ in range(60)] + [(None, ["a"])]
    got = text.word_errors(spark.createDataFrame(rows, "a array<string>, b array<string>"), "a", "b").collect()
    assert [r.errors for r in got] == [None if r.a is None else brute_distance(r.a, r.b) for r in got]
    assert {(tuple(r.a or []), tuple(r.b)) for r in got} == {(tuple(a or []), tuple(b)) for a, b in rows}


def test_grouping(spark):
    def lengths(rows):
        df = spark.createDataFrame([(1, k, s, int(a * 1e6), int(b * 1e6)) for k, (s, a, b) in enumerate(rows)], "meeting_id long, id long, speaker_id long, start_us long, end_us long")
        return [r.utterances for r in transcripts.group_utterances(df, 30_000_000).orderBy("run").collect()]

    assert lengths([(1, 0, 1), (1, 2, 3), (1, 31, 32)]) == [3]
    assert lengths([(1, 0, 1), (2, 2, 3), (1, 4, 5)]) == [1, 1, 1]
    assert lengths([(1, 0, 1), (1, 2, 3), (1, 33.5, 34)]) == [2, 1]
    assert lengths([(None, 0, 1), (None, 2, 3)]) == [2] and lengths([]) == []


def test_packing_is_lossless(spark):
    df = spark.createDataFrame([(1, k, "s", float(k), "x" * n) for k, n in enumerate([5, 40, 200, 3, 3, 90])], "meeting_id long, id long, speaker string, start_s double, text string")
    chunks = [r.body for r in transcripts.pack_lines(df, 80).orderBy("chunk").collect()]
    whole = transcripts.render(df).first().transcript
    assert "\n".join(chunks) == whole and len(chunks) > 3 and all(len(c) <= 80 or "\n" not in c for c in chunks)
    assert [r.body for r in transcripts.pack_lines(df, 0).collect()] == [whole]


def test_participants(spark):
    df = spark.createDataFrame([(1, 0.0, 0, "Ann"), (1, 1.0, 1, "Ivan"), (1, 2.0, 2, "Ivan"), (1, 3.0, 3, None)], "meeting_id long, start_s double, id long, speaker string")
    assert relational.participants(df, "speaker", ["start_s", "id"]).first().participants == "Ivan (2), Ann (1), unknown (1)"
    assert relational.segments_by_ids(df, 1, []).count() == 0


def test_matching_in_blocks(spark, monkeypatch):
    prints = spark.createDataFrame([(k, k % 3, [float(k == j) for j in range(5)]) for k in range(5)], "id long, speaker_id long, centroid array<double>")
    probes = spark.createDataFrame([(9, [0.0, 0.6, 0.8, 0.0, 0.0]), (10, [0.2, 0.2, 0.2, 0.2, 0.2])], "id long, centroid array<double>")
    want = {(9, 2, 2, 0.8, 0.8), (10, None, None, None, 0.2)}
    assert {tuple(r) for r in vectors.match_frozen(probes, prints).collect()} == want
    monkeypatch.setattr(vectors, "BLOCK_PRINTS", 2)
    monkeypatch.setattr(vectors, "BLOCK_PROBES", 1)
    monkeypatch.setattr(vectors, "BROADCAST_BYTES", 0)
    assert {tuple(r) for r in vectors.match_frozen(probes, prints).collect()} == want
    assert {tuple(r) for r in vectors.match_frozen(probes, prints.limit(0)).collect()} == {(9, None, None, None, None), (10, None, None, None, None)}


def test_dominance(spark):
    df = spark.createDataFrame([(1.0, 0.1), (0.1, 1.0), (0.5, 0.5), (0.01, 0.0), (0.0, 0.01)], "m double, s double")
    assert [r[0] for r in df.select(signal.dominance(F.col("m"), F.col("s"))).collect()] == ["mic", "system", "mixed", "mic", "system"]


def test_batch_folds_equal_the_steps(spark):
    if not os.path.isdir(SF):
        pytest.skip("the synthetic tables are not here")
    rows = folds.timed_segments(spark, SF)
    got = {r.id: r.speaker_id for r in recency.donor_chained(rows, 600_000_000).collect()}
    last, meeting, want = {}, None, {}
    for r in rows.orderBy("meeting_id", "start_us", "id").collect():
        if r.meeting_id != meeting:
            meeting, last = r.meeting_id, {}
        want[r.id] = steps.donor_step(last, r.channel, r.start_us, r.end_us, r.speaker_id, 600_000_000)
    assert got == want
    prints = sorted(folds.voice_prints(spark, SF).collect(), key=lambda r: r.id)
    libs = {k: steps.Library() for k in range(4)}
    online = {r.id: r.speaker for r in catalogue.QUERIES["voice_match_online"](spark, SF).collect()}
    assert online == {r.id: steps.match_step(libs[r.id % 4], list(r.centroid), r.id % 3 == 0, 2.5)[0] for r in prints}


def test_stream_sessions(spark, tmp_path):
    """The stream closes the batch's sessions, but for those the watermark has not passed at the end."""
    if not os.path.isdir(SF):
        pytest.skip("the synthetic tables are not here")
    (tmp_path / "in").mkdir()
    os.symlink(f"{SF}/events.parquet", tmp_path / "in" / "events.parquet")
    got = {tuple(r) for r in folds.stream_sessions(spark, str(tmp_path / "in"), "15 minutes", "10 minutes", str(tmp_path / "out"), str(tmp_path / "state")).collect()}
    # A session ends a full gap after its last mark: marks exactly a gap apart still meet, and days do not split a key.
    want = {(r.meeting_id, r.marks, r.start_us, r.end_us) for r in catalogue.QUERIES["session_windows"](spark, SF).collect()}
    assert got <= want and len(want - got) <= 2


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_against_duckdb(spark, name):
    duckdb = pytest.importorskip("duckdb")
    if not os.path.isdir(SF):
        pytest.skip("the synthetic tables are not here")
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{SF}/{f}'")
    want, got = con.sql(catalogue.SQL[name]), catalogue.QUERIES[name](spark, SF)
    assert sorted(want.columns) == sorted(got.columns)
    plain = lambda v: round(float(v), 5) if isinstance(v, float) else v
    rows = lambda data, columns: sorted(repr([plain(v) for _, v in sorted(zip(columns, r))]) for r in data)
    assert rows(want.fetchall(), want.columns) == rows([tuple(r) for r in got.collect()], got.columns)


def test_pairs_in_blocks(spark, monkeypatch):
    """Every pair of prints is counted once, whatever the blocks; prints of nobody count nowhere."""
    rnd = random.Random(3)
    rows = [(k, rnd.randrange(4), [rnd.uniform(-1, 1) for _ in range(6)]) for k in range(40)]
    df = spark.createDataFrame(rows + [(99, None, [0.0] * 6)], "id long, speaker_id long, centroid array<double>")
    sims = {}
    for (_, a, u), (_, b, v) in itertools.combinations(rows, 2):
        sims.setdefault((min(a, b), max(a, b)), []).append(sum(x * y for x, y in zip(u, v)))
    for block in (1_024, 7):
        monkeypatch.setattr(vectors, "PAIR_BLOCK", block)
        got = {(r.a, r.b): r for r in vectors.pair_similarity(df).collect()}
        assert set(got) == set(sims)
        for key, r in got.items():
            assert r.pairs == len(sims[key]) and (r.low, r.mean, r.high) == pytest.approx((min(sims[key]), sum(sims[key]) / len(sims[key]), max(sims[key])))


def test_values_at_ranks(spark, monkeypatch):
    rnd = random.Random(5)
    rows = [(k, rnd.choice([rnd.gauss(0, 1), float(round(rnd.gauss(0, 1))), 5.0])) for k in ("a", "b", None) for _ in range({"a": 200, "b": 1, None: 7}[k])] + [("c", 2.0)] * 9 + [("a", None)]
    for ranges in (1_024, 3):
        monkeypatch.setattr(evaluation, "RANGES", ranges)
        got = {r.key: r for r in evaluation.percentiles(spark.createDataFrame(rows, "key string, x double"), "key", "x").collect()}
        for key in ("a", "b", "c", None):
            xs = sorted(x for k, x in rows if k == key and x is not None)
            assert got[key].n == len(xs) and got[key].p50 == pytest.approx(statistics.median(xs), abs=1e-6) and got[key].p95 == pytest.approx(xs[math.ceil(0.95 * len(xs)) - 1], abs=1e-6)


def test_recent_speakers_at_the_borders(spark):
    rows = [(1, 1, 0, 0, 10), (2, 1, 0, 110, 120), (3, 1, 1, 111, 112), (4, 1, None, 212, 300), (5, 2, 0, 0, 10), (6, 1, 0, 120, 120), (7, 1, 1, 10, 10)]
    got = {r.id: r.recent for r in recency.recent_speakers(spark.createDataFrame(rows, "id long, meeting_id long, speaker_id long, start_us long, end_us long"), 100).collect()}
    want = {i: len({w for _, m2, w, _, e in rows if m2 == m and w is not None and 0 <= s - e <= 100}) for i, m, _, s, _ in rows}
    assert got == want


def test_split_by_dominance(spark):
    """Against a plain reading of the rules, window by window; short runs, mixed windows, tails and one-channel spans."""
    rnd = random.Random(7)
    spans, frames = [], []
    for k in range(30):
        start = k * 10_000
        spans.append((1, k, start, start + rnd.randrange(300, 8_000)))
        for _ in range(rnd.randrange(0, 60)):
            frames.append((1, rnd.randrange(start, start + 9_000), rnd.choice(["mic", "system"] if k % 5 else ["mic"]), rnd.choice([0.0, 1.0, 5.0])))

    def whole(start, stop):
        n = max((stop - start) // 500, 1)
        slots = [[] for _ in range(n)]
        for _, at, channel, energy in frames:
            if start <= at <= stop:
                slots[min((at - start) // 500, n - 1)].append((channel, energy))
        labels = []
        for s in slots:
            mic, system = (math.sqrt(sum(e * e for e in x) / len(x)) if (x := [e for c, e in s if c == which]) else 0.0 for which in ("mic", "system"))
            labels.append("mic" if mic > 0 and system <= 0 else "system" if system > 0 and mic <= 0 else "mic" if mic > 2 * system else "system" if system > 2 * mic else "mixed")
        known = [x for x in labels if x != "mixed"]
        for i in range(n):
            if labels[i] == "mixed":
                labels[i] = labels[i - 1] if i else known[0] if known else "mixed"
        runs = steps.absorb_short_runs([(label, len(list(g))) for label, g in itertools.groupby(labels)], 2)
        seen = list(itertools.accumulate(r[1] for r in runs))
        return [(label, start + (e - c) * 500, stop if e == n else start + e * 500) for (label, c), e in zip(runs, seen)]

    got = signal.split_by_dominance(spark.createDataFrame(spans, "meeting_id long, span long, start_us long, end_us long"), spark.createDataFrame(frames, "meeting_id long, at_us long, channel string, energy double"), 500, 1_000)
    found = {}
    for r in sorted(got.collect(), key=lambda r: (r.span, r.part)):
        found.setdefault(r.span, []).append((r.label, r.start_us, r.end_us))
    assert found == {k: whole(a, b) for _, k, a, b in spans}


def test_blocks_carry_over(spark):
    rows = [(1, 0, [1.0, 2.0]), (1, 1, []), (1, 2, [3.0, 4.0, 5.0, 6.0, 7.0]), (2, 0, [9.0])]
    got = sorted((r.k, r.block, r.x, r.full) for r in signal.reblock(spark.createDataFrame(rows, "k long, seq long, x array<double>"), "k", "seq", "x", 3).collect())
    assert got == [(1, 0, [1.0, 2.0, 3.0], True), (1, 1, [4.0, 5.0, 6.0], True), (1, 2, [7.0], False), (2, 0, [9.0], False)]


def test_attribution_and_simulation_equal_the_steps(spark):
    if not os.path.isdir(SF):
        pytest.skip("the synthetic tables are not here")
    rows = folds.timed_segments(spark, SF).withColumn("speech_us", F.when(F.col("id") % 3 == 0, 300_000).otherwise(2_500_000)).join(folds.voice_prints(spark, SF).select("id", "centroid"), "id", "left")
    live, meeting, want = None, None, {}
    for r in rows.orderBy("meeting_id", "start_us", "id").collect():
        if r.meeting_id != meeting:
            meeting, live = r.meeting_id, steps.Live()
        want[r.id] = steps.attribute_step(live, r.centroid and list(r.centroid), r.channel, r.start_us, r.end_us, r.speech_us)[0]
    assert {r.id: r.speaker for r in folds.attribute(rows).collect()} == want
    merge = spark.createDataFrame([(0, 1_704_067_200_000_000 + 43_200_000_000, 1, 0)], "meeting_id long, start_us long, source long, target long")
    live, done, after = steps.Live(), False, {}
    for r in rows.filter("meeting_id = 0").orderBy("start_us", "id").collect():
        if not done and r.start_us >= 1_704_067_200_000_000 + 43_200_000_000:
            steps.merge_live(live, 1, 0, "", [])
            done = True
        after[r.id] = steps.attribute_step(live, r.centroid and list(r.centroid), r.channel, r.start_us, r.end_us, r.speech_us)[0]
    merged = {r.id: r.speaker for r in folds.attribute(rows, merge).collect()}
    assert {i: merged[i] for i in after} == after and done and len(merged) == len(want)
    prints = [tuple(r) for r in folds.voice_prints(spark, SF).limit(60).collect()]
    got = {r.threshold: (r.profiles, r.splits, r.merges) for r in folds.threshold_simulation(spark.createDataFrame(prints, "id long, speaker_id long, centroid array<double>"), [0.2, 0.5]).collect()}
    by = {}
    for i, s, v in sorted(prints):
        by.setdefault(s, []).append(v)
    for threshold in (0.2, 0.5):
        lib, held = steps.Library(), {s: set() for s in by}
        for turn in range(max(map(len, by.values()))):
            for s in sorted(by):
                if turn < len(by[s]):
                    held[s].add(steps.match_step(lib, list(by[s][turn]), False, 0.0, rules=steps.MatchRules(threshold=threshold))[0])
        merges = sum(bool(held[a] & held[b]) for a, b in itertools.combinations(held, 2))
        assert got[threshold] == (len(set().union(*held.values())), sum(len(h) > 1 for h in held.values()), merges)


def test_files_take_prints_in_order(spark):
    samples = spark.createDataFrame([(1, 7, "gone"), (2, 7, "a"), (3, 7, "b"), (4, 8, "c")], "id long, speaker_id long, path string")
    prints = spark.createDataFrame([(10, 7, "old"), (11, 7, None), (12, 9, None)], "id long, speaker_id long, audio_path string")
    there = spark.createDataFrame([("a",), ("b",), ("c",)], "path string")
    assert [(r.speaker_id, r.sample_id, r.print_id, r.path) for r in lifecycle.pair_files(samples, prints, there).collect()] == [(7, 2, 11, "a")]
    files = spark.createDataFrame([("old", b"x")], "path string, content binary")
    assert lifecycle.owned_file(prints, files, 7, 10).count() == 1 and lifecycle.owned_file(prints, files, 8, 10).count() == 0 and lifecycle.owned_file(prints, files, 7, 11).count() == 0
