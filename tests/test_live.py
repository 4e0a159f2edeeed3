"""The live streams against plain loops, in any portions, and across a crash."""

import os
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from colloquy.functions import steps
from colloquy.sources.store import Store
from colloquy.streaming import folds, speech, stateful


@pytest.fixture(autouse=True)
def rocksdb(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def files(df, folder, parts):
    """``df`` as files that a stream takes one after the other: ``parts`` lists a filter for each."""
    os.makedirs(folder, exist_ok=True)
    for k, part in enumerate(parts):
        df.filter(part).coalesce(1).write.parquet(f"{folder}/p{k}")
        os.utime(f"{folder}/p{k}", (1_700_000_000 + 60 * k,) * 2)
        for name in os.listdir(f"{folder}/p{k}"):
            os.utime(f"{folder}/p{k}/{name}", (1_700_000_000 + 60 * k,) * 2)
    return df.sparkSession.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/p*")


def recording(seed, spans, total):
    rnd = np.random.default_rng(seed)
    x = rnd.normal(0, 0.001, total).astype(np.float32)
    for a, b in spans:
        x[a:b] += rnd.normal(0, 0.2, b - a).astype(np.float32)
    return x


def plain_segments(x):
    """One pass over the whole recording, window by window, with every sample at hand."""
    out, begin, quiet, triggered, done = [], None, None, False, 0
    for done in range(512, len(x) + 1, 512):
        if np.sqrt(np.mean(x[done - 512 : done].astype(float) ** 2)) >= 0.02:
            quiet = None
            if not triggered:
                triggered, begin = True, max(0, done - 2400 - 512)
        elif triggered:
            quiet = quiet or done
            if done - quiet >= 4800:
                out.append((begin, quiet + 2400 - 512))
                begin, quiet, triggered = None, None, False
        if begin is not None and done - begin >= 240_000:
            out.append((begin, done))
            begin = done
    if begin is not None:
        out.append((begin, done))
    return [(a, b) for a, b in out if b - a >= 4000]


SPANS = [(900, 40_000), (43_000, 60_000), (90_000, 91_000), (130_000, 640_000), (700_000, 702_000), (800_000, 1_050_000)]


def test_segmenter_in_any_portions():
    for seed, total in ((1, 1_050_000), (2, 1_100_300), (3, 100_000)):
        x = recording(seed, [s for s in SPANS if s[1] <= total], total)
        want = plain_segments(x)
        for size in (160, 1_600, 50_000, 10**7):
            rnd, now, found, at, most = random.Random(size), steps.Segmenter(), [], 0, 0
            while at < len(x):
                n = rnd.randint(1, 2 * size)
                found += now.feed(x[at : at + n], speech.loud)
                most, at = max(most, len(now.buffer)), at + n
            found += now.flush()
            assert [(a, b) for a, b, _ in found] == want and all((s == x[a:b]).all() for a, b, s in found)
            assert size > 5_000 or most <= 240_000 + 2 * 16_000
    assert any(b - a > 239_000 for a, b in plain_segments(recording(1, SPANS, 1_050_000)))


def test_batch_form_equals_the_loop(spark):
    rows, want = [], set()
    for k in range(6):
        rnd = random.Random(k)
        spans = sorted((a, a + rnd.randint(1_000, 300_000)) for a in (rnd.randrange(1_300_000) for _ in range(rnd.randint(0, 9))))
        x = recording(k, [(a, min(b, 1_300_000)) for a, b in spans], 1_300_000)
        rows += [(k, i, bool(speech.loud(x[512 * i : 512 * i + 512]))) for i in range(len(x) // 512)]
        want |= {(k, a, b) for a, b in plain_segments(x)}
    got = speech.speech_cuts(spark.createDataFrame(rows, "stream long, at long, speech boolean"))
    assert sorted(map(tuple, got.collect())) == sorted(want) and len(want) > 10


def test_segment_stream(spark, tmp_path):
    """Frames of two streams over several batches, one ended by null samples: the plain loop's segments and samples."""
    data = {k: recording(k, [(a, min(b, 500_000)) for a, b in SPANS if a < 300_000], 500_000) for k in (1, 2)}
    rows = [(k, i, [float(v) for v in x[i * 4_000 : i * 4_000 + 4_000]]) for k, x in data.items() for i in range(125)]
    rows += [(k, 125, None) for k in data]
    frames = spark.createDataFrame(rows, "stream long, seq long, samples array<float>")
    stream = files(frames, f"{tmp_path}/in", ["seq < 13", "seq BETWEEN 13 AND 60", "seq BETWEEN 61 AND 62", "seq > 62"])
    speech.segment_stream(stream).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
    got = {(r.stream, r.start_sample, r.end_sample): np.array(r.samples, np.float32) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert sorted(got) == sorted((k, a, b) for k, x in data.items() for a, b in plain_segments(x))
    assert all((x == data[k][a:b]).all() for (k, a, b), x in got.items())


def test_a_timer_ends_an_idle_stream(spark, tmp_path):
    x = recording(5, [(2_000, 60_000)], 60_000)
    frames = spark.createDataFrame([(9, 0, [float(v) for v in x])], "stream long, seq long, samples array<float>")
    query = speech.segment_stream(files(frames, f"{tmp_path}/in", ["true"]), idle_ms=500).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(processingTime="1 second").start()
    try:
        for _ in range(60):
            time.sleep(1)
            if any(p["numInputRows"] == 0 and p["batchId"] > 0 for p in query.recentProgress):
                break
    finally:
        query.stop()
    assert [(r.start_sample, r.end_sample) for r in spark.read.parquet(f"{tmp_path}/out").collect()] == plain_segments(x)


class Crash(RuntimeError):
    pass


def meeting_rows(n=240):
    rnd = random.Random(8)
    voices = [[rnd.gauss(0, 1) for _ in range(16)] for _ in range(5)]
    rows = []
    for k in range(n):
        vector = [a + rnd.gauss(0, 0.25) for a in voices[rnd.randrange(5)]]
        odd = {50: [1.0, 2.0], 51: [float("nan")] * 16, 52: None}
        rows.append((k % 3, k, ["mic", "system", "mixed"][rnd.randrange(3)], k * 1_700_000, k * 1_700_000 + 900_000, 2_500_000 if k in odd else rnd.choice([200_000, 2_500_000]), odd.get(k, vector), "" if k % 17 == 3 else f"line {k}"))
    rows.append((1, 900, "mic", 100_500_000, None, 2_500_000, voices[0], "no end"))
    return rows


UTTERANCE = "meeting_id long, id long, channel string, start_us long, end_us long, speech_us long, centroid array<double>, text string"


def test_live_attribution_across_a_crash(spark, tmp_path):
    """Two inputs, three sinks, a crash after a batch's commit: the batch fold's rows, each exactly once."""
    said = spark.createDataFrame(meeting_rows(), UTTERANCE)
    merges = spark.createDataFrame([(0, 150_000_000, 2, 1), (1, 200_000_000, 1, 3), (2, 150_000_000, 4, 4), (1, 290_000_000, 3, 0)], "meeting_id long, start_us long, source long, target long")
    edges = [0, 90_000_000, 150_000_000, 260_000_000, 10**15]
    parts = [f"start_us >= {a} AND start_us < {b}" for a, b in zip(edges, edges[1:])]
    store = Store(spark, f"file://{tmp_path}/store")
    write, seen = stateful.into_store(store), []

    def run(crash_after=None):
        def sink(batch, number):
            write(batch, number)
            seen.append(number)
            if number == crash_after:
                raise Crash("after the commit, before the checkpoint")

        both = stateful.attribution_stream(files(said, f"{tmp_path}/said", parts) if crash_after else reopened("said", said), files(merges, f"{tmp_path}/merges", parts) if crash_after else reopened("merges", merges))
        both.writeStream.foreachBatch(sink).option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()

    def reopened(name, df):
        return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/{name}/p*")

    with pytest.raises(Exception, match="after the commit"):
        run(crash_after=1)
    assert store.read("segments").count() > 0
    run()
    assert seen.count(1) == 2
    key = lambda r: (r.meeting_id, r.id, r.speaker, r.similarity, r.is_new, r.error)
    want = sorted(map(str, map(key, folds.attribute(said.filter("text <> ''"), merges).collect())))
    segments = store.read("segments")
    assert sorted(map(str, map(key, segments.collect()))) == want
    errors = {r.id: r.error for r in segments.collect() if r.error}
    assert sorted(errors) == [50, 51, 900] and errors[900] == "no end_us"
    new = segments.filter("is_new").count()
    assert store.read("speakers").count() == new > 3 and store.read("events").count() == segments.count() + new
    assert not segments.filter("meeting_id = 1 AND speaker = 1 AND start_us > 200000000").count()


def test_bad_rows_cost_themselves_only(spark):
    """The batch fold with bad rows equals the fold without them, elsewhere."""
    said = spark.createDataFrame(meeting_rows(), UTTERANCE)
    whole = {r.id: r for r in folds.attribute(said).collect()}
    good = {r.id: r for r in folds.attribute(said.filter("id NOT IN (50, 51, 900)")).collect()}
    assert all(whole[i][1:] == r[1:] for i, r in good.items()) and whole[50].speaker is None and "2 numbers" in whole[50].error
    online = folds.match_online(said.select(F.lit(1).alias("stream"), "id", "centroid", F.lit(False).alias("mic"), F.lit(3.0).alias("seconds"))).collect()
    assert sorted(r.id for r in online if r.error) == [50, 51, 52] and all((r.speaker is None) == bool(r.error) for r in online)
