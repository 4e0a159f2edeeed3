import collections
import io
import struct
import uuid
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from colloquy.functions import steps
from colloquy.plans import summary
from colloquy.sources import audio, messages
from colloquy.streaming import folds, stateful


def test_frames_and_wavs(spark, tmp_path):
    frames = [(1, b"\x00" + struct.pack("<2h", 16384, -32768)), (2, b"\x01" + struct.pack("<h", 0)), (3, b"\x07\x00\x00"), (4, b"\x00"), (5, b"")]
    got = audio.read_frames(spark.createDataFrame([(k, bytearray(f)) for k, f in frames], "seq int, frame binary")).orderBy("seq").collect()
    assert [(r.channel, r.samples) for r in got] == [("mic", [0.5, -1.0]), ("system", [0.0])]
    df = spark.createDataFrame([([0.5, -2.0, 0.25] * 8000,)], "x array<float>")
    blob = df.select(audio.samples_to_wav("x")).first()[0]
    (tmp_path / "ann").mkdir()
    (tmp_path / "ann" / "a.wav").write_bytes(blob)
    (tmp_path / "ann" / "bad.wav").write_bytes(b"nothing")
    with wave.open(io.BytesIO(bytes(blob))) as w:
        assert (w.getframerate(), w.getnframes()) == (16000, 24000)
    read = {r.path[-5:]: r for r in audio.read_wavs(spark, str(tmp_path)).collect()}
    assert read["a.wav"].person == "ann" and read["a.wav"].samples[:2] == pytest.approx([0.5, -1.0], abs=1e-3) and read["d.wav"].problem
    part = df.select(F.size(audio.cut(F.col("x"), F.lit(0.5), F.lit(9.0))), audio.level(F.array(F.lit(3.0), F.lit(4.0)))).first()
    assert part[0] == 16000 and part[1] == pytest.approx(12.5**0.5)


def test_commands_and_reports(spark, tmp_path):
    good, bad = messages.commands(spark.createDataFrame([('{"type":"ask","question":"q","segment_ids":["1","x","3"]}',), ('{"type":"dance"}',), ("no json",)], "body string"))
    assert [(r.type, r.ids) for r in good.select("type", messages.segment_ids(F.col("segment_ids")).alias("ids")).collect()] == [("ask", [1, 3])]
    assert sorted(r.error for r in bad.collect()) == ["not a command", "unknown command"]
    rows = spark.createDataFrame([("1.5GiB / 3GiB",), ("512MiB / 3GiB",), ("?",)], "x string")
    assert [r[0] for r in rows.select(messages.memory_mb(F.col("x"))).collect()] == [1536.0, 512.0, 0.0]
    assert messages.events(spark.createDataFrame([(1, "é")], "id int, text string"), "segment", "id", "text").first().value == '{"type":"segment","id":1,"text":"é"}'
    (tmp_path / "r.xml").write_text('<testsuite><testcase name="a" classname="c" time="0.1"/><testcase name="b" classname="c" time="0.2"><failure>no</failure></testcase></testsuite>')
    assert sorted((r.name, r.status) for r in messages.junit_cases(spark, str(tmp_path / "r.xml")).collect()) == [("a", "passed"), ("b", "failed")]
    urls = spark.createDataFrame([("https://api.example.org/v1",), ("ftp://x",), ("none",)], "u string")
    assert [r[0] for r in urls.select(messages.usable_url(F.col("u"), ["api.example.org"])).collect()] == [True, False, False]
    assert spark.createDataFrame([('{"error":{"message":"m"}}',)], "b string").select(messages.error_detail(F.col("b"))).first()[0] == "m"


def _segments(spark, n, size):
    return spark.createDataFrame([(1, k, "s", float(k), "x" * size) for k in range(n)] + [(2, 0, "s", 0.0, "short")], "meeting_id long, id long, speaker string, start_s double, text string")


def test_each_chunk_is_asked_once(spark, tmp_path):
    """One call a chunk and level, however many levels read the notes."""

    def model(system, prompt):
        (tmp_path / uuid.uuid4().hex).write_text(system)
        return "n " * 40 if system == summary.NOTES else "protocol"

    got = summary.summarize(_segments(spark, 40, 50), model, 300, model_name="m")
    rows = {r.meeting_id: r for r in got.collect()}
    got.count()
    asked = collections.Counter(p.read_text() for p in tmp_path.iterdir())
    chunks = summary.pack_lines(_segments(spark, 40, 50).filter("meeting_id = 1"), 300).count()
    notes = "\n".join(["n " * 40] * chunks)
    second = -(-len(notes) // 300)
    assert asked[summary.PROTOCOL] == 2 and chunks < asked[summary.NOTES] <= chunks + 3 * second + 3
    assert rows[1].summary == "protocol" and rows[1].summary_model == "m" and rows[1].status == "done"


def test_client_frames_and_recordings(spark, tmp_path):
    rnd = np.random.default_rng(2)
    x = rnd.uniform(-1.2, 1.2, 3_500)
    sent = audio.encode_frames(spark.createDataFrame([(5, "mic", x.tolist()), (6, "tape", [0.1] * 2_000)], "k long, channel string, samples array<double>"), ["k"])
    rows = sent.orderBy("no").collect()
    assert [(r.k, r.channel, r.no, len(r.frame)) for r in rows] == [(5, "mic", 0, 3_201), (5, "mic", 1, 3_201)]
    clamped = np.clip(x[:1_600], -1, 1)
    assert np.frombuffer(bytes(rows[0].frame[1:]), "<i2").tolist() == [int(v * (32768 if v < 0 else 32767)) for v in clamped] and rows[0].level == pytest.approx(np.sqrt(np.mean(clamped**2)))
    wavs = audio.recordings(audio.read_frames(sent.withColumn("seq", F.col("no"))).select("k", "seq", "channel", "samples"), "k", "seq").collect()
    with wave.open(io.BytesIO(bytes(wavs[0].wav))) as w:
        assert len(wavs) == 1 and w.getnframes() == 3_200
    told = spark.createDataFrame([([0.5] * 16_000 * 9,)], "x array<float>").select(audio.print_recording(F.col("x")).alias("r")).first().r
    assert told.seconds == 8.0 and len(told.name) == 12 and len(told.wav) == 44 + 2 * 128_000
    (tmp_path / "bob").mkdir()
    with wave.open(str(tmp_path / "bob" / "s.wav"), "wb") as w:
        w.setnchannels(2)
        w.setsampwidth(1)
        w.setframerate(8_000)
        w.writeframes(bytes([192, 64]) * 800)
    read = audio.read_wavs(spark, str(tmp_path)).first()
    assert read.problem is None and len(read.samples) == 1_600 and read.samples[5] == pytest.approx(0.0)


def test_inventory_of_tests(spark, tmp_path):
    (tmp_path / "test_a.py").write_text('import pytest\n@pytest.mark.parametrize("x", [1, 2, 3])\ndef test_one_thing(x):\n    """Does  one\n    thing."""\nasync def test_other():\n    pass\ndef helper():\n    pass\n')
    (tmp_path / "test_b.py").write_text("def broken(:\n")
    got = sorted((r.name, r.title, r.parameters) for r in messages.test_inventory(spark, str(tmp_path)).collect())
    assert got == [("test_one_thing", "Does one thing.", 3), ("test_other", "other", 0)]
    assert sorted(r.name for r in messages.test_names(spark, str(tmp_path)).collect()) == ["test_one_thing", "test_other"]
    ids = spark.createDataFrame([(["1", "1.5", "5.0", "-7", "x", None, ""],)], "i array<string>")
    assert ids.select(messages.segment_ids(F.col("i"))).first()[0] == [1, -7]


def test_summaries(spark):
    def model(system, prompt):
        if len(prompt) > 400:
            raise summary.TooLong
        return f"note {len(prompt)}" if system == summary.NOTES else f"protocol of {prompt.count('note')} notes"

    got = {r.meeting_id: r for r in summary.summarize(_segments(spark, 40, 50), model, 300).collect()}
    assert got[1].summary.startswith("protocol of") and got[1].error is None and got[2].summary == "protocol of 0 notes"
    halved = {r.meeting_id: r for r in summary.summarize(_segments(spark, 12, 60), model, 600).collect()}
    assert halved[1].error is None
    failed = {r.meeting_id: r for r in summary.summarize(_segments(spark, 1, 900), model, 500).collect()}
    assert failed[1].summary is None and failed[1].error == "did not fit" and failed[2].error is None


def test_questions_and_export(spark):
    rows = _segments(spark, 3, 4)
    r = summary.question_context(rows, 1, [2, 0, 99], 1000).first()
    assert r.quoted == "[00:00] s: xxxx\n[00:02] s: xxxx" and r.earlier == "[00:01] s: xxxx"
    meetings = spark.sql("SELECT 2L AS meeting_id, 'T' AS title, timestamp '2024-05-06 07:08:09' AS started_at, '' AS summary")
    assert summary.export(meetings, rows).first().text == "# T\n*06.05.2024 07:08*\n**Participants:** s (1)\n\n## Transcript\n\n[00:00] s: short\n"
    assert summary.export(meetings.withColumn("summary", F.lit("S")), rows, "pdf").first().text == f"T\n06.05.2024 07:08\nParticipants: s (1)\n\nS\n\n{'-' * 40}\n\n[00:00] s: short\n"


def test_streams_equal_the_folds(spark, tmp_path):
    """Fed file by file, the keyed state gives what one pass over all rows does."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = [(k % 2, k, [float((k * 7 + j * 3) % 5) - 2 for j in range(6)], k % 3 == 0, 2.5) for k in range(24)]
    schema = "stream long, id long, centroid array<double>, mic boolean, seconds double"
    df = spark.createDataFrame(rows, schema)
    for part in range(3):
        df.filter(f"id >= {part * 8} AND id < {part * 8 + 8}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in" / f"p{part}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    out = []
    query = stateful.match_stream(stream).writeStream.foreachBatch(lambda b, _: out.extend(b.collect())).outputMode("append").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination(300)
    assert {(r.id, r.speaker) for r in out} == {(r.id, r.speaker) for r in folds.match_online(df).collect()} and len(out) == 24


def test_aligned_stream_equals_the_steps(spark, tmp_path):
    """Two channels in frames of uneven lengths, late ones among them, over several batches, and a flush at the end."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    frames = [(1, k, ("mic", "system")[k % 3 == 1], [float(k)] * (k % 5)) for k in range(30)] + [(1, 30, "end", [])]
    schema = "stream long, seq long, channel string, samples array<double>"
    df = spark.createDataFrame(frames, schema)
    for part in range(3):
        df.filter(f"seq >= {part * 11} AND seq < {part * 11 + 11}").coalesce(1).write.parquet(str(tmp_path / "in" / f"p{part}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    out = []
    query = stateful.align_stream(stream, 7).writeStream.foreachBatch(lambda b, _: out.extend(b.collect())).outputMode("append").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination(300)
    aligner, want = steps.Aligner(7), []
    for _, _, channel, samples in frames:
        want += aligner.flush() if channel == "end" else aligner.feed(channel, list(samples))
    assert [x for r in out for x in r.samples] == want and want
