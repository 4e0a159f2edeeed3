"""Live connectors: every record once, across growing files, restarts and crashes."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from colloquy.sources import audio, messages, wire


def made(seed, n):
    rnd = np.random.default_rng(seed)
    return [bytes([int(rnd.choice([0, 1, 7]))]) + rnd.integers(-30_000, 30_000, int(rnd.integers(0, 50))).astype("<i2").tobytes() for _ in range(n)]


class Crash(RuntimeError):
    pass


def test_frames_are_read_once(spark, tmp_path):
    (tmp_path / "log").mkdir()
    frames = {m: made(k, 40) for k, m in enumerate(("a", "b.c"))}
    logs = {m: wire.packed_frames(f) for m, f in frames.items()}
    seen = []

    def run(crash=False):
        def sink(batch, number):
            rows = audio.read_frames(batch, "record").select("meeting", "position", "channel", "samples").collect()
            if crash and rows:
                raise Crash("before the batch is done")
            seen.extend(rows)

        wire.stream_of(spark, f"{tmp_path}/log").writeStream.foreachBatch(sink).option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()

    # Files that grow, at first by a part of a record.
    for share in (0.3, 0.31, 1.0):
        for m, log in logs.items():
            (tmp_path / "log" / f"{m}.frames").write_bytes(log[: int(len(log) * share)])
        (tmp_path / "log" / "other.txt").write_text("not a log")
        if share == 1.0:
            with pytest.raises(Exception, match="before the batch is done"):
                run(crash=True)
        run()
    rows = [(m, sum(4 + len(x) for x in f[:k]), x) for m, f in frames.items() for k, x in enumerate(f)]
    want = audio.read_frames(spark.createDataFrame(rows, "meeting string, position long, record binary"), "record").select("meeting", "position", "channel", "samples").collect()
    assert sorted(map(str, seen)) == sorted(map(str, want)) and len(want) > 20


def test_command_lines(spark, tmp_path):
    (tmp_path / "log").mkdir()
    lines = ['{"type": "start", "title": "é 漢"}', "", "no json", '{"type": "ask", "question": "' + "q" * 3_000_000 + '"}', '{"type": "stop"}']
    (tmp_path / "log" / "m.lines").write_text("\n".join(lines) + '\n{"type": "half', encoding="utf-8")
    found = []

    def sink(batch, _):
        known, _ = messages.commands(batch.withColumn("body", F.col("record").cast("string")))
        found.extend(known.select("position", "type", F.length("question").alias("n")).collect())

    for most in (100, 1 << 26):
        wire.stream_of(spark, f"{tmp_path}/log", wire.LINES, most).writeStream.foreachBatch(sink).option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
    assert [(r["type"], r["n"]) for r in sorted(found)] == [("start", None), ("ask", 3_000_000), ("stop", None)]


def test_events_are_written_once(spark, tmp_path):
    """A batch that was committed before a crash is not written again; what no manifest names is not read."""
    wire.register(spark)
    df = spark.range(40).select(F.to_json(F.struct(F.lit("segment").alias("type"), F.lit("é").alias("text"), "id")).alias("value"))
    for k in range(2):
        df.filter(f"value LIKE '%id%' AND CAST(get_json_object(value, '$.id') AS INT) % 2 = {k}").repartition(2).write.parquet(f"{tmp_path}/in/p{k}")
        stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in/p*")
        stream.writeStream.format("event_log").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
    writer, before = wire.EventWriter(f"{tmp_path}/out", 0), len(list((tmp_path / "out" / "parts").iterdir()))
    again = writer.write(iter([("again",), (None,)]))
    writer.commit([again, None], 0)
    lost = writer.write(iter([("lost",)]))
    assert len(list((tmp_path / "out" / "parts").iterdir())) == before + 1
    got = wire.events_of(spark, f"{tmp_path}/out").collect()
    assert sorted(json.loads(r.value)["id"] for r in got) == list(range(40)) and {r.batch for r in got} == {0, 1} and lost.rows == 1


def test_offsets_are_whole_records(tmp_path):
    rnd = random.Random(2)
    frames = [bytes(rnd.randrange(256) for _ in range(rnd.randint(0, 30))) for _ in range(50)]
    log, ends = wire.packed_frames(frames), {0}
    for k in range(50):
        ends.add(sum(4 + len(f) for f in frames[: k + 1]))
    for most in (1, 40, 10**6):
        reader, got, before = wire.WireReader(str(tmp_path), wire.FRAMES, most), [], {}
        for size in (*range(0, len(log), 97), *[len(log)] * 60):
            (tmp_path / "x.frames").write_bytes(log[:size])
            now = reader.latestOffset()
            for part in reader.partitions(before, now):
                got += [r for b in reader.read(part) for r in b.column(2).to_pylist()]
            before = now
            assert now["x.frames"] in ends
        assert got == frames
