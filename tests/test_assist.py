"""The assistant's stream against its step function under a test clock, and texts in parts."""

import datetime
import random

import pytest
from pyspark.sql import functions as F
from test_live import files, rocksdb  # noqa: F401

from colloquy.functions import steps
from colloquy.streaming import assist

T0 = 1_700_000_000


def at(seconds):
    return datetime.datetime.fromtimestamp(T0 + seconds, datetime.timezone.utc).replace(tzinfo=None)


def plain(rows):
    """What is told, by looking at the clock every half second."""
    out = []
    for meeting in sorted({r[0] for r in rows}):
        own = sorted((r for r in rows if r[0] == meeting), key=lambda r: (r[1], r[2] == "answer"))
        chars, last, gap, skips, errors, until, off, waiting, hints, k = 0, -1e9, 15.0, 0, 0, -1e9, False, False, [], 0
        for tick in range(0, int(own[-1][1] * 2) + 1):
            now = tick / 2

            def look():
                nonlocal chars, last, waiting
                if not off and not waiting and chars >= 15 and now >= until and now - last >= gap:
                    chars, last, waiting = 0, now, True
                    out.append((meeting, now, "ask", None))

            look()
            while k < len(own) and own[k][1] == now:
                _, _, kind, n, hint, error = own[k]
                k += 1
                if kind == "line":
                    chars += n
                    look()
                elif kind == "answer" and waiting:
                    waiting = False
                    if error:
                        errors += 1
                        until, off = now + min(15 * 2**errors, 120), errors >= 5
                        if off or errors == 1:
                            out.append((meeting, now, "hint_error", steps.PAUSED if off else error))
                    elif hint is None:
                        errors, skips = 0, skips + 1
                        gap = min(8.0 * skips, 45)
                    else:
                        errors, skips, gap = 0, 0, 15.0
                        if not any(steps.alike(hint, h) for h in hints[-3:]):
                            hints.append(hint)
                            out.append((meeting, now, "hint", hint))
                    look()
    return sorted(map(str, out))


def made():
    rnd, rows = random.Random(4), []
    texts = ["Ask about the budget of next year", "Ask about the budget of last year", "Name the owner of this task", "Agree on a date", "Sum up what was decided"]
    for meeting in (1, 2, 3):
        now = meeting * 3.0
        for _ in range(90):
            now += rnd.choice([0.5, 2, 3.5, 9, 31])
            rows.append((meeting, now, "line", rnd.choice([0, 4, 12, 40]), None, None))
            if rnd.random() < 0.5:
                what = rnd.random()
                error = what < (0.9 if meeting == 3 else 0.2)
                rows.append((meeting, now + 1, "answer", None, None if error or what > 0.75 else rnd.choice(texts), "no line" if error else None))
    end = max(r[1] for r in rows) + 200
    return rows + [(m, end, "tick", None, None, None) for m in (1, 2, 3)]


SCHEMA = "meeting_id long, at timestamp, kind string, chars long, hint string, error string"


def told(rows):
    return sorted(str((r.meeting_id, r.at.replace(tzinfo=datetime.timezone.utc).timestamp() - T0, r.kind, r.text)) for r in rows)


def test_assistant_equals_a_clock(spark, tmp_path):
    rows = made()
    df = spark.createDataFrame([(m, at(t), k, n, h, e) for m, t, k, n, h, e in rows], SCHEMA)
    want = plain(rows)
    assert all(sum(f"'{kind}'" in w for w in want) > 3 for kind in ("ask", "hint")) and sum(steps.PAUSED in w for w in want) == 1
    assert told(assist.assist(df).collect()) == want
    ends = [T0 - 10, T0 + 100, T0 + 101, T0 + 400, T0 + 10**6]
    parts = [f"at >= timestamp_seconds({a}) AND at < timestamp_seconds({b})" for a, b in zip(ends, ends[1:])]
    lines = files(df.filter("kind <> 'answer'"), f"{tmp_path}/lines", parts)
    answers = files(df.filter("kind = 'answer'"), f"{tmp_path}/answers", parts)
    assist.assist_stream(lines, answers).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
    assert told(spark.read.parquet(f"{tmp_path}/out").collect()) == want


def test_a_timer_asks_without_new_rows(spark, tmp_path):
    """Enough was said within the gap; another meeting's clock moves on, and the request goes at its time."""
    rows = [(1, 0.0, "line", 20), (1, 5.0, "line", 20), (2, 40.0, "tick", 0), (2, 80.0, "tick", 0)]
    df = spark.createDataFrame([(m, at(t), k, n) for m, t, k, n in rows], "meeting_id long, at timestamp, kind string, chars long")
    answers = spark.createDataFrame([(1, at(1.0), None, None), (2, at(60.0), None, None)], "meeting_id long, at timestamp, hint string, error string")
    parts = [f"at < timestamp_seconds({T0 + 20})", f"at BETWEEN timestamp_seconds({T0 + 20}) AND timestamp_seconds({T0 + 59})", f"at >= timestamp_seconds({T0 + 60})"]
    stream = assist.assist_stream(files(df, f"{tmp_path}/l", parts), files(answers, f"{tmp_path}/a", parts))
    stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
    # Silence at 1 makes the gap 8 seconds.
    assert told(spark.read.parquet(f"{tmp_path}/out").collect()) == [str((1, 0.0, "ask", None)), str((1, 8.0, "ask", None))]


@pytest.mark.parametrize("answer,want", [(("h" * 20, None), ("hint", "h" * 20)), ((None, "down"), ("hint_error", "down")), ((None, None), None)])
def test_answers(answer, want):
    now = steps.Assistant()
    assert now.row(0.0, "line", 14, None, None) == [] and now.due() is None
    assert now.row(1.0, "line", 1, None, None) == [(1.0, "ask", None)] and now.waiting
    assert now.answered(2.0, *answer) == want and now.answered(3.0, *answer) == (None if want is None or want[0] == "hint" else None)


def test_answer_texts(spark, tmp_path):
    rnd, rows, want = random.Random(1), [], {}
    for request in range(6):
        parts = ["".join(rnd.choice("ab é") for _ in range(rnd.randint(0, 5))) for _ in range(rnd.randint(1, 40))]
        want[request] = "".join(parts)
        rows += [(request, k, p if p else None, k == len(parts) - 1, (request + k) % 3 if k < len(parts) - 1 else 3) for k, p in enumerate(parts)]
    rows = [(r, k, p, f, min(3, k // 12) if not f else 3) for r, k, p, f, _ in rows]
    df = spark.createDataFrame(rows + [rows[0]], "request long, seq long, delta string, final boolean, part long")
    stream = files(df, f"{tmp_path}/in", [f"part = {k}" for k in range(4)])
    assist.answer_stream(stream.drop("part")).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
    assert sorted((r.request, r.text) for r in spark.read.parquet(f"{tmp_path}/out").collect()) == sorted(want.items())
    batch = df.filter(F.lit(True)).dropDuplicates(["request", "seq"]).groupBy("request").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", F.coalesce("delta", F.lit("")).alias("d")))), lambda x: x["d"]), "").alias("text"))
    assert {r.request: r.text for r in batch.collect()} == want
