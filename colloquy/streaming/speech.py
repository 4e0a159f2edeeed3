"""Speech cut out of streams of samples: the live form in keyed state, and the batch form as Catalyst expressions.

Both tell the same segments. What tells speech from silence is a callable over a window of samples (a model's slot); the
energy is the default. The batch form takes a flag for each window.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.steps import LEAST_CUT, MOST_CUT, PAD, PAUSE, RATE, VAD_WINDOW, Segmenter
from ..sources.lens import TIMED, timed_segments

#: Root mean square from which a window is speech, where no model tells.
LOUD = 0.02
#: Samples of a chunk of the buffer in state.
CHUNK = 16_384
SEGMENTS = "stream long, start_sample long, end_sample long, start_s double, end_s double, samples array<float>"


def loud(window: np.ndarray) -> bool:
    return float(np.sqrt(np.mean(window.astype(np.float64) ** 2))) >= LOUD


class SegmentProcessor(StatefulProcessor):
    """Rows (stream, seq, samples) of a batch in order of seq; out go complete segments. Null samples end a stream.

    State is the segmenter's: its samples as a list of chunks, to whose end new ones are added and which is written anew
    only when its beginning goes; the part of a window and the counters as one value. After ``idle_ms`` without rows, if
    given, a timer ends the stream as null samples would.
    """

    def __init__(self, speaks: Callable[[np.ndarray], bool] = loud, idle_ms: int | None = None):
        self.speaks, self.idle_ms = speaks, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.chunks = handle.getListState("chunks", "samples binary")
        self.place = handle.getValueState("place", "tail binary, offset long, done long, begin long, quiet long, triggered boolean, timer long")

    def _held(self) -> tuple[Segmenter, int | None]:
        if not self.place.exists():
            return Segmenter(), None
        tail, offset, done, begin, quiet, triggered, timer = self.place.get()
        of = lambda b: np.frombuffer(bytes(b), np.float32)
        buffer = np.concatenate([np.zeros(0, np.float32), *(of(row[0]) for row in self.chunks.get())])
        whole = lambda x: None if pd.isna(x) else int(x)
        return Segmenter(of(tail), buffer, int(offset), int(done), whole(begin), whole(quiet), bool(triggered)), whole(timer)

    def _keep(self, now: Segmenter, offset: int, n: int, timer: int | None) -> None:
        """``offset`` and ``n``: where the buffer began and how long it was before."""
        if now.offset == offset and len(now.buffer) >= n:
            fresh = now.buffer[n:]
            if len(fresh):
                self.chunks.appendList([(fresh[k : k + CHUNK].tobytes(),) for k in range(0, len(fresh), CHUNK)])
        elif len(now.buffer):
            self.chunks.put([(now.buffer[k : k + CHUNK].tobytes(),) for k in range(0, len(now.buffer), CHUNK)])
        else:
            self.chunks.clear()
        self.place.update((now.tail.tobytes(), now.offset, now.done, now.begin, now.quiet, now.triggered, timer))

    @staticmethod
    def _told(key, found) -> pd.DataFrame:
        starts, ends = (np.array([f[k] for f in found], np.int64) for k in (0, 1))
        samples = pd.Series([f[2].astype(float).tolist() for f in found], dtype=object)
        return pd.DataFrame({"stream": np.full(len(found), key[0], np.int64), "start_sample": starts, "end_sample": ends, "start_s": starts / RATE, "end_s": ends / RATE, "samples": samples})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        now, timer = self._held()
        offset, n, found = now.offset, len(now.buffer), []
        for row in pd.concat(list(rows)).sort_values("seq").itertuples(index=False):
            found += now.flush() if row.samples is None else now.feed(row.samples, self.speaks)
        if self.idle_ms is not None:
            if timer is not None:
                self.handle.deleteTimer(timer)
            timer = timerValues.getCurrentProcessingTimeInMs() + self.idle_ms
            self.handle.registerTimer(timer)
        self._keep(now, offset, n, timer)
        yield self._told(key, found)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now, _ = self._held()
        offset, n = now.offset, len(now.buffer)
        found = now.flush()
        self._keep(now, offset, n, None)
        yield self._told(key, found)

    def close(self) -> None:
        pass


def segment_stream(frames: DataFrame, speaks: Callable[[np.ndarray], bool] = loud, idle_ms: int | None = None) -> DataFrame:
    """Segments of streaming frames (stream, seq, samples) as they are complete; see ``SegmentProcessor``."""
    return frames.groupBy("stream").transformWithStateInPandas(SegmentProcessor(speaks, idle_ms), SEGMENTS, "Append", "None" if idle_ms is None else "ProcessingTime")


def speech_cuts(windows: DataFrame, pause: int = PAUSE, pad: int = PAD, least: int = LEAST_CUT, most: int = MOST_CUT) -> DataFrame:
    """(stream, start_sample, end_sample) of windows (stream, at, speech), at from 0 without holes: the stream's segments, in batch.

    Windows of speech closer than the pause make one phrase. The greatest length is reached at a whole window, and from
    there on at equal steps, so a phrase's cuts are a sequence; a pause under way can still hold one.
    """
    quiet = -(-pause // VAD_WINDOW) + 1  # silent windows that end a phrase
    spoken = windows.filter("speech")
    by = Window.partitionBy("stream").orderBy("at")
    new = F.coalesce(F.col("at") - F.lag("at").over(by) > quiet, F.lit(True)).cast("long")
    phrases = spoken.withColumn("new", new).withColumn("phrase", F.sum("new").over(by)).groupBy("stream", "phrase").agg(F.min("at").alias("first"), F.max("at").alias("last"))
    ends = windows.groupBy("stream").agg(((F.max("at") + 1) * VAD_WINDOW).alias("done"))
    held = phrases.join(ends, "stream")
    start = F.greatest(F.col("first") * VAD_WINDOW - pad, F.lit(0))
    closes = (F.col("last") + 1 + quiet) * VAD_WINDOW
    open_still = closes > F.col("done")
    end = F.when(open_still, F.col("done")).otherwise((F.col("last") + 1) * VAD_WINDOW + pad)
    step = -(-most // VAD_WINDOW) * VAD_WINDOW
    # Cuts come at processed windows before the one that closes the phrase, or up to the stream's end.
    upto = F.when(open_still, F.col("done")).otherwise(closes - VAD_WINDOW)
    cut = F.ceil((F.col("start") + most) / VAD_WINDOW).cast("long") * VAD_WINDOW
    told = held.select("stream", start.cast("long").alias("start"), end.cast("long").alias("end"), upto.cast("long").alias("upto")).withColumn("cut", cut)
    cuts = F.when(F.col("cut") <= F.col("upto"), F.sequence("cut", "upto", F.lit(step).cast("long"))).otherwise(F.array().cast("array<long>"))
    edges = told.select("stream", F.concat(F.array("start"), cuts).alias("starts"), F.concat(cuts, F.array("end")).alias("ends"))
    parts = edges.select("stream", F.explode(F.arrays_zip("starts", "ends")).alias("x")).select("stream", F.col("x.starts").alias("start_sample"), F.col("x.ends").alias("end_sample"))
    return parts.filter(F.col("end_sample") - F.col("start_sample") >= least)


def _flags(spark, d):
    """The events of a day as windows in order, speech where they are loud."""
    by = Window.partitionBy("meeting_id").orderBy("start_us", "id")
    return timed_segments(spark, d).select(F.col("meeting_id").alias("stream"), (F.row_number().over(by) - 1).cast("long").alias("at"), ((F.col("id") % 40 < 22) | (F.col("meeting_id") % 3 == 0)).alias("speech"))


QUERIES = {"speech_cuts": lambda s, d: speech_cuts(_flags(s, d), most=100_000)}
SQL = {
    "speech_cuts": f"""WITH w AS (SELECT meeting_id AS stream, row_number() OVER (PARTITION BY meeting_id ORDER BY start_us, id) - 1 AS pos, id % 40 < 22 OR meeting_id % 3 = 0 AS speech FROM {TIMED}),
      n AS (SELECT stream, pos, CASE WHEN pos - lag(pos) OVER (PARTITION BY stream ORDER BY pos) <= 11 THEN 0 ELSE 1 END AS fresh FROM w WHERE speech),
      p AS (SELECT stream, sum(fresh) OVER (PARTITION BY stream ORDER BY pos) AS phrase, pos FROM n),
      e AS (SELECT stream, (max(pos) + 1) * 512 AS done FROM w GROUP BY stream),
      h AS (SELECT stream, greatest(min(pos) * 512 - 2400, 0) AS a, (max(pos) + 12) * 512 AS closes, (max(pos) + 1) * 512 + 2400 AS padded FROM p GROUP BY stream, phrase),
      t AS (SELECT h.stream, a, CASE WHEN closes > done THEN done ELSE padded END AS b, CASE WHEN closes > done THEN done ELSE closes - 512 END AS upto, ((a + 100000 + 511) // 512) * 512 AS cut FROM h JOIN e ON e.stream = h.stream),
      c AS (SELECT stream, a, b, CASE WHEN cut <= upto THEN generate_series(cut, upto, 100352) ELSE [] END AS cuts FROM t),
      s AS (SELECT stream, unnest(list_prepend(a, cuts)) AS start_sample, unnest(list_append(cuts, b)) AS end_sample FROM c)
      SELECT stream, start_sample::BIGINT AS start_sample, end_sample::BIGINT AS end_sample FROM s WHERE end_sample - start_sample >= 4000""",
}
