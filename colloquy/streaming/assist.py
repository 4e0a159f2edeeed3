"""The assistant beside a running meeting: requests by timers, answers as a second input, and texts that come in parts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.steps import Assistant, Trigger

#: What comes in: lines with their length, answers with a hint (null: silence) or an error, ticks that only tell the time.
ASSIST_ROW = ["meeting_id", "at", "kind", "chars", "hint", "error"]
TOLD = "meeting_id long, at timestamp, kind string, text string"


def _seconds(at: pd.Timestamp) -> float:
    return at.value / 1e9


def _frame(key: int, told: list[tuple[float, str, str | None]]) -> pd.DataFrame:
    at = pd.to_datetime([round(t * 1e6) for t, _, _ in told], unit="us")
    return pd.DataFrame({"meeting_id": pd.array([key] * len(told), dtype="Int64"), "at": pd.Series(at, dtype="datetime64[us]"), "kind": pd.array([k for _, k, _ in told], dtype="string"), "text": pd.array([x for _, _, x in told], dtype="string")})


def _step(now: Assistant, row) -> list[tuple[float, str, str | None]]:
    text = lambda x: None if pd.isna(x) else str(x)
    return now.row(_seconds(row.at), row.kind, 0 if pd.isna(row.chars) else int(row.chars), text(row.hint), text(row.error))


class AssistProcessor(StatefulProcessor):
    """Rows of a meeting of a batch in order of time; out go requests, hints and error messages.

    What is due later is a timer on the event clock: it asks when the watermark has passed it, even if nothing more is
    said. State is the trigger's numbers and the last few hints, to which an answer is compared.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.place = handle.getValueState("place", "chars long, last double, gap double, skips long, errors long, until double, off boolean, waiting boolean, timer long")
        self.hints = handle.getListState("hints", "text string")

    def _held(self) -> tuple[Assistant, int | None]:
        if not self.place.exists():
            return Assistant(), None
        chars, last, gap, skips, errors, until, off, waiting, timer = self.place.get()
        state = Trigger(int(chars), float(last), float(gap), int(skips), int(errors), float(until), bool(off))
        return Assistant(state, bool(waiting), [row[0] for row in self.hints.get()]), None if pd.isna(timer) else int(timer)

    def _keep(self, now: Assistant, hints: list[str], timer: int | None, clock_ms: int) -> None:
        due, s = now.due(), now.state
        wanted = None if due is None else max(int(-(-due * 1000 // 1)), clock_ms + 1)
        if wanted != timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            if wanted is not None:
                self.handle.registerTimer(wanted)
        if now.hints != hints:
            self.hints.put([(h,) for h in now.hints])
        self.place.update((s.chars, s.last, s.gap, s.skips, s.errors, s.until, s.off, now.waiting, wanted))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        now, timer = self._held()
        hints, out = list(now.hints), []
        for row in pd.concat(list(rows)).sort_values(["at", "kind"], ascending=[True, False], kind="stable").itertuples(index=False):
            out += _step(now, row)
        self._keep(now, hints, timer, timerValues.getCurrentWatermarkInMs())
        yield _frame(key[0], out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now, _ = self._held()
        due, out = now.due(), []
        if due is not None and due * 1000 <= expiredTimerInfo.getExpiryTimeInMs() and now.ask(due):
            out.append((due, "ask", None))
        self._keep(now, list(now.hints), None, timerValues.getCurrentWatermarkInMs())
        yield _frame(key[0], out)

    def close(self) -> None:
        pass


def assist_stream(lines: DataFrame, answers: DataFrame, delay: str = "0 seconds") -> DataFrame:
    """(meeting_id, at, kind, text) told of streams of lines (meeting_id, at, chars) and answers (meeting_id, at, hint, error).

    Lines may carry a kind of their own: any but ``line`` only tells the time.
    """
    kind = F.col("kind") if "kind" in lines.columns else F.lit("line")
    none = F.lit(None).cast("string")
    rows = lines.select("meeting_id", "at", kind.alias("kind"), F.col("chars").cast("long").alias("chars"), none.alias("hint"), none.alias("error"))
    rows = rows.unionByName(answers.select("meeting_id", "at", F.lit("answer").alias("kind"), F.lit(None).cast("long").alias("chars"), "hint", "error"))
    return rows.withWatermark("at", delay).groupBy("meeting_id").transformWithStateInPandas(AssistProcessor(), TOLD, "Append", "EventTime")


def assist(rows: DataFrame) -> DataFrame:
    """The same in batch over rows (``ASSIST_ROW``): each meeting's are folded in order of time by one task, in batches.

    What is still due when a meeting's rows end is not asked any more: a last row of any other kind tells the end.
    """
    dealt = rows.select(*ASSIST_ROW).repartition("meeting_id").sortWithinPartitions("meeting_id", "at", F.desc("kind"))

    def fold(batches):
        meeting, now = object(), Assistant()
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                if row.meeting_id != meeting:
                    meeting, now = row.meeting_id, Assistant()
                out.append(_frame(row.meeting_id, _step(now, row)))
            yield pd.concat(out) if out else _frame(0, [])

    return dealt.mapInPandas(fold, TOLD)


class DeltaProcessor(StatefulProcessor):
    """Parts of texts (request, seq, delta, final) as they come; a whole text goes out once, with its final part.

    State is the list of parts so far, appended to and never written anew: it is as large as the text. Parts of one batch
    are put in order of seq; a part that is met again (a batch run anew, a client that sends twice) counts once.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.parts = handle.getListState("parts", "seq long, delta string")
        self.last = handle.getValueState("last", "seq long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values("seq").drop_duplicates("seq")
        last = int(self.last.get()[0]) if self.last.exists() else -1
        batch = batch[batch["seq"] > last]
        texts: list[str] = []
        if len(batch):
            self.parts.appendList([(int(r.seq), "" if pd.isna(r.delta) else r.delta) for r in batch.itertuples(index=False)])
            self.last.update((int(batch["seq"].max()),))
            if batch["final"].any():
                texts = ["".join(delta for _, delta in self.parts.get())]
                self.parts.clear()
        yield pd.DataFrame({"request": pd.array([key[0]] * len(texts), dtype="Int64"), "text": pd.array(texts, dtype="string")})

    def close(self) -> None:
        pass


def answer_stream(deltas: DataFrame) -> DataFrame:
    """(request, text) of streaming parts (request, seq, delta, final), one row a text."""
    return deltas.groupBy("request").transformWithStateInPandas(DeltaProcessor(), "request long, text string", "Append", "None")
