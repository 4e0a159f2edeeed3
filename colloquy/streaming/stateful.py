"""Keyed state over Structured Streaming: the learning match, attribution with merges and the two-channel aligner, by the batch folds' steps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.steps import DONOR_US, RECENT_US, Aligner, Library, Live, match_step
from ..sources.store import Store
from .live import ATTRIBUTED, attributed_frame, in_order, live_step, told_of

_PRINTS = "place long, prints array<struct<vector:array<double>,n:long>>"
_CHANNELS = "mic array<double>, system array<double>, mic_debt long, system_debt long"


class MatchProcessor(StatefulProcessor):
    """Rows (stream, id, centroid, mic, seconds) of a batch in order of id; out go id, speaker and is_new.

    The library is a map by speaker: a batch writes back only the speakers that have learned something.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.prints = handle.getMapState("prints", "speaker long", _PRINTS)
        self.next_id = handle.getValueState("next_id", "id long")

    def _library(self) -> tuple[Library, dict[int, int]]:
        """The library in order of entry, and each speaker's place in it."""
        held = sorted((int(value[0]), int(key[0]), value[1]) for key, value in self.prints.iterator())
        prints = {speaker: [[list(p[0]), int(p[1])] for p in rows] for _, speaker, rows in held}
        lib = Library(prints=prints)
        if self.next_id.exists():
            lib.next_id = int(self.next_id.get()[0])
        return lib, {speaker: place for place, speaker, _ in held}

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        lib, places = self._library()
        batch = pd.concat(list(rows)).sort_values("id")
        out = [match_step(lib, list(r.centroid), bool(r.mic), float(r.seconds)) for r in batch.itertuples(index=False)]
        for speaker in dict.fromkeys(o[0] for o in out):
            places.setdefault(speaker, len(places))
            self.prints.updateValue((speaker,), (places[speaker], [([float(x) for x in vector], n) for vector, n in lib.prints[speaker]]))
        self.next_id.update((lib.next_id,))
        yield pd.DataFrame({"stream": key[0], "id": batch["id"].to_numpy(), "speaker": [o[0] for o in out], "is_new": [o[2] for o in out]})

    def close(self) -> None:
        pass


class AlignProcessor(StatefulProcessor):
    """Rows (stream, seq, channel, samples) of a batch in order of seq; out go mixed samples. A row with the channel "end" flushes.

    What is held is bounded by the greatest lag.
    """

    def __init__(self, most_lag: int):
        self.most_lag = most_lag

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.channels = handle.getValueState("channels", _CHANNELS)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        aligner = Aligner(self.most_lag)
        if self.channels.exists():
            mic, system, mic_debt, system_debt = self.channels.get()
            aligner = Aligner(self.most_lag, {"mic": list(mic), "system": list(system)}, {"mic": int(mic_debt), "system": int(system_debt)})
        out: list[float] = []
        for r in pd.concat(list(rows)).sort_values("seq").itertuples(index=False):
            out += aligner.flush() if r.channel == "end" else aligner.feed(r.channel, [float(x) for x in r.samples])
        self.channels.update((aligner.held["mic"], aligner.held["system"], aligner.debt["mic"], aligner.debt["system"]))
        yield pd.DataFrame({"stream": [key[0]], "samples": [out]})

    def close(self) -> None:
        pass


def match_stream(utterances: DataFrame) -> DataFrame:
    return utterances.groupBy("stream").transformWithStateInPandas(MatchProcessor(), "stream long, id long, speaker long, is_new boolean", "Append", "None")


def align_stream(frames: DataFrame, most_lag: int = 8_000) -> DataFrame:
    return frames.groupBy("stream").transformWithStateInPandas(AlignProcessor(most_lag), "stream long, samples array<double>", "Append", "None")


class AttributionProcessor(StatefulProcessor):
    """Rows of a meeting, utterances and merges together, of a batch in order of time; out go utterances and who spoke them.

    State: prints by speaker, and the last donor of each channel and the last end of each recent speaker, which go as soon
    as the meeting's clock has left them behind. Utterances without text are dropped before anybody is matched to them.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.prints = handle.getMapState("prints", "speaker long", _PRINTS)
        self.donors = handle.getMapState("donors", "channel string", "end long, speaker long")
        self.recent = handle.getMapState("recent", "speaker long", "end long")
        self.next_id = handle.getValueState("next_id", "id long")

    def _live(self) -> tuple[Live, dict[int, int]]:
        held = sorted((int(value[0]), int(key[0]), value[1]) for key, value in self.prints.iterator())
        lib = Library(prints={speaker: [[np.asarray(p[0], float), int(p[1])] for p in rows] for _, speaker, rows in held})
        if self.next_id.exists():
            lib.next_id = int(self.next_id.get()[0])
        last = {key[0]: (int(value[0]), int(value[1])) for key, value in self.donors.iterator()}
        recent = {int(key[0]): int(value[0]) for key, value in self.recent.iterator()}
        return Live(library=lib, last=last, recent=recent), {speaker: place for place, speaker, _ in held}

    @staticmethod
    def _renew(state, before: dict, now: dict) -> None:
        """Write what has changed and remove what has gone."""
        for key in before.keys() - now.keys():
            state.removeKey((key,))
        for key, value in now.items():
            if before.get(key) != value:
                state.updateValue((key,), value if isinstance(value, tuple) else (value,))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        live, places = self._live()
        last, recent, touched, out, clock = dict(live.last), dict(live.recent), set(), [], 0
        batch = pd.concat(list(rows))
        batch = batch.assign(said=batch["source"].isna()).sort_values(["start_us", "said", "id"], na_position="first")
        for row in batch.itertuples(index=False):
            if row.said and not row.text:
                continue
            found = live_step(live, row)
            clock = max(clock, 0 if pd.isna(row.start_us) else int(row.start_us))
            if found is None:
                touched |= set(places) | set(live.library.prints)
            else:
                touched.add(found[0])
                out.append((row.meeting_id, row.id, *found, row.channel, row.start_us, row.end_us, row.text))
        live.last = {c: v for c, v in live.last.items() if clock - v[0] < DONOR_US}
        live.recent = {who: end for who, end in live.recent.items() if clock - end <= RECENT_US}
        self._renew(self.donors, last, live.last)
        self._renew(self.recent, recent, live.recent)
        for speaker in touched - {None}:
            if speaker in live.library.prints:
                places.setdefault(speaker, max(places.values(), default=-1) + 1)
                self.prints.updateValue((speaker,), (places[speaker], [([float(x) for x in vector], n) for vector, n in live.library.prints[speaker]]))
            elif speaker in places:
                self.prints.removeKey((speaker,))
        self.next_id.update((live.library.next_id,))
        frame = attributed_frame([r[:6] for r in out])
        for k, (name, kind) in enumerate((("channel", "string"), ("start_us", "Int64"), ("end_us", "Int64"), ("text", "string")), 6):
            frame[name] = pd.array([None if pd.isna(r[k]) else r[k] for r in out], dtype=kind)
        yield frame

    def close(self) -> None:
        pass


LIVE_SEGMENT = f"{ATTRIBUTED}, channel string, start_us long, end_us long, text string"


def attribution_stream(utterances: DataFrame, merges: DataFrame) -> DataFrame:
    """Both streams in one keyed state: who spoke each utterance (with a column ``text``), merges taking effect in their place.

    A merge that comes in a later batch than the utterances after it takes effect from its batch on, as in a running
    meeting that hears of it late.
    """
    return in_order(utterances, merges, ["text"]).groupBy("meeting_id").transformWithStateInPandas(AttributionProcessor(), LIVE_SEGMENT, "Append", "None")


def into_store(store: Store, writer: str = "live"):
    """A ``foreachBatch`` function: segments, new speakers and client events of a batch become one version of the store.

    Of a batch that is run again after a crash nothing is written twice, in any of the three tables.
    """

    def write(batch: DataFrame, number: int) -> None:
        held = batch.persist()  # three tables of one run of the state
        try:
            with store.transaction(writer, number) as change:
                held.count()  # a batch whose rows are in already still moves the state on, in all partitions
                kept = held.select("meeting_id", "id", "channel", "start_us", "end_us", "text", "speaker", "similarity", "is_new", "error")
                change.append("segments", kept)
                change.append("speakers", held.filter("is_new").select("meeting_id", "speaker", F.col("id").alias("first_id")))
                change.append("events", told_of(held))
        finally:
            held.unpersist()

    return write
