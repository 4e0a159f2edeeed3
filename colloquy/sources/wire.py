"""Live connectors as Python data sources: logs of wire frames or command lines in, client events out.

``wire_log`` streams the files of a folder, one a meeting, that grow while they are read. A record is a frame behind its
length (four bytes, little-endian), or a line of text. An offset says for each file how many bytes have been handed out,
always whole records, so that a batch run again after a crash reads the same records and no record is read twice.
``event_log`` writes a batch's rows as JSON lines and names its files in one manifest per batch: a batch is there whole
or not at all, and once.

Paths are of any file system that Arrow knows (``file://``, ``hdfs://``, ``s3://``).
"""

from __future__ import annotations

import json
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, DataSourceStreamWriter, InputPartition, WriterCommitMessage

#: Bytes of a file that a batch takes at most, unless its first record is longer.
MOST_BYTES = 1 << 26
FRAMES, LINES = "frames", "lines"
RECORD = "meeting string, position long, record binary"
_ARROW = pa.schema([("meeting", pa.string()), ("position", pa.int64()), ("record", pa.binary())])
#: Records, and bytes of them, that leave a reading task together.
PORTION, PORTION_BYTES = 4_096, 1 << 24


def packed_frames(frames: list[bytes]) -> bytes:
    """Frames as a log holds them."""
    return b"".join(struct.pack("<I", len(f)) + f for f in frames)


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")


@dataclass
class Part(InputPartition):
    """Bytes ``start`` to ``end`` of a file, whole records."""

    file: str
    start: int
    end: int


class WireReader(DataSourceStreamReader):
    def __init__(self, path: str, kind: str, most: int):
        self.path, self.kind, self.most = path.rstrip("/"), kind, most
        self.upto: dict[str, int] = {}

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        """Up to the last whole record of every file, or as far as one batch goes."""
        system, root = _opened(self.path)
        for info in system.get_file_info(fs.FileSelector(root)):
            if info.type == fs.FileType.File and info.base_name.endswith(f".{self.kind}"):
                self.upto[info.base_name] = self._whole(system, info.path, self.upto.get(info.base_name, 0), info.size)
        return dict(self.upto)

    def _whole(self, system: fs.FileSystem, path: str, start: int, size: int) -> int:
        if size <= start:
            return start
        with system.open_input_file(path) as f:
            end = start
            if self.kind == FRAMES:
                while end + 4 <= size:
                    f.seek(end)
                    following = end + 4 + struct.unpack("<I", f.read(4))[0]
                    if following > size or (end > start and following > start + self.most):
                        break
                    end = following
                return end
            f.seek(start)
            while end < size and end - start < self.most:
                piece = f.read(min(1 << 20, size - end))
                if not piece:
                    break
                last = piece.rfind(b"\n")
                end_of_piece = f.tell()
                if last >= 0:
                    end = end_of_piece - len(piece) + last + 1
                if end_of_piece >= size or end - start >= self.most:
                    break
                if last < 0:
                    continue  # a line longer than the piece: on to the next
            return end

    def partitions(self, start: dict, end: dict) -> list[Part]:
        # After a restart the offsets come from the checkpoint.
        self.upto = {f: max(n, self.upto.get(f, 0)) for f, n in end.items()}
        return [Part(f, start.get(f, 0), n) for f, n in sorted(end.items()) if n > start.get(f, 0)]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        system, root = _opened(self.path)
        meeting = partition.file[: -len(self.kind) - 1]
        rows: list[tuple[int, bytes]] = []
        with system.open_input_file(f"{root}/{partition.file}") as f:
            held = 0
            for at, record in (self._frames if self.kind == FRAMES else self._lines)(f, partition):
                rows.append((at, record))
                held += len(record)
                if len(rows) >= PORTION or held >= PORTION_BYTES:
                    yield self._batch(meeting, rows)
                    rows, held = [], 0
        if rows:
            yield self._batch(meeting, rows)

    @staticmethod
    def _batch(meeting: str, rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([meeting] * len(rows)), pa.array([a for a, _ in rows], pa.int64()), pa.array([r for _, r in rows], pa.binary())], schema=_ARROW)

    @staticmethod
    def _frames(f, part: Part) -> Iterator[tuple[int, bytes]]:
        at = part.start
        f.seek(at)
        while at < part.end:
            n = struct.unpack("<I", f.read(4))[0]
            yield at, f.read(n)
            at += 4 + n

    @staticmethod
    def _lines(f, part: Part) -> Iterator[tuple[int, bytes]]:
        at, rest, left = part.start, b"", part.end - part.start
        f.seek(at)
        while left > 0:
            piece = f.read(min(1 << 20, left))
            left -= len(piece)
            *whole, rest = (rest + piece).split(b"\n")
            for line in whole:
                yield at, line
                at += len(line) + 1

    def commit(self, end: dict) -> None:
        pass


class WireLog(DataSource):
    """Options: ``path``, a folder; ``records``, frames or lines, which is also the files' ending; ``mostBytes`` of a file a batch."""

    @classmethod
    def name(cls) -> str:
        return "wire_log"

    def schema(self) -> str:
        return RECORD

    def streamReader(self, schema) -> WireReader:
        kind = self.options.get("records", FRAMES)
        if kind not in (FRAMES, LINES):
            raise ValueError(f"records are {FRAMES} or {LINES}, not {kind}")
        return WireReader(self.options["path"], kind, int(self.options.get("mostBytes", MOST_BYTES)))


@dataclass
class Written(WriterCommitMessage):
    file: str
    rows: int


class EventWriter(DataSourceStreamWriter):
    """Rows with a column ``value`` of JSON text."""

    def __init__(self, path: str, place: int):
        self.path, self.place = path.rstrip("/"), place

    def write(self, iterator) -> Written:
        system, root = _opened(self.path)
        system.create_dir(f"{root}/parts", recursive=True)
        name, n = f"{uuid.uuid4().hex}.jsonl", 0
        with system.open_output_stream(f"{root}/parts/{name}") as out:
            for row in iterator:
                if row[self.place] is not None:
                    out.write(row[self.place].encode() + b"\n")
                    n += 1
        return Written(name, n)

    def commit(self, messages: list[Written | None], batchId: int) -> None:
        system, root = _opened(self.path)
        place = f"{root}/batch-{batchId:020d}.json"
        if system.get_file_info(place).type != fs.FileType.NotFound:
            return self.abort(messages, batchId)  # written before a crash
        parts = [m.file for m in messages if m is not None and m.rows]
        beside = f"{root}/.{uuid.uuid4().hex}"
        with system.open_output_stream(beside) as out:
            out.write(json.dumps({"batch": batchId, "parts": parts}).encode() + b"\n")
        system.move(beside, place)
        for m in messages:
            if m is not None and not m.rows:
                system.delete_file(f"{root}/parts/{m.file}")

    def abort(self, messages: list[Written | None], batchId: int) -> None:
        system, root = _opened(self.path)
        for m in messages:
            if m is not None and system.get_file_info(f"{root}/parts/{m.file}").type != fs.FileType.NotFound:
                system.delete_file(f"{root}/parts/{m.file}")


class EventLog(DataSource):
    """Option: ``path``, a folder. Streams write rows whose column ``value`` is an event's JSON text; a null one is nothing."""

    @classmethod
    def name(cls) -> str:
        return "event_log"

    def schema(self) -> str:
        return "value string"

    def streamWriter(self, schema, overwrite: bool) -> EventWriter:
        return EventWriter(self.options["path"], schema.names.index("value"))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WireLog)
    spark.dataSource.register(EventLog)


def stream_of(spark: SparkSession, path: str, records: str = FRAMES, most_bytes: int = MOST_BYTES) -> DataFrame:
    """(meeting, position, record) of a folder's logs; positions are a file's bytes, so they order its records."""
    register(spark)
    return spark.readStream.format("wire_log").option("path", path).option("records", records).option("mostBytes", str(most_bytes)).load()


def events_of(spark: SparkSession, path: str) -> DataFrame:
    """(batch, value) of all events that a stream has written, by the manifests alone."""
    named = spark.read.schema("batch long, parts array<string>").json(f"{path}/batch-*.json").select("batch", F.explode("parts").alias("part"))
    lines = spark.read.text(f"{path}/parts").select("value", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("part"))
    return lines.join(named, "part").select("batch", "value")
