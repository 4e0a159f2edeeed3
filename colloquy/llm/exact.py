"""Exact deduplication by Grace hashing (operator 10).

Records are partitioned by a digest of their content, first by Spark's shuffle and then, inside a task,
by further digest bits into spill files, level by level, until a bucket fits an open-addressing table that
compares complete contents. The same step runs on each input partition before the shuffle, so that a
content sends one record per input partition, however many copies it has: a hot group never meets in one
task. Spill files are a task's own scratch, like Spark's own spills: written, read and deleted within one
task attempt and never seen by another process.
"""

from __future__ import annotations

import os
import shutil
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CHARS, documents, keep_rows, materialise

#: Content bytes that one open-addressing table may hold before its bucket is split into spill files.
TABLE_BYTES = 48 << 20
FAN_OUT = 32
_SCHEMA = pa.schema([("digest", pa.binary()), ("content", pa.string()), ("n_points", pa.int64()), ("best_id", pa.int64()), ("group_size", pa.int64()), ("n_best", pa.int64())])
_SQL_SCHEMA = "digest binary, content string, n_points long, best_id long, group_size long, n_best long"


def _better(points: int, row_id: int | None, than_points: int, than_id: int | None) -> bool:
    """More code points, then the smaller id; a null id comes last."""
    if points != than_points:
        return points > than_points
    return row_id is not None and (than_id is None or row_id < than_id)


class ContentTable:
    """Open addressing with linear probing; an entry is one content with its best row and its count."""

    def __init__(self):
        self.slots: list[int] = [-1] * 1024
        self.entries: list[list] = []
        self.bytes = 0

    def add(self, digest: bytes, content: str, points: int, row_id: int | None, count: int, n_best: int) -> None:
        if len(self.entries) * 2 >= len(self.slots):
            self._grow()
        mask = len(self.slots) - 1
        at = int.from_bytes(digest[:8], "little") & mask
        while (k := self.slots[at]) >= 0:
            entry = self.entries[k]
            if entry[0] == digest and entry[1] == content:
                if (points, row_id) == (entry[2], entry[3]):
                    entry[5] += n_best
                elif _better(points, row_id, entry[2], entry[3]):
                    entry[2], entry[3], entry[5] = points, row_id, n_best
                entry[4] += count
                return
            at = (at + 1) & mask
        self.slots[at] = len(self.entries)
        self.entries.append([digest, content, points, row_id, count, n_best])
        self.bytes += len(content) + 160

    def _grow(self) -> None:
        self.slots = [-1] * (4 * len(self.slots))
        mask = len(self.slots) - 1
        for k, entry in enumerate(self.entries):
            at = int.from_bytes(entry[0][:8], "little") & mask
            while self.slots[at] >= 0:
                at = (at + 1) & mask
            self.slots[at] = k

    def batches(self) -> Iterator[pa.RecordBatch]:
        start = size = 0
        for k, entry in enumerate(self.entries):
            size += len(entry[1])
            if size > 4 << 20 or k + 1 == len(self.entries):
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*self.entries[start : k + 1]), _SCHEMA)], schema=_SCHEMA)
                start, size = k + 1, 0


def _scatter(batches: Iterator[pa.RecordBatch], folder: str, level: int) -> list[str]:
    """Spill files of the records, dealt by the level's digest byte."""
    names = [os.path.join(folder, f"{level}-{k}.arrow") for k in range(FAN_OUT)]
    writers: dict[int, pa.ipc.RecordBatchStreamWriter] = {}
    try:
        for batch in batches:
            bucket = [d[8 + level % 20] % FAN_OUT for d in batch.column(0).to_pylist()]
            for k in set(bucket):
                if k not in writers:
                    writers[k] = pa.ipc.new_stream(names[k], _SCHEMA, options=pa.ipc.IpcWriteOptions(compression="lz4"))
                writers[k].write_batch(batch.filter(pa.array([b == k for b in bucket])))
    finally:
        for w in writers.values():
            w.close()
    return [names[k] for k in sorted(writers)]


def _spilled(path: str) -> Iterator[pa.RecordBatch]:
    with pa.ipc.open_stream(path) as stream:
        yield from stream
    os.remove(path)


def grace_merge(batches: Iterator[pa.RecordBatch], table_bytes: int = TABLE_BYTES, level: int = 0, scratch: str | None = None) -> Iterator[pa.RecordBatch]:
    """One record per distinct content of ``batches``; contents beyond ``table_bytes`` go through spill files."""
    table = ContentTable()
    batches = iter(batches)
    for batch in batches:
        # Sliced, so that one wide batch does not become Python objects all at once.
        for at in range(0, batch.num_rows, 256):
            for row in zip(*(c.to_pylist() for c in batch.slice(at, 256).columns)):
                table.add(*row)
        if table.bytes > table_bytes and level < 20 and len(table.entries) > 1:
            break
    else:
        yield from table.batches()
        return
    folder = tempfile.mkdtemp(prefix="grace-", dir=scratch)
    try:
        held = table.batches()
        table = None

        def both() -> Iterator[pa.RecordBatch]:
            yield from held
            yield from batches

        for path in _scatter(both(), folder, level):
            yield from grace_merge(_spilled(path), table_bytes, level + 1, folder)
    finally:
        shutil.rmtree(folder, ignore_errors=True)


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return grace_merge(pa.RecordBatch.from_arrays(b.columns, names=_SCHEMA.names) for b in batches)


def _content(text: str) -> Column:
    """The text without white space; null counts as empty."""
    return F.translate(F.coalesce(F.col(f"`{text}`"), F.lit("")), SPACE_CHARS, "")


def _keys(text: str, row_id: str) -> list[Column]:
    """What names a row of a group: the content's digest, the id and the code points of the original text."""
    return [F.unhex(F.sha2(_content(text).cast("binary"), 256)), F.col(f"`{row_id}`").cast("long"), F.coalesce(F.length(F.col(f"`{text}`")), F.lit(0)).cast("long")]


def content_groups(df: DataFrame, text: str = "text", row_id: str = "doc_id") -> DataFrame:
    """One row per distinct content: digest, best_id and n_points of the row that stays, group_size and n_best.

    Contents are equal when identical without white space. Of a group's rows the one with the most code points
    stays, then the smallest id. ``n_best`` counts rows that tie in both, which only repeated ids can.
    """
    digest, best, points = _keys(text, row_id)
    one = F.lit(1).cast("long")
    records = df.select(digest.alias("digest"), _content(text).alias("content"), points.alias("n_points"), best.alias("best_id"), one.alias("group_size"), one.alias("n_best"))
    merged = records.mapInArrow(_merge, _SQL_SCHEMA).repartition("digest").mapInArrow(_merge, _SQL_SCHEMA)
    return materialise(merged.drop("content"))


def exact_groups(df: DataFrame, text: str = "text", row_id: str = "doc_id") -> DataFrame:
    """Per row: keep_id, group_size, kept, text_sha256, beside the id.

    Null text counts as empty; all empty texts are one group. A null id is kept only where no row of its group
    with as many code points has one. Rows of one id that tie in code points too are one document: each says the same.
    Of rows of one id with other white space, those with the most code points are kept. An empty table gives an empty
    one. Other columns, whatever their names, are not read.
    """
    digest, row, points = _keys(text, row_id)
    rows = df.select(digest.alias("of"), row.alias("doc_id"), points.alias("points"))
    joined = rows.join(content_groups(df, text, row_id), F.col("of") == F.col("digest"))
    return joined.select(
        "doc_id",
        F.col("best_id").alias("keep_id"),
        "group_size",
        (F.col("doc_id").eqNullSafe(F.col("best_id")) & (F.col("points") == F.col("n_points"))).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def exact_dedup(df: DataFrame, text: str = "text", row_id: str = "doc_id") -> DataFrame:
    """The rows that stay, exactly one per content, with all their columns, whatever their names.

    Nulls, empty texts and repeats as in ``exact_groups``; where a survivor's row is itself repeated, one of the
    repeats stays, the least by a hash of all columns.
    """
    groups = content_groups(df, text, row_id).select("digest", "best_id", "n_points", "n_best")
    return keep_rows(df, _keys(text, row_id), groups, groups.filter("n_best > 1"))


def op10_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_groups(documents(spark, sf_dir))


OP10_SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS body FROM documents
), g AS (
  SELECT doc_id, body, first_value(doc_id) OVER (PARTITION BY body ORDER BY n DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY body) AS group_size FROM d
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(body) AS text_sha256 FROM g
"""
