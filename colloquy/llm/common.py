"""Helpers the training-data operators share: tables, cut points, and word hashing over Arrow text."""

from __future__ import annotations

import functools
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that separates words in every contract of this subpackage.
SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"
#: The same, as Spark's translate() takes it.
SPACE_CHARS = " \t\n\x0b\x0c\r"
#: Bytes of text handled at once inside a task; bounds the numpy temporaries. A longer text is handled alone, whole.
SLICE_BYTES = (1 << 18) - 1


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet in the cluster's shared checkpoint folder and read it back.

    Cuts the lineage: a lost executor re-reads files that all executors see instead of recomputing.
    The folder is what ``spark.checkpoint.dir`` names; where that is unset (tests, a local session)
    the warehouse folder serves.
    """
    spark = df.sparkSession
    root = spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_scratch"
    path = f"{root.rstrip('/')}/colloquy-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def free_names(taken: list[str], *wanted: str) -> list[str]:
    """``wanted`` names for new columns, each with underscores after it where the caller's columns have it, in any case."""
    held, out = {c.lower() for c in taken}, []
    for name in wanted:
        while name.lower() in held:
            name += "_"
        held.add(name.lower())
        out.append(name)
    return out


#: Bits of the bitmap that tells rows that may have a given key from those that have not: 65,536 words, 1 MB.
MARK_BITS = 1 << 22


def marked(rows: DataFrame, key_hash: Column, keys: DataFrame, hash_of_keys: Column) -> DataFrame:
    """``rows`` with ``maybe``, false only where the row's key is none of ``keys``.

    A bitmap of fixed size is broadcast, so that rows of other keys, long ones for most, need no shuffle to find that
    out. The more keys there are, the more rows pass that need not; at worst all do, which costs what a join costs.
    """
    slot = lambda h: F.pmod(h, F.lit(MARK_BITS).cast("long"))
    words = keys.select(slot(hash_of_keys).alias("slot")).groupBy(F.shiftright("slot", 6).alias("word"))
    words = words.agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("slot") % 64).cast("int"))).alias("bits"))
    slotted = rows.withColumn("slot", slot(key_hash)).withColumn("word", F.shiftright("slot", 6))
    bit = F.call_function("shiftright", F.col("bits"), (F.col("slot") % 64).cast("int")).bitwiseAND(F.lit(1).cast("long"))
    return slotted.join(F.broadcast(words), "word", "left").withColumn("maybe", F.coalesce(bit == 1, F.lit(False))).drop("slot", "word", "bits")


def keep_rows(df: DataFrame, keys: list[Column], stay: DataFrame, many: DataFrame, gone: DataFrame | None = None) -> DataFrame:
    """The rows of ``df`` whose ``keys`` are a row of ``stay``, with all their columns, whatever their names.

    ``stay`` holds each key once, nulls equal to nulls. Keys that are also in ``many`` are those of several rows: of
    them the row with the least hash of all columns stays. ``gone``, if given, has all other keys of ``df``: rows that
    are surely neither of them nor of ``many`` stay where they are, and only the rest is shuffled.
    """
    names = [f"k{i}" for i in range(len(keys))]
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), *[k.alias(n) for k, n in zip(keys, names)])

    certain = None
    if gone is not None:
        doubtful = gone.toDF(*names).unionByName(many.select(*many.columns[: len(keys)]).toDF(*names))
        rows = marked(rows, F.xxhash64(*names), doubtful, F.xxhash64(*names))
        certain = rows.filter("not maybe").select("row")
        rows = rows.filter("maybe").select("row", *names)

    def on(other: DataFrame, how: str, these: DataFrame) -> DataFrame:
        other = other.toDF(*[f"of_{n}" for n in names])
        same = functools.reduce(lambda a, b: a & b, [F.col(n).eqNullSafe(F.col(f"of_{n}")) for n in names])
        return these.join(other, same, how).select("row", *names)

    kept = on(stay.select(*stay.columns[: len(keys)]), "left_semi", rows)
    many = many.select(*many.columns[: len(keys)])
    kept_rows = kept.select("row")
    if not many.isEmpty():
        one = on(many, "left_semi", kept).groupBy(*names).agg(F.min_by("row", F.xxhash64("row")).alias("row")).select("row")
        kept_rows = on(many, "left_anti", kept).select("row").unionByName(one)
    return (kept_rows if certain is None else certain.unionByName(kept_rows)).select("row.*")


def crc_bucket(id_col: str, n: int):
    """crc32 of the id as text, modulo ``n``; null ids count as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(n))


def text_slices(column: pa.Array, max_bytes: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets into them) over a text column; null counts as empty."""
    column = column.fill_null("") if column.null_count else column
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        end = int(np.searchsorted(offsets, offsets[row] + max_bytes, "right")) - 1
        end = min(max(end, row + 1), len(column))
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_MULTIPLIER), -1, 1 << 64))
_POWERS: dict[str, np.ndarray] = {}


def _powers(which: str, n: int) -> np.ndarray:
    """base ** (0..n-1) modulo 2**64."""
    have = _POWERS.get(which)
    if have is None or len(have) < n:
        size = max(1 << 16, 1 << int(n - 1).bit_length())
        base = _MULTIPLIER if which == "up" else _INVERSE
        steps = np.full(size, base, np.uint64)
        steps[0] = 1
        have = _POWERS[which] = np.cumprod(steps, dtype=np.uint64)
    return have[:n]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE_VALUES = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(SPACES)] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def words(data: np.ndarray, offsets: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document index, start, end, 64-bit hash) of every white-space separated word, in order.

    Words never run across a document's end. The hash covers every byte and the length.
    """
    space = _IS_SPACE[data]
    edge = np.ones(len(data) + 1, bool)
    np.not_equal(space[1:], space[:-1], out=edge[1:-1])
    edge[offsets] = True
    cuts = np.flatnonzero(edge)
    starts, ends = cuts[:-1], cuts[1:]
    if len(data):
        real = ~space[starts]
        starts, ends = starts[real], ends[real]
    values = _BYTE_VALUES[_LOWER[data]] if lower else _BYTE_VALUES[data]
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(values * _powers("up", len(data)), out=sums[1:])
    hashes = (sums[ends] - sums[starts]) * _powers("down", len(data) + 1)[starts]
    hashes = mix64(hashes + (ends - starts).astype(np.uint64) * np.uint64(0xA0761D6478BD642F))
    return np.searchsorted(offsets, starts, "right") - 1, starts, ends, hashes


def window_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of ``width`` consecutive words (order matters); document ends are the caller's."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for k in range(width):
        total = total * np.uint64(0xE7037ED1A0B428DB) + hashes[k : k + n]
    return mix64(total)
