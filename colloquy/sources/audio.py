"""Audio frames and files: wire frames, 16-bit PCM, and WAV folders as tables."""

from __future__ import annotations

import io
import wave

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, FloatType

SAMPLE_RATE = 16_000
#: Channel by a frame's first byte (fixed values); frames of other channels are dropped.
CHANNELS = {0: "mic", 1: "system"}


@F.pandas_udf(ArrayType(FloatType()))
def pcm_to_samples(pcm: pd.Series) -> pd.Series:
    """Little-endian 16-bit samples over 32768; an odd last byte is ignored."""
    return pcm.map(lambda b: None if b is None else np.frombuffer(b[: len(b) // 2 * 2], "<i2").astype(np.float32) / 32768.0)


@F.pandas_udf(BinaryType())
def samples_to_wav(samples: pd.Series) -> pd.Series:
    """A mono 16-bit WAV file of samples, clipped, times 32767."""

    def pack(x) -> bytes:
        out = io.BytesIO()
        with wave.open(out, "wb") as w:
            w.setnchannels(1)
            w.setsampwidth(2)
            w.setframerate(SAMPLE_RATE)
            w.writeframes((np.clip(np.asarray(x, np.float64), -1, 1) * 32767).astype("<i2").tobytes())
        return out.getvalue()

    return samples.map(lambda x: None if x is None else pack(x))


def encode_frames(spoken: DataFrame, keys: list[str], samples: str = "samples", size: int = 1_600) -> DataFrame:
    """Samples as a client sends them: per row, frames (no, level, frame) of ``size`` samples, each a channel byte and PCM.

    Samples are clamped to 1; negative ones are scaled by 32768 and others by 32767, and a frame's level is its root
    mean square. What is left at the end, less than a frame, is not sent. ``spoken`` has a column channel.
    """
    known = {name: tag for tag, name in CHANNELS.items()}

    @F.pandas_udf("array<struct<no:long,level:double,frame:binary>>")
    def cut_up(channel: pd.Series, x: pd.Series) -> pd.Series:
        def one(name: str, values) -> list[dict]:
            v = np.clip(np.asarray(values, np.float64), -1, 1)
            v = v[: len(v) // size * size].reshape(-1, size)
            pcm = np.trunc(np.where(v < 0, v * 0x8000, v * 0x7FFF)).astype("<i2")
            return [{"no": k, "level": float(np.sqrt(np.mean(row * row))), "frame": bytes([known[name]]) + words.tobytes()} for k, (row, words) in enumerate(zip(v, pcm))]

        return pd.Series([one(c, v) if c in known and v is not None else [] for c, v in zip(channel, x)])

    return spoken.select(*keys, "channel", F.explode(cut_up("channel", samples)).alias("f")).select(*keys, "channel", "f.*")


def recordings(frames: DataFrame, key: str, order: str) -> DataFrame:
    """One WAV per ``key`` and channel of decoded frames (channel, samples): (key, channel, wav), each channel as it came, not mixed."""
    gathered = frames.groupBy(key, "channel").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(order, "samples"))), lambda f: f["samples"])).alias("samples"))
    return gathered.select(key, "channel", samples_to_wav("samples").alias("wav"))


def print_recording(samples: Column, seconds: float = 8.0) -> Column:
    """(wav, seconds, name) of a print's recording: its first ``seconds``, under a name of eight hexadecimal digits from its content."""
    kept = F.slice(samples, 1, int(seconds * SAMPLE_RATE))
    wav = samples_to_wav(kept)
    return F.struct(wav.alias("wav"), (F.size(kept) / SAMPLE_RATE).alias("seconds"), F.concat(F.left(F.sha2(F.to_json(F.struct(kept.alias("x"))).cast("binary"), 256), F.lit(8)), F.lit(".wav")).alias("name"))


def read_frames(frames: DataFrame, payload: str = "frame") -> DataFrame:
    """Wire frames, a channel byte and PCM, as channel and samples; empty frames and unknown channels go."""
    tag = F.conv(F.hex(F.substring(payload, 1, 1)), 16, 10).cast("int")
    channel = F.element_at(F.create_map(*[F.lit(x) for kv in CHANNELS.items() for x in kv]), tag)
    known = frames.filter(F.octet_length(payload) >= 2).withColumn("channel", channel).filter(F.col("channel").isNotNull())
    return known.withColumn("samples", pcm_to_samples(F.substr(payload, F.lit(2))))


def read_wavs(spark: SparkSession, folder: str) -> DataFrame:
    """WAV files below a folder: person (the file's folder), path, samples and why a file can't be read.

    Other rates, widths and numbers of channels are converted: channels are averaged, rates interpolated.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.wav").load(folder)

    def samples_of(blob: bytes) -> np.ndarray:
        with wave.open(io.BytesIO(blob), "rb") as w:
            channels, width, rate, raw = w.getnchannels(), w.getsampwidth(), w.getframerate(), w.readframes(w.getnframes())
        if width == 1:
            x = (np.frombuffer(raw, np.uint8).astype(np.float64) - 128) / 128
        elif width in (2, 4):
            x = np.frombuffer(raw, f"<i{width}") / float(1 << (8 * width - 1))
        else:
            raise wave.Error(f"a width of {width} bytes")
        x = x.reshape(-1, channels).mean(1)
        if rate != SAMPLE_RATE and len(x):
            x = np.interp(np.arange(int(len(x) * SAMPLE_RATE / rate)) * rate / SAMPLE_RATE, np.arange(len(x)), x)
        return x.astype(np.float32)

    @F.pandas_udf("samples array<float>, problem string")
    def decode(content: pd.Series) -> pd.DataFrame:
        rows = []
        for blob in content:
            try:
                rows.append((samples_of(blob), None))
            except (wave.Error, EOFError, ValueError) as e:
                rows.append((None, str(e) or type(e).__name__))
        return pd.DataFrame(rows, columns=["samples", "problem"])

    parts = F.split("path", "/")
    read = files.withColumn("wav", decode("content"))
    return read.select(F.element_at(parts, -2).alias("person"), "path", "wav.samples", "wav.problem")


def cut(samples: Column, start_s: Column, end_s: Column) -> Column:
    """Samples between two times, clamped to what there is."""
    first = F.greatest(F.floor(start_s * SAMPLE_RATE), F.lit(0)).cast("int")
    last = F.least(F.floor(end_s * SAMPLE_RATE), F.size(samples)).cast("int")
    return F.slice(samples, first + 1, F.greatest(last - first, F.lit(0)))


def level(samples: Column) -> Column:
    """Root mean square; 0 for nothing."""
    total = F.aggregate(samples, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    return F.when(F.size(samples) > 0, F.sqrt(total / F.size(samples))).otherwise(0.0)
