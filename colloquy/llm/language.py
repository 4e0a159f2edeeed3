"""Language identification by word-first backoff (operator 9).

A word seen in training scores by its log frequency per language; an unseen one falls back to its character
n-grams, from the longest length of which training knows one down to single letters. A text's score sums over its
words, and the posterior of the best language is returned.

The model is fitted on a bounded sample: at most ``SAMPLE_DOCS`` distinct labelled texts a language, drawn by a hash,
of at most ``SAMPLE_TEXT_BYTES`` each and ``SAMPLE_BYTES`` together.
All words and n-grams of the sample are kept. What is broadcast grows with the languages and the sample's vocabulary,
not with the input. Every document is scored whole.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import crc_bucket, documents, materialise

SAMPLE_DOCS = 1_500
#: Bytes that a text of the sample has at most, and all texts of a language together: longer texts teach nothing.
SAMPLE_TEXT_BYTES, SAMPLE_BYTES = 1 << 15, 1 << 23
LONGEST_GRAM = 4
#: Distinct words whose scores a worker remembers.
REMEMBERED = 300_000
#: Words of a very long text that are looked up at once.
PART = 50_000
_LETTERS = re.compile(r"[^\W\d_]+")
UNDETERMINED = "und"


def letter_runs(text: str) -> list[str]:
    return _LETTERS.findall(text.lower())


def grams(word: str, n: int) -> list[str]:
    """Character n-grams of a word between marks for its ends; single letters come without the marks."""
    if n == 1:
        return list(word)
    marked = f"\x02{word}\x03"
    return [marked[i : i + n] for i in range(len(marked) - n + 1)]


class Model:
    """Log frequencies per language of words and of character n-grams by length."""

    def __init__(self, langs: list[str], words: dict[str, list[int]], pieces: dict[str, list[int]], docs: list[int]):
        self.langs = langs
        self.prior = np.log(np.array(docs, float) + 1.0)
        self.words = self._logs(words)
        by_length: dict[int, dict[str, list[int]]] = {}
        for g, counts in pieces.items():
            by_length.setdefault(len(g), {})[g] = counts
        self.pieces = {n: self._logs(table) for n, table in by_length.items()}
        self.known: dict[str, int] = {}
        self.table = np.zeros((1024, len(langs)), np.float32)

    def _logs(self, counts: dict[str, list[int]]) -> tuple[dict[str, int], np.ndarray]:
        """Rows by entry, and the rows."""
        if not counts:
            return {}, np.zeros((0, len(self.langs)), np.float32)
        table = np.array(list(counts.values()), float) + 0.05
        logs = np.log(table / table.sum(0))
        # Only differences between languages decide; an entry's mean is taken off so that long texts stay in range.
        return dict(zip(counts, range(len(counts)))), (logs - logs.mean(1, keepdims=True)).astype(np.float32)

    def word(self, word: str) -> np.ndarray:
        rows, logs = self.words
        if (found := rows.get(word)) is not None:
            return logs[found]
        for n in range(LONGEST_GRAM, 0, -1):
            rows, logs = self.pieces.get(n, ({}, None))
            if rows and (hits := [rows[g] for g in grams(word, n) if g in rows]):
                return np.sum(logs[hits], axis=0) / math.sqrt(len(hits))
        return np.zeros(len(self.langs), np.float32)

    def _row(self, word: str) -> int:
        row = self.known[word] = len(self.known)
        if row >= len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        self.table[row] = self.word(word)
        return row

    def predict(self, text: str | None) -> tuple[str, float]:
        found = letter_runs(text or "")
        if not self.langs or not any(c.isalpha() for w in found for c in w):
            return UNDETERMINED, 0.0
        total, get = self.prior - self.prior.max(), self.known.get
        for at in range(0, len(found), PART):
            part = found[at : at + PART]
            if len(self.known) + len(part) > REMEMBERED:
                self.known.clear()
            rows = [r if (r := get(w)) is not None else self._row(w) for w in part]
            total = total + self.table[rows].sum(0, dtype=np.float64)
        weights = np.exp(total - total.max())
        best = int(weights.argmax())
        return self.langs[best], float(weights[best] / weights.sum())


def fit(df: DataFrame, text: str = "text", lang: str = "lang", sample_docs: int = SAMPLE_DOCS) -> Model:
    """A model of the labelled rows of ``df``; rows without text or label teach nothing."""
    rows = df.filter(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"))
    rows = rows.withColumn("key", F.xxhash64("text"))
    keys = materialise(rows.groupBy("lang", "key").agg(F.count("*").alias("n"), F.max(F.octet_length("text")).alias("bytes")))
    short = F.col("bytes") <= SAMPLE_TEXT_BYTES
    totals = {r.lang: r for r in keys.groupBy("lang").agg(F.sum("n").alias("n"), F.count_if(short).alias("texts")).collect()}
    langs = sorted(totals)
    if not langs:
        return Model([], {}, {}, [])
    per_lang = lambda values: F.element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), F.col("lang"))
    # Some more than the sample by a share of the distinct texts; then the lowest keys of these, exactly as many as it takes.
    likely = F.pmod(F.col("key"), F.lit(1_000_000)) < per_lang({k: min(1_000_000, (2 * sample_docs + 100) * 1_000_000 // max(1, totals[k].texts) + 1) for k in langs})
    by_key = Window.partitionBy("lang").orderBy("key")
    ranked = keys.filter(likely & short).select("lang", "key", F.row_number().over(by_key).alias("rank"), F.sum("bytes").over(by_key).alias("upto"))
    last = {r.lang: r.key for r in ranked.filter((F.col("rank") <= sample_docs) & (F.col("upto") <= SAMPLE_BYTES)).groupBy("lang").agg(F.max("key").alias("key")).collect()}
    drawn = likely & (F.octet_length("text") <= SAMPLE_TEXT_BYTES) & (F.col("key") <= per_lang({k: last.get(k, -(1 << 63)) for k in langs}))
    sample = rows.filter(drawn).groupBy("lang", "key").agg(F.min("text").alias("text")).select("text", "lang")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally: dict[tuple[str, int, str], int] = {}
        for batch in batches:
            for body, k in zip(batch.column(0), batch.column(1)):
                which = k.as_py()
                for w in letter_runs(body.as_py()):
                    tally["w", which, w] = tally.get(("w", which, w), 0) + 1
        out: dict[tuple[str, int, str], int] = dict(tally)
        for (_, which, w), n in tally.items():
            for length in range(1, LONGEST_GRAM + 1):
                for g in grams(w, length):
                    out["g", which, g] = out.get(("g", which, g), 0) + n
        kinds, whiches, items = zip(*out) if out else ((), (), ())
        for at in range(0, len(items), 50_000):
            cut = slice(at, at + 50_000)
            yield pa.RecordBatch.from_arrays([pa.array(kinds[cut]), pa.array(whiches[cut]), pa.array(items[cut]), pa.array(list(out.values())[cut], pa.int64())], names=["kind", "lang", "item", "n"])

    seen = sample.mapInArrow(count, "kind string, lang string, item string, n long").groupBy("kind", "item").pivot("lang", langs).agg(F.sum("n")).na.fill(0)
    found = seen.toArrow().sort_by([("kind", "ascending"), ("item", "ascending")])
    tables: dict[str, dict[str, list[int]]] = {"w": {}, "g": {}}
    for batch in found.to_batches(max_chunksize=50_000):
        counts = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns[2:]], axis=1).tolist()
        for kind, item, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), counts):
            tables[kind][item] = n
    return Model(langs, tables["w"], tables["g"], [totals[k].n for k in langs])


def identify(df: DataFrame, model: Model, text: str = "text", row_id: str = "doc_id") -> DataFrame:
    """Per row: doc_id, lang_pred and score. Null texts, and those without a letter, are ``und`` with score 0.

    Row by row: repeated rows get the same answer, an empty table gives an empty one, very long texts are read whole, in
    parts. Of languages that tie, the first by name wins. Other columns, whatever their names, are not read.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            found = [own.predict(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], names=["doc_id", "lang_pred", "score"])

    return df.select(F.col(f"`{row_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double")


def op9_language_id(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held_out = crc_bucket("doc_id", 4) == 2
    model = fit(docs.filter(~held_out))
    return identify(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
