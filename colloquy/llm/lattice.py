"""Language-model scoring by subword lattice likelihood (operator 6).

The pieces of an existing public vocabulary weigh all segmentations of a word: a piece's probability falls with its
rank among the vocabulary's scores, corrected by its expected uses in the training words (each as often as it stands
there), and a log-space forward recursion over the word's characters sums the products of all ways to cut it up. That
gives every word, seen or not, its marginal probability L(w); over all words they sum to 1 at most. With E, the share of
text ends among the training tokens, a text's score is the log10 of the product of (1 - E) L(w) over its words, and of E
for its end: a distribution over texts. The corpus acts through the pieces' weights and E only.

Beside it, ``mixed_score`` lets whole words' counts in: P(w) = (c(w) + K (1 - E) L(w)) / (N + K), where c and N count
training tokens, ends included, and K is the number of words seen once; words and end sum to 1 there too.

Counts cover all training documents. The most frequent words, a bounded number of them, are broadcast; all others
meet their counts in a join, so the vocabulary may grow with the corpus. A frequent word is never shuffled per
document, and a rare one has few rows: no key is hot.
"""

from __future__ import annotations

import math
from array import array
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_bucket, documents, materialise, mix64

#: Words whose counts are broadcast, and the bytes that such a word has at most: 3.2 MB of words. Others meet theirs in a join.
FREQUENT, FREQUENT_BYTES = 50_000, 64
#: Uses that the vocabulary's own weights count for beside the corpus.
PRIOR = 1_000.0
#: Steps of expectation that fit the pieces' weights.
STEPS = 2
#: Smoothing of the base score (fixed values of the contract).
ALPHA = 0.1
_UPPER = bytes(range(65, 91))
_TABLE = bytes.maketrans(_UPPER, _UPPER.lower())
_START = "▁"


def tokens(text: str) -> list[bytes]:
    """Words, A-Z lower-cased."""
    return text.encode("utf-8", "surrogatepass").translate(_TABLE).split()


def vocabulary(path: str) -> list[tuple[str, float]]:
    """(piece, score) of a sentencepiece model, without control pieces; bytes as one-byte strings of the form <0x..>."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size()) if not model.is_control(i) and not model.is_unknown(i)]


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Lattice:
    """Marginal log10 probability of a word over all segmentations; over all words the probabilities sum to 1 at most.

    ``pieces`` are (piece, score); ``seen`` are expected uses of arcs in the corpus, by label: ``^`` and a piece that
    begins a word, ``+`` and one inside, ``^0`` and ``+0`` for any byte, ``.`` for a word's end.
    """

    def __init__(self, pieces: list[tuple[str, float]], seen: dict[str, float] | None = None):
        seen = seen or {}
        plain = sorted(((s, p) for p, s in pieces if not p.startswith("<0x")), reverse=True)
        # The scores order the pieces; the prior probability falls as one over the rank.
        weight = {p: 1.0 / (r + 10) for r, (_, p) in enumerate(plain)}
        last = 1.0 / (len(plain) + 10)
        first = {p[1:]: w for p, w in weight.items() if p.startswith(_START) and _START not in p[1:]}
        first.setdefault("", last)
        inner = {p: w for p, w in weight.items() if _START not in p}
        # Any byte can follow, at the rate of the last rank each: no text is impossible.
        prior = {"^": sum(first.values()) + 256 * last, "+": sum(inner.values()) + 256 * last}
        uses = {k: sum(n for x, n in seen.items() if x[0] == k) for k in "^+."}

        def log_of(kind: str, name: str, w: float) -> float:
            return math.log((seen.get(kind + name, 0.0) + PRIOR * w / prior[kind]) / (uses[kind] + PRIOR))

        # A word goes on with the inner pieces' share of the uses, before any with their share of the vocabulary.
        share = prior["+"] / (prior["+"] + prior["^"])
        go = math.log((uses["+"] + PRIOR * share) / (uses["+"] + uses["."] + PRIOR))
        self.stop = math.log((uses["."] + PRIOR * (1 - share)) / (uses["+"] + uses["."] + PRIOR))
        self.first = {p: log_of("^", p, w) for p, w in first.items() if p}
        self.bare = log_of("^", "", first[""])  # the bare mark: the first piece holds none of the word's characters
        self.inner = {p: log_of("+", p, w) + go for p, w in inner.items()}
        self.first_byte = log_of("^", "\0", 256 * last) - math.log(256)
        self.inner_byte = log_of("+", "\0", 256 * last) - math.log(256) + go
        self.longest = max(map(len, weight), default=1)
        self.tables = {"+": _Table(self.inner), "^": _Table(self.first)}

    def arcs(self, word: str, i: int) -> list[tuple[int, float, str]]:
        """(from, log probability, label) of the pieces that end at ``i``; -1 is before the word, with nothing written."""
        found = []
        for j in range(max(0, i - self.longest), i):
            piece = word[j:i]
            if j == 0 and (p := self.first.get(piece)) is not None:
                found.append((-1, p, "^" + piece))
            if (p := self.inner.get(piece)) is not None:
                found.append((j, p, "+" + piece))
        width = len(word[i - 1].encode("utf-8", "surrogatepass"))
        found.append((i - 1, width * self.inner_byte, "+\0"))
        if i == 1:
            found.append((-1, self.first_byte + (width - 1) * self.inner_byte, "^\0"))
        return found

    def forward(self, word: str) -> array:
        """Log probability of all ways to have written word[:i], for each i: 8 bytes a character, arcs are not kept."""
        reach = array("d", [self.bare])
        for i in range(1, len(word) + 1):
            terms = [p + reach[j] if j >= 0 else p for j, p, _ in self.arcs(word, i)]
            top = max(terms)
            reach.append(top + math.log(sum([math.exp(t - top) for t in terms])) if len(terms) > 1 else top)
        return reach

    def word(self, raw: bytes) -> float:
        """log10 of the summed probability of all segmentations; linear in the word's length."""
        return (self.forward(raw.decode("utf-8", "replace"))[-1] + self.stop) / math.log(10)

    def expect(self, raw: bytes, into: dict[str, float], times: float = 1.0) -> None:
        """Add the expected uses of each arc in the word, given all its segmentations, ``times`` over."""
        word = raw.decode("utf-8", "replace")
        reach = self.forward(word)
        into["."] = into.get(".", 0.0) + times
        # share[i]: probability that the segmentation has a cut at i.
        share = array("d", bytes(8 * len(word)))
        share.append(1.0)
        for i in range(len(word), -1, -1):
            if share[i] < 1e-9:
                continue
            for j, p, label in self.arcs(word, i) if i else [(-1, self.bare, "^")]:
                use = share[i] * math.exp((reach[j] if j >= 0 else 0.0) + p - reach[i])
                into[label] = into.get(label, 0.0) + use * times
                if j >= 0:
                    share[j] += use


class _Table:
    """Log probabilities of pieces by a 64-bit hash of their code points."""

    def __init__(self, logs: dict[str, float]):
        names, keys = list(logs), np.array([_hash_of(p) for p in logs], np.uint64)
        order = np.argsort(keys)
        self.names = [names[k] for k in order]
        self.keys, self.logs = keys[order], np.append(np.array(list(logs.values()))[order] if logs else [], -np.inf)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Places of hashes; that of -inf for those of no piece."""
        if not len(self.keys):
            return np.zeros(hashes.shape, np.int64)
        at = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
        return np.where(self.keys[at] == hashes, at, len(self.keys))


_STEP = np.uint64(0x9E3779B97F4A7C15)


def _hash_of(piece: str) -> int:
    h = 0
    for c in piece:
        h = h * int(_STEP) + ord(c) + 1
    return int(mix64(np.array([(h + len(piece)) % (1 << 64)], np.uint64))[0])


#: Words up to this length are handled many at once, longer ones alone.
TOGETHER = 24


class Batch:
    """The forward recursion over many words at once, and their expected uses: what Lattice does for one."""

    def __init__(self, lattice: Lattice, words: list[str]):
        self.lattice, n = lattice, len(words)
        self.lengths = np.array([len(w) for w in words])
        size = self.size = int(self.lengths.max())
        codes = np.zeros((n, size), np.uint64)
        inside = np.arange(size) < self.lengths[:, None]
        codes[inside] = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        self.width = 1 + (codes >= 0x80).astype(np.int64) + (codes >= 0x800) + (codes >= 0x10000)
        self.inner: list[np.ndarray] = []
        self.first: list[np.ndarray] = []
        h = np.zeros((n, size), np.uint64)
        for k in range(1, min(size, lattice.longest) + 1):
            h = h[:, : size - k + 1] * _STEP + codes[:, k - 1 :] + np.uint64(1)
            keys = mix64(h + np.uint64(k))
            self.inner.append(lattice.tables["+"].find(keys))
            self.first.append(lattice.tables["^"].find(keys[:, 0]))
        self.reach = np.full((n, size + 1), -np.inf)
        self.reach[:, 0] = lattice.bare
        for i in range(1, size + 1):
            terms = np.stack([t for _, _, t in self.terms(i)])
            top = terms.max(0)
            self.reach[:, i] = top + np.log(np.exp(terms - top).sum(0))
        self.ends = self.reach[np.arange(n), self.lengths]

    def terms(self, i: int) -> list[tuple[str, int, np.ndarray]]:
        """(label, pieces' length, log probability) of the arcs that end at ``i``; lengths of 0 are bytes."""
        lat, reach = self.lattice, self.reach
        out = [("+", 0, reach[:, i - 1] + self.width[:, i - 1] * lat.inner_byte)]
        if i == 1:
            out.append(("^", 0, lat.first_byte + (self.width[:, 0] - 1) * lat.inner_byte))
        if i <= lat.longest:
            out.append(("^", i, lat.tables["^"].logs[self.first[i - 1]]))
        for k in range(1, min(i, lat.longest) + 1):
            out.append(("+", k, reach[:, i - k] + lat.tables["+"].logs[self.inner[k - 1][:, i - k]]))
        return out

    def log10(self) -> np.ndarray:
        return (self.ends + self.lattice.stop) / math.log(10)

    def expect(self, uses: dict[str, np.ndarray], times: np.ndarray) -> None:
        """Add expected uses, each word's ``times`` over: by piece under + and ^, of bytes under +0 and ^0, of the bare mark and of ends."""
        n = len(self.lengths)
        share = np.zeros((n, self.size + 1))
        share[np.arange(n), self.lengths] = times
        for i in range(self.size, 0, -1):
            for label, k, term in self.terms(i):
                use = share[:, i] * np.exp(term - self.reach[:, i])
                if k == 0:
                    uses[label + "0"] += use.sum()
                else:
                    uses[label] += np.bincount(self.inner[k - 1][:, i - k] if label == "+" else self.first[i - 1], use, len(uses[label]))
                if label == "+":
                    share[:, i - max(k, 1)] += use
        uses["bare"] += share[:, 0].sum()
        uses["end"] += times.sum()


def _portions(words: list[bytes], size: int = 4096) -> Iterator[tuple[list[int], list[str]]]:
    """Places and texts of short words, those of like length together."""
    texts = [(k, w.decode("utf-8", "replace")) for k, w in enumerate(words)]
    texts = sorted((x for x in texts if 0 < len(x[1]) <= TOGETHER), key=lambda x: len(x[1]))
    for at in range(0, len(texts), size):
        yield [k for k, _ in texts[at : at + size]], [t for _, t in texts[at : at + size]]


def score_many(lattice: Lattice, words: list[bytes]) -> np.ndarray:
    """Lattice.word of each."""
    out = np.full(len(words), np.nan)
    for places, texts in _portions(words):
        out[places] = Batch(lattice, texts).log10()
    for k in np.flatnonzero(np.isnan(out)):
        out[k] = lattice.word(words[k])
    return out


def expect_many(lattice: Lattice, words: list[bytes], into: dict[str, float], times: np.ndarray | None = None) -> None:
    """Lattice.expect of each."""
    times = np.ones(len(words)) if times is None else times
    uses = {k: np.zeros(len(t.keys) + 1) for k, t in lattice.tables.items()} | {k: 0.0 for k in ("+0", "^0", "bare", "end")}
    done = set()
    for places, texts in _portions(words):
        Batch(lattice, texts).expect(uses, times[places])
        done.update(places)
    for label, table in lattice.tables.items():
        for k in np.flatnonzero(uses[label][:-1]):
            into[label + table.names[k]] = into.get(label + table.names[k], 0.0) + float(uses[label][k])
    for label, k in (("+\0", "+0"), ("^\0", "^0"), ("^", "bare"), (".", "end")):
        into[label] = into.get(label, 0.0) + float(uses[k])
    for k, w in enumerate(words):
        if k not in done:
            lattice.expect(w, into, float(times[k]))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, tokens in training, tokens in all) of a task's texts, in portions."""
    train, held = Counter(), Counter()

    def portion() -> pa.RecordBatch:
        every = list(train.keys() | held.keys())
        return pa.RecordBatch.from_arrays([pa.array(every, pa.binary()), pa.array([train[w] for w in every], pa.int64())], names=["word", "c"])

    for batch in batches:
        for text, out in zip(batch.column(0), batch.column(1).to_pylist()):
            (held if out else train).update(tokens(text.as_py()))
            if len(train) + len(held) > 400_000:
                yield portion()
                train.clear()
                held.clear()
    yield portion()


def _expect(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice, uses = model.value, {}
        for batch in batches:
            expect_many(lattice, batch.column(0).to_pylist(), uses, batch.column(1).to_numpy().astype(float))
        yield pa.RecordBatch.from_arrays([pa.array(list(uses), pa.string()), pa.array(list(uses.values()), pa.float64())], names=["arc", "uses"])

    return run


def _score_words(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = model.value
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score_many(lattice, batch.column(0).to_pylist()))], names=["word", "c", "lattice"])

    return run


class Tokens(NamedTuple):
    """Training tokens of all kinds: n in all, v distinct, ends among them, and words seen once."""

    n: int
    v: int
    ends: int
    once: int

    @property
    def end(self) -> float:
        """The probability that a text ends here."""
        return (self.ends + 0.5) / (self.n + 1)

    @property
    def strength(self) -> float:
        """How many tokens of unseen words to expect: the lattice's weight against the counts, in the mixture."""
        return float(max(1, self.once))

    def base(self, c: int) -> float:
        return math.log10((c + ALPHA) / (self.n + ALPHA * (self.v + 1)))

    def mixed(self, c: int, log: float) -> float:
        """Of a token with ``c`` uses and the log10 probability ``log`` without its count."""
        return math.log10((c + self.strength * 10.0**log) / (self.n + self.strength)) if c else log + math.log10(self.strength / (self.n + self.strength))


def _sum_frequent(frequent, of: Tokens):
    """Per text: sums over its frequent words, and the others as lists of words and of how often each stands there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        goes_on = math.log10(1 - of.end)
        known = {w: (of.base(c), log + goes_on, of.mixed(c, log + goes_on), c > 0) for w, c, log in frequent.value}
        for batch in batches:
            out = [[] for _ in range(7)]
            for text in batch.column(2):
                base = score = mixed = 0.0
                n = n_known = 0
                rare: dict[bytes, int] = {}
                for w, k in Counter(tokens(text.as_py())).items():
                    n += k
                    found = known.get(w)
                    if found is None:
                        rare[w] = k
                    else:
                        base += k * found[0]
                        score += k * found[1]
                        mixed += k * found[2]
                        n_known += k * found[3]
                for column, value in zip(out, (n, n_known, base, score, mixed, list(rare), list(rare.values()))):
                    column.append(value)
            types = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.list_(pa.binary()), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, t) for c, t in zip(out, types))], names=["doc_id", "held_out", "n", "n_known", "base", "score", "mixed", "rare", "times"])

    return run


def fit(counted: DataFrame, pieces: list[tuple[str, float]], steps: int = STEPS) -> Lattice:
    """The lattice of ``pieces`` after ``steps`` steps of expectation over all distinct words (word, c).

    As many rows come back as the vocabulary has arcs, summed in exact decimals: the order in which parts arrive
    leaves no trace.
    """
    model = Lattice(pieces)
    for _ in range(steps):
        shared = counted.sparkSession.sparkContext.broadcast(model)
        uses = counted.filter("c > 0").mapInArrow(_expect(shared), "arc string, uses double")
        seen = {r.arc: float(r.uses) for r in uses.groupBy("arc").agg(F.sum(F.col("uses").cast("decimal(38,9)")).alias("uses")).collect()}
        model = Lattice(pieces, seen)
    return model


def score_texts(df: DataFrame, held_out, vocab_path: str, text: str = "text", row_id: str = "doc_id", frequent: int = FREQUENT) -> DataFrame:
    """Per row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score and mixed_score.

    Null texts count as empty: one token, the end. Ends are counted as tokens of one kind. Without any training text
    every token has count 0. Repeated rows count each. Long texts are scored whole. An empty table gives an empty one;
    other columns, whatever their names, are not read.
    """
    spark = df.sparkSession
    rows = df.select(F.col(f"`{row_id}`").cast("long").alias("doc_id"), held_out.alias("held_out"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    counted = materialise(rows.select("text", "held_out").mapInArrow(_count, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c")))
    model = spark.sparkContext.broadcast(fit(counted, vocabulary(vocab_path)))
    words = materialise(counted.mapInArrow(_score_words(model), "word binary, c long, lattice double"))
    sums = words.agg(F.sum("c").alias("n"), F.count_if(F.col("c") > 0).alias("v"), F.count_if(F.col("c") == 1).alias("once")).first()
    ends = rows.filter(~F.col("held_out")).count()
    of = Tokens((sums.n or 0) + ends, sums.v + (ends > 0), ends, sums.once)
    often = [tuple(r) for r in words.filter(F.octet_length("word") <= FREQUENT_BYTES).orderBy(F.desc("c"), "word").limit(frequent).collect()]
    shared = spark.sparkContext.broadcast([(bytes(w), c, log) for w, c, log in often])

    parts = rows.mapInArrow(_sum_frequent(shared, of), "doc_id long, held_out boolean, n long, n_known long, base double, score double, mixed double, rare array<binary>, times array<long>")
    # Written, so that a row's number stays with it when an executor is lost.
    parts = materialise(parts).withColumn("row", F.monotonically_increasing_id())
    rare = parts.select("row", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("row", F.col("x.rare").alias("word"), F.col("x.times").alias("k"))
    base = F.log10((F.col("c") + ALPHA) / F.lit(of.n + ALPHA * (of.v + 1)))
    score = F.col("lattice") + math.log10(1 - of.end)
    mixed = F.when(F.col("c") > 0, F.log10((F.col("c") + of.strength * F.pow(F.lit(10.0), score)) / F.lit(of.n + of.strength))).otherwise(score + math.log10(of.strength / (of.n + of.strength)))
    sum_of = lambda x, to: F.sum(F.col("k") * x).alias(to)
    tails = rare.join(words, "word").groupBy(F.col("row").alias("of_row")).agg(sum_of(base, "b"), sum_of(score, "s"), sum_of(mixed, "m"), F.sum(F.when(F.col("c") > 0, F.col("k"))).alias("known"))
    joined = parts.join(tails, F.col("row") == F.col("of_row"), "left")
    whole = lambda seen, tail, end: (F.col(seen) + F.coalesce(tail, F.lit(0.0)) + end)
    end = math.log10(of.end)
    return joined.select(
        "doc_id",
        "held_out",
        (F.col("n") + 1).alias("n_tokens"),
        (F.col("n_known") + F.coalesce("known", F.lit(0)) + int(ends > 0)).cast("long").alias("n_known"),
        F.lit(of.n).cast("long").alias("train_tokens"),
        whole("base", "b", of.base(ends)).alias("base_score"),
        whole("score", "s", end).alias("score"),
        whole("mixed", "m", of.mixed(ends, end)).alias("mixed_score"),
    )


def op6_lattice_score(spark, sf_dir: str) -> DataFrame:
    return score_texts(documents(spark, sf_dir), crc_bucket("doc_id", 10) == 0, default_vocabulary())
