"""Toxicity by a bidirectional gated recurrent network with attention pooling (operator 4).

A text's words run through overlapping windows of ``WINDOW`` words, ``STRIDE`` apart. A word enters as the sum of an
embedding of its own, where training knew it, and the mean embedding of its hashed character n-grams. Two gated
recurrent layers read the window in both directions, attention weighs their states, and a logistic unit scores the
pooled state. A text's score is that of its worst window; all windows of all texts are scored. A word is read in
pieces of ``PIECE`` letters, ``PIECE_STEP`` apart, and most words are one piece: a piece enters with the embedding of its
whole word and the n-grams of its own letters, so that of unspaced text too every letter reaches the network.

The network is trained in numpy on a bounded sample of labelled texts (``SAMPLE_TOXIC`` and ``SAMPLE_CLEAN``, of at most
``SAMPLE_WORDS`` words each, drawn by a hash of the id). A label holds for a text, not for its windows, so each toxic
text teaches by the windows where its words are most peculiar to toxic texts, and each clean one by its most suspicious
and by other windows. Beyond the sample nothing is cut. The trained model, of a size its parameters fix, is broadcast.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_bucket, documents, mix64

WINDOW, STRIDE = 16, 8
SAMPLE_TOXIC, SAMPLE_CLEAN, SAMPLE_WORDS = 1_200, 1_800, 4_000
#: Letters of a piece, and how far apart the pieces of a word begin.
PIECE, PIECE_STEP = 12, 4
EMBED, HIDDEN, ATTEND = 12, 8, 8
VOCABULARY, GRAMS = 20_000, 1 << 15
EPOCHS, BATCH, RATE = 14, 256, 0.01
#: Distinct words whose inputs a worker remembers.
REMEMBERED = 100_000
#: Windows of a very long text that are laid out at once.
PORTION = 40_000
#: Texts and windows that run through the network at once.
TEXTS_AT_ONCE = 64
WINDOWS_AT_ONCE = 1_024
_LETTERS = re.compile(r"[^\W\d_]+")


def letter_runs(text: str | None) -> list[str]:
    """The pieces of a text's letter runs; those of a run of several carry, after a zero, the digest of the whole run."""
    runs = _LETTERS.findall((text or "").lower())
    if max(map(len, runs), default=0) <= PIECE:
        return runs
    out = []
    for r in runs:
        if len(r) <= PIECE:
            out.append(r)
        else:
            whole = f"\0{zlib.crc32(r.encode()):08x}"
            out += [r[k : k + PIECE] + whole for k in range(0, len(r) - PIECE + PIECE_STEP, PIECE_STEP)]
    return out


def whole_word(piece: str) -> str:
    """What tells the word of a piece from others: itself, or its digest."""
    return piece[piece.find("\0") :] if "\0" in piece else piece


def gram_ids(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, bounds): piece i's n-grams of 3 to 5 bytes, ends marked, are hashes[bounds[i]:bounds[i + 1]]."""
    raw = [f"<{w.partition('\0')[0]}>".encode() for w in words]
    lengths = np.array([len(r) for r in raw], np.int64)
    data = np.frombuffer(b"".join(raw), np.uint8).astype(np.uint64) + np.uint64(1)
    owner, ends = np.repeat(np.arange(len(raw)), lengths), np.repeat(np.cumsum(lengths), lengths)
    ids, owners = [], []
    for n in (3, 4, 5):
        size = max(0, len(data) - n + 1)
        h = np.zeros(size, np.uint64)
        for k in range(n):
            h = h * np.uint64(0x100000001B3) + data[k : k + size]
        inside = np.arange(size) + n <= ends[:size]
        ids.append(mix64(h[inside] + np.uint64(n)) % np.uint64(GRAMS))
        owners.append(owner[:size][inside])
    who = np.concatenate(owners)
    order = np.argsort(who, kind="stable")
    return np.concatenate(ids)[order].astype(np.int64), np.concatenate([[0], np.cumsum(np.bincount(who, minlength=len(raw)))])


def window_starts(n: int) -> range:
    return range(0, max(1, n - STRIDE), STRIDE)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Network:
    """Parameters, forward pass and gradients. Inputs are rows of per-word vectors, padded in front of nothing."""

    def __init__(self, words: dict[str, int], seed: int = 11):
        rng = np.random.default_rng(seed)
        draw = lambda *shape, by: rng.normal(0, by, shape).astype(np.float32)
        self.words = words
        self.p = {"word": draw(len(words) + 1, EMBED, by=0.05), "gram": draw(GRAMS, EMBED, by=0.05)}
        for d in "fb":
            self.p |= {f"W{d}": draw(EMBED, 3 * HIDDEN, by=0.4), f"U{d}": draw(HIDDEN, 3 * HIDDEN, by=0.3), f"c{d}": np.zeros(3 * HIDDEN, np.float32)}
        self.p |= {"A": draw(2 * HIDDEN, ATTEND, by=0.3), "v": draw(ATTEND, by=0.3), "o": draw(2 * HIDDEN, by=0.3), "b": np.zeros(1, np.float32)}

    def inputs(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Vectors of words, and what they were made of: word rows, flat n-grams and where each word's begin."""
        rows = np.array([self.words.get(whole_word(w), -1) + 1 for w in words], np.int64)
        flat, starts = gram_ids(words)
        mean = np.add.reduceat(self.p["gram"][flat], starts[:-1]) / np.diff(starts)[:, None]
        return (np.where(rows[:, None] > 0, self.p["word"][rows], 0) + mean).astype(np.float32), rows, flat, starts

    def _layer(self, projected: np.ndarray, mask: np.ndarray, d: str, keep: list | None) -> np.ndarray:
        """States (time, windows, hidden); steps where the mask is 0 carry the state on."""
        u, h = self.p[f"U{d}"], np.zeros((projected.shape[1], HIDDEN), np.float32)
        out = np.empty((*projected.shape[:2], HIDDEN), np.float32)
        for t in range(len(projected)) if d == "f" else range(len(projected) - 1, -1, -1):
            gates = _sigmoid(projected[t, :, : 2 * HIDDEN] + h @ u[:, : 2 * HIDDEN])
            z, r = gates[:, :HIDDEN], gates[:, HIDDEN:]
            n = np.tanh(projected[t, :, 2 * HIDDEN :] + (r * h) @ u[:, 2 * HIDDEN :])
            new = h + mask[t] * z * (n - h)
            if keep is not None:
                keep.append((t, h, z, r, n))
            out[t] = h = new
        return out

    def project(self, x: np.ndarray) -> np.ndarray:
        """Both directions' input terms of word vectors, side by side."""
        return np.concatenate([x @ self.p["Wf"] + self.p["cf"], x @ self.p["Wb"] + self.p["cb"]], axis=-1)

    def forward(self, projected: np.ndarray, mask: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """Logits of windows from projected inputs (time, windows, 6 * hidden) and a mask (time, windows, 1)."""
        steps = {"f": None, "b": None} if keep is None else {"f": [], "b": []}
        h = np.concatenate([self._layer(projected[..., : 3 * HIDDEN], mask, "f", steps["f"]), self._layer(projected[..., 3 * HIDDEN :], mask, "b", steps["b"])], axis=-1)
        a = np.tanh(h @ self.p["A"])
        e = np.where(mask[..., 0] > 0, a @ self.p["v"], -1e9)
        e = np.exp(e - e.max(0))
        w = e / e.sum(0)
        pooled = (w[..., None] * h).sum(0)
        if keep is not None:
            keep |= {"steps": steps, "h": h, "a": a, "w": w, "pooled": pooled}
        return pooled @ self.p["o"] + self.p["b"]

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray, float]:
        """(gradients, gradient of x, loss) of the mean logistic loss."""
        keep: dict = {}
        logit = self.forward(self.project(x), mask, keep)
        p = _sigmoid(logit)
        g = ((p - y) / len(y)).astype(np.float32)
        h, a, w, pooled = keep["h"], keep["a"], keep["w"], keep["pooled"]
        out = {"o": pooled.T @ g, "b": np.array([g.sum()], np.float32)}
        d_pooled = g[:, None] * self.p["o"]
        d_w = (d_pooled * h).sum(-1)
        d_h = w[..., None] * d_pooled
        d_e = w * (d_w - (w * d_w).sum(0))
        out["v"] = np.einsum("tn,tnk->k", d_e, a)
        d_a = d_e[..., None] * self.p["v"] * (1 - a * a)
        out["A"] = np.einsum("tni,tnk->ik", h, d_a)
        d_h = d_h + d_a @ self.p["A"].T
        d_x = np.zeros_like(x)
        for k, d in enumerate("fb"):
            u, w_in = self.p[f"U{d}"], self.p[f"W{d}"]
            grads = {"W": np.zeros_like(w_in), "U": np.zeros_like(u), "c": np.zeros(3 * HIDDEN, np.float32)}
            carried = np.zeros((x.shape[1], HIDDEN), np.float32)
            for t, h0, z, r, n in reversed(keep["steps"][d]):
                d_new = carried + d_h[t, :, k * HIDDEN : (k + 1) * HIDDEN]
                on = mask[t] * d_new
                d_n = on * z * (1 - n * n)
                d_rh = d_n @ u[:, 2 * HIDDEN :].T
                d_zr = np.concatenate([on * (n - h0) * z * (1 - z), d_rh * h0 * r * (1 - r)], axis=1)
                grads["U"][:, 2 * HIDDEN :] += (r * h0).T @ d_n
                grads["U"][:, : 2 * HIDDEN] += h0.T @ d_zr
                d_in = np.concatenate([d_zr, d_n], axis=1)
                grads["W"] += x[t].T @ d_in
                grads["c"] += d_in.sum(0)
                d_x[t] += d_in @ w_in.T
                carried = d_new - on * z + d_rh * r + d_zr @ u[:, : 2 * HIDDEN].T
            out |= {f"{name}{d}": v for name, v in grads.items()}
        loss = float(np.mean(np.logaddexp(0, logit) - y * logit))
        return out, d_x, loss


def _odds(texts: list[np.ndarray], labels: np.ndarray, flat: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How much likelier words and n-grams are in toxic texts: log ratios of the shares of texts that hold them.

    ``texts`` hold word numbers; ``flat`` and ``bounds`` are those words' n-grams.
    """
    seen, grams = np.zeros((2, len(bounds) - 1)), np.zeros((2, GRAMS))
    for words, y in zip(texts, labels):
        own = np.unique(words)
        seen[y, own] += 1
        if len(own):
            grams[y, np.unique(np.concatenate([flat[bounds[w] : bounds[w + 1]] for w in own]))] += 1
    toxic, clean = max(1, int(labels.sum())), max(1, int((1 - labels).sum()))
    ratio = lambda c: (np.log((c[1] + 0.3) / toxic) - np.log((c[0] + 0.3) / clean)) * (c.sum(0) > 2)
    return ratio(seen), ratio(grams)


def train(texts: list[str], labels: list[int], seed: int = 5) -> Network | None:
    """A network from texts and their 0/1 labels; None where one of the labels is missing."""
    y = np.array(labels, np.int64)
    if len(set(labels)) < 2:
        return None
    rng = np.random.default_rng(seed)
    runs = [letter_runs(t) for t in texts]
    index: dict[str, int] = {}
    ids = [np.array([index.setdefault(w, len(index)) for w in r], np.int64) for r in runs]
    spelled = list(index)
    if not spelled:
        return None
    flat, bounds = gram_ids(spelled)
    odds, gram_odds = _odds(ids, y, flat, bounds)
    counts = Counter(w for r in runs for w in set(map(whole_word, r)))
    vocabulary = {w: k for k, (w, n) in enumerate(sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:VOCABULARY]) if n > 2}
    net = Network(vocabulary)
    # The first input starts as the log ratio; training goes on from there.
    net.p["gram"][:, 0] = np.clip(gram_odds, -3, 6) / 3
    for piece, at in index.items():  # the pieces of one word stand in the same texts
        if (k := vocabulary.get(whole_word(piece))) is not None:
            net.p["word"][k + 1, 0] = np.clip(odds[at], -3, 6) / 3
    suspect = np.maximum(odds, np.maximum.reduceat(gram_odds[flat], bounds[:-1]))
    windows, marks = [], []
    for r, label in zip(ids, y):
        starts = np.array(window_starts(len(r)))
        if not len(r):
            continue
        worst = np.array([suspect[r[s : s + WINDOW]].max() for s in starts])
        order = np.argsort(-worst, kind="stable")
        picked = [k for k in order[:3] if worst[k] > 0.7 * worst[order[0]]] if label else [*order[:3], *rng.choice(len(starts), 2)]
        windows += [r[starts[k] : starts[k] + WINDOW] for k in picked]
        marks += [label] * len(picked)
    marks_a = np.array(marks, np.float32)
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.p.items()}
    step = 0
    for epoch in range(EPOCHS):
        order = rng.permutation(len(windows))
        for at in range(0, len(order), BATCH):
            batch = order[at : at + BATCH]
            own, place = np.unique(np.concatenate([windows[k] for k in batch]), return_inverse=True)
            vectors, rows, flat, starts = net.inputs([spelled[i] for i in own])
            where = np.full((WINDOW, len(batch)), -1)
            used = 0
            for col, k in enumerate(batch):
                n = len(windows[k])
                where[:n, col] = place[used : used + n]
                used += n
            mask = (where >= 0).astype(np.float32)[..., None]
            grads, d_x, _ = net.gradients(vectors[where] * mask, mask, marks_a[batch])
            flat_where, d_flat = where.ravel(), (d_x * mask).reshape(-1, EMBED)
            ok = flat_where >= 0
            d_word = np.stack([np.bincount(flat_where[ok], d_flat[ok, e], len(own)) for e in range(EMBED)], axis=1)
            per_gram = np.repeat(d_word / np.diff(starts)[:, None], np.diff(starts), axis=0)
            grads["gram"] = np.stack([np.bincount(flat, per_gram[:, e], GRAMS) for e in range(EMBED)], axis=1)
            grads["word"] = np.zeros_like(net.p["word"])
            np.add.at(grads["word"], rows, d_word * (rows > 0)[:, None])
            step += 1
            rate = RATE * (1 - 0.8 * epoch / EPOCHS)
            for name, g in grads.items():
                m, s = moments[name]
                m += 0.1 * (g - m)
                s += 0.01 * (g * g - s)
                net.p[name] -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
    # A text is toxic by its worst window of many: the bias moves to where that tells the sample's texts apart best.
    scorer = Scorer(net)
    worst = scorer.logits(texts)
    cuts = np.concatenate([[worst.min() - 1], np.sort(worst)])
    mids = (cuts[1:] + cuts[:-1]) / 2
    errors = np.array([np.sum((worst > c) != (y == 1)) for c in mids])
    best = np.flatnonzero(errors == errors.min())
    net.p["b"] -= np.float32(mids[best[len(best) // 2]])
    return net


class Scorer:
    """A trained network with the projected inputs of the words met so far."""

    def __init__(self, net: Network):
        self.net = net
        self.known: dict[str, int] = {}
        self.table = np.zeros((4096, 6 * HIDDEN), np.float32)

    def _rows(self, words: list[str]) -> np.ndarray:
        if len(self.known) + len(words) > REMEMBERED and len(self.known) > 0:
            self.known.clear()
        known = self.known
        new = [w for w in dict.fromkeys(words) if w not in known]
        if new:
            base = len(known)
            while base + len(new) >= len(self.table):
                self.table = np.concatenate([self.table, np.zeros_like(self.table)])
            for at in range(0, len(new), 4096):
                part = new[at : at + 4096]
                self.table[base + at : base + at + len(part)] = self.net.project(self.net.inputs(part)[0])
            known.update(zip(new, range(base, base + len(new))))
        return np.array([known[w] for w in words], np.int64)

    def _windows(self, where: np.ndarray) -> np.ndarray:
        mask = (where >= 0).astype(np.float32)[..., None]
        return self.net.forward(self.table[where], mask)

    def logits(self, texts: list[str | None]) -> np.ndarray:
        """The worst window's logit of each text; -inf where there is no word."""
        out = np.full(len(texts), -np.inf, np.float32)
        pending: list[np.ndarray] = []
        owners: list[np.ndarray] = []
        waiting = 0

        def run() -> None:
            nonlocal waiting
            if not waiting:
                return
            where, owner = np.concatenate(pending), np.concatenate(owners)
            for at in range(0, len(where), WINDOWS_AT_ONCE):
                part = self._windows(np.ascontiguousarray(where[at : at + WINDOWS_AT_ONCE].T))
                np.maximum.at(out, owner[at : at + WINDOWS_AT_ONCE], part)
            pending.clear()
            owners.clear()
            waiting = 0

        for k, text in enumerate(texts):
            words = letter_runs(text)
            # Long texts come in portions that overlap by a window's rest; the same windows result.
            for at in range(0, len(words), PORTION * STRIDE):
                part = words[at : at + PORTION * STRIDE + WINDOW - STRIDE]
                if at and len(part) <= STRIDE:
                    continue
                if len(self.known) + len(part) > REMEMBERED:
                    run()  # before what is remembered starts anew
                rows = self._rows(part)
                starts = np.arange(0, max(1, len(part) - STRIDE), STRIDE)
                spots = starts[:, None] + np.arange(WINDOW)
                pending.append(np.where(spots < len(rows), rows[np.minimum(spots, len(rows) - 1)], -1))
                owners.append(np.full(len(starts), k))
                waiting += len(starts)
            if waiting >= WINDOWS_AT_ONCE:
                run()
        run()
        return out


_SCORERS: list = []


def _scorer(shared) -> Scorer:
    """The worker's scorer for a broadcast network; what it remembers serves later tasks too."""
    if not _SCORERS or _SCORERS[0] != shared.id:
        _SCORERS[:] = [shared.id, Scorer(shared.value[1])]
    return _SCORERS[1]


class _Shared:
    """A broadcast network and the key that tells it from others."""

    def __init__(self, spark, net: Network):
        self.id = zlib.crc32(b"".join(v.tobytes() for v in net.p.values()))
        self.broadcast = spark.sparkContext.broadcast((self.id, net))

    @property
    def value(self):
        return self.broadcast.value

    def __getstate__(self):
        return {"id": self.id, "broadcast": self.broadcast}


def fit(df: DataFrame, labels: DataFrame, text: str = "text", row_id: str = "doc_id") -> Network | None:
    """A network from the rows of ``df`` with a label (doc_id, toxic); None without both labels.

    An id with both labels counts as toxic; every row of a repeated id is a text of its own, and ties are drawn in order
    of the text. Null texts, ids and labels teach nothing. Other columns, whatever their names, are not read.
    """
    rows = df.select(F.col(f"`{row_id}`").alias("id"), F.col(f"`{text}`").alias("text")).filter("id IS NOT NULL AND text IS NOT NULL")
    rows = rows.filter(F.regexp_count("text", F.lit(r"\s+")) < SAMPLE_WORDS)
    marks = labels.filter("toxic IN (0, 1)").groupBy(F.col("doc_id").alias("id")).agg(F.max("toxic").alias("y"))
    texts, ys = [], []
    for label, most in ((1, SAMPLE_TOXIC), (0, SAMPLE_CLEAN)):
        drawn = marks.filter(F.col("y") == label)
        n = drawn.count()
        if n > most:  # a share by hash of the id, so that few texts are joined
            drawn = drawn.filter(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < int(1_500_000 * most / n))
        picked = rows.join(drawn, "id").orderBy(F.xxhash64("id"), "text").limit(most).collect()
        texts += [r["text"] for r in picked]
        ys += [label] * len(picked)
    return train(texts, ys)


def score(df: DataFrame, net: Network | None, text: str = "text", row_id: str = "doc_id") -> DataFrame:
    """Per row: doc_id and score. Null and empty texts, and those without a word, score 0, as all do without a network.

    Row by row: repeated rows score alike, an empty table gives an empty one, very long texts are scored whole, in
    portions of the same windows. Other columns, whatever their names, are not read.
    """
    picked = df.select(F.col(f"`{row_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    if net is None:
        return picked.select("doc_id", F.lit(0.0).alias("score"))
    shared = _Shared(df.sparkSession, net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _scorer(shared)
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS_AT_ONCE):
                part = batch.slice(at, TEXTS_AT_ONCE)
                logits = scorer.logits(part.column(1).to_pylist())
                scores = np.where(np.isfinite(logits), _sigmoid(np.nan_to_num(logits, neginf=-30)), 0.0)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(scores.astype(np.float64))], names=["doc_id", "score"])

    return picked.mapInArrow(run, "doc_id long, score double")


def op4_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held_out = crc_bucket("doc_id", 5) == 0
    net = fit(docs.filter(~held_out), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, net).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
