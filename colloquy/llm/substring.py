"""Substring deduplication by fixed-block anchors (operator 13).

A window of 50 words that two documents share holds, wherever it stands, one whole block of 25 of the blocks that cut
the first document into pieces. So:

1. Anchors. Non-overlapping blocks of every document are the index; every rolling window of 25 words probes it. Both
   travel as a few bytes of a hash, once for a slice of documents, to the bucket that owns the hash. Where an indexed
   block is met by a second document, the holders are told. Hashes are short and may meet by chance: that costs a
   comparison, never a result.
2. Extension. A document lists the windows around its anchors, and of all documents that list one, those with a greater
   id than the least are told that it is a repeat. Consecutive repeats make up the maximal ones.
3. Removal. The words under a document's repeated windows go.

Windows are compared by 64 bits beside those that choose the bucket. A passage that very many documents hold is sent to
a bucket once a slice only; whole copies of a document are known by the digest of their words and take no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SLICE_BYTES, SPACES, documents, materialise, mix64, text_slices, window_hashes, words

#: Fixed value of the contract: words of a window. A block is half of one.
WINDOW = 50
#: Bytes of text, about, of the slice of documents that is sent as one; words, on average, that a bucket compares.
SLICE_TEXT, BUCKET_WORDS = 1 << 22, 300_000
#: Bytes of a probe's hash beside the bits that choose its bucket.
KEY_BYTES = 3

#: kind: DIRECTORY rows list a slice's documents and what the slice itself has found, ENTRIES are for a bucket, REPLIES
#: for a slice. idx: document of the slice (and a flag), 2 bytes each; at: places in it, 4 bytes each.
DIRECTORY, ENTRIES, REPLIES = 0, 1, 2
PARCEL = pa.schema([("bucket", pa.int32()), ("slice", pa.int64()), ("kind", pa.int8()), ("idx", pa.binary()), ("keys", pa.binary()), ("at", pa.binary()), ("ids", pa.binary()), ("texts", pa.binary())])
PARCEL_SQL = "bucket int, slice long, kind byte, idx binary, keys binary, at binary, ids binary, texts binary"

_SPACE = np.zeros(256, bool)
_SPACE[list(SPACES)] = True


def _pieces(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The bytes in parts of bounded size; a long text is cut between words."""
    if len(data) <= SLICE_BYTES:
        yield data, offsets
        return
    at = 0
    while at < len(data):
        end = min(at + SLICE_BYTES, len(data))
        while end < len(data) and not _SPACE[data[end - 1 : end]].any():
            back = np.flatnonzero(_SPACE[data[at:end]])
            end = at + int(back[-1]) + 1 if len(back) else min(end + SLICE_BYTES, len(data))
        yield data[at:end], np.array([0, end - at])
        at = end


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(document index, hash) of every word of ``texts``, in order."""
    docs, hashes = [np.zeros(0, np.int32)], [np.zeros(0, np.uint64)]
    for first, _, data, offsets in text_slices(texts):
        for part, bounds in _pieces(data, offsets):
            doc, _, _, h = words(part, bounds, lower=False)
            docs.append((doc + first).astype(np.int32))
            hashes.append(h)
    return np.concatenate(docs), np.concatenate(hashes)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, int]]:
    """(rows by ascending id, a number that its rows' ids and texts decide) of bounded slices."""
    for batch in batches:
        for first, end, *_ in text_slices(batch.column("text"), SLICE_TEXT):
            for a in range(first, end, 1 << 15):
                part = batch.slice(a, min(end, a + (1 << 15)) - a)
                part = part.take(pc.sort_indices(part, [("doc_id", "ascending"), ("text_key", "ascending")]))
                told = hashlib.blake2b(digest_size=8)
                for c in ("doc_id", "text_key"):
                    told.update(part.column(c).to_numpy().tobytes())
                yield part, int.from_bytes(told.digest(), "little", signed=True)


def _rolling(doc: np.ndarray, hashes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, place in it, hash) of each run of ``width`` words of one document."""
    found = window_hashes(hashes, width)
    start = np.flatnonzero(doc[: len(found)] == doc[width - 1 :]) if len(found) else np.zeros(0, np.int64)
    first = np.searchsorted(doc, np.arange(int(doc[-1]) + 1 if len(doc) else 0))
    return doc[start], (start - first[doc[start]]).astype(np.uint32), found[start]


def _bucket_edges(buckets: int) -> np.ndarray:
    return np.array([(b << 64) // buckets for b in range(1, buckets)], np.uint64)


def _packed(keys: np.ndarray) -> bytes:
    return keys.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :KEY_BYTES].tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // KEY_BYTES, 4), np.uint8)
    out[:, :KEY_BYTES] = np.frombuffer(data, np.uint8).reshape(-1, KEY_BYTES)
    return out.reshape(-1).view("<u4")


def _packed_ids(ids: np.ndarray) -> bytes:
    """64-bit ids as the least and what the others are above it, in as few bytes as the widest needs."""
    least = ids.min()
    above = ids.view(np.uint64) - np.uint64(least.view(np.uint64))
    width = next(w for w in (1, 2, 4, 8) if w == 8 or int(above.max()) < 1 << 8 * w)
    return bytes([width]) + least.tobytes() + above.astype(f"<u{width}").tobytes()


def _unpacked_ids(data: bytes) -> np.ndarray:
    above = np.frombuffer(data, f"<u{data[0]}", offset=9).astype(np.uint64)
    return (above + np.frombuffer(data, np.uint64, 1, 1)).view(np.int64)


def _parcels(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, PARCEL)


def _directory(part: pa.RecordBatch, number: int, buckets: int, idx: np.ndarray, at: np.ndarray) -> dict:
    ids, texts = (part.column(c).to_numpy().tobytes() for c in ("doc_id", "text_key"))
    return {"bucket": number % buckets, "slice": number, "kind": DIRECTORY, "idx": idx.astype("<u2").tobytes(), "at": at.astype("<u4").tobytes(), "ids": ids, "texts": texts}


def _runs(*sorted_keys: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    new = np.ones(len(sorted_keys[0]), bool)
    new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in sorted_keys])
    return np.flatnonzero(new)


def probes(buckets: int, window: int):
    """Step 1, by slices: every rolling block with a flag where it is one of the index, once a slice; places of those met twice."""
    block = window // 2
    edges = _bucket_edges(buckets)

    def run(batches):
        for part, number in _slices(batches):
            doc, at, h = _rolling(*word_hashes(part.column("text")), block)
            order = np.argsort(h, kind="stable")  # equal hashes stay in order of their documents
            h, d = h[order], doc[order]
            first = _runs(h)
            last = np.append(first[1:], len(h)) - 1
            flags = np.logical_or.reduceat(at[order] % block == 0, first) if len(h) else np.zeros(0, bool)
            met = np.repeat(d[first] != d[last], last - first + 1)
            out = [_directory(part, number, buckets, d[met], at[order][met])]
            keys, idx = h[first], (d[first] << 1 | flags).astype("<u2")
            bounds = [0, *np.searchsorted(keys, edges).tolist(), len(keys)]
            out += [{"bucket": b, "slice": number, "kind": ENTRIES, "keys": _packed(keys[x:y] & np.uint64(0xFFFFFFFF)), "idx": idx[x:y].tobytes()} for b, (x, y) in enumerate(zip(bounds, bounds[1:])) if x < y]
            yield _parcels(out)

    return run


def _entries(parcels: pa.Table, column: str, read) -> tuple[list[int], np.ndarray, list[np.ndarray]]:
    """(slices, which of them an entry is of, their values) of a bucket's ENTRIES."""
    rows = parcels.filter(pc.equal(parcels["kind"], ENTRIES))
    values = [read(v) for v in rows[column].to_pylist()]
    owner = np.repeat(np.arange(len(values), dtype=np.int32), [len(v) for v in values])
    return rows["slice"].to_pylist(), owner, values


def _replies(bucket: int, slices: list[int], owner: np.ndarray, idx: np.ndarray, values: np.ndarray, column: str) -> list[dict]:
    order = np.argsort(owner, kind="stable")
    owner, idx, values = owner[order], idx[order], values[order]
    starts = _runs(owner) if len(owner) else np.zeros(0, np.int64)
    ends = [*starts[1:].tolist(), len(owner)]
    return [{"bucket": bucket, "slice": slices[owner[a]], "kind": REPLIES, "idx": idx[a:b].astype("<u2").tobytes(), column: values[a:b].tobytes()} for a, b in zip(starts.tolist(), ends)]


def _passed_on(parcels: pa.Table) -> pa.Table:
    return parcels.filter(pc.equal(parcels["kind"], DIRECTORY)).select(PARCEL.names).cast(PARCEL)


def meet(key: tuple, parcels: pa.Table) -> pa.Table:
    """Step 1, by buckets: the holders of an indexed block that a second document has learn of it."""
    slices, owner, keys = _entries(parcels, "keys", _unpacked)
    if not slices:
        return _passed_on(parcels)
    keys = np.concatenate(keys)
    idx = np.frombuffer(b"".join(x for x in parcels.filter(pc.equal(parcels["kind"], ENTRIES))["idx"].to_pylist()), "<u2")
    order = np.argsort(keys, kind="stable")
    keys, owner, idx = keys[order], owner[order], idx[order]
    first = _runs(keys)
    size = np.diff(np.append(first, len(keys)))
    holder = owner.astype(np.int64) << 16 | idx >> 1
    several = np.minimum.reduceat(holder, first) != np.maximum.reduceat(holder, first)
    told = np.repeat(several & np.logical_or.reduceat(idx & 1 == 1, first), size)
    bucket = key[0].as_py()
    anchors = np.uint64(bucket) << np.uint64(8 * KEY_BYTES) | keys[told].astype(np.uint64)
    replies = _replies(bucket, slices, owner[told], idx[told] >> 1, anchors, "keys")
    return pa.concat_tables([_passed_on(parcels), pa.Table.from_batches([_parcels(replies)])])


HITS_SQL = "doc_id long, text_key long, keys binary, at binary"


def assemble(key: tuple, parcels: pa.Table) -> pa.Table:
    """What a slice was told and has found itself, by its documents."""
    parcels = parcels.to_pydict()
    directory = parcels["kind"].index(DIRECTORY)
    ids, texts = (np.frombuffer(parcels[c][directory], np.int64) for c in ("ids", "texts"))
    out: dict[str, list] = {"doc_id": [], "text_key": [], "keys": [], "at": []}
    found = {}
    for column, kind in (("keys", np.uint64), ("at", np.uint32)):
        rows = [k for k, v in enumerate(parcels[column]) if v is not None]
        idx = np.concatenate([np.zeros(0, np.uint16), *[np.frombuffer(parcels["idx"][k], "<u2") for k in rows]])
        values = np.concatenate([np.zeros(0, kind), *[np.frombuffer(parcels[column][k], kind) for k in rows]])
        order = np.argsort(idx, kind="stable")
        values, bounds = values[order], np.searchsorted(idx[order], np.arange(len(ids) + 1))
        found[column] = [values[a:b] for a, b in zip(bounds, bounds[1:])]
    for doc, (k, a) in enumerate(zip(found["keys"], found["at"])):
        if len(k) or len(a):
            for c, v in zip(out, (ids[doc], texts[doc], k.tobytes(), a.tobytes())):
                out[c].append(v)
    return pa.table({"doc_id": pa.array(out["doc_id"], pa.int64()), "text_key": pa.array(out["text_key"], pa.int64()), "keys": pa.array(out["keys"], pa.binary()), "at": pa.array(out["at"], pa.binary())})


def windows(buckets: int, window: int):
    """Step 2, by slices: the windows around anchors, once a slice, from the least document that lists one; the others' are repeats."""
    block = window // 2
    edges = _bucket_edges(buckets)

    def around(doc, at, h, part):
        """Which rolling blocks are anchors: told ones, and those that their slice has met twice."""
        codes = np.searchsorted(edges, h, "right").astype(np.uint64) << np.uint64(8 * KEY_BYTES) | h & np.uint64((1 << 8 * KEY_BYTES) - 1)
        anchor = np.zeros(len(h), bool)
        bounds = np.searchsorted(doc, np.arange(len(part) + 1))
        for k, (told, met) in enumerate(zip(part.column("keys").to_pylist(), part.column("at").to_pylist())):
            a, b = bounds[k], bounds[k + 1]
            anchor[a:b] = np.isin(codes[a:b], np.frombuffer(told, np.uint64))
            anchor[a + np.frombuffer(met, np.uint32).astype(np.int64)] = True
        return anchor

    def run(batches):
        for part, number in _slices(batches):
            ids = part.column("doc_id").to_numpy()
            doc, hashes = word_hashes(part.column("text"))
            small = _rolling(doc, hashes, block)
            anchor = around(*small, part)
            d, at, h = _rolling(doc, hashes, window)
            # A window lists itself if one of its rolling blocks, from the first to the last, is an anchor.
            upto = np.concatenate([[0], np.cumsum(anchor)])
            begin = np.searchsorted(small[0], d).astype(np.int64) + at
            listed = upto[begin + window - block + 1] > upto[begin]
            d, at, h, begin = d[listed], at[listed], h[listed], begin[listed]
            second = mix64(small[2][begin] * np.uint64(0x9FB21C651E98DF25) + small[2][begin + window - block])
            order = np.lexsort((d, second, h))
            d, at, h, second = d[order], at[order], h[order], second[order]
            first = _runs(h, second) if len(h) else np.zeros(0, np.int64)
            repeat = ids[d] > np.repeat(ids[d[first]], np.diff(np.append(first, len(h)))) if len(h) else np.zeros(0, bool)
            out = [_directory(part, number, buckets, d[repeat], at[repeat])]
            # Rows of one id do not remove from each other, so all of the least id's windows are sent.
            d, at, h, second = d[~repeat], at[~repeat], h[~repeat], second[~repeat]
            bounds = [0, *np.searchsorted(h, edges).tolist(), len(h)]
            for b, (x, y) in enumerate(zip(bounds, bounds[1:])):
                if x < y:
                    out.append({"bucket": b, "slice": number, "kind": ENTRIES, "keys": second[x:y].tobytes(), "idx": d[x:y].astype("<u2").tobytes(), "at": at[x:y].tobytes(), "ids": _packed_ids(ids[d[x:y]])})
            yield _parcels(out)

    return run


def settle(key: tuple, parcels: pa.Table) -> pa.Table:
    """Step 2, by buckets: documents of a greater id than the least that lists a window learn that theirs is a repeat."""
    slices, owner, keys = _entries(parcels, "keys", lambda v: np.frombuffer(v, np.uint64))
    if not slices:
        return _passed_on(parcels)
    rows = parcels.filter(pc.equal(parcels["kind"], ENTRIES))
    keys = np.concatenate(keys)
    idx, at = (np.frombuffer(b"".join(rows[c].to_pylist()), kind) for c, kind in (("idx", "<u2"), ("at", "<u4")))
    ids = np.concatenate([_unpacked_ids(v) for v in rows["ids"].to_pylist()])
    order = np.argsort(keys, kind="stable")
    keys, owner, idx, at, ids = keys[order], owner[order], idx[order], at[order], ids[order]
    first = _runs(keys)
    repeat = ids > np.repeat(np.minimum.reduceat(ids, first), np.diff(np.append(first, len(keys))))
    replies = _replies(key[0].as_py(), slices, owner[repeat], idx[repeat], at[repeat], "at")
    return pa.concat_tables([_passed_on(parcels), pa.Table.from_batches([_parcels(replies)])])


def _facts(batches):
    """(doc_id, text_key, n_words, sha256 of the words joined by a space)."""
    for batch in batches:
        n, digests = [], []
        for text in batch.column("text").cast(pa.binary()):
            found = text.as_py().split()
            n.append(len(found))
            digests.append(hashlib.sha256(b" ".join(found)).digest())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_key"), pa.array(n, pa.int64()), pa.array(digests, pa.binary())], names=["doc_id", "text_key", "n_words", "digest"])


def _stripped(window: int, give_text: bool):
    """Step 3: what is left of each text."""

    def run(batches):
        for batch in batches:
            removed, kept = [], []
            for text, starts in zip(batch.column("text").cast(pa.binary()), batch.column("at").to_pylist()):
                found = text.as_py().split()
                change = np.zeros(len(found) + 1, np.int64)
                starts = np.unique(np.frombuffer(starts, np.uint32)).astype(np.int64)
                change[starts] += 1
                change[starts + window] -= 1
                stays = np.cumsum(change[:-1]) == 0
                rest = b" ".join(found[k] for k in np.flatnonzero(stays).tolist())
                removed.append(len(found) - int(stays.sum()))
                kept.append(rest if give_text else hashlib.sha256(rest).digest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_key"), pa.array(removed, pa.int64()), pa.array(kept, pa.binary())], names=["doc_id", "text_key", "n_removed", "kept"])

    return run


class Repeats:
    """Windows of ``df``'s texts that also start in a row of a smaller id, and what is left without their words.

    Null texts have no words. Texts shorter than a window lose nothing. A null id is neither smaller nor greater than
    any, so its row keeps all and takes from none; rows of one id do not take from each other, and equal rows get equal
    results. Long texts are read whole, in parts. An empty table gives an empty result. Other columns, whatever their
    names, are not read.
    """

    def __init__(self, df: DataFrame, text: str = "text", row_id: str = "doc_id", window: int = WINDOW) -> None:
        body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
        self.window = window
        self.docs = df.select(F.col(f"`{row_id}`").cast("long").alias("doc_id"), F.xxhash64(body).alias("text_key"), body.alias("text"))
        #: (doc_id, text_key, n_words, digest) of every row.
        self.facts = materialise(self.docs.mapInArrow(_facts, "doc_id long, text_key long, n_words long, digest binary"))
        total = self.facts.agg(F.sum("n_words")).first()[0] or 0
        buckets = max(1, -(-total // BUCKET_WORDS))
        known = self.docs.filter("doc_id IS NOT NULL")
        first = self.facts.filter(F.col("n_words") >= window).groupBy("digest").agg(F.min("doc_id").alias("first_id"))
        #: The same rows with ``first_id``, the least id of a row of the same words; null for short texts.
        self.whole = materialise(self.facts.join(first, "digest", "left"))
        hits = self._told(known, probes(buckets, window), meet)
        taking_part = self.whole.filter("doc_id = first_id").select("doc_id", "text_key").distinct()
        hits = materialise(hits.join(taking_part, ["doc_id", "text_key"], "left_semi"))
        near = known.join(hits, ["doc_id", "text_key"])
        starts = self._told(near, windows(buckets, window), settle).select("doc_id", "text_key", "at")
        #: (doc_id, text_key, at): places of the repeated windows, 4 bytes each; rows that repeat an earlier one whole are left out.
        self.starts = materialise(starts.dropDuplicates(["doc_id", "text_key"]))

    @staticmethod
    def _told(rows: DataFrame, send, answer) -> DataFrame:
        """Slices send to buckets, buckets answer slices, and each document gets what concerns it."""
        answered = rows.mapInArrow(send, PARCEL_SQL).groupBy("bucket").applyInArrow(answer, PARCEL_SQL)
        return answered.groupBy("slice").applyInArrow(assemble, HITS_SQL)

    def stripped(self, give_text: bool = False) -> DataFrame:
        """(doc_id, text_key, n_words, n_removed, kept) of every row; kept: the words left, joined by a space, or their sha256."""
        found = self.docs.join(self.starts, ["doc_id", "text_key"])
        found = found.mapInArrow(_stripped(self.window, give_text), "doc_id long, text_key long, n_removed long, kept binary").dropDuplicates(["doc_id", "text_key"])
        rows = self.whole.join(found, ["doc_id", "text_key"], "left")
        copy = F.coalesce(F.col("doc_id") > F.col("first_id"), F.lit(False))
        gone = F.when(copy, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0)))
        if give_text:
            own = self.docs.select("doc_id", "text_key", F.array_join(F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != ""), " ").alias("all")).dropDuplicates(["doc_id", "text_key"])
            rows = rows.join(own.withColumnsRenamed({"doc_id": "of", "text_key": "of_text"}), F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("text_key") == F.col("of_text")), "left")
            left = F.when(copy, F.lit("")).otherwise(F.coalesce(F.col("kept").cast("string"), F.col("all")))
        else:
            left = F.lower(F.hex(F.when(copy, F.unhex(F.sha2(F.lit("").cast("binary"), 256))).otherwise(F.coalesce("kept", "digest"))))
        return rows.select("doc_id", "text_key", "n_words", gone.alias("n_removed"), left.alias("kept"))


def op13_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return Repeats(documents(spark, sf_dir)).stripped().select("doc_id", "n_words", "n_removed", F.col("kept").alias("kept_sha256"))


#: Every window of every document against the least document that it starts in.
OP13_SQL = """
WITH docs AS (SELECT row_number() OVER () AS row_no, doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS words FROM documents),
starts AS (SELECT row_no, doc_id, words, unnest(generate_series(1, len(words) - 49)) AS place FROM docs),
shown AS (SELECT row_no, doc_id, place, sha256(array_to_string(words[place:place + 49], ' ')) AS shown FROM starts),
firsts AS (SELECT shown, min(doc_id) AS first_id FROM shown GROUP BY shown),
gone AS (SELECT row_no, unnest(generate_series(s.place, s.place + 49)) AS place FROM shown s JOIN firsts f ON f.shown = s.shown AND s.doc_id > f.first_id),
places AS (SELECT row_no, list(DISTINCT place) AS place FROM gone GROUP BY row_no)
SELECT d.doc_id, len(d.words)::BIGINT AS n_words, coalesce(len(p.place), 0)::BIGINT AS n_removed,
  sha256(array_to_string(CASE WHEN p.place IS NULL THEN d.words ELSE list_filter(d.words, lambda w, k: NOT list_contains(p.place, k)) END, ' ')) AS kept_sha256
FROM docs d LEFT JOIN places p ON p.row_no = d.row_no
"""
