"""N-gram Jaccard join by size-banded tiles and bitmap signatures (operator 1).

A document is the set of its distinct five-word shingles. Documents with equal sets form one class, and classes are
joined at a Jaccard similarity of 0.8 or more:

1. Tiles. In any one order of all shingles, two linked sets share one of their first n - ceil(0.8 n) + 1. Shingles that
   many documents hold come last in that order, so that a shared passage brings few sets together; how many hold one is
   counted over all documents in a sketch of fixed size, and decides the order only, never the result. A tile is what
   shares such a shingle and a size band wide enough for every pair that can link.
2. Groups. Each tile names its least member, the anchor. All tiles of one anchor form one group, so that the hundreds of
   nearly equal tiles of a family of copies become one, with one row a member.
3. Bounds. Hashed bitmap signatures of a group's sets bound every overlap from above by bit counts; a set that could
   link with none of its group leaves it. Only the texts of those that stay are shuffled.
4. Proof. Groups are compared inside tasks: larger bitmaps bound once more, and what passes is decided by intersecting
   the sorted arrays. Pairs that links already join are not compared again, and a task gives no more rows than members:
   each with the least one it is joined to. Groups beyond a task's size are dealt in chunks first; what is then still
   apart is compared in pairs of blocks.

Sets are held as 64-bit hashes of shingles, classes as 128-bit sums over their sets.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import documents, keep_rows, marked, materialise, mix64, text_slices, window_hashes, words
from .components import components

WIDTH = 5
#: Documents per bucket of keys, on average; a bucket is sorted in one task.
BUCKET_DOCS = 4_000
#: Key records that a task gathers before it deals them into buckets.
HELD_KEYS = 100_000
#: Sets, and shingles of all its sets, that a task compares with each other, on average.
CHUNK_SETS, CHUNK_SHINGLES = 512, 1 << 20
#: Bits a shingle, at least, of the signatures that travel to groups.
SIGNATURE_BITS = 2
#: log2 of the counters of the frequency sketch, and of the parts it is added up in.
COUNTER_BITS, PART_BITS = 22, 9
#: A shingle that more sets hold is dealt over several buckets; in a full sketch, one that stands out this many times.
HOT_SETS, STANDS_OUT = 20_000, 8
#: Size bands: BAND_STEPS of them make a ratio of 1.25; one more is allowed for rounding.
BAND_STEPS = 4


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, bounds): document i's sorted distinct shingles are hashes[bounds[i]:bounds[i + 1]]."""
    n = len(offsets) - 1
    doc, _, _, hashes = words(data, offsets, lower=True)
    counts = np.bincount(doc, minlength=n)
    short = np.flatnonzero((counts > 0) & (counts < WIDTH))
    windows = window_hashes(hashes, WIDTH)
    whole = doc[: len(windows)] == doc[WIDTH - 1 :] if len(windows) else np.zeros(0, bool)
    shingles, owner = windows[whole], doc[: len(windows)][whole]
    if len(short):
        first = np.concatenate([[0], np.cumsum(counts)])[short]
        extra = np.array([_sequence(hashes[a : a + counts[d]]) for a, d in zip(first, short)], np.uint64)
        at = np.searchsorted(owner, short)
        shingles, owner = np.insert(shingles, at, extra), np.insert(owner, at, short)
    bounds = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=n))]).tolist()
    for a, b in itertools.pairwise(bounds):
        shingles[a:b].sort()  # one by one: far cheaper than one sort of all by owner
    new = np.ones(len(shingles), bool)
    new[1:] = (shingles[1:] != shingles[:-1]) | (owner[1:] != owner[:-1])
    return shingles[new], np.concatenate([[0], np.cumsum(np.bincount(owner[new], minlength=n))])


def _sequence(hashes: np.ndarray) -> np.uint64:
    total = np.full(1, len(hashes) + 1, np.uint64)
    for h in hashes:
        total = mix64(total * np.uint64(0xD6E8FEB86659FD93) + h)
    return total[0]


def class_ids(shingles: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both halves of each set's 128-bit id; 0 for empty ones."""
    sizes = np.diff(bounds)
    full = np.flatnonzero(sizes)
    halves = []
    for key in (0x5851F42D4C957F2D, 0x2545F4914F6CDD1D):
        out = np.zeros(len(sizes), np.uint64)
        if len(full):
            sums = np.add.reduceat(mix64(shingles ^ np.uint64(key)), bounds[:-1][full])
            out[full] = mix64(sums + sizes[full].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        halves.append(out)
    return halves[0], halves[1]


def size_band(n: np.ndarray) -> np.ndarray:
    return np.floor(np.log(n) * (BAND_STEPS / np.log(1.25))).astype(np.uint64)


def level(counts: np.ndarray) -> np.ndarray:
    """Counts in quarters of a power of two, as bytes."""
    return np.minimum(4 * np.log2(counts + 1.0), 255).astype(np.uint8)


def tile_keys(shingles: np.ndarray, bounds: np.ndarray, levels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document index, key) of each set's first shingles, in order of their counters' ``levels``, then of their hashes."""
    sizes = np.diff(bounds)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    keys = mix64(shingles)
    order = np.argsort(owner << 8 | levels[keys >> np.uint64(64 - COUNTER_BITS)], kind="stable")
    rank = np.arange(len(shingles)) - np.repeat(bounds[:-1], sizes)
    first = rank < (sizes - -(-4 * sizes // 5) + 1)[owner]
    return owner[first], keys[order][first]


def bitmap(shingles: np.ndarray, least_bits: int = 8) -> np.ndarray:
    """Hashed bitmap of ``least_bits`` to twice as many bits a shingle, a power of two of 64-bit words."""
    bits = 64
    while bits < least_bits * len(shingles):
        bits *= 2
    flags = np.zeros(bits, np.uint8)
    flags[(shingles & np.uint64(bits - 1)).astype(np.int64)] = 1
    return np.packbits(flags, bitorder="little").view(np.uint64)


def most_overlap(a: np.ndarray, n_a: int, b: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Upper bounds of the overlap of one set and others from bitmaps of one width: a bit that the other lacks is an element it lacks."""
    here = n_a - np.bitwise_count(a & ~b).sum(-1, dtype=np.int64)
    there = n_b - np.bitwise_count(b & ~a).sum(-1, dtype=np.int64)
    return np.minimum(here, there)


def least_overlap(n_a, n_b):
    """The overlap that sets of these sizes need: 100 * overlap >= 80 * union."""
    return -(-4 * (n_a + n_b) // 9)


class _Once:
    """Whether an id is met for the first time; forgets when full, so it saves work but proves nothing."""

    def __init__(self):
        self.seen: set[int] = set()

    def new(self, ids: np.ndarray) -> np.ndarray:
        out = np.zeros(len(ids), bool)
        for k, i in enumerate(ids.tolist()):
            if i not in self.seen:
                out[k] = True
                self.seen.add(i)
        if len(self.seen) > 500_000:
            self.seen.clear()
        return out


_MEMBERS = "doc_id long, text_hash long, n_shingles long, c1 long, c2 long, signature binary, part int, counts binary"


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text_hash, text) to rows of size, class id and signature, and at the task's end to the parts of its counters."""
    names = [c.split()[0] for c in _MEMBERS.split(", ")]
    counters, once = np.zeros(1 << COUNTER_BITS, np.uint32), _Once()
    for batch in batches:
        for start, end, data, offsets in text_slices(batch.column(2)):
            shingles, bounds = shingle_sets(data, offsets)
            c1, c2 = class_ids(shingles, bounds)
            new = np.repeat(once.new(c1), np.diff(bounds))
            np.add.at(counters, mix64(shingles[new]) >> np.uint64(64 - COUNTER_BITS), 1)
            part = batch.slice(start, end - start)
            none = [pa.nulls(end - start, pa.int32()), pa.nulls(end - start, pa.binary())]
            signs = pa.array([bitmap(shingles[a:b], SIGNATURE_BITS).tobytes() for a, b in itertools.pairwise(bounds.tolist())], pa.binary())
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(np.diff(bounds), pa.int64()), pa.array(c1.view(np.int64)), pa.array(c2.view(np.int64)), signs, *none], names=names)
    pieces = counters.reshape(1 << PART_BITS, -1)
    for k in np.flatnonzero(pieces.any(1)).tolist():
        packed = pa.compress(pieces[k].tobytes(), "zstd", asbytes=True)
        yield pa.RecordBatch.from_arrays([*[pa.nulls(1, pa.int64())] * 5, pa.nulls(1, pa.binary()), pa.array([k], pa.int32()), pa.array([packed], pa.binary())], names=names)


def _add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Parts of counters added up and turned into levels, with their sum."""
    width = 1 << (COUNTER_BITS - PART_BITS)
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for k, packed in zip(batch.column(0).to_pylist(), batch.column(1)):
            counts = np.frombuffer(pa.decompress(packed.as_buffer(), 4 * width, "zstd"), np.uint32)
            sums[k] = sums.get(k, 0) + counts.astype(np.uint64)
    for k, total in sums.items():
        yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([level(total).tobytes()], pa.binary()), pa.array([int(total.sum())], pa.int64())], names=["part", "levels", "total"])


def _sketch(members: DataFrame) -> tuple[np.ndarray, int]:
    """(level of each counter, level from which a shingle is hot): a fixed number of bytes, whatever the corpus."""
    rows = members.filter("part is not null").select("part", "counts").repartition("part").mapInArrow(_add_up, "part int, levels binary, total long").collect()
    levels = np.zeros((1 << PART_BITS, 1 << (COUNTER_BITS - PART_BITS)), np.uint8)
    for r in rows:
        levels[r.part] = np.frombuffer(r.levels, np.uint8)
    mean = sum(r.total for r in rows) >> COUNTER_BITS
    return levels.ravel(), int(level(np.array([max(HOT_SETS, STANDS_OUT * mean)]))[0])


def _dealt(records: np.ndarray, bucket: np.ndarray) -> pa.RecordBatch:
    """One row per bucket with its packed records."""
    order = np.argsort(bucket, kind="stable")
    bucket, records = bucket[order], records[order]
    cuts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(bucket) else np.zeros(0, np.int64)
    packed = [records[a:b].tobytes() for a, b in zip(cuts, np.append(cuts[1:], len(bucket)))]
    return pa.RecordBatch.from_arrays([pa.array(bucket[cuts].astype(np.int64)), pa.array(packed, pa.binary())], names=["bucket", "packed"])


def _keys(n_buckets: int, shared):
    """Texts to records of their sets' keys (high half of the key and size band, class id), packed by bucket.

    A hot key's records are dealt over several buckets.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (levels, hot), once = shared.value, _Once()
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            for _, _, data, offsets in text_slices(batch.column(0)):
                shingles, bounds = shingle_sets(data, offsets)
                c1, _ = class_ids(shingles, bounds)
                docs, keys = tile_keys(shingles, bounds, levels)
                fresh = once.new(c1)[docs]
                docs, keys = docs[fresh], keys[fresh]
                ids, bands = c1[docs], size_band(np.diff(bounds)[docs])
                of = levels[keys >> np.uint64(64 - COUNTER_BITS)]
                splits = np.where(of >= hot, np.exp2(of / 4.0) // HOT_SETS + 1, 1).astype(np.uint64)
                bucket = ((keys & np.uint64(0xFFFFFFFF)) + mix64(ids) % splits) % np.uint64(n_buckets)
                held.append((np.stack([(keys & ~np.uint64(0xFFFFFFFF)) | bands, ids], 1), bucket))
                if sum(len(b) for _, b in held) > HELD_KEYS:
                    yield _dealt(*map(np.concatenate, zip(*held)))
                    held.clear()
        if held:
            yield _dealt(*map(np.concatenate, zip(*held)))

    return run


def _tiles(shared):
    """Key records of a bucket to (anchor, member, hot): once each, the members of tiles of two classes or more.

    A hot tile may go on in other buckets: ``hot`` names it, and its anchor here is one of several; else it is -1.
    """

    def run(table: pa.Table) -> pa.Table:
        levels, hot_from = shared.value
        records = np.concatenate([np.frombuffer(b.as_buffer(), np.uint64).reshape(-1, 2) for b in table.column("packed")])
        high, ids = records[:, 0], records[:, 1]
        order = np.argsort(high, kind="stable")
        high, ids = high[order], ids[order]
        key = high >> np.uint64(32)
        cuts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        sizes = np.diff(np.append(cuts, len(key)))
        hot = levels[key[cuts] >> np.uint64(32 - COUNTER_BITS)] >= hot_from
        met = np.repeat((sizes > 1) | hot, sizes)
        high, ids, hot = high[met], ids[met], np.repeat(hot, sizes)[met]
        # Bands step to step + 2 * (BAND_STEPS + 1): of two sets that can link, the smaller one's step holds both.
        step = (high & np.uint64(0xFFFFFFFF)) // np.uint64(BAND_STEPS + 1) + np.uint64(1)
        tile = np.concatenate([(high & ~np.uint64(0xFFFFFFFF)) | step, (high & ~np.uint64(0xFFFFFFFF)) | (step - np.uint64(1))])
        ids, hot = np.concatenate([ids, ids]), np.concatenate([hot, hot])
        order = np.lexsort((ids, tile))
        tile, ids, hot = tile[order], ids[order], hot[order]
        once = np.ones(len(tile), bool)
        once[1:] = (tile[1:] != tile[:-1]) | (ids[1:] != ids[:-1])
        tile, ids, hot = tile[once], ids[once], hot[once]
        cuts = np.flatnonzero(np.concatenate([[True], tile[1:] != tile[:-1]])) if len(tile) else np.zeros(0, np.int64)
        sizes = np.diff(np.append(cuts, len(tile)))
        anchor = np.repeat(ids[cuts], sizes)
        told = hot | (anchor != ids)
        rows = np.stack([anchor, ids, np.where(hot, tile, ~np.uint64(0))], 1)[told]
        rows = np.unique(rows, axis=0).view(np.int64)
        return pa.table({c: pa.array(rows[:, k].copy()) for k, c in enumerate(("anchor", "member", "hot"))})

    return run


def _groups(tiles: DataFrame) -> DataFrame:
    """Distinct (anchor, member); the parts of a hot tile get the least of their anchors."""
    plain = tiles.filter("hot = -1").select("anchor", "member")
    hot = tiles.filter("hot <> -1")
    if hot.isEmpty():
        return plain.distinct()
    tops = hot.groupBy("hot").agg(F.min("anchor").alias("top"))
    return plain.unionByName(hot.join(tops, "hot").select(F.col("top").alias("anchor"), "member")).filter("anchor <> member").distinct()


def _first_of_class(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    once = _Once()
    for batch in batches:
        yield batch.filter(pa.array(once.new(batch.column(0).to_numpy()), pa.bool_()))


def plausible(n: np.ndarray, bits: list[np.ndarray], apart: Callable[[int, np.ndarray], np.ndarray]) -> Iterator[tuple[int, np.ndarray]]:
    """(i, partners) of sets in order of size: those ``apart`` from i whose sizes and bitmaps leave room for a link, each pair once."""
    width = np.array([len(b) for b in bits])
    for w in np.unique(width):
        # Partners of the band have bitmaps of this width or, folded, of twice it.
        at = np.flatnonzero((width == w) | (width == 2 * w))
        table = np.stack([bits[k] if len(bits[k]) == w else bits[k][:w] | bits[k][w:] for k in at])
        for row in np.flatnonzero(width[at] == w).tolist():
            i = at[row]
            others = at[row + 1 : int(np.searchsorted(n[at], n[i] * 5 // 4, "right"))]
            rows = row + 1 + np.flatnonzero(apart(i, others))
            if len(rows):
                yield i, at[rows[most_overlap(table[row], n[i], table[rows], n[at[rows]]) >= least_overlap(n[i], n[at[rows]])]]


def _with_partner(table: pa.Table) -> pa.Table:
    """The members of a group whose signatures leave room for a link with another one."""
    ids, first = np.unique(table.column("id").to_numpy(), return_index=True)
    table = table.take(pa.array(first))
    n = table.column("n").to_numpy()
    order = np.argsort(n, kind="stable")
    signs = [np.frombuffer(b.as_buffer(), np.uint64) for b in table.column("signature")]
    kept = np.zeros(len(ids), bool)
    for i, partners in plausible(n[order], [signs[k] for k in order], lambda i, others: np.ones(len(others), bool)):
        if len(partners):
            kept[order[i]] = kept[order[partners]] = True
    return pa.table({"anchor": table.column("anchor").filter(pa.array(kept)), "id": ids[kept]})


def joined(sets: list[np.ndarray], component: np.ndarray, side: np.ndarray | None = None) -> np.ndarray:
    """Components (as indices) of sets that start in ``component``, after all links between them; with ``side``, between sides only."""
    n = np.array([len(s) for s in sets])
    order = np.argsort(n, kind="stable")
    n, label = n[order], np.unique(component, return_inverse=True)[1][order]
    side = None if side is None else side[order]
    apart = lambda i, others: (label[others] != label[i]) & (True if side is None else side[others] != side[i])
    for i, partners in plausible(n, [bitmap(sets[k]) for k in order], apart):
        for j in partners.tolist():
            if label[j] != label[i] and len(np.intersect1d(sets[order[i]], sets[order[j]], assume_unique=True)) >= least_overlap(n[i], n[j]):
                label[label == label[j]] = label[i]
    out = np.empty_like(label)
    out[order] = label
    return out


def _compare(table: pa.Table) -> pa.Table:
    """The classes of a chunk or of a pair of blocks, each (a) with the least one (b) it is newly joined to."""
    ids, first = np.unique(table.column("id").to_numpy(), return_index=True)
    table = table.take(pa.array(first))
    sets = []
    for chunk in table.column("text").chunks:
        for _, _, data, offsets in text_slices(chunk):
            shingles, bounds = shingle_sets(data, offsets)
            sets += [shingles[a:b] for a, b in zip(bounds[:-1], bounds[1:])]
    before, side = table.column("component").to_numpy(), table.column("side").to_numpy()
    label = joined(sets, before, side if (side != side[0]).any() else None)
    least = np.full(label.max() + 1, np.iinfo(np.int64).max)
    np.minimum.at(least, label, ids)
    # A component that was whole before and has gained none tells nothing.
    kinds = np.unique(np.stack([label, np.unique(before, return_inverse=True)[1]], 1), axis=0)[:, 0]
    grown = np.bincount(kinds, minlength=len(least))[label] > 1
    told = grown & (least[label] != ids)
    return pa.table({"a": ids[told], "b": least[label][told]})


def _same_row(rows: DataFrame, wanted: DataFrame) -> Column:
    return rows["doc_id"].eqNullSafe(wanted["doc_id"]) & (rows["text_hash"] == wanted["text_hash"])


def _shares(rows: DataFrame, by: list[str]) -> DataFrame:
    """``rows`` (n and more) by ``by``: the chunks that their number and size ask for."""
    return rows.groupBy(*by).agg((F.floor(F.greatest(F.count("*") / CHUNK_SETS, F.sum("n") / CHUNK_SHINGLES)) + 1).alias("chunks"))


def _compared(placed: DataFrame, texts: DataFrame, by: list[str]) -> DataFrame:
    """New connections (a, b) among ``placed`` rows (id, component, side and ``by``), compared by ``by``; materialised."""
    return materialise(placed.join(texts, "id").groupBy(*by).applyInArrow(_compare, "a long, b long").distinct())


def _every(n) -> Column:
    return F.explode(F.sequence(F.lit(0).cast("long"), n - 1))


def _between_blocks(group: DataFrame) -> DataFrame:
    """Rows (anchor, id, n, component) of large groups placed into pairs of blocks.

    A group's most frequent component, its hub, is not compared with itself: its blocks meet those of the other
    components, which also meet each other.
    """
    counts = group.groupBy("anchor", "component").agg(F.count("*").alias("k"))
    hubs = counts.groupBy("anchor").agg(F.max_by("component", "k").alias("hub"), F.count("*").alias("kinds")).filter("kinds > 1").select("anchor", "hub")
    dealt = group.join(hubs, "anchor").withColumn("in_hub", F.col("component") == F.col("hub")).drop("hub")
    shares = _shares(dealt, ["anchor", "in_hub"])
    shares = shares.groupBy("anchor").agg(F.max(F.when(F.col("in_hub"), F.col("chunks"))).alias("hubs"), F.max(F.when(~F.col("in_hub"), F.col("chunks"))).alias("others"))
    dealt = dealt.join(shares, "anchor").withColumn("block", F.pmod(F.xxhash64("id"), F.when(F.col("in_hub"), F.col("hubs")).otherwise(F.col("others"))))
    base = ["anchor", "id", "component"]
    hub = dealt.filter("in_hub").select(*base, _every(F.col("others")).alias("one"), (-1 - F.col("block")).alias("two"), F.lit(-1).cast("long").alias("side"))
    meet = dealt.filter("not in_hub").select(*base, "block", _every(F.col("hubs")).alias("with"))
    meet = meet.select(*base, F.col("block").alias("one"), (-1 - F.col("with")).alias("two"), F.lit(0).cast("long").alias("side"))
    rest = dealt.filter("not in_hub").select(*base, "block", _every(F.col("others")).alias("with"))
    rest = rest.select(*base, F.least("block", "with").alias("one"), F.greatest("block", "with").alias("two"), F.col("block").alias("side"))
    return hub.unionByName(meet).unionByName(rest)


def _components(df: DataFrame, text: str, row_id: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(members: a row per document; classes; (id, component) of the linked classes)."""
    spark = df.sparkSession
    docs = df.select(F.col(f"`{row_id}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    docs = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    members = materialise(docs.mapInArrow(_members, _MEMBERS))
    shared = spark.sparkContext.broadcast(_sketch(members))
    members = members.filter("part is null").drop("part", "counts")
    classes = members.filter("n_shingles > 0").groupBy("c1", "c2").agg(F.min("doc_id").alias("rep"), F.min_by("text_hash", "doc_id").alias("of_rep"), F.max("text_hash").alias("of_any"), F.max("n_shingles").alias("n"))
    classes = materialise(classes.select("c1", "c2", "rep", F.coalesce("of_rep", "of_any").alias("text_hash"), "n", F.monotonically_increasing_id().alias("id")))

    n_buckets = max(64, members.count() // BUCKET_DOCS)
    keys = docs.select("text").mapInArrow(_keys(n_buckets, shared), "bucket long, packed binary")
    tiles = materialise(keys.groupBy("bucket").applyInArrow(_tiles(shared), "anchor long, member long, hot long"))
    groups = materialise(_groups(tiles))

    # The classes of groups, and their groups with the chunks that they are compared in.
    met = groups.select(F.col("anchor").alias("c1")).unionByName(groups.select(F.col("member").alias("c1"))).distinct()
    wanted = materialise(classes.join(met, "c1").select("id", "c1", "n", F.col("rep").alias("doc_id"), "text_hash"))
    held = groups.unionByName(groups.select("anchor", F.col("anchor").alias("member")).distinct()).join(wanted.select(F.col("c1").alias("member"), "id", "n"), "member")
    held = materialise(held.join(_shares(held, ["anchor"]), "anchor").withColumn("is_anchor", F.col("anchor") == F.col("member")).drop("member"))

    # Signatures first: what can link with nobody of its group needs no text. Groups of several chunks stay whole.
    signed = members.join(wanted, _same_row(members, wanted)).select(wanted["id"], members["signature"]).mapInArrow(_first_of_class, "id long, signature binary")
    thinned = held.filter("chunks = 1").select("anchor", "id", "n").join(signed, "id").groupBy("anchor").applyInArrow(_with_partner, "anchor long, id long")
    kept = materialise(thinned.unionByName(held.filter("chunks > 1").select("anchor", "id")))
    wanted = materialise(wanted.join(kept.select("id").distinct(), "id"))
    near = marked(docs, F.xxhash64("doc_id", "text_hash"), wanted, F.xxhash64("doc_id", "text_hash")).filter("maybe")
    of = wanted.select("id", F.col("doc_id").alias("of_id"), F.col("text_hash").alias("of_hash"))
    texts = near.join(of, F.col("doc_id").eqNullSafe(F.col("of_id")) & (F.col("text_hash") == F.col("of_hash"))).select("id", "text")
    texts = materialise(texts.mapInArrow(_first_of_class, "id long, text string"))

    held = held.join(kept, ["anchor", "id"])
    one = held.select("anchor", "id", F.when(F.col("is_anchor"), F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).otherwise(F.array(F.pmod(F.xxhash64("id"), F.col("chunks")))).alias("in"))
    one = one.select("anchor", "id", F.explode("in").alias("chunk"), F.col("id").alias("component"), F.lit(0).cast("long").alias("side"))
    links = _compared(one, texts, ["anchor", "chunk"])
    linked = components(links)

    large = held.filter("chunks > 1").select("anchor", "id", "n")
    if not large.isEmpty():
        large = materialise(large.join(linked, "id", "left").withColumn("component", F.coalesce("component", "id")))
        more = _compared(_between_blocks(large), texts, ["anchor", "one", "two"])
        if not more.isEmpty():
            linked = components(links.unionByName(more))
    return members, classes, linked


def jaccard_components(df: DataFrame, text: str = "text", row_id: str = "doc_id") -> DataFrame:
    """Per row: doc_id, n_shingles and component_id.

    Null, empty and white-space texts have no shingles and link with nothing, not even each other. Rows with equal
    sets, repeats included, link. A null id is nobody's component id while its component has another; a component
    of null ids only has a null one. An empty table gives an empty one; other columns, whatever their names, are not
    read. Very long texts are read whole.
    """
    members, classes, linked = _components(df, text, row_id)
    reached = linked.join(classes.select("id", "rep"), "id").groupBy("component").agg(F.min("rep").alias("least"))
    named = classes.join(linked.join(reached, "component").select("id", "least", F.lit(True).alias("is_linked")), "id", "left")
    named = named.select("c1", "c2", F.when(F.col("is_linked"), F.col("least")).otherwise(F.col("rep")).alias("least"))
    found = members.join(named, ["c1", "c2"], "left")
    return found.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("least")).otherwise(F.col("doc_id")).alias("component_id"))


def near_dedup(df: DataFrame, text: str = "text", row_id: str = "doc_id") -> DataFrame:
    """One row of each component, with all its columns; rows without shingles are nobody's copies and all stay.

    The row with the component's least id stays, null ids last; where that row is itself repeated (same id and text),
    one of the repeats, the least by a hash of all columns. An empty table gives an empty one. Columns may have any
    names.
    """
    members, classes, linked = _components(df, text, row_id)
    alone = classes.join(linked, "id", "left_anti").select("rep", "text_hash")
    first = F.struct(F.col("rep").isNull().alias("none"), "rep", "text_hash")
    of_linked = linked.join(classes.select("id", "rep", "text_hash"), "id").groupBy("component").agg(F.min(first).alias("first")).select("first.rep", "first.text_hash")
    stay = alone.unionByName(of_linked)
    many = members.filter("n_shingles > 0").groupBy("doc_id", "text_hash").agg(F.count("*").alias("rows")).filter("rows > 1")
    empty = members.filter("n_shingles = 0").select(F.col("doc_id").alias("rep"), "text_hash").distinct()
    whole = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    stay = materialise(stay.toDF("of_id", "of_hash").unionByName(empty.toDF("of_id", "of_hash")))
    known = members.select("doc_id", "text_hash").distinct()
    gone = known.join(stay, F.col("doc_id").eqNullSafe(F.col("of_id")) & (F.col("text_hash") == F.col("of_hash")), "left_anti")
    return keep_rows(df, [F.col(f"`{row_id}`").cast("long"), F.xxhash64(whole)], stay, many, materialise(gone))


def op1_ngram_jaccard(spark, sf_dir: str) -> DataFrame:
    return jaccard_components(documents(spark, sf_dir))


OP1_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')] ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) END AS g FROM w
), n AS MATERIALIZED (SELECT doc_id, len(g)::BIGINT AS n FROM s), x AS MATERIALIZED (SELECT doc_id, unnest(g) AS g FROM s),
c AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS k FROM x a JOIN x b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS MATERIALIZED (SELECT u, v FROM c JOIN n a ON a.doc_id = u JOIN n b ON b.doc_id = v WHERE 100 * k >= 80 * (a.n + b.n - k)),
reach(u, v) AS (SELECT doc_id, doc_id FROM n UNION SELECT reach.u, e.v FROM reach JOIN e ON e.u = reach.v)
SELECT n.doc_id, n.n AS n_shingles, min(reach.v) AS component_id FROM n JOIN reach ON reach.u = n.doc_id GROUP BY n.doc_id, n.n
"""
