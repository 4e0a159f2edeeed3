"""Voice vectors: matching against a frozen library, similarity reports, sweeps and means."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.lens import PRINTS, voice_prints

THRESHOLD, RECENT_BONUS = 0.35, 0.10
#: Bytes of vectors up to which a library is broadcast.
BROADCAST_BYTES = 4 << 20
#: Vectors are dealt into at most PARTS parts while a part's vectors, as doubles, stay under PART_BYTES: each vector travels
#: as often as there are parts, and what a task holds is bounded. Fewer than these prints or probes are not parted further.
PARTS, PART_BYTES, BLOCK_PRINTS, BLOCK_PROBES, PAIR_BLOCK = 12, 64 << 20, 4_096, 4_096, 1_024
#: Rows and columns of one product, so that its similarities stay in a few MB; rows of pairs that a task gathers.
PRODUCT, GATHERED = 1_024, 1 << 20


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def unit(v: Column) -> Column:
    """Scaled to length 1; the zero vector stays."""
    norm = F.sqrt(dot(v, v))
    return F.when(norm > 0, F.transform(v, lambda x: x / norm)).otherwise(v)


_ANSWER = "probe long, print long, speaker_id long, sim double, best_sim double"


def parts(n: int, dims: int, least: int) -> int:
    """Parts that ``n`` vectors are dealt into."""
    return max(1, min(PARTS, -(-n // least)), -(-n * dims * 8 // PART_BYTES))


def _copies(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each vector the first that equals it, and the second (the first again where there is one only)."""
    whole = np.ascontiguousarray(vectors + 0.0)  # no negative zeros
    order = np.lexsort(whole.T[::-1]) if whole.size == 0 else np.argsort(whole.view(np.dtype((np.void, whole.shape[1] * 8))).ravel(), kind="stable")
    new = np.ones(len(order), bool)
    new[1:] = (whole[order[1:]] != whole[order[:-1]]).any(1)
    start = np.flatnonzero(new)[np.cumsum(new) - 1]
    after = np.minimum(start + 1, len(order) - 1)
    after = np.where(new[after], start, after)
    first, second = np.empty_like(order), np.empty_like(order)
    first[order], second[order] = order[start], order[after]
    return first, second


def _best(probes: np.ndarray, vectors: np.ndarray, ids: np.ndarray, matrix: np.ndarray, others_only: bool) -> tuple[np.ndarray, np.ndarray]:
    """(row of ``matrix``, similarity) of each probe's best, the first of equal vectors; a row of -1 where it has none.

    Products are formed in squares. A winner's similarity is formed once more row by row, so that equal vectors have equal
    ones wherever they stand.
    """
    best, top = np.full(len(probes), -1), np.full(len(probes), -np.inf)
    if not len(ids):
        return best, top
    own = [np.searchsorted(ids, probes, side) for side in ("left", "right")] if others_only else None
    for at in range(0, len(probes), PRODUCT):
        rows = np.arange(at, min(at + PRODUCT, len(probes)))
        for c in range(0, len(ids), PRODUCT):
            sims = vectors[rows] @ matrix[c : c + PRODUCT].T
            if own:
                lo, hi = np.maximum(own[0][rows], c) - c, np.minimum(own[1][rows], c + PRODUCT) - c
                for r in np.flatnonzero(lo < hi):
                    sims[r, lo[r] : hi[r]] = -np.inf
            found = sims.argmax(1)
            value = sims[np.arange(len(rows)), found]
            better = value > top[rows]
            best[rows[better]], top[rows[better]] = found[better] + c, value[better]
    hit = np.flatnonzero(best >= 0)
    first, second = _copies(matrix)
    for equal in (second, first):
        other = equal[best[hit]]
        free = ids[other] != probes[hit] if others_only else np.ones(len(hit), bool)
        best[hit[free]] = np.minimum(best[hit], other)[free]
    top[hit] = np.einsum("ij,ij->i", vectors[hit], matrix[best[hit]])
    return best, top


def _answers(probes: np.ndarray, vectors: np.ndarray, ids: np.ndarray, speakers: np.ndarray, matrix: np.ndarray, rule: tuple) -> pa.Table:
    """Each probe's best able print, the first on ties, and its best similarity of all; prints stand in order of id.

    All prints of a kind, the favoured speaker's and the others', have one threshold, so the best of each kind decide.
    """
    threshold, favoured, bonus, others_only = rule
    kinds = [("probe", pa.int64()), ("print", pa.int64()), ("speaker_id", pa.int64()), ("sim", pa.float64()), ("best_sim", pa.float64())]
    if not len(ids) or not len(probes):
        return pa.table({name: pa.array(probes, kind) if name == "probe" else pa.nulls(len(probes), kind) for name, kind in kinds})
    top, sim, best = (np.full(len(probes), x) for x in (-np.inf, -np.inf, -1))
    favour = speakers == favoured if favoured is not None else np.zeros(len(ids), bool)
    for kind, need in ((~favour, threshold), (favour, threshold - bonus)):
        rows = np.flatnonzero(kind)
        if not len(rows):
            continue
        row, value = _best(probes, vectors, ids[rows], matrix[rows], others_only)
        row = np.where(row < 0, -1, rows[row])
        top = np.maximum(top, value)
        wins = (row >= 0) & (value >= need) & ((value > sim) | ((value == sim) & (row < best)))
        best, sim = np.where(wins, row, best), np.where(wins, value, sim)
    hit = best >= 0
    found = (probes, ids[best], speakers[best], sim, top)
    masks = (np.zeros(len(hit), bool), ~hit, ~hit, ~hit, ~np.isfinite(top))
    return pa.table({name: pa.array(np.where(m, 0, x), kind, mask=m) for (name, kind), x, m in zip(kinds, found, masks)})


def _library(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, speakers, vectors) in order of id."""
    table = table.sort_by("id")
    return table.column("id").to_numpy(), table.column("speaker_id").to_numpy(), _matrix(table.column("centroid"))


def _matrix(vectors) -> np.ndarray:
    flat = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(flat), -1) if len(flat) else np.zeros((0, 0))


def _numbers(df: DataFrame, *columns: str) -> DataFrame:
    """``columns`` and the centroid, as floats if it is given as such (they travel at half the size), else as doubles."""
    kept = dict(df.dtypes)["centroid"] == "array<float>"
    return df.select(*columns, F.col("centroid") if kept else F.col("centroid").cast("array<double>").alias("centroid"))


def _every(n: int):
    return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))


def match_frozen(probes: DataFrame, library: DataFrame, threshold: float = THRESHOLD, favoured: int | None = None, bonus: float = 0.0, others_only: bool = False) -> DataFrame:
    """Per probe its best print among those that reach their own speaker's threshold, the first on ties, and the best of all.

    ``favoured`` is the speaker whose threshold is lower by ``bonus``; with ``others_only`` a probe doesn't meet the
    print of its own id. A library of up to BROADCAST_BYTES is broadcast; a larger one is dealt into blocks, probes
    meet every block in chunks, and their best answers are combined: nothing of it passes the driver. Each vector goes to
    at most PARTS tasks while a task's vectors stay under PART_BYTES, and a task forms its products in small squares.
    """
    rule = (threshold, favoured, bonus, others_only)
    held, asked = _numbers(library, "id", "speaker_id"), _numbers(probes, "id")
    size = held.agg(F.count("*").alias("n"), F.coalesce(F.max(F.size("centroid")), F.lit(0)).alias("dims")).first()
    if size.n * size.dims * 8 <= BROADCAST_BYTES:
        shared = probes.sparkSession.sparkContext.broadcast(_library(held.toArrow()))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield from _answers(batch.column(0).to_numpy(), _matrix(batch.column(1)), *shared.value, rule).to_batches()

        return asked.mapInArrow(run, _ANSWER)

    blocks, chunks = parts(size.n, size.dims, BLOCK_PRINTS), parts(asked.count(), size.dims, BLOCK_PROBES)
    # Names of its own on one side: of two sides of one table Spark would prune columns by the other's needs.
    dealt = held.select(*[F.col(c).alias(f"r_{c}") for c in held.columns]).withColumn("r_block", F.pmod(F.xxhash64("r_id"), F.lit(blocks))).withColumn("r_chunk", _every(chunks))
    meet = asked.withColumn("chunk", F.pmod(F.xxhash64("id"), F.lit(chunks))).withColumn("block", _every(blocks))
    compare = lambda l, r: _answers(l.column("id").to_numpy(), _matrix(l.column("centroid")), *_library(r.rename_columns([c.removeprefix("r_") for c in r.column_names])), rule)
    found = meet.groupBy("block", "chunk").cogroup(dealt.groupBy("r_block", "r_chunk")).applyInArrow(compare, _ANSWER)
    best = F.max_by(F.struct("print", "speaker_id", "sim"), F.when(F.col("sim").isNotNull(), F.struct("sim", -F.col("print"))))
    return found.groupBy("probe").agg(best.alias("b"), F.max("best_sim").alias("best_sim")).select("probe", "b.print", "b.speaker_id", "b.sim", "best_sim")


_PAIR_KINDS = {"a": pa.int64(), "b": pa.int64(), "pairs": pa.int64(), "low": pa.float64(), "total": pa.float64(), "high": pa.float64()}


def _gathered(rows: list[pa.Table]) -> pa.Table:
    """One row a pair of speakers."""
    both = pa.concat_tables(rows).group_by(["a", "b"]).aggregate([("pairs", "sum"), ("low", "min"), ("total", "sum"), ("high", "max")])
    return both.select(["a", "b", "pairs_sum", "low_min", "total_sum", "high_max"]).rename_columns(list(_PAIR_KINDS)).cast(pa.schema(_PAIR_KINDS))


def _square(x: np.ndarray, y: np.ndarray, of_x: np.ndarray, of_y: np.ndarray, same: bool) -> pa.Table:
    """Count, least, sum and greatest of the similarities of two runs of vectors, in order of speaker, by their speakers (a <= b)."""
    sims = x @ y.T
    cuts = [np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]])) for s in (of_x, of_y)]
    by = lambda f, v: f.reduceat(f.reduceat(v, cuts[0], axis=0), cuts[1], axis=1)
    if same:
        counted = np.triu(np.ones(sims.shape, bool), 1)
        n, low = by(np.add, counted.astype(np.int64)), by(np.minimum, np.where(counted, sims, np.inf))
        total, high = by(np.add, np.where(counted, sims, 0.0)), by(np.maximum, np.where(counted, sims, -np.inf))
    else:
        n = np.outer(*[np.diff(np.append(c, len(s))) for c, s in zip(cuts, (of_x, of_y))])
        low, total, high = by(np.minimum, sims), by(np.add, sims), by(np.maximum, sims)
    i, j = np.nonzero(n)
    a, b = of_x[cuts[0]][i], of_y[cuts[1]][j]
    return pa.table({c: pa.array(v, kind) for (c, kind), v in zip(_PAIR_KINDS.items(), (np.minimum(a, b), np.maximum(a, b), n[i, j], low[i, j], total[i, j], high[i, j]))})


def _pairs_of_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Count, least, sum and greatest of the similarities of all pairs of prints of two parts, by their speakers (a <= b)."""
    table = pa.Table.from_batches(batches)
    one, two = table.column("one")[0].as_py(), table.column("two")[0].as_py()
    sides = []
    for side in (one, two) if one != two else (one,):
        part = table.filter(pyarrow.compute.equal(table.column("side"), side)).sort_by([("speaker_id", "ascending"), ("id", "ascending")])
        sides.append((_matrix(part.column("centroid")), part.column("speaker_id").to_numpy()))
    del table
    (x, of_x), (y, of_y) = sides[0], sides[-1]
    found = []
    for i in range(0, len(x), PRODUCT):
        for j in range(i if one == two else 0, len(y), PRODUCT):
            found.append(_square(x[i : i + PRODUCT], y[j : j + PRODUCT], of_x[i : i + PRODUCT], of_y[j : j + PRODUCT], one == two and i == j))
            if sum(map(len, found)) > GATHERED:
                yield from _gathered(found).to_batches()
                found = []
        found = [_gathered(found)] if found else []
    if found:
        yield from _gathered(found).to_batches()


def _tiles(held: DataFrame, blocks) -> DataFrame:
    """Prints beside every part of ``blocks`` (a column): those of parts ``one`` <= ``two`` meet there."""
    dealt = held.withColumn("side", F.pmod(F.xxhash64("id"), blocks)).withColumn("with", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
    return dealt.select("id", "speaker_id", "centroid", "side", F.least("side", "with").alias("one"), F.greatest("side", "with").alias("two"))


def _size(held: DataFrame) -> tuple[int, int]:
    """(vectors, numbers of the longest)."""
    return tuple(held.agg(F.count("*"), F.coalesce(F.max(F.size("centroid")), F.lit(0))).first())


def inside_similarity(prints: DataFrame) -> DataFrame:
    """(a, b, pairs, low, mean, high) inside each speaker, a = b: only prints of one speaker are multiplied, in pairs of its parts."""
    held = _numbers(prints.filter("speaker_id IS NOT NULL"), "id", "speaker_id")
    n, room = F.count("*"), F.lit(PART_BYTES / 8)
    blocks = F.greatest(F.least(F.lit(PARTS), F.ceil(n / PAIR_BLOCK)), F.ceil(n * F.max(F.size("centroid")) / room)).cast("long")
    dealt = held.join(held.groupBy("speaker_id").agg(blocks.alias("blocks")), "speaker_id")
    return _summed(_tiles(dealt, F.col("blocks")).groupBy("speaker_id", "one", "two"))


def _summed(tiles) -> DataFrame:
    found = tiles.applyInArrow(_pairs_of_blocks, "a long, b long, pairs long, low double, total double, high double")
    return found.groupBy("a", "b").agg(F.sum("pairs").alias("pairs"), F.min("low").alias("low"), (F.sum("total") / F.sum("pairs")).alias("mean"), F.max("high").alias("high"))


def pair_similarity(prints: DataFrame) -> DataFrame:
    """(a, b, pairs, low, mean, high): similarities of all pairs of prints by their two speakers, a = b inside one.

    Prints are dealt into parts, at most PARTS while a part's vectors stay under PART_BYTES, so what travels grows with the
    prints and not with their pairs; two parts meet in a task, which multiplies them in squares, and of which only rows per
    pair of speakers leave.
    """
    held = _numbers(prints.filter("speaker_id IS NOT NULL"), "id", "speaker_id")
    return _summed(_tiles(held, F.lit(parts(*_size(held), PAIR_BLOCK)).cast("long")).groupBy("one", "two"))


def separability(pairs: DataFrame) -> DataFrame:
    """(worst_inside, best_between, separable, threshold): whether one threshold tells all voices apart, and the middle one."""
    both = pairs.agg(F.coalesce(F.min(F.when(F.col("a") == F.col("b"), F.col("low"))), F.lit(1.0)).alias("worst_inside"), F.coalesce(F.max(F.when(F.col("a") != F.col("b"), F.col("high"))), F.lit(-1.0)).alias("best_between"))
    apart = F.col("worst_inside") > F.col("best_between")
    return both.select("*", apart.alias("separable"), F.when(apart, F.round((F.col("worst_inside") + F.col("best_between")) / 2, 2)).alias("threshold"))


def vector_sums(prints: DataFrame) -> DataFrame:
    cells = prints.select("speaker_id", F.posexplode("centroid").alias("at", "x")).groupBy("speaker_id", "at").agg(F.sum("x").alias("x"), F.count("*").alias("n"))
    return cells.groupBy("speaker_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "x"))), lambda c: c["x"]).alias("total"), F.max("n").alias("n"))


def assignment_errors(truth: DataFrame, by: list[str] | None = None) -> DataFrame:
    """profiles, splits (people with several profiles) and merges (pairs of people that share one) of (person, profile), per ``by``."""
    by = by or []
    held = truth.filter("profile IS NOT NULL").select(*by, "person", "profile").distinct()
    splits = held.groupBy(*by, "person").agg(F.count("*").alias("n")).groupBy(*by).agg(F.count_if(F.col("n") > 1).alias("splits"))
    one, two = held.withColumnRenamed("person", "a"), held.withColumnRenamed("person", "b")
    merges = one.join(two, [*by, "profile"]).filter("a < b").select(*by, "a", "b").distinct().groupBy(*by).agg(F.count("*").alias("merges"))
    profiles = held.groupBy(*by).agg(F.count_distinct("profile").alias("profiles"))
    if not by:
        return profiles.join(splits).join(merges)  # one row each
    return profiles.join(splits, by, "left").join(merges, by, "left").select(*by, "profiles", "splits", F.coalesce("merges", F.lit(0)).cast("long").alias("merges"))


def threshold_sweep(matches: DataFrame, steps: list[float]) -> DataFrame:
    """How many probes each threshold would attribute: probes counted by the highest step they reach, and added up."""
    reached = F.size(F.filter(F.array(*[F.lit(float(s)) for s in sorted(steps)]), lambda s: F.col("best_sim") >= s))
    counts = matches.groupBy(F.greatest(reached, F.lit(0)).alias("reached")).agg(F.count("*").alias("n"))  # one row a step at most
    told = [F.struct(F.lit(float(s)).alias("threshold"), F.coalesce(F.sum(F.when(F.col("reached") > k, F.col("n"))), F.lit(0)).alias("matched"), F.coalesce(F.sum("n"), F.lit(0)).alias("probes")) for k, s in enumerate(sorted(steps))]
    return counts.agg(F.array(*told).alias("told")).select(F.explode("told").alias("t")).select("t.*").filter("probes > 0")


STEPS = [k / 100 for k in range(20, 65, 5)]


def _frozen(spark, d):
    """Every print against all others."""
    prints = voice_prints(spark, d, "float")
    return match_frozen(prints, prints, 0.25, 3, RECENT_BONUS, others_only=True).select("probe", "print", "speaker_id", F.round("sim", 6).alias("sim"), F.round("best_sim", 6).alias("best_sim"))


def _rounded(pairs: DataFrame) -> DataFrame:
    return pairs.select("a", "b", "pairs", *[F.round(c, 6).alias(c) for c in ("low", "mean", "high")])


def _errors(spark, d):
    return assignment_errors(_frozen(spark, d).join(voice_prints(spark, d).select(F.col("id").alias("probe"), F.col("speaker_id").alias("person")), "probe").select("person", F.col("speaker_id").alias("profile")))


_SIMS = f"""(SELECT p.id AS probe, l.id AS print, l.speaker_id, p.speaker_id AS person, list_dot_product(p.centroid, l.centroid) AS sim FROM {PRINTS} p, {PRINTS} l WHERE p.id <> l.id)"""
_MATCH = f"""(SELECT probe, any_value(person) AS person, arg_max(print, sim) FILTER (sim >= 0.25 - CASE WHEN speaker_id = 3 THEN 0.1 ELSE 0 END) AS print, arg_max(speaker_id, sim) FILTER (sim >= 0.25 - CASE WHEN speaker_id = 3 THEN 0.1 ELSE 0 END) AS speaker_id,
  round(max(sim) FILTER (sim >= 0.25 - CASE WHEN speaker_id = 3 THEN 0.1 ELSE 0 END), 6) AS sim, round(max(sim), 6) AS best_sim FROM {_SIMS} GROUP BY probe)"""

_PAIRS = f"""(SELECT least(x.speaker_id, y.speaker_id) AS a, greatest(x.speaker_id, y.speaker_id) AS b, count(*) AS pairs, round(min(list_dot_product(x.centroid, y.centroid)), 6) AS low, round(avg(list_dot_product(x.centroid, y.centroid)), 6) AS mean,
  round(max(list_dot_product(x.centroid, y.centroid)), 6) AS high FROM {PRINTS} x JOIN {PRINTS} y ON x.id < y.id GROUP BY ALL)"""

QUERIES = {
    "voice_match_frozen": _frozen,
    "similarity_within": lambda s, d: _rounded(inside_similarity(voice_prints(s, d, "float"))),
    "voice_separability": lambda s, d: separability(_rounded(pair_similarity(voice_prints(s, d, "float")))),
    "assignment_errors": _errors,
    "threshold_sweep": lambda s, d: threshold_sweep(_frozen(s, d), STEPS),
    "centroid_mean": lambda s, d: vector_sums(voice_prints(s, d)).select("speaker_id", F.col("n"), F.round(F.get(unit(F.col("total")), F.lit(0)), 6).alias("first"), F.round(F.get(unit(F.col("total")), F.lit(63)), 6).alias("last")),
}

SQL = {
    "voice_match_frozen": f"SELECT probe, print, speaker_id, sim, best_sim FROM {_MATCH}",
    "similarity_within": f"SELECT * FROM {_PAIRS} WHERE a = b",
    "voice_separability": f"""SELECT *, worst_inside > best_between AS separable, CASE WHEN worst_inside > best_between THEN round((worst_inside + best_between) / 2, 2) END AS threshold
      FROM (SELECT coalesce(min(low) FILTER (a = b), 1.0) AS worst_inside, coalesce(max(high) FILTER (a <> b), -1.0) AS best_between FROM {_PAIRS})""",
    "assignment_errors": f"""WITH h AS (SELECT DISTINCT person, speaker_id AS profile FROM {_MATCH} WHERE speaker_id IS NOT NULL)
      SELECT (SELECT count(DISTINCT profile) FROM h) AS profiles, (SELECT count(*) FROM (SELECT person FROM h GROUP BY person HAVING count(*) > 1)) AS splits,
      (SELECT count(*) FROM (SELECT DISTINCT a.person, b.person FROM h a JOIN h b ON a.profile = b.profile AND a.person < b.person)) AS merges""",
    "threshold_sweep": f"SELECT threshold, count(*) FILTER (best_sim >= threshold) AS matched, count(*) AS probes FROM {_MATCH}, (VALUES {', '.join(f'({s}::DOUBLE)' for s in STEPS)}) AS v(threshold) GROUP BY threshold",
    "centroid_mean": f"""WITH c AS (SELECT speaker_id, unnest(centroid) AS x, generate_subscripts(centroid, 1) AS i FROM {PRINTS}), s AS (SELECT speaker_id, i, sum(x) AS x, count(*) AS n FROM c GROUP BY ALL),
      t AS (SELECT speaker_id, sqrt(sum(x * x)) AS norm, max(n) AS n FROM s GROUP BY speaker_id)
      SELECT speaker_id, t.n, round(a.x / norm, 6) AS first, round(b.x / norm, 6) AS last FROM t JOIN s a USING (speaker_id) JOIN s b USING (speaker_id) WHERE a.i = 1 AND b.i = 64""",
}
