"""Similarities between voices by bounds: groups of like vectors that cannot hold an extreme are never multiplied.

Each speaker's vectors are dealt into chunks, and a task parts its chunk into groups around far-apart pivots; a group is
told by its middle direction, the widest angle from it and its lengths. Angles obey the triangle inequality, so two groups
bound all their products from both sides. The best certain bounds of two speakers leave out every pair of groups that can
neither raise the greatest similarity nor lower the least; the products of the others are formed. The mean needs none.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.lens import voice_prints
from ..sources.tables import written
from .vectors import _PAIRS, _matrix, _rounded, dot, pair_similarity, vector_sums

#: Vectors of a chunk and groups that it is parted into; groups whose pairs one task bounds.
CHUNK, GROUPS, TILE = 2_048, 16, 1_024
#: Share of the products from which forming all of them, block by block, costs less.
TOO_MANY = 0.5
#: Slack for rounding of angles, so that a bound is never too tight.
SLACK = 1e-9

_GROUPED = "speaker_id long, grp long, id long, centroid array<double>, middle array<double>, angle double, least double, most double, n long"


def parted(x: np.ndarray, groups: int) -> np.ndarray:
    """A group for each vector: the nearest in direction of pivots that each lie farthest from those before."""
    norms = np.linalg.norm(x, axis=1)
    unit = x / np.where(norms > 0, norms, 1)[:, None]
    near, which, pivot = np.full(len(x), -np.inf), np.zeros(len(x), np.int64), 0
    for k in range(min(groups, len(x))):
        sims = unit @ unit[pivot]
        closer = sims > near
        near[closer], which[closer] = sims[closer], k
        pivot = int(near.argmin())
        if near[pivot] > 1 - 1e-12:
            break
    return which


def _part(key: tuple, chunk: pa.Table) -> pa.Table:
    speaker, number = key[0].as_py(), key[1].as_py()
    chunk = chunk.sort_by("id")
    x, ids = _matrix(chunk.column("centroid")), chunk.column("id").to_numpy()
    which = parted(x, GROUPS)
    heads = {k: [] for k in ("middle", "angle", "least", "most", "n")}
    first = np.zeros(len(ids), bool)
    for g in np.unique(which):
        own = np.flatnonzero(which == g)
        first[own[0]] = True
    for i in range(len(ids)):
        if not first[i]:
            for v in heads.values():
                v.append(None)
            continue
        own = x[which == which[i]]
        lengths = np.linalg.norm(own, axis=1)
        unit = own / np.where(lengths > 0, lengths, 1)[:, None]
        middle = unit.mean(0)
        size = np.linalg.norm(middle)
        middle = middle / size if size > 0 else unit[0]
        # A zero vector has no direction: any angle.
        angle = np.pi if (lengths == 0).any() or size == 0 else float(np.arccos(np.clip(unit @ middle, -1, 1)).max()) + SLACK
        for c, v in zip(heads, (middle.tolist(), angle, float(lengths.min()), float(lengths.max()), len(own))):
            heads[c].append(v)
    grp = number * GROUPS + which
    columns = {"speaker_id": pa.array([speaker] * len(ids), pa.int64()), "grp": pa.array(grp, pa.int64()), "id": pa.array(ids, pa.int64()), "centroid": chunk.column("centroid"), "middle": pa.array(heads["middle"], pa.list_(pa.float64()))}
    return pa.table(columns | {c: pa.array(heads[c], pa.float64()) for c in ("angle", "least", "most")} | {"n": pa.array(heads["n"], pa.int64())})


def bounds(one: dict, two: dict) -> tuple[np.ndarray, np.ndarray]:
    """(least, greatest) that any product of a vector of each of ``one``'s groups and one of ``two``'s can be."""
    between = np.arccos(np.clip(one["middle"] @ two["middle"].T, -1, 1))
    wide = one["angle"][:, None] + two["angle"][None, :] + SLACK
    low, high = np.cos(np.minimum(between + wide, np.pi)), np.cos(np.maximum(between - wide, 0))
    short, long = one["least"][:, None] * two["least"][None, :], one["most"][:, None] * two["most"][None, :]
    return np.where(low < 0, low * long, low * short) - SLACK, np.where(high > 0, high * long, high * short) + SLACK


def _sides(tile: pa.Table) -> tuple[dict, dict, bool]:
    """Both sides' groups as arrays, and whether they are one."""
    one, two = tile.column("one")[0].as_py(), tile.column("two")[0].as_py()
    out = []
    for side in (one, two):
        part = tile.filter(pa.compute.equal(tile.column("side"), side))
        told = {c: part.column(c).to_numpy() for c in ("speaker_id", "grp", "angle", "least", "most", "n")}
        out.append(told | {"middle": _matrix(part.column("middle"))})
    return out[0], out[1], one == two


_EMPTY = {"a": pa.int64(), "b": pa.int64()}


def _pairs_of(one: dict, two: dict, same: bool):
    """Index pairs of groups of different speakers, each once, with (a, b) speakers in order, and their bounds."""
    if not len(one["grp"]) or not len(two["grp"]):
        none = np.zeros(0, np.int64)
        return none, none, none, none, none.astype(float), none.astype(float)
    low, high = bounds(one, two)
    sa, sb = one["speaker_id"][:, None], two["speaker_id"][None, :]
    i, j = np.nonzero((sa < sb) if same else (sa != sb))
    a, b = one["speaker_id"][i], two["speaker_id"][j]
    return i, j, np.minimum(a, b), np.maximum(a, b), low[i, j], high[i, j]


def _certain(tile: pa.Table) -> pa.Table:
    """By two speakers: what the greatest similarity reaches, and the least falls to, for certain; and all products."""
    one, two, same = _sides(tile)
    i, j, a, b, low, high = _pairs_of(one, two, same)
    products = one["n"][i] * two["n"][j] if len(i) else np.zeros(0, np.int64)
    pairs, where = np.unique(np.stack([a, b], 1), axis=0, return_inverse=True) if len(i) else (np.zeros((0, 2), np.int64), np.zeros(0, np.int64))
    reach, fall, total = np.full(len(pairs), -np.inf), np.full(len(pairs), np.inf), np.zeros(len(pairs), np.int64)
    np.maximum.at(reach, where, low)
    np.minimum.at(fall, where, high)
    np.add.at(total, where, products)
    return pa.table({"a": pa.array(pairs[:, 0], pa.int64()), "b": pa.array(pairs[:, 1], pa.int64()), "reach": reach, "fall": fall, "products": total})


def _open(tile: pa.Table, certain: pa.Table) -> pa.Table:
    """Pairs of groups that may hold an extreme."""
    kinds = {"a": pa.int64(), "b": pa.int64(), "of_a": pa.int64(), "of_b": pa.int64(), "products": pa.int64()}
    if not len(tile):
        return pa.table({c: pa.array([], k) for c, k in kinds.items()})
    one, two, same = _sides(tile)
    i, j, a, b, low, high = _pairs_of(one, two, same)
    known = {(r["a"], r["b"]): (r["reach"], r["fall"]) for r in certain.to_pylist()}
    reach, fall = (np.array([known[p][k] for p in zip(a.tolist(), b.tolist())]) for k in (0, 1))
    may = (high >= reach) | (low <= fall) if len(i) else np.zeros(0, bool)
    i, j, a, b = i[may], j[may], a[may], b[may]
    turned = one["speaker_id"][i] != a
    of_a, of_b = np.where(turned, two["grp"][j], one["grp"][i]), np.where(turned, one["grp"][i], two["grp"][j])
    return pa.table({c: pa.array(v, kinds[c]) for c, v in zip(kinds, (a, b, of_a, of_b, one["n"][i] * two["n"][j]))})


def _multiplied(left: pa.Table, right: pa.Table) -> pa.Table:
    row = {c: left.column(f"l_{c}")[0].as_py() for c in ("a", "b")}
    sims = _matrix(left.column("l_x")) @ _matrix(right.column("r_x")).T
    return pa.table({"a": pa.array([row["a"]], pa.int64()), "b": pa.array([row["b"]], pa.int64()), "low": [float(sims.min())], "high": [float(sims.max())]})


def pair_extremes(prints: DataFrame) -> tuple[DataFrame, float]:
    """((a, b, low, high) of every two speakers a < b, the share of the products that was formed)."""
    held = prints.filter("speaker_id IS NOT NULL AND centroid IS NOT NULL").select(F.col("speaker_id").cast("long").alias("speaker_id"), "id", F.col("centroid").cast("array<double>").alias("centroid"))
    sizes = held.groupBy("speaker_id").agg(F.ceil(F.count("*") / CHUNK).alias("chunks"))
    dealt = held.join(sizes, "speaker_id").withColumn("chunk", F.pmod(F.xxhash64("id"), F.col("chunks")))
    grouped = written(dealt.select("speaker_id", "chunk", "id", "centroid").groupBy("speaker_id", "chunk").applyInArrow(_part, _GROUPED))
    heads = grouped.filter("n IS NOT NULL").drop("id", "centroid")
    sides = max(1, -(-heads.count() // TILE))
    with_all = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(sides - 1).cast("long")))
    tiles = heads.withColumn("side", F.pmod(F.xxhash64("speaker_id", "grp"), F.lit(sides))).withColumn("with", with_all)
    tiles = tiles.withColumns({"one": F.least("side", "with"), "two": F.greatest("side", "with")}).drop("with")
    found = tiles.groupBy("one", "two").applyInArrow(_certain, "a long, b long, reach double, fall double, products long")
    certain = written(found.groupBy("a", "b").agg(F.max("reach").alias("reach"), F.min("fall").alias("fall"), F.sum("products").alias("products")))
    told = _certain_of_tiles(tiles, certain)
    left = written(tiles.groupBy("one", "two").cogroup(told.groupBy("of_one", "of_two")).applyInArrow(_open, "a long, b long, of_a long, of_b long, products long"))
    whole = certain.agg(F.sum("products")).first()[0] or 0
    share = (left.agg(F.sum("products")).first()[0] or 0) / whole if whole else 0.0
    if share > TOO_MANY:
        return pair_similarity(held).filter("a < b").select("a", "b", "low", "high"), 1.0
    rows = grouped.select("speaker_id", "grp", "centroid")
    names = ["a", "b", "of_a", "of_b"]

    def side(k: str, mark: str):
        """The vectors of one side of every pair that is left, under names of their own."""
        pairs, of = left.select(*[F.col(c).alias(mark + c) for c in names]), rows.select(F.col("speaker_id").alias(f"{mark}speaker"), F.col("grp").alias(f"{mark}grp"), F.col("centroid").alias("centroid"))
        met = pairs.join(of, (F.col(f"{mark}{k}") == F.col(f"{mark}speaker")) & (F.col(f"{mark}of_{k}") == F.col(f"{mark}grp")))
        return met.select(*[mark + c for c in names], F.col("centroid").alias(f"{mark}x")).groupBy(*[mark + c for c in names])

    products = side("a", "l_").cogroup(side("b", "r_")).applyInArrow(_multiplied, "a long, b long, low double, high double")
    return products.groupBy("a", "b").agg(F.min("low").alias("low"), F.max("high").alias("high")), share


def _certain_of_tiles(tiles: DataFrame, certain: DataFrame) -> DataFrame:
    """The certain bounds of the speakers that meet in each tile."""
    met = lambda x: tiles.select(F.col("one").alias(f"one_{x}"), F.col("two").alias(f"two_{x}"), F.col("speaker_id").alias(x)).distinct()
    same = (F.col("one_a") == F.col("one_b")) & (F.col("two_a") == F.col("two_b")) & (F.col("a") < F.col("b"))
    pairs = met("a").join(met("b"), same).select(F.col("one_a").alias("of_one"), F.col("two_a").alias("of_two"), "a", "b").distinct()
    return pairs.join(certain.select("a", "b", "reach", "fall"), ["a", "b"]).select("of_one", "of_two", "a", "b", "reach", "fall")


def between_similarity(prints: DataFrame) -> DataFrame:
    """(a, b, pairs, low, mean, high) of every two speakers a < b; the mean comes from both sums of vectors."""
    extremes, _ = pair_extremes(prints)
    sums = vector_sums(prints.filter("speaker_id IS NOT NULL"))
    side = lambda k: sums.select(F.col("speaker_id").alias(k), F.col("total").alias(f"t{k}"), F.col("n").alias(f"n{k}"))
    both = extremes.join(side("a"), "a").join(side("b"), "b")
    pairs = F.col("na") * F.col("nb")
    return both.select("a", "b", pairs.alias("pairs"), "low", (dot(F.col("ta"), F.col("tb")) / pairs).alias("mean"), "high")


QUERIES = {"similarity_between": lambda s, d: _rounded(between_similarity(voice_prints(s, d)))}
SQL = {"similarity_between": f"SELECT * FROM {_PAIRS} WHERE a < b"}
