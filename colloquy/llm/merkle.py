"""Merkle manifest of a dataset with a proof for each row (operator 12).

Every row is a leaf; the leaves of one tree ascend by their order columns, sixteen nodes hash to one, and the trees'
roots, in order of the trees' names, hash in the same way to the manifest's root. Positions come from range
partitions and counts, never from one sorted task. A tree is cut into aligned blocks of 16 ** 3 leaves. A first pass
hashes each block to its root, and the blocks' roots are the leaves of the next, 4096 times smaller round. A second
pass walks the leaves of a block in order: a treehash for each level builds the next run of siblings, one leaf a step,
while the present run serves, so that a walk holds one run and one open hash a level; what lies above the block is
the same for all of its leaves and is appended.
"""

from __future__ import annotations

import hashlib
import string
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import documents, materialise

#: Fixed values of the contract: children of a node, and the first divisor of an id's crc32 that marks a changed row.
ARITY, CHANGED = 16, 5
#: Levels inside an aligned block; a block of 4096 leaves is walked by one task.
BLOCK_LEVELS = 3
BLOCK = ARITY**BLOCK_LEVELS

PATH = "array<struct<left:string,right:string>>"


def encoded(columns: list[Column]) -> Column:
    """Values one after the other without ambiguity: ``-`` for null, else the UTF-8 length, a colon and the value."""
    parts = []
    for c in columns:
        value = c.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-")))
    return F.concat(*parts)


def digest(text: Column) -> Column:
    """32 bytes of sha256; as hexadecimal text they would travel at twice the length."""
    return F.unhex(F.sha2(text.cast("binary"), 256))


def positions(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` with ``pos``, their place in their ``tree`` by ``order``, and ``n``, the tree's number of rows.

    A range partition holds consecutive rows; how many of a tree precede it is a sum over one row a partition. Ties in
    ``order`` are told apart by the column ``row``, so that equal rows are dealt over partitions too.
    """
    spread = materialise(rows.repartitionByRange("tree", *order, "row").withColumn("part", F.spark_partition_id()))
    by_part = Window.partitionBy("tree").orderBy("part")
    counts = spread.groupBy("tree", "part").agg(F.count("*").alias("held"))
    before = F.coalesce(F.sum("held").over(by_part.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select("tree", "part", before.alias("before"), F.sum("held").over(Window.partitionBy("tree")).alias("n"))
    inside = F.row_number().over(Window.partitionBy("tree", "part").orderBy(*order, "row")) - 1
    return spread.withColumn("inside", inside).join(counts, ["tree", "part"]).withColumn("pos", F.col("before") + F.col("inside")).drop("part", "before", "inside")


class Treehash:
    """The nodes of one level from leaves that come one by one: an open hash and a count for each level below."""

    def __init__(self, level: int) -> None:
        self.level, self.nodes = level, []
        self.open, self.count = [hashlib.sha256() for _ in range(level)], [0] * level

    def push(self, node: bytes, level: int = 0) -> None:
        while level < self.level:
            self.open[level].update(node)
            self.count[level] += 1
            if self.count[level] < ARITY:
                return
            node = self._close(level)
            level += 1
        self.nodes.append(node)

    def _close(self, level: int) -> bytes:
        node = self.open[level].hexdigest().encode()
        self.open[level], self.count[level] = hashlib.sha256(), 0
        return node

    def take(self) -> list[bytes]:
        """All nodes so far; runs that the leaves' end leaves short are closed. It begins anew after that."""
        for level in range(self.level):
            if self.count[level]:
                self.push(self._close(level), level + 1)
        nodes, self.nodes = self.nodes, []
        return nodes


def levels_of(n: int) -> int:
    """Levels that a block of a tree of ``n`` leaves has: all of them, or as many as leave one node of a lone block."""
    levels = 0
    while levels < BLOCK_LEVELS and ARITY**levels < n:
        levels += 1
    return levels


def walk(leaves: list[bytes], levels: int) -> Iterator[list[tuple[bytes, bytes]]]:
    """For each leaf of a block in order, by level: the siblings to its left and to its right, one after the other.

    At level h the next run needs the next 16 ** (h + 1) leaves, and the present run serves for as many steps: a step
    takes one leaf a level.
    """
    spans = [ARITY ** (h + 1) for h in range(levels)]
    coming = [Treehash(h) for h in range(levels)]
    runs, path = [], [(b"", b"")] * levels
    for h, span in enumerate(spans):
        for leaf in leaves[:span]:
            coming[h].push(leaf)
        runs.append(coming[h].take())
    for i in range(len(leaves)):
        for h in range(levels):
            if i % (spans[h] // ARITY):
                break
            at = i // (spans[h] // ARITY) % ARITY
            path[h] = (b"".join(runs[h][:at]), b"".join(runs[h][at + 1 :]))
        yield path
        for h, span in enumerate(spans):
            if i + span < len(leaves):
                coming[h].push(leaves[i + span])
            if (i + 1) % span == 0:
                runs[h] = coming[h].take()


def fold(node: bytes, path: list[tuple[bytes, bytes]]) -> bytes:
    """The root that ``node`` gives with its siblings."""
    for left, right in path:
        node = hashlib.sha256(left + node + right).hexdigest().encode()
    return node


def _in_order(block: pa.Table) -> tuple[pa.Table, list[bytes], int]:
    block = block.sort_by("pos")
    return block, [d.hex().encode() for d in block["digest"].to_pylist()], levels_of(block["n"][0].as_py())


def _block_root(key: tuple, block: pa.Table) -> pa.Table:
    block, leaves, levels = _in_order(block)
    top = Treehash(levels)
    for leaf in leaves:
        top.push(leaf)
    (root,) = top.take()
    n = -(-block["n"][0].as_py() // BLOCK)
    return pa.table({"tree": [key[0].as_py()], "pos": pa.array([key[1].as_py()], pa.int64()), "n": pa.array([n], pa.int64()), "digest": pa.array([bytes.fromhex(root.decode())], pa.binary())})


def _above(shared: pa.Table) -> list[tuple[bytes, bytes]]:
    return [(s["left"].encode(), s["right"].encode()) for s in shared["above"][0].as_py()]


def _block_paths(key: tuple, block: pa.Table, shared: pa.Table) -> pa.Table:
    if not len(block):
        return pa.table({c: pa.array([], t) for c, t in (("tree", pa.string()), ("pos", pa.int64()), ("path", pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))), ("top", pa.binary()))})
    block, leaves, levels = _in_order(block)
    above = _above(shared)
    paths = [[{"left": left.decode(), "right": right.decode()} for left, right in [*path, *above]] for path in walk(leaves, levels)]
    return pa.table({"tree": block["tree"], "pos": block["pos"], "path": pa.array(paths, pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))), "top": pa.chunked_array([shared["top"].chunk(0).take(pa.array([0] * len(block)))])})


def climb(nodes: DataFrame) -> DataFrame:
    """(tree, pos, path, top) of ``nodes`` (tree, pos, n, digest): siblings by level, left and right, and the tree's root."""
    nodes = nodes.select("tree", "pos", "n", "digest")
    if nodes.filter("n > 1").isEmpty():
        return nodes.select("tree", "pos", F.array().cast(PATH).alias("path"), F.col("digest").alias("top"))
    above = climb(block_roots(nodes)).select("tree", F.col("pos").alias("block"), F.col("path").alias("above"), "top")
    return materialise(blocks(nodes).cogroup(above.groupBy("tree", "block")).applyInArrow(_block_paths, f"tree string, pos long, path {PATH}, top binary"))


def blocks(nodes: DataFrame):
    return nodes.withColumn("block", F.floor(F.col("pos") / BLOCK)).groupBy("tree", "block")


def block_roots(nodes: DataFrame) -> DataFrame:
    return materialise(blocks(nodes.select("tree", "pos", "n", "digest")).applyInArrow(_block_root, "tree string, pos long, n long, digest binary"))


def shared_parts(leaves: DataFrame) -> DataFrame:
    """(tree, block, above, subroot, top): what the leaves of a block share, with their tree's root and the manifest's."""
    within = climb(block_roots(leaves))
    roots = within.filter("pos = 0").select(F.lit("").alias("tree"), F.col("tree").alias("name"), F.lit(0).alias("row"), F.col("top").alias("digest"))
    roots = materialise(positions(roots, ["name"]))
    over = climb(roots).withColumnRenamed("path", "over").drop("tree")
    over = roots.select("name", "pos").join(over, "pos").drop("pos")
    both = within.join(over.withColumnRenamed("top", "root"), F.col("tree") == F.col("name"))
    return both.select("tree", F.col("pos").alias("block"), F.concat("path", "over").alias("above"), F.col("top").alias("subroot"), F.col("root").alias("top"))


def leaves_of(df: DataFrame, tree: str, order: str, digests: dict[str, Column]) -> DataFrame:
    """Leaves with places: columns ``id`` (of ``order``), ``tree``, ``pos``, ``n``, ``digest`` and others of ``digests``.

    Null trees form one of their own, before all others; null ids come first in their tree; rows of one id stand by their
    digest, and rows equal in that too are interchangeable.
    """
    name = F.coalesce(F.concat(F.lit("="), F.col(f"`{tree}`").cast("string")), F.lit(""))
    rows = df.select(F.col(f"`{order}`").alias("id"), name.alias("tree"), *[c.alias(n) for n, c in digests.items()])
    return materialise(positions(rows.withColumn("row", F.monotonically_increasing_id()), ["id", "digest"]))


def manifest(df: DataFrame, tree: str, order: str, fields: list[str]) -> DataFrame:
    """Per row: id, source tree's ``name`` (null for null), ``leaf``, ``path``, ``subroot`` and ``root``, as hex text.

    ``path`` lists by level the hashes to the left and to the right (64 characters each) with which the leaf gives the
    root, see ``fold``. Nulls in any field, empty and very long texts are values like others; repeated rows are leaves
    each. An empty table gives an empty result. Other columns, whatever their names, are not read.
    """
    leaves = leaves_of(df, tree, order, {"digest": digest(encoded([F.col(f"`{c}`") for c in fields]))})
    shared = materialise(shared_parts(leaves))
    paths = blocks(leaves).cogroup(shared.groupBy("tree", "block")).applyInArrow(_block_paths, f"tree string, pos long, path {PATH}, top binary")
    hexed = lambda c: F.lower(F.hex(c))
    out = leaves.withColumn("block", F.floor(F.col("pos") / BLOCK)).join(paths, ["tree", "pos"]).join(shared.select("tree", "block", "subroot"), ["tree", "block"])
    name = F.when(F.col("tree") != "", F.substr("tree", F.lit(2)))
    return out.select("id", name.alias("name"), hexed("digest").alias("leaf"), "path", hexed("subroot").alias("subroot"), hexed("top").alias("root"))


def _audit_block(key: tuple, block: pa.Table, shared: pa.Table) -> pa.Table:
    out: dict[str, list] = {c: [] for c in ("leaf", "subroot", "root", "proof_sha256", "folded_root")}
    if len(block):
        block, leaves, levels = _in_order(block)
        above = _above(shared)
        tail = b"".join(left + right for left, right in above)
        subroot, root = (shared[c][0].as_py().hex() for c in ("subroot", "top"))
        for leaf, found, path in zip(leaves, block["found"].to_pylist(), walk(leaves, levels)):
            proof = hashlib.sha256(b"".join(left + right for left, right in path) + tail).hexdigest()
            folded = fold(found.hex().encode() if found else leaf, [*path, *above])
            for c, v in zip(out, (leaf.decode(), subroot, root, proof, folded.decode())):
                out[c].append(v)
    ids = block["id"] if len(block) else pa.array([], block.schema.field("id").type)
    return pa.table({"id": ids} | {c: pa.array(v, pa.string()) for c, v in out.items()})


def audit(leaves: DataFrame) -> DataFrame:
    """Per leaf: id, leaf, subroot, root, the digest of its proof, and the root that ``found`` folds to with that proof.

    ``found`` is the digest of the row as it is met now, null where that is the leaf itself.
    """
    id_type = leaves.schema["id"].dataType.simpleString()
    schema = f"id {id_type}, leaf string, subroot string, root string, proof_sha256 string, folded_root string"
    return blocks(leaves).cogroup(shared_parts(leaves).groupBy("tree", "block")).applyInArrow(_audit_block, schema)


def op12_merkle_manifest(spark, sf_dir: str) -> DataFrame:
    """All documents; where 5 divides the crc32 of an id, the row is met with lower-cased text. A null id's row is met unchanged."""
    docs = documents(spark, sf_dir)
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    lowered = F.translate("text", string.ascii_uppercase, string.ascii_lowercase)
    changed = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(CHANGED)) == 0
    digests = {"digest": digest(encoded([*fields, F.col("text")])), "found": F.when(changed, digest(encoded([*fields, lowered])))}
    found = audit(leaves_of(docs, "source", "doc_id", digests))
    return found.select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def _levels_sql(first: str, depth: int) -> str:
    """Nodes of each level of ``first`` (tree, pos, digest, n) with their siblings; a lone node stays as it is."""
    parts = []
    for k in range(depth):
        here = first if k == 0 else f"{first}{k}"
        parts.append(f"""{here}s AS (SELECT *, coalesce(string_agg(digest, '') OVER (PARTITION BY tree, pos // 16 ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
 coalesce(string_agg(digest, '') OVER (PARTITION BY tree, pos // 16 ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r FROM {here}),
{first}{k + 1} AS (SELECT tree, pos // 16 AS pos, CASE WHEN any_value(n) > 1 THEN sha256(string_agg(digest, '' ORDER BY pos)) ELSE any_value(digest) END AS digest, (any_value(n) + 15) // 16 AS n FROM {here} GROUP BY tree, pos // 16)""")
    return ",\n".join(parts)


def _path_sql(first: str, start: str, depth: int, tree: str, pos: str, cols: str) -> str:
    """Follows ``start`` up the levels of ``first``: siblings added to ``proof``, nodes folded into ``folded``."""
    parts = []
    for k in range(depth):
        here, before = f"{first}s" if k == 0 else f"{first}{k}s", start if k == 0 else f"{start}_{k}"
        parts.append(f"""{start}_{k + 1} AS (SELECT {cols}, p.proof || CASE WHEN s.n > 1 THEN s.l || s.r ELSE '' END AS proof, CASE WHEN s.n > 1 THEN sha256(s.l || p.folded || s.r) ELSE p.folded END AS folded
 FROM {before} p JOIN {here} s ON s.tree = p.{tree} AND s.pos = p.{pos} // {16**k})""")
    return ",\n".join(parts)


def _enc(column: str) -> str:
    return f"coalesce(strlen({column}::varchar) || ':' || {column}::varchar, '-')"


#: Six levels a source (16.7 million rows) and four of sources. crc32 is computed bit by bit.
OP12_SQL = f"""
WITH marked AS (
  SELECT doc_id, source, lang, n_chars, text, list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(doc_id::varchar, ''), lambda c: ascii(c)::UBIGINT)),
    lambda a, b: list_reduce(list_prepend(xor(a, b), [0::UBIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, y: xor(x >> 1, (x & 1) * 3988292384::UBIGINT))) AS turned FROM documents),
leaf AS (
  SELECT doc_id, coalesce('=' || source, '') AS tree, sha256({_enc("doc_id")} || {_enc("source")} || {_enc("lang")} || {_enc("n_chars")} || {_enc("text")}) AS digest,
    CASE WHEN xor(turned, 4294967295::UBIGINT) % 5 = 0 THEN sha256({_enc("doc_id")} || {_enc("source")} || {_enc("lang")} || {_enc("n_chars")} || {_enc("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")}) END AS found FROM marked),
placed AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, digest) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS n FROM leaf),
t AS (SELECT tree, pos, digest, n FROM placed),
{_levels_sql("t", 6)},
u AS (SELECT 'all' AS tree, row_number() OVER (ORDER BY tree) - 1 AS pos, digest, count(*) OVER () AS n, tree AS name FROM t6),
{_levels_sql("u", 4)},
p AS (SELECT placed.doc_id, placed.tree, placed.pos, placed.digest AS leaf, u.digest AS subroot, 'all' AS top, u.pos AS place, '' AS proof, coalesce(placed.found, placed.digest) AS folded FROM placed JOIN u ON u.name = placed.tree),
{_path_sql("t", "p", 6, "tree", "pos", "p.doc_id, p.tree, p.pos, p.leaf, p.subroot, p.top, p.place")},
q AS (SELECT doc_id, leaf, subroot, top, place, proof, folded FROM p_6),
{_path_sql("u", "q", 4, "top", "place", "p.doc_id, p.leaf, p.subroot, p.top, p.place")}
SELECT q_4.doc_id, leaf, subroot, u4.digest AS root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = u4.digest AS verified FROM q_4 CROSS JOIN u4
"""
