import hashlib
import zlib
from collections import defaultdict

from colloquy.llm import merkle


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def enc(*values):
    return "".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values)


def plain_tree(nodes):
    """(root, the siblings of each leaf by level as (left, right)) by hashing whole levels."""
    paths, where = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for path, at in zip(paths, where):
            first = at // 16 * 16
            path.append(("".join(nodes[first:at]), "".join(nodes[at + 1 : first + 16])))
        nodes = [sha("".join(nodes[k : k + 16])) for k in range(0, len(nodes), 16)]
        where = [at // 16 for at in where]
    return nodes[0] if nodes else None, paths


def plain(rows):
    """The query's rows, sorted as text."""
    trees = defaultdict(list)
    for doc, text, lang, source, n in rows:
        low = None if text is None else text.encode().lower().decode()
        changed = doc is not None and zlib.crc32(str(doc).encode()) % 5 == 0
        leaf = sha(enc(doc, source, lang, n, text))
        trees[source].append((doc is not None, doc or 0, leaf, doc, sha(enc(doc, source, lang, n, low)) if changed else leaf))
    names = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    done = {s: plain_tree([leaf for _, _, leaf, *_ in sorted(trees[s], key=lambda x: x[:3])]) for s in names}
    root, over = plain_tree([done[s][0] for s in names])
    out = []
    for s, upper in zip(names, over):
        for (_, _, leaf, doc, node), path in zip(sorted(trees[s], key=lambda x: x[:3]), done[s][1]):
            for left, right in [*path, *upper]:
                node = sha(left + node + right)
            out.append((doc, leaf, done[s][0], root, sha("".join(a + b for a, b in [*path, *upper])), node, node == root))
    return sorted(map(str, out))


def test_query(spark, corpus, rows):
    got = merkle.op12_merkle_manifest(spark, f"{corpus}/full").collect()
    assert sorted(str(tuple(r)) for r in got) == plain(rows)
    assert 0 < sum(not r.verified for r in got) < len(got)
    assert merkle.op12_merkle_manifest(spark, f"{corpus}/empty").count() == 0


def test_walk_equals_whole_levels():
    for n in (1, 2, 15, 16, 17, 40, 255, 256, 257, 600, 4096):
        leaves = [sha(str(k)) for k in range(n)]
        root, paths = plain_tree(leaves)
        levels = merkle.levels_of(n)
        walked = [[(a.decode(), b.decode()) for a, b in path] for path in merkle.walk([x.encode() for x in leaves], levels)]
        assert walked == paths
        assert all(merkle.fold(x.encode(), [(a.encode(), b.encode()) for a, b in p]).decode() == root for x, p in zip(leaves, paths))


def test_trees_of_many_blocks(spark, tmp_path):
    """A source of two blocks and a piece, one of exactly one block, small ones, equal rows, and names of the caller's."""
    rows = [(k // 2, f"T{k}", None, "hot", k) for k in range(8200)] + [(k, "Ab", "en", None, 1) for k in range(4096)]
    rows += [(5, "same", "en", "é", 2)] * 40 + [(None, None, None, f"s{k % 30}", None) for k in range(60)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).repartition(5).selectExpr("*", "1 AS pos", "2 AS tree", "3 AS digest").write.parquet(f"{tmp_path}/documents.parquet")
    got = merkle.op12_merkle_manifest(spark, str(tmp_path))
    assert sorted(str(tuple(r)) for r in got.collect()) == plain(rows)


def test_manifest_gives_paths(spark):
    df = spark.createDataFrame([(k, ["a", None][k % 2], f"t{k}") for k in range(50)], "id long, name string, path string")
    got = merkle.manifest(df, "name", "id", ["id", "path"]).collect()
    assert len(got) == 50 and len({r.root for r in got}) == 1 and len({r.subroot for r in got}) == 2
    for r in got:
        assert merkle.fold(r.leaf.encode(), [(p.left.encode(), p.right.encode()) for p in r.path]).decode() == r.root
        assert r.leaf == sha(enc(r.id, f"t{r.id}"))
