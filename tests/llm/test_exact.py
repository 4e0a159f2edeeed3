import hashlib
import re
from collections import Counter

import pyarrow as pa

from colloquy.llm import exact


def brute(rows):
    groups = {}
    for doc_id, text, *_ in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", text or ""), []).append((-len(text or ""), doc_id is None, doc_id))
    out = []
    for doc_id, text, *_ in rows:
        body = re.sub(r"[\x20\x09-\x0D]", "", text or "")
        best = min(groups[body])
        out.append((doc_id, best[2], len(groups[body]), (-len(text or ""), doc_id is None, doc_id) == best, hashlib.sha256(body.encode()).hexdigest()))
    return Counter(out)


def test_query(spark, corpus, rows):
    assert Counter(map(tuple, exact.op10_exact_dedup(spark, f"{corpus}/full").collect())) == brute(rows)
    assert exact.op10_exact_dedup(spark, f"{corpus}/empty").count() == 0


def test_dedup_keeps_one_row_a_content(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, best_id long")
    kept = exact.exact_dedup(df).collect()
    assert len(kept) == len({re.sub(r"[\x20\x09-\x0D]", "", r[1] or "") for r in rows})
    assert exact.exact_dedup(df).columns == df.columns


def test_repeated_ids_and_clashing_names(spark):
    """One id with other white space, equal rows, null ids; every name the operator uses is also the caller's."""
    texts = [(1, "a b"), (1, "ab"), (2, "q r"), (2, "q r"), (2, "q r"), (2, "q r"), (None, "n"), (None, "n"), (3, "x y"), (3, " xy"), (None, None), (4, " ")]
    names = ["doc_id", "text", "digest", "of", "k0", "k1", "of_k0", "row", "n_best", "best_id", "content", "points", "_digest", "_g", "_b", "_n"]
    df = spark.createDataFrame([(*t, *[f"{c}{k}" for c in names[2:]]) for k, t in enumerate(texts)], "doc_id long, text string, " + ", ".join(f"{c} string" for c in names[2:])).repartition(3)
    assert Counter(map(tuple, exact.exact_groups(df).collect())) == brute(texts)
    got = exact.exact_dedup(df)
    assert got.columns == names
    rows = sorted(map(tuple, got.collect()), key=str)
    assert Counter(r[0] for r in rows) == Counter([1, 2, None, 3, 4]) and ("a b" in [r[1] for r in rows]) and ("ab" not in [r[1] for r in rows])
    assert all(len({c[len(n) :] for c, n in zip(r[2:], names[2:])}) == 1 for r in rows)
    assert sorted(map(tuple, exact.exact_dedup(df.repartition(5)).collect()), key=str) == rows


def test_spill_recursion(tmp_path):
    """A table of a few bytes goes through many levels and gives the same groups; nothing is left behind."""
    rows = [(hashlib.sha256(str(k % 300).encode()).digest(), str(k % 300) * 20, k % 7, k, 1, 1) for k in range(3000)]
    batches = [pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows[i : i + 500]), exact._SCHEMA)], schema=exact._SCHEMA) for i in range(0, 3000, 500)]
    merged = lambda size: sorted(tuple(r.values()) for b in exact.grace_merge(iter(batches), size, 0, str(tmp_path)) for r in b.to_pylist())
    assert merged(2000) == merged(1 << 30)
    assert len(merged(2000)) == 300 and sum(r[4] for r in merged(2000)) == 3000
    assert not list(tmp_path.iterdir())


def test_equal_digests_with_other_content_stay_apart():
    same = b"\0" * 32
    batch = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip((same, "a", 1, 1, 1, 1), (same, "b", 1, 2, 1, 1), (same, "a", 2, 3, 1, 1)), exact._SCHEMA)], schema=exact._SCHEMA)
    got = [r for b in exact.grace_merge(iter([batch]), 10) for r in b.to_pylist()]
    assert sorted((r["content"], r["best_id"], r["group_size"]) for r in got) == [("a", 3, 2), ("b", 2, 1)]
