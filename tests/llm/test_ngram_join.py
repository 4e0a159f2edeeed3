import random
import re

import numpy as np

from colloquy.llm import ngram_join as nj
from colloquy.llm.components import components


def brute(rows):
    sets = []
    for _, text, *_ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    label = list(range(len(rows)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and min(len(a), len(b)) * 5 >= max(len(a), len(b)) * 4 and 100 * len(a & b) >= 80 * len(a | b):
                label[root(i)] = root(j)
    least = {}
    for i, r in enumerate(rows):
        k = root(i)
        if r[0] is not None:
            least[k] = min(least.get(k, r[0]), r[0])
    return sorted((str(r[0]), len(s), str(least.get(root(i)) if s else r[0])) for i, (r, s) in enumerate(zip(rows, sets)))


def check(got, rows):
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == brute(rows)


def test_query(spark, corpus, rows):
    check(nj.op1_ngram_jaccard(spark, f"{corpus}/full").collect(), rows)
    assert nj.op1_ngram_jaccard(spark, f"{corpus}/empty").count() == 0


def test_near_copies_at_the_border(spark):
    """Chains and stars of edited copies, many of them close to a similarity of 0.8."""
    rnd, rows = random.Random(5), []
    for family in range(12):
        base = [f"f{family}w{k}" for k in range(rnd.choice([6, 9, 14, 30, 80, 300]))]
        for _ in range(14):
            copy = list(base)
            for _ in range(rnd.randint(0, max(1, len(base) // 25))):
                at = rnd.randrange(len(copy))
                copy[at : at + rnd.randint(0, 2)] = [f"e{rnd.randrange(10**6)}"] * rnd.randint(0, 2)
            rows.append((len(rows), " ".join(copy)))
            base = copy if rnd.random() < 0.3 else base
    rnd.shuffle(rows)
    got = nj.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    check(got, rows)


def test_on_the_synthetic_corpus(spark, real):
    rows = [tuple(r) for r in spark.read.parquet(f"{real}/documents.parquet").select("doc_id", "text").collect()]
    check(nj.op1_ngram_jaccard(spark, real).collect(), rows)


def test_linked_sets_share_a_key():
    rnd = np.random.default_rng(2)
    for n in [3, 4, 5, 6, 9, 17, 40, 111, 500]:
        for _ in range(60):
            base = np.unique(rnd.integers(0, 1 << 63, 2 * n, dtype=np.uint64))
            drop = rnd.integers(0, max(1, n // 9) + 1)
            a = np.sort(base[:n])
            b = np.sort(np.concatenate([base[drop:n], base[n : n + rnd.integers(0, max(1, n // 9) + 1)]]))
            if not len(b) or 100 * len(np.intersect1d(a, b)) < 80 * len(np.union1d(a, b)):
                continue
            levels = rnd.integers(0, 5, 1 << nj.COUNTER_BITS).astype(np.uint8)
            docs, keys = nj.tile_keys(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]), levels)
            assert set(keys[docs == 0].tolist()) & set(keys[docs == 1].tolist())
            assert abs(int(nj.size_band(len(a))) - int(nj.size_band(len(b)))) <= nj.BAND_STEPS + 1


def test_bound_is_above_overlap():
    rnd = np.random.default_rng(3)
    for _ in range(200):
        base = np.unique(rnd.integers(0, 1 << 63, 300, dtype=np.uint64))
        a, b = (np.sort(rnd.choice(base, rnd.integers(1, 250), replace=False)) for _ in range(2))
        bits = [nj.bitmap(a), nj.bitmap(b)]
        width = min(len(x) for x in bits)
        bits = [np.bitwise_or.reduce(x.reshape(-1, width), axis=0) for x in bits]
        assert nj.most_overlap(bits[0], len(a), bits[1], len(b)) >= len(np.intersect1d(a, b))


def test_components(spark):
    chain = [(k, k + 1) for k in range(30)] + [(100, 200), (300, 200), (400, 300)] + [(1000, 1000 + k) for k in range(50)]
    got = {r.id: r.component for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert all(got[k] == 0 for k in range(31)) and got[400] == 100 and all(got[1000 + k] == 1000 for k in range(50))


def test_near_dedup(spark):
    rows = [(1, "a b c d e f g h", 1), (2, "a b c d e f g h", 2), (3, "z y x w v u", 3), (4, None, 4), (5, "", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, component_id int")
    assert sorted(r.doc_id for r in nj.near_dedup(df).collect()) == [1, 3, 4, 5]


def hot(monkeypatch):
    """Every shingle that two sets hold is hot and dealt over several buckets."""
    monkeypatch.setattr(nj, "HOT_SETS", 2)


def test_repeats_nulls_and_clashing_names(spark):
    text = "one two three four five six seven eight nine ten"
    rows = [(1, text)] * 4 + [(None, text + " x"), (None, text.upper()), (7, text + " y"), (7, "p q r s t u v w"), (None, "m n o p q r s"), (None, "m n o p q r s"), (9, ""), (9, ""), (None, None)]
    names = ["doc_id", "text", "row", "k0", "of_k0", "k1", "component", "rep", "anchor", "id", "n_shingles"]
    df = spark.createDataFrame([(*r, *range(k, k + 9)) for k, r in enumerate(rows)], ", ".join(f"{n} {'string' if n == 'text' else 'long'}" for n in names)).repartition(3)
    got = nj.near_dedup(df)
    assert got.columns == names
    assert sorted((str(r.doc_id), str(r.text)) for r in got.collect()) == sorted([("1", text), ("7", "p q r s t u v w"), ("None", "m n o p q r s"), ("9", ""), ("9", ""), ("None", "None")])
    check(nj.jaccard_components(df).collect(), rows)


def test_large_tiles_in_blocks(spark, monkeypatch):
    """Families of far more copies than a small tile holds, compared in several blocks; many pairs do not link."""
    monkeypatch.setattr(nj, "CHUNK_SETS", 9)
    hot(monkeypatch)
    rnd, rows = random.Random(8), []
    for family, edits in enumerate((1, 3, 6)):
        base = [f"f{family}w{k}" for k in range(90)]
        for _ in range(45):
            copy = list(base)
            for _ in range(rnd.randint(0, edits)):
                copy[rnd.randrange(len(copy))] = f"e{rnd.randrange(10**6)}"
            rows.append((len(rows), " ".join(copy)))
    shared = " ".join(f"p{k}" for k in range(12))
    rows += [(1000 + k, " ".join(f"r{k}x{i}" for i in range(8)) + " " + shared) for k in range(30)]
    rnd.shuffle(rows)
    check(nj.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect(), rows)
