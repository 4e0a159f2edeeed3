import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from colloquy.llm import substring

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def plain(rows, window):
    """(doc_id, n_words, n_removed, kept words) by comparing every window with the least id that it starts in."""
    split = [[w for w in re.split("[\x20\x09-\x0d]+", text or "") if w] for _, text, *_ in rows]
    least = {}
    for (doc, *_), words in zip(rows, split):
        for k in range(len(words) - window + 1):
            if doc is not None:
                shown = tuple(words[k : k + window])
                least[shown] = min(doc, least.get(shown, doc))
    out = []
    for (doc, *_), words in zip(rows, split):
        gone = set()
        for k in range(len(words) - window + 1):
            if doc is not None and least[tuple(words[k : k + window])] < doc:
                gone.update(range(k, k + window))
        out.append((doc, len(words), len(gone), " ".join(w for k, w in enumerate(words) if k not in gone)))
    return sorted(map(str, out))


def made(seed, n=120, repeated=30):
    """Texts with shared passages at any place, near copies, whole copies, and passages just too short."""
    rnd = random.Random(seed)
    word = lambda: rnd.choice(["a", "b", "É", "漢", "x.", "Y"]) + str(rnd.randrange(40))
    gap = lambda: rnd.choice([" ", "\n", " \t", "\x0b"])
    passages = [[word() for _ in range(rnd.randint(5, 3 * repeated))] for _ in range(8)]
    texts = []
    for _ in range(n):
        words = [word() for _ in range(rnd.randint(0, 60))]
        for p in rnd.sample(passages, rnd.randint(0, 2)):
            a = rnd.randrange(len(p))
            at = rnd.randint(0, len(words))
            words[at:at] = p[a:] if rnd.random() < 0.4 else p
        texts.append("".join(w + gap() for w in words))
    for t in rnd.sample(texts, 12):
        words = t.split()
        texts += [t, " ".join(words), " ".join(words[: len(words) // 2] + ["edit"] + words[len(words) // 2 :])]
    texts += [None, "", " \n", "w " * 200, "w " * 90, "x" * 300_000 + " " + " ".join(passages[0])]
    ids = list(range(len(texts)))
    rnd.shuffle(ids)
    rows = [(i, t, "en", "s", None) for i, t in zip(ids, texts)]
    return rows + [rows[3], (rows[4][0], rows[5][1], None, None, None), (None, rows[6][1], "en", "s", 1), (None, " ".join(passages[1]), "en", "s", 1), (-(2**62), " ".join(passages[1]), "en", "s", 1)]


@pytest.mark.parametrize("seed,window,bucket_words,parts", [(1, 10, 40, 4), (2, 7, 300_000, 1), (3, 50, 500, 3)])
def test_repeats(spark, monkeypatch, seed, window, bucket_words, parts):
    monkeypatch.setattr(substring, "BUCKET_WORDS", bucket_words)
    rows = made(seed, repeated=max(window, 10))
    df = spark.createDataFrame(rows, SCHEMA).repartition(parts).selectExpr("*", "1 AS text_key", "2 AS bucket", "3 AS at")
    got = substring.Repeats(df, window=window).stripped(give_text=True).collect()
    want = plain(rows, window)
    assert sorted(str((r.doc_id, r.n_words, r.n_removed, r.kept)) for r in got) == want
    assert sum(r.n_removed > 0 for r in got) > 10


def test_query(spark, corpus, rows, tmp_path):
    got = substring.op13_substring_dedup(spark, f"{corpus}/full").collect()
    hashed = lambda rs: sorted(str((d, n, r, hashlib.sha256(k.encode()).hexdigest())) for d, n, r, k in rs)
    assert sorted(map(str, map(tuple, got))) == hashed(map(eval, plain(rows, 50)))
    assert substring.op13_substring_dedup(spark, f"{corpus}/empty").count() == 0


def test_odd_blocks(spark):
    """Windows of an odd number of words hold one whole block too."""
    rows = [(2, " ".join(f"{'p' if 3 <= k < 14 else 'q'}{k}" for k in range(40)), None, None, None), (1, " ".join(f"{'p' if 3 <= k < 14 else 'r'}{k}" for k in range(30)), None, None, None)]
    got = substring.Repeats(spark.createDataFrame(rows, SCHEMA), window=11).stripped(give_text=True).collect()
    assert sorted(str((r.doc_id, r.n_words, r.n_removed, r.kept)) for r in got) == plain(rows, 11)


def test_long_texts_are_cut_between_words():
    words = [f"w{k % 977}" for k in range(200_000)]
    texts = pa.array([" ".join(words), "é" * 700_000 + " tail", None, "a b"])
    doc, hashes = substring.word_hashes(texts)
    assert np.bincount(doc, minlength=4).tolist() == [200_000, 2, 0, 2]
    known = dict(zip(words, hashes[:200_000]))
    assert all(known[w] == h for w, h in zip(words, hashes)) and len(set(known.values())) == 977


def test_packing():
    ids = np.array([5, -(2**63), 2**63 - 1, 7, 7])
    for some in (ids, ids[3:], ids[[0, 3]]):
        assert substring._unpacked_ids(substring._packed_ids(some)).tolist() == some.tolist()
    keys = np.array([0, 1, 2**24 - 1, 77], np.uint64)
    assert substring._unpacked(substring._packed(keys)).tolist() == keys.tolist()
