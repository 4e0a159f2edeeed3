import itertools
import math
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from colloquy.llm import lattice


PRIOR_MODEL = lattice.Lattice(lattice.vocabulary(lattice.default_vocabulary()))


def brute(rows):
    low = lambda t: re.sub("[A-Z]+", lambda m: m[0].lower(), t or "")
    docs = [(r[0], zlib.crc32(("" if r[0] is None else str(r[0])).encode()) % 10 == 0, [*re.findall(r"[^\x20\x09-\x0D]+", low(r[1])), None]) for r in rows]
    c = Counter(w for _, held, ws in docs if not held for w in ws)
    n, v = sum(c.values()), len(c)
    pieces, model = lattice.vocabulary(lattice.default_vocabulary()), PRIOR_MODEL
    for _ in range(lattice.STEPS):
        uses = {}
        for w, times in c.items():
            if w is not None:
                model.expect(w.encode(), uses, times)
        model = lattice.Lattice(pieces, uses)
    k, end = max(1, sum(x == 1 for w, x in c.items() if w is not None)), (c[None] + 0.5) / (n + 1)
    out = []
    for d, held, ws in docs:
        base = sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws)
        logs = [math.log10(end) if w is None else model.word(w.encode()) + math.log10(1 - end) for w in ws]
        mixed = sum(math.log10((c[w] + k * 10**log) / (n + k)) if c[w] else log + math.log10(k / (n + k)) for w, log in zip(ws, logs))
        out.append((str(d), held, len(ws), sum(c[w] > 0 for w in ws), n, base, sum(logs), mixed))
    return sorted(out)


@pytest.mark.parametrize("frequent", [3, 50_000])
def test_against_brute_force(spark, corpus, rows, frequent):
    docs = spark.read.parquet(f"{corpus}/full/documents.parquet")
    got = lattice.score_texts(docs, lattice.crc_bucket("doc_id", 10) == 0, lattice.default_vocabulary(), frequent=frequent).collect()
    got = sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score, r.mixed_score) for r in got)
    for a, b in zip(got, brute(rows), strict=True):
        assert a[:5] == b[:5] and a[5:] == pytest.approx(b[5:], rel=1e-6)


def test_empty(spark, corpus):
    assert lattice.op6_lattice_score(spark, f"{corpus}/empty").count() == 0


def test_held_out_likelihood(spark, real):
    """On held-out texts: above a uniform code by far; the mixture near the base where all words are known, above the lattice in all."""
    got = [r for r in lattice.op6_lattice_score(spark, real).collect() if r.held_out]
    size = {r.doc_id: len(r.text.encode()) for r in spark.read.parquet(f"{real}/documents.parquet").select("doc_id", "text").collect()}
    assert sum(r.score for r in got) > -math.log10(256) * 0.5 * sum(size[r.doc_id] for r in got)
    known = [r for r in got if r.n_known == r.n_tokens]
    assert sum(r.mixed_score for r in known) >= 1.05 * sum(r.base_score for r in known)
    assert sum(r.mixed_score for r in got) > sum(r.score for r in got)


def test_forward_sums_all_segmentations():
    model = lattice.Lattice([("▁a", -0.0), ("b", -1.0), ("▁ab", -2.0), ("▁", -3.0), ("a", -4.0), ("ab", -5.0)])

    def all_ways(word):
        total = 0.0

        def walk(at, p):
            nonlocal total
            if at == len(word):
                total += p * math.exp(model.stop)
            for end in range(at + 1, len(word) + 1):
                if word[at:end] in model.inner:
                    walk(end, p * math.exp(model.inner[word[at:end]]))
                if end == at + 1:
                    walk(end, p * math.exp(model.inner_byte))

        for end in range(1, len(word) + 1):
            if word[:end] in model.first:
                walk(end, math.exp(model.first[word[:end]]))
        walk(1, math.exp(model.first_byte))
        walk(0, math.exp(model.bare))
        return math.log10(total)

    for word in ("a", "ab", "abab", "b", "zab"):
        assert model.word(word.encode()) == pytest.approx(all_ways(word), rel=1e-9)


def test_expectation_counts_every_character_once():
    uses = {}
    PRIOR_MODEL.expect("ещёthing".encode(), uses)
    written = sum(n * (len(x) - 1 if "\0" not in x else 1) for x, n in uses.items() if x != ".")
    assert written == pytest.approx(8) and uses["."] == 1
    assert sum(n for x, n in uses.items() if x[0] == "^") == pytest.approx(1)


def test_many_words_at_once_equal_one_by_one():
    words = [w.encode() for w in ("a", "the", "thing", "ещё", "größer", "漢字", "😀x", "x" * 24, "y" * 25, "ab" * 200, "the")] + [b"\xff\xfe", b""]
    got = lattice.score_many(PRIOR_MODEL, words)
    assert got == pytest.approx([PRIOR_MODEL.word(w) for w in words], rel=1e-9)
    one, many = {}, {}
    for w in words:
        PRIOR_MODEL.expect(w, one)
    lattice.expect_many(PRIOR_MODEL, words, many)
    assert {k: v for k, v in many.items() if v > 1e-6} == pytest.approx({k: v for k, v in one.items() if v > 1e-6}, rel=1e-6, abs=1e-6)


def test_words_and_end_share_one_mass():
    """Over all words of up to eight letters of a small alphabet, rarer ways left out, and the end: close to 1, never above."""
    pieces = [("▁a", -0.0), ("b", -1.0), ("▁ab", -2.0), ("a", -4.0), ("▁b", -5.0)]
    uses = {"^a": 1e7, "^b": 1e7, "+a": 1e6, "+b": 1e6, ".": 2e7}
    model = lattice.Lattice(pieces, uses)
    words = [w for n in range(1, 9) for w in map("".join, itertools.product("ab", repeat=n))]
    c = {"a": 7, "ab": 2, "b": 1}
    of = lattice.Tokens(sum(c.values()) + 5, len(c) + 1, 5, 30)
    goes_on = [model.word(w.encode()) + math.log10(1 - of.end) for w in words]
    assert 0.99 < of.end + sum(10**x for x in goes_on) <= 1 + 1e-9
    mixed = 10 ** of.mixed(of.ends, math.log10(of.end)) + sum(10 ** of.mixed(c.get(w, 0), x) for w, x in zip(words, goes_on))
    assert 0.99 < mixed <= 1 + 1e-9


def test_query_scores_end_and_words_with_one_mass(spark):
    """The score of an empty text is its end's; with all likely words' lattice shares it makes 1 at most."""
    docs = spark.createDataFrame([(k, "a" if k % 2 else "b ab", None) for k in range(40)] + [(99, "", None), (98, "a", None)], "doc_id long, text string, n string")
    got = {r.doc_id: r for r in lattice.score_texts(docs, F.col("doc_id") > 90, lattice.default_vocabulary()).collect()}
    of = lattice.Tokens(40 + 60, 4, 40, 0)
    assert 10 ** got[99].score == pytest.approx(of.end) and 10 ** got[99].mixed_score == pytest.approx((40 + of.end) / 101)
    assert 10 ** got[98].score < (1 - of.end) * of.end
    assert 0 < sum(10 ** PRIOR_MODEL.word(w.encode()) for w in PRIOR_MODEL.first) <= 1


def test_long_unspaced_words_in_bounded_memory(spark):
    """A word of two million letters scores in some bytes a letter; giant words never reach the driver."""
    import tracemalloc

    word = ("abcdefghij" * 200_000)[:2_000_000]
    tracemalloc.start()
    long = PRIOR_MODEL.word(word[:200_000].encode())
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40 * 200_000 and long < 0
    rows = [(k, f"a b {chr(97 + k) * 100_000}", None, None, None) for k in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = lattice.score_texts(df, F.lit(False), lattice.default_vocabulary()).collect()
    assert len(got) == 20 and all(r.n_tokens == 4 and r.score < -1000 for r in got)
