import random
import re
from collections import Counter

from pyspark.sql import functions as F

from colloquy.llm import quality


def base(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {i + k for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), failed


def check(rows, got):
    want = Counter((r[0], *base(r[1])) for r in rows)
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got) == want
    assert not any(r.kept and r.base_failed for r in got)


def test_query(spark, corpus, rows):
    check(rows, quality.op8_quality_rules(spark, f"{corpus}/full").collect())
    assert quality.op8_quality_rules(spark, f"{corpus}/empty").count() == 0


def test_on_the_synthetic_corpus(spark, real):
    """Clean documents stay; a good part of the junk that the base rules let through goes."""
    rows = [tuple(r) for r in spark.read.parquet(f"{real}/documents.parquet").select("doc_id", "text").collect()]
    got = quality.op8_quality_rules(spark, real).collect()
    check(rows, got)
    label = {r.doc_id: r.quality for r in spark.read.parquet(f"{real}/labels.parquet").collect()}
    clean = [r.kept for r in got if label.get(r.doc_id) == 1 and not r.base_failed]
    junk = [r.kept for r in got if label.get(r.doc_id) == 0 and not r.base_failed]
    assert sum(clean) >= 0.98 * len(clean) and sum(junk) <= 0.5 * len(junk)


def exact_quantile(values, part):
    """The least bucket that holds the given part of the values, rounded down as the sketch does."""
    values = sorted(v if v < 128 else v >> (v.bit_length() - 7) << (v.bit_length() - 7) for v in values)
    return next(v for k, v in enumerate(values, 1) if k >= part * len(values) - 1e-9)


def test_groups_have_their_own_limits_without_a_step(spark):
    """Limits follow from plain sorting, for a group of 99 documents as for one of 100 and of 3; each group's own tail counts."""
    rnd = random.Random(4)
    rows = []
    for lang, source, n, most in (("en", "a", 99, 5), ("en", "b", 100, 40), ("en", "c", 3, 200), ("de", "a", 60, 0), (None, None, 7, 90)):
        for _ in range(n):
            w = [f"w{rnd.randrange(10**6)}" for _ in range(rnd.randrange(60, 90))]
            rows.append((len(rows), " ".join(w) + "#" * rnd.randint(0, most), lang, source))
    rows.append((len(rows), "too short", "xx", "only"))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    limits = {(r.of_lang, r.of_source): r.t_symbols for r in quality.thresholds(quality.measures(df, {"lang": "lang", "source": "source"})).collect()}
    rates = {}
    for _, t, lang, source in rows[:-1]:
        rates.setdefault((lang, source), []).append(1000 * t.count("#") // len(t.split()))
    lean = lambda n, q, w: (n * q + quality.PRIOR_DOCS * w) // (n + quality.PRIOR_DOCS)
    for (lang, source), own in rates.items():
        pooled = [v for (x, _), vs in rates.items() if x == lang for v in vs]
        every = [v for vs in rates.values() for v in vs]
        middle, high = (lean(len(own), exact_quantile(own, p), lean(len(pooled), exact_quantile(pooled, p), exact_quantile(every, p))) for p in (0.5, 0.9))
        assert limits[lang, source] == high + quality.SPREADS * (high - middle)
    assert set(limits) == set(rates) and limits["en", "a"] < limits["en", "b"]
    judged = {r.doc_id: r for r in quality.judge(df).collect()}
    for doc_id, t, lang, source in rows[:-1]:
        n, k, limit = len(t.split()), t.count("#"), limits[lang, source]
        excess = 1000 * k - n * limit
        assert judged[doc_id].kept == (not judged[doc_id].base_failed and not (excess > 0 and excess**2 > quality.NOISE**2 * 1000 * (n * limit + 1000)))
    assert not judged[len(rows) - 1].kept


def test_sketch_buckets(spark):
    values = [0, 1, 127, 128, 129, 130, 255, 256, 1000, 123456789]
    got = [r.b for r in spark.createDataFrame([(v,) for v in values], "v long").select(quality.bucket(F.col("v")).alias("b")).collect()]
    assert got == [0, 1, 127, 128, 128, 130, 254, 256, 1000, 123456789 >> 20 << 20]
    assert all(v * 63 <= b * 64 <= v * 64 for v, b in zip(values, got))


def test_keep_good_agrees(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_words long")
    kept = quality.keep_good(df)
    assert kept.columns == df.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter(r.doc_id for r in quality.judge(df).collect() if r.kept)
