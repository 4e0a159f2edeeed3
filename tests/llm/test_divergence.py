import random
import re
from collections import Counter, defaultdict

import pytest

from colloquy.llm import divergence

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def plain(rows, least, top=50):
    """All rows of the query by the definition: every term of a language against every group."""
    docs = [(lang or "", source or "", re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))) for _, text, lang, source, _ in rows]
    of_lang, held, groups = Counter(), defaultdict(Counter), defaultdict(Counter)
    for lang, source, terms in docs:
        groups[lang, source].update(terms)
        held[lang].update(set(terms))
    out = []
    for lang in {g[0] for g in groups}:
        kept = [t for t, n in held[lang].items() if n >= least]
        sources = sorted((s for l, s in groups if l == lang), key=str.encode)
        of_lang = sum((groups[lang, s] for s in sources), Counter())

        def shares(counts):
            total = sum(counts[t] for t in kept)
            return {t: 1 + 1_000_000_000 * (counts[t] + 5) // (total + 5 * len(kept)) for t in kept}

        p, q = {s: shares(groups[lang, s]) for s in sources}, shares(of_lang)
        for s in sources:
            pairs = [(-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode(), o) for o in sources if o != s]
            terms = [(q[t] - p[s][t], t.encode(), t) for t in kept if groups[lang, s][t] and p[s][t] > q[t]]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
                out += [(lang, s, part, item, -v, k) for k, (v, _, item) in enumerate(found, 1)]
    return sorted(out)


def made(n=700, seed=5):
    rnd = random.Random(seed)
    vocab = [f"{a}{b}" for a in "abcdefghijklm" for b in ("x", "Yé", "漢", "zz", "q’s", "um", "or", "Ix")]
    rows = []
    for k in range(n):
        lang, source = rnd.choice(["en", "de", None, ""]), rnd.choice(["s1", "s1", "s1", "s2", "é", None, "Z"])
        lean = rnd.randrange(1, len(vocab))
        rows.append((k, " ".join(vocab[min(int(rnd.expovariate(0.05)) * lean % len(vocab), len(vocab) - 1)] for _ in range(rnd.randint(0, 60))), lang, source, None))
    rows += [(0, None, "en", "nothing", 1), (0, "", "fr", "alone", 1), (None, " 12 _\t", "fr", "digits", 1), rows[0], rows[0]]
    return rows + [(9, "Wort-wort " * 5000 + "x" * 100_000, "de", "s2", 0), (9, "ab\x00cd\x7fef", "de", "s2", 0)]


@pytest.mark.parametrize("least,top", [(1, 3), (4, 50), (10**6, 50)])
def test_audit(spark, least, top):
    rows = made(250)
    audit = divergence.Audit(spark.createDataFrame(rows, SCHEMA).repartition(4), least_documents=least)
    want = plain(rows, least, top)
    assert sorted((*r[:2], "pair", *r[2:]) for r in audit.pairs().collect()) == [r[:5] for r in want if r[2] == "pair"]
    got = audit.terms(top)
    assert sorted((r["lang"], r["source"], "term", r["item"], r["value"]) for r in got.collect()) == [r[:5] for r in want if r[2] == "term"]


def test_query(spark, tmp_path):
    rows = made()
    spark.createDataFrame(rows, SCHEMA).repartition(3).selectExpr("*", "1 AS term", "2 AS n", "3 AS docs").write.parquet(f"{tmp_path}/full/documents.parquet")
    got = divergence.op11_source_divergence(spark, f"{tmp_path}/full")
    assert sorted(map(tuple, got.select("lang", "source", "part", "item", "value", "rank").collect())) == plain(rows, 30)
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/empty/documents.parquet")
    assert divergence.op11_source_divergence(spark, f"{tmp_path}/empty").count() == 0


def test_counts_are_handed_on_in_parts(spark, monkeypatch):
    """Counts that leave a task early add up to the same."""
    import pyarrow as pa

    rows = made(60)
    batch = pa.RecordBatch.from_pydict({"lang": [r[2] or "" for r in rows], "source": [r[3] or "" for r in rows], "text": [r[1] or "" for r in rows]})

    def total():
        n, parts = Counter(), 0
        for part in divergence._count(iter([batch, batch])):
            parts += 1
            for r in part.to_pylist():
                n[r["lang"], r["source"], r["term"]] += r["n"] + 1000 * r["docs"]
        return n, parts

    whole, one = total()
    monkeypatch.setattr(divergence, "FLUSH_TERMS", 20)
    pieces, several = total()
    assert whole == pieces and one == 1 < several


def test_large_counts(spark):
    """Shares stay exact beyond 64 bits of the product."""
    got = spark.range(1).select(divergence.share("4000000000000000000L", "9000000000000000000L", "7L").alias("p")).first().p
    assert got == 1 + 1_000_000_000 * (4 * 10**18 + 5) // (9 * 10**18 + 35)
