import math
import random
import re
import zlib

import pytest

from colloquy.llm import language


def test_query(spark, corpus, rows):
    got = language.op9_language_id(spark, f"{corpus}/full").collect()
    assert len(got) == len(rows)
    texts = {r[0]: r[1] for r in rows}
    for r in got:
        assert r.held_out == (zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % 4 == 2)
        assert 0 <= r.score <= 1 and r.lang_pred in {"en", "de", "und"}
        assert (r.lang_pred == "und") == (not any(c.isalpha() for c in texts[r.doc_id] or ""))
    assert language.op9_language_id(spark, f"{corpus}/empty").count() == 0


def test_held_out_accuracy(spark, real):
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{real}/documents.parquet").select("doc_id", "lang").collect()}
    held = [(r.lang_pred, truth[r.doc_id]) for r in language.op9_language_id(spark, real).collect() if r.held_out]
    assert sum(a == b for a, b in held) >= 0.95 * len(held)


def test_backoff_takes_the_longest_known_grams():
    model = language.Model(["a", "b"], {"known": [9, 1]}, {"abc": [1, 9], "xyz": [9, 1], "a": [9, 1], "z": [1, 1]}, [1, 1])
    assert model.predict("known")[0] == "a"
    assert model.predict("xabcx")[0] == "b"  # three letters decide before one does
    assert model.predict("aaa")[0] == "a"
    assert model.predict("!!!") == ("und", 0.0)


def test_a_small_language_keeps_its_words(spark):
    """Twenty labelled documents beside two large languages of the same letters."""
    rnd = random.Random(4)
    word = lambda: "".join(rnd.choice("abcdefghijklmnopqrst") for _ in range(7))
    rows, small = [], [" ".join(word() for _ in range(6)) for _ in range(20)]
    for lang in ("aa", "bb"):
        vocab = [word() for _ in range(40_000)]
        rows += [(" ".join(vocab[k : k + 100] * 2), lang) for k in range(0, len(vocab), 100)]
    model = language.fit(spark.createDataFrame(rows + [(t, "zz") for t in small], "text string, lang string"))
    assert {w for t in small for w in t.split()} <= set(model.words[0])
    assert [model.predict(t)[0] for t in small] == ["zz"] * 20
    assert all(model.predict(t)[0] == lang for t, lang in rows[::40])


def test_sample_is_of_distinct_texts_and_limited(spark):
    rows = [(f"w{'abcdefghij'[k % 10]}{'klmnopqrst'[k // 10]}", "aa") for k in range(100)] + [("copy", "aa")] * 50 + [("other", "bb")]
    rows = [(t.replace("w", "same w", 1), k) for t, k in rows]
    model = language.fit(spark.createDataFrame(rows, "text string, lang string"), sample_docs=30)
    assert len(model.words[0]) in (31, 32) and model.prior[0] > model.prior[1]
    whole = language.fit(spark.createDataFrame(rows, "text string, lang string"), sample_docs=1000)
    assert len(whole.words[0]) == 103


def plain_predict(langs, words, pieces, docs, text):
    """The same backoff from the counts, in plain Python."""
    def logs(table, item):
        sums = [sum(n[k] + 0.05 for n in table.values()) for k in range(len(langs))]
        raw = [math.log((table[item][k] + 0.05) / sums[k]) for k in range(len(langs))]
        return [x - sum(raw) / len(raw) for x in raw]

    total = [math.log(d + 1.0) for d in docs]
    for word in re.findall(r"[^\W\d_]+", text.lower()):
        add = logs(words, word) if word in words else [0.0] * len(langs)
        for n in (4, 3, 2, 1):
            if word in words:
                break
            marked = f"\x02{word}\x03" if n > 1 else word
            known = {g: c for g, c in pieces.items() if len(g) == n}
            hits = [g for g in (marked[i : i + n] for i in range(len(marked) - n + 1)) if g in known]
            if hits:
                rows = [logs(known, g) for g in hits]
                add = [sum(r[k] for r in rows) / math.sqrt(len(hits)) for k in range(len(langs))]
                break
        total = [t + a for t, a in zip(total, add)]
    weights = [math.exp(t - max(total)) for t in total]
    return langs[weights.index(max(weights))], max(weights) / sum(weights)


def test_predictions_equal_a_plain_reading(spark, monkeypatch):
    """Words first, then ever shorter n-grams, from given counts; very long texts in parts, and little memory, change nothing."""
    rnd = random.Random(6)
    word = lambda: "".join(rnd.choice("abcde") for _ in range(rnd.randint(1, 6)))
    langs, texts = ["aa", "bb", "cc"], [" ".join(word() for _ in range(rnd.randint(1, 40))) for _ in range(40)] + ["zzz qqq", "a1b2 C-d"]
    words = {word(): [rnd.randint(0, 9) for _ in langs] for _ in range(25)}
    pieces = {g: [rnd.randint(0, 9) for _ in langs] for w in (word() for _ in range(30)) for n in range(1, 5) for g in language.grams(w, n)}
    want = [plain_predict(langs, words, pieces, [3, 5, 1], t) for t in texts]
    for part, remembered in ((50_000, 300_000), (3, 8)):
        monkeypatch.setattr(language, "PART", part)
        monkeypatch.setattr(language, "REMEMBERED", remembered)
        model = language.Model(langs, words, pieces, [3, 5, 1])
        got = [model.predict(t) for t in texts]
        assert [g[0] for g in got] == [w[0] for w in want] and [g[1] for g in got] == pytest.approx([w[1] for w in want], rel=1e-4)
    rows = [(k, t, "x") for k, t in enumerate(texts)] + [(None, None, "y"), (7, texts[7], "z"), (8, "", "z")]
    found = language.identify(spark.createDataFrame(rows, "doc_id long, text string, lang_pred string"), language.Model(langs, words, pieces, [3, 5, 1])).collect()
    assert len(found) == len(rows) and {r.lang_pred for r in found if r.doc_id == 7} == {want[7][0]}
    assert [(r.lang_pred, r.score) for r in found if r.doc_id is None] == [("und", 0.0)]


def test_the_sample_is_bounded_in_bytes(spark, monkeypatch):
    """Texts too long to teach are left out, the others are taken by key until their bytes are spent; all are predicted."""
    monkeypatch.setattr(language, "SAMPLE_TEXT_BYTES", 2_000)
    monkeypatch.setattr(language, "SAMPLE_BYTES", 3_000)
    tail = lambda k: chr(97 + k // 26) + chr(97 + k % 26)
    rows = [(k, f"wort{tail(k)} " * 20, "de") for k in range(100)] + [(200 + k, f"word{tail(k)} " * 20, "en") for k in range(100)] + [(900, "riese" * 100_000, "de"), (901, "giant " * 100_000, "only")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.fit(df)
    assert model.langs == ["de", "en", "only"] and "giant" not in model.words[0]
    taught = {lang: sum(w.startswith(stem) for w in model.words[0]) for lang, stem in (("de", "wort"), ("en", "word"))}
    assert all(15 <= n <= 25 for n in taught.values())
    assert language.identify(df, model).count() == len(rows)
