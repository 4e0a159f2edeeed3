import math
import random
import zlib

import numpy as np
import pytest

from colloquy.llm import toxicity as tox


def test_query(spark, corpus, rows):
    got = tox.op4_toxicity(spark, f"{corpus}/full").collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.held_out == (zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
    assert all(r.score == 0 for r in got if not any(c.isalpha() for c in dict((x[0], x[1]) for x in rows)[r.doc_id] or ""))
    assert tox.op4_toxicity(spark, f"{corpus}/empty").count() == 0


def test_gradients_match_differences():
    rng = np.random.default_rng(0)
    net = tox.Network({})
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x, y = rng.normal(0, 1, (tox.WINDOW, 6, tox.EMBED)), np.array([0, 1, 1, 0, 1, 0.0])
    mask = (np.arange(tox.WINDOW)[:, None, None] < np.array([16, 3, 9, 1, 16, 5])[None, :, None]).astype(float)
    x = x * mask
    grads, d_x, _ = net.gradients(x, mask, y)

    def loss():
        logit = net.forward(net.project(x), mask)
        return np.mean(np.logaddexp(0, logit) - y * logit)

    for name in ("Wf", "Ub", "cf", "A", "v", "o", "b", "Uf"):
        flat, got = net.p[name].reshape(-1), grads[name].reshape(-1)
        for i in rng.choice(len(flat), min(4, len(flat)), replace=False):
            keep = flat[i]
            flat[i] = keep + 1e-3
            up = loss()
            flat[i] = keep - 1e-3
            down = loss()
            flat[i] = keep
            assert (up - down) / 2e-3 == pytest.approx(got[i], abs=2e-4)


def test_learns_stems_and_leaves_clean_texts_alone():
    rnd = random.Random(1)
    vocab = ["".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 8))) for _ in range(400)]
    stem = lambda: "zork" + "".join(rnd.choice("abcd") for _ in range(3))

    def text(toxic):
        words = [rnd.choice(vocab) for _ in range(rnd.randint(20, 120))]
        for _ in range(rnd.randint(1, 3) * toxic):
            words[rnd.randrange(len(words))] = stem()
        return " ".join(words)

    labels = [k % 3 == 0 for k in range(400)]
    net = tox.train([text(y) for y in labels], [int(y) for y in labels])
    fresh = [k % 2 == 0 for k in range(200)]
    hits = tox.Scorer(net).logits([text(y) for y in fresh]) >= 0
    assert np.mean(hits == np.array(fresh)) >= 0.95


def test_portions_of_a_long_text_hold_the_same_windows():
    for n in (1, 8, 9, 16, 17, 100):
        covered = {k for s in tox.window_starts(n) for k in range(s, min(n, s + tox.WINDOW))}
        assert covered == set(range(n))


def test_without_both_labels_there_is_no_network():
    assert tox.train(["a b", "c d"], [0, 0]) is None and tox.train(["", "1"], [0, 1]) is None


def test_words_of_all_lengths_are_read_by_one_rule():
    """Pieces of 12 letters, 4 apart; nothing changes at 48 letters, and a word of several pieces still is one word."""
    made = lambda n: "".join(random.Random(1).choice("abcdefghij") for _ in range(n))
    for n in (1, 11, 12, 13, 16, 17, 47, 48, 49, 50, 53, 500):
        run = made(n)
        pieces = tox.letter_runs(f"x {run} y")[1:-1]
        spelled = [w.partition("\0")[0] for w in pieces]
        assert spelled == [run[k : k + 12] for k in range(0, max(1, n - 8), 4)]
        assert {run[k : k + 5] for k in range(n - 4)} <= {w[k : k + 5] for w in spelled for k in range(len(w) - 4)}
        assert run.startswith(spelled[0]) and run.endswith(spelled[-1])
        assert len({tox.whole_word(w) for w in pieces}) == 1 and tox.whole_word(pieces[0]) != tox.whole_word(tox.letter_runs(made(n + 1))[0])
    net = tox.Network({tox.whole_word(tox.letter_runs(made(n))[0]): k for k, n in enumerate((48, 49))})
    for n in (47, 48, 49):
        rows = net.inputs(tox.letter_runs(made(n)))[1]
        assert set(rows) == {n - 47}


def test_a_long_word_teaches_at_any_length():
    """A word of 47 to 50 letters that marks toxic texts is told by its own embedding on both sides of 48."""
    rnd = random.Random(6)
    vocab = ["".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(3, 9))) for _ in range(200)]
    marks = ["".join(rnd.choice("klmnopqrst") for _ in range(n)) for n in (47, 48, 49, 50)]
    text = lambda y: " ".join([*rnd.choices(vocab, k=20), *([rnd.choice(marks)] if y else []), *rnd.choices(vocab, k=20)])
    labels = [int(k % 3 == 0) for k in range(240)]
    net = tox.train([text(y) for y in labels], labels)
    fresh = [f"{vocab[0]} {m} {vocab[1]}" for m in marks] + [f"{vocab[0]} {v} {vocab[1]}" for v in vocab[2:40]]
    hits = tox.Scorer(net).logits(fresh) >= 0
    assert hits[:4].all() and hits[4:].mean() < 0.1


def test_a_stem_in_the_middle_of_unspaced_text():
    rnd = random.Random(2)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 8)))
    vocab = [word() for _ in range(400)]

    def words(toxic):
        out = [rnd.choice(vocab) for _ in range(60)]
        if toxic:
            out[30] = "zork" + rnd.choice("abcd") + rnd.choice("abcd")
        return out

    labels = [k % 3 == 0 for k in range(400)]
    net = tox.train([" ".join(words(y)) for y in labels], [int(y) for y in labels])
    fresh = [k % 2 == 0 for k in range(100)]
    logits = tox.Scorer(net).logits(["".join(words(y)) for y in fresh])
    toxic, clean = logits[np.array(fresh)], logits[~np.array(fresh)]
    assert np.mean(toxic[:, None] > clean[None, :]) >= 0.9


def plain_score(net, text):
    """The worst window's logit, word by word and gate by gate, in plain Python."""
    p, h = {k: v.astype(float) for k, v in net.p.items()}, tox.HIDDEN
    sig = lambda v: 1 / (1 + math.exp(-max(-30.0, min(30.0, v))))
    words = tox.letter_runs(text)
    vectors = [net.inputs([w])[0][0].astype(float) for w in words]
    worst = -math.inf
    for start in tox.window_starts(len(words)) if words else []:
        xs, states = vectors[start : start + tox.WINDOW], []
        for d, order in (("f", range(len(xs))), ("b", reversed(range(len(xs))))):
            state, out = np.zeros(h), {}
            for t in order:
                w, u = xs[t] @ p[f"W{d}"] + p[f"c{d}"], p[f"U{d}"]
                z = np.array([sig(w[i] + state @ u[:, i]) for i in range(h)])
                r = np.array([sig(w[h + i] + state @ u[:, h + i]) for i in range(h)])
                n = np.array([math.tanh(w[2 * h + i] + (r * state) @ u[:, 2 * h + i]) for i in range(h)])
                state = out[t] = state + z * (n - state)
            states.append(out)
        both = [np.concatenate([states[0][t], states[1][t]]) for t in range(len(xs))]
        energy = [np.tanh(s @ p["A"]) @ p["v"] for s in both]
        weights = [math.exp(e - max(energy)) for e in energy]
        pooled = sum(w * s for w, s in zip(weights, both)) / sum(weights)
        worst = max(worst, float(pooled @ p["o"] + p["b"][0]))
    return worst


def test_scores_equal_a_plain_loop(spark, monkeypatch):
    """Whole texts against a word-by-word reading of the same network; portions and what is remembered change nothing."""
    rnd = random.Random(3)
    vocab = ["".join(rnd.choice("abcdefghé") for _ in range(rnd.randint(1, 9))) for _ in range(60)]
    net = tox.Network({w: k for k, w in enumerate(vocab[:30])})
    net.p["b"] += 0.3
    texts = [" ".join(rnd.choice(vocab) for _ in range(n)) for n in (1, 7, 8, 9, 16, 17, 24, 25, 90)] + ["x" * 130, None, "", "1 2 3"]
    want = [plain_score(net, t) for t in texts]
    for portion, remembered, at_once in ((40_000, 200_000, 4_096), (1, 200_000, 3), (2, 20, 5)):
        monkeypatch.setattr(tox, "PORTION", portion)
        monkeypatch.setattr(tox, "REMEMBERED", remembered)
        monkeypatch.setattr(tox, "WINDOWS_AT_ONCE", at_once)
        assert tox.Scorer(net).logits(texts) == pytest.approx(want, abs=1e-4)
    rows = [(k, t, 5) for k, t in enumerate(texts)] + [(None, texts[3], 6)]
    got = tox.score(spark.createDataFrame(rows, "doc_id long, text string, score int"), net).collect()
    by = {r.doc_id: r.score for r in got}
    assert len(got) == len(rows) and by[None] == by[3]
    assert [by[k] for k in range(len(texts))] == pytest.approx([0.0 if w == -math.inf else 1 / (1 + math.exp(-w)) for w in want], abs=1e-4)


def test_labels_that_differ_and_repeat(spark, monkeypatch):
    """An id with both labels is toxic; repeats of a label change nothing; ids and texts that are null teach nothing."""
    seen = {}
    monkeypatch.setattr(tox, "train", lambda texts, ys: seen.update(zip(texts, ys)))
    docs = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b2"), (3, None), (None, "n"), (4, "d")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0), (1, 1), (2, 0), (2, 0), (3, 1), (None, 1), (4, None)], "doc_id long, toxic int")
    tox.fit(docs, labels)
    assert seen == {"a": 1, "b": 0, "b2": 0}
