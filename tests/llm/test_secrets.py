import hashlib
import re

from colloquy.llm import secrets

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def base(text):
    spans = []
    for m in ASSIGN.finditer(text):
        if len(m[2]) >= 6 and m[1].isascii():
            spans.append((m.start(), 0, f"assign:{m.start()}:{m.end()}"))
    spans += [(m.start(), 1, f"access:{m.start()}:{m.end()}") for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    spans += [(m.start(), 2, f"hex:{m.start()}:{m.end()}") for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return [s[2] for s in sorted(spans)]


def check(rows, got):
    want = {d: base(t or "") for d, t, *_ in rows}
    for r in got:
        spans = want[r.doc_id]
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(s.startswith(k) for s in spans) for k in ("assign:", "access:", "hex:")), (r, spans)
        assert r.base_sha256 == hashlib.sha256(",".join(spans).encode()).hexdigest()
        assert [s for s in r.spans.split(",") if s and not s.startswith("owned")] == spans
    assert len(got) == len(rows)


def test_query(spark, corpus, rows):
    check(rows, secrets.op7_secret_scan(spark, f"{corpus}/full").collect())
    assert secrets.op7_secret_scan(spark, f"{corpus}/empty").count() == 0


def test_on_the_synthetic_corpus(spark, real):
    rows = [tuple(r) for r in spark.read.parquet(f"{real}/documents.parquet").select("doc_id", "text").collect()]
    check(rows, secrets.op7_secret_scan(spark, real).collect())


def test_ownership(spark):
    live, example = "Zz9" + "k3J" * 8, "Ex4" + "m7P" * 8
    data = [(1, f"x {live} y", "a"), (2, f"{example}", "a"), (3, f"q {example}", "b"), (4, f"x {live} again", "a")]
    df = spark.createDataFrame(data, "doc_id long, text string, source string")
    got = {r.doc_id: [s.kind for s in r.spans] for r in secrets.scan(df).collect()}
    assert got == {1: ["owned"], 2: [], 3: [], 4: ["owned"]}


def test_both_counts_decide_over_all_candidates(spark):
    """A key in many documents of one owner is copied; rows repeated count once; base and very long values are counted."""
    many, few, long = "Mm1" + "b2C" * 8, "Ff2" + "d3E" * 8, "Ll3" + "q4R" * 100
    data = [(k, f"x {many}", "a") for k in range(secrets.MOST_PLACES + 1)]
    data += [(100, f"y {few}", "a")] * (secrets.MOST_PLACES + 5) + [(101, long, "b"), (102, "password=hunter22", "a"), (103, "token: hunter22", "b")]
    df = spark.createDataFrame(data, "doc_id long, text string, source string")
    rows = secrets.scan(df).collect()
    assert len(rows) == len(data)
    got = {r.doc_id: ([s.kind for s in r.spans], [(c.kind, c.places, c.owners, c.verdict) for c in r.candidates]) for r in rows}
    assert got[0] == ([], [("owned", secrets.MOST_PLACES + 1, 1, "copied")])
    assert got[100] == (["owned"], [("owned", 1, 1, "live")]) and got[101] == (["owned"], [("owned", 1, 1, "live")])
    assert got[102] == got[103] == (["assign"], [("assign", 2, 2, "copied")])


def test_very_long_tokens_and_very_many_matches(spark):
    token = "Aa1" + "xY7zQ" * 2000
    many = "é ".join(f"token=abc{k:04d}{'' if k % 3 else '!'} {'AKIA' + 'Z' * (14 + k % 5)} {'0af' * (7 + k % 3)}" for k in range(3 * secrets.RUN + 5))
    rows = [(1, f"x {token} y", "a", 0), (2, many, "b", 0), (3, token[:-1], "a", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, hash int")
    got = {r.doc_id: r for r in secrets.scan(df).collect()}
    assert [(s.kind, s.start, s.stop) for s in got[1].spans] == [("owned", 2, 2 + len(token))] and [s.kind for s in got[3].spans] == ["owned"]
    found = sorted((s.start, s.rank, f"{s.kind}:{s.start}:{s.stop}") for s in got[2].base)
    assert [f[2] for f in found] == base(many) and len(found) > 3 * secrets.RUN


def test_copied_by_owners_or_by_places(spark, corpus):
    """A brute count of places and owners over all candidates of the fixture gives the same verdicts."""
    rows = secrets.scan(spark.read.parquet(f"{corpus}/full/documents.parquet")).collect()
    text = {(r.doc_id): r for r in spark.read.parquet(f"{corpus}/full/documents.parquet").collect()}
    places = {}
    for r in rows:
        for c in r.candidates:
            places.setdefault(c["hash"], set()).add((text[r.doc_id].source, r.doc_id, text[r.doc_id].text))
    for r in rows:
        for c in r.candidates:
            at = places[c["hash"]]
            owners = {p[0] for p in at}
            assert (c.places, c.owners) == (len(at), len(owners))
            assert (c.verdict == "live") == (len(owners) <= secrets.MOST_OWNERS and len(at) <= secrets.MOST_PLACES)
    assert any(r.candidates for r in rows)
