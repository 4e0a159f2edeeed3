import bisect
import itertools
import math
import random
import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from colloquy.llm import mixing


def fill(totals, weights, want):
    target, free = {s: 0.0 for s in totals}, set(totals)
    while free and want > 0:
        scale = want / sum(weights[s] for s in free)
        over = [s for s in free if weights[s] * scale > 2 * totals[s]]
        if not over:
            return target | {s: weights[s] * scale for s in free}
        for s in over:
            target[s] = 2 * totals[s]
            want -= target[s]
            free.remove(s)
    return target


def check(rows, got):
    sizes = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    totals = defaultdict(int)
    for _, text, _, source, _ in rows:
        totals[source] += sizes(text)
    names = sorted(s for s in totals if s is not None) + [None] * (None in totals)
    targets = fill(totals, {s: [3, 1, 2][k % 3] for k, s in enumerate(names)}, 1.5 * sum(totals.values()))
    assert Counter((r.doc_id, r["size"]) for r in got) == Counter((r[0], sizes(r[1])) for r in rows)
    source_of = {r[0]: r[3] for r in rows}
    taken = defaultdict(int)
    for r in got:
        assert r.source_size == totals[source_of[r.doc_id]] and abs(r.target - targets[source_of[r.doc_id]]) < 1e-6 * (1 + r.target)
        assert 0 <= r.taken <= 2 * r["size"]
        taken[source_of[r.doc_id]] += r.taken
    for s in names:
        assert abs(taken[s] - targets[s]) <= 1


def test_query(spark, corpus, rows):
    got = mixing.op3_mix(spark, f"{corpus}/full").collect()
    check(rows, got)
    assert sorted(map(str, mixing.op3_mix(spark, f"{corpus}/full").collect())) == sorted(map(str, got))
    assert mixing.op3_mix(spark, f"{corpus}/empty").count() == 0


def test_on_the_synthetic_corpus(spark, real):
    rows = [tuple(r) for r in spark.read.parquet(f"{real}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").collect()]
    check(rows, mixing.op3_mix(spark, real).collect())


def test_repeats_nulls_and_clashing_names(spark):
    """Every name that the mix uses is also a column of the caller's; rows of one id each have their own tokens."""
    names = ["k", "z", "hash", "bucket", "row", "named", "goal", "blocks", "begins", "at", "ends", "_k", "_from", "_place", "Taken"]
    rows = [(1, 10, "a")] * 4 + [(None, 7, None), (None, 9, None), (2, None, "a"), (3, 0, "b"), (4, 1000, "b")]
    df = spark.createDataFrame([(*r, *range(len(names))) for r in rows], "doc_id long, size long, source string, " + ", ".join(f"{n} int" for n in names))
    out = mixing.mix(df, "size", [3.0, 1.0, 2.0], 1.5)
    assert out.columns == [*df.columns, "source_size", "target", "taken_"]
    assert mixing.mix(df.limit(0), "size", [3.0, 1.0, 2.0], 1.5).columns == out.columns
    out = out.drop("Taken").withColumnRenamed("taken_", "taken")
    names.remove("Taken")
    got = out.collect()
    assert Counter(tuple(r)[: 3 + len(names)] for r in got) == Counter(map(tuple, df.drop("Taken").collect()))
    assert all(0 <= r.taken <= 2 * (r["size"] or 0) for r in got)
    for s in ("a", "b", None):
        mine = [r for r in got if r.source == s]
        assert abs(sum(r.taken for r in mine) - mine[0].target) <= 1
    again = mixing.mix(df.repartition(7), "size", [3.0, 1.0, 2.0], 1.5).drop("Taken").withColumnRenamed("taken_", "taken")
    assert sorted(map(str, again.collect())) == sorted(map(str, got))


def test_many_sources(spark):
    """Far more sources than a literal table could name meet their targets."""
    df = spark.range(3000).selectExpr("id AS doc_id", "1 + id % 7 AS size", "concat('s', id % 1000) AS source")
    got = mixing.mix(df, "size", [3.0, 1.0, 2.0], 1.5, block=2).groupBy("source").agg({"taken": "sum", "target": "max"}).collect()
    assert len(got) == 1000 and all(abs(r["sum(taken)"] - r["max(target)"]) <= 1 for r in got)


def test_schedule_interleaves(spark):
    """Any run of slots holds each source near its share: the points are evenly spread."""
    slots = mixing._rank_slots(spark, [600.0, 300.0, 100.0], [600, 300, 100])
    assert Counter(r.k for r in slots.collect()) == {0: 600, 1: 300, 2: 100}
    assert all(sorted(r.rank for r in slots.filter(f"k = {k}").collect()) == list(range(n)) for k, n in enumerate([600, 300, 100]))


def plain_mix(rows, weights, share, block):
    """(tie, taken) of rows (source, size, hash, tie) by walking the schedule slot by slot over each source's line of tokens."""
    names = sorted({r[0] for r in rows if r[0] is not None}) + [None] * any(r[0] is None for r in rows)
    totals = {s: sum(r[1] for r in rows if r[0] == s) for s in names}
    targets = fill(totals, {s: weights[k % 3] for k, s in enumerate(names)}, share * sum(totals.values()))
    taken, lines = defaultdict(int), {}
    for s in names:
        line, at = [], 0
        for _, size, _, tie in sorted((r for r in rows if r[0] == s), key=lambda r: r[2:]):
            line.append((at, at + size, tie))
            at += size
        lines[s] = line
    goal = {s: round(targets[s]) for s in names}
    quota = {s: goal[s] // totals[s] * math.ceil(totals[s] / block) + math.ceil(goal[s] % totals[s] / block) if totals[s] else 0 for s in names}
    edges = list(itertools.accumulate((targets[s] if totals[s] else 0.0) / sum(targets.values()) for s in names))
    done = dict.fromkeys(names, 0)
    slots = [names[min(bisect.bisect_right(edges[:-1], k * mixing.GOLDEN % 1.0), len(names) - 1)] for k in range(sum(quota.values()))]
    for s in slots + [s for s in names for _ in range(quota[s])]:
        if done[s] == quota[s]:
            continue
        turn, at = divmod(done[s], math.ceil(totals[s] / block))
        done[s] += 1
        begin, end = at * block, min((at + 1) * block, totals[s], goal[s] - turn * totals[s])
        for a, b, tie in lines[s]:
            taken[tie] += max(0, min(b, end) - max(a, begin))
    return {r[3]: taken[r[3]] for r in rows}


def test_taken_words_of_every_document(spark):
    rnd = random.Random(9)
    rows = [(k, rnd.choice([0, 1, 5, 40, 300]), rnd.choice(["a", "b", "c", "d", None])) for k in range(150)] + [(3, 7, "a"), (None, 9, "b")]
    df = spark.createDataFrame(rows, "doc_id long, size long, source string")
    keyed = df.select("source", "size", F.xxhash64("doc_id", F.lit(0)).alias("hash"), F.xxhash64("doc_id", "size", "source", F.lit(0)).alias("tie")).collect()
    want = plain_mix([tuple(r) for r in keyed], [3, 1, 2], 1.5, 32)
    got = mixing.mix(df, "size", [3.0, 1.0, 2.0], 1.5, block=32).select(F.xxhash64("doc_id", "size", "source", F.lit(0)).alias("tie"), "taken").collect()
    assert {r.tie: r.taken for r in got} == want and sum(want.values()) > 0
