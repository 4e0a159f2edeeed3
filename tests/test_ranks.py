import random
from collections import defaultdict

from colloquy.operators import lifecycle
from colloquy.operators.ranks import ranked


def test_places_in_groups(spark):
    """A key of most rows, a null key, single rows and descending ids, dealt over partitions."""
    rnd = random.Random(1)
    rows = [(rnd.choice([1, 1, 1, 1, None, 2]), i) for i in rnd.sample(range(10_000), 900)] + [(7, -5)]
    want = defaultdict(list)
    for k, i in rows:
        want[k].append(i)
    df = spark.createDataFrame(rows, "k long, id long").repartition(6)
    got = {(r.k, r.id): r["rank"] for r in ranked(df, "k", ["id"]).collect()}
    assert got == {(k, i): n for k, ids in want.items() for n, i in enumerate(sorted(ids), 1)}
    assert ranked(df.limit(0), "k", ["id"]).count() == 0


def test_ids_go_on_over_spans_of_meetings(spark, monkeypatch):
    monkeypatch.setattr(lifecycle, "MEETINGS_A_SPAN", 3)
    old = spark.createDataFrame([(4, 1, 0)], "id long, meeting_id long, at long")
    new = [(m, a) for m in range(20) for a in range(m % 4)]
    df = spark.createDataFrame([(None, m, a) for m, a in new], "id long, meeting_id long, at long")
    got = {(r.meeting_id, r.at): r.id for r in lifecycle.append_segments(old, df, ["at"]).filter("id > 4").collect()}
    assert got == {x: k for k, x in enumerate(sorted(new), 5)}
