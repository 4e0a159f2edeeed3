import random

from colloquy.llm.components import components


def plain(links):
    least = {}

    def root(x):
        while least.setdefault(x, x) != x:
            x = least[x]
        return x

    for a, b in links:
        a, b = sorted((root(a), root(b)))
        least[b] = a
    return {x: root(x) for x in least}


def test_components_end_when_only_stars_are_left(spark):
    """Chains, cycles, stars, repeats and self-links against a plain union; one round more never changes anything."""
    rnd = random.Random(3)
    links = [(k, k + 1) for k in range(100, 160)] + [(500, 500 + k) for k in range(1, 30)] + [(900 + k, 900 + (k + 1) % 17) for k in range(17)]
    links += [(rnd.randrange(2_000, 2_120), rnd.randrange(2_000, 2_120)) for _ in range(70)] + [(7, 7), (3, 2), (2, 3), (-5, 2**62)]
    want = {x: r for x, r in plain([x for x in links if x[0] != x[1]]).items()}
    got = {r.id: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
