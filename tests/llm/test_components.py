import random

import pytest

from codestrata.llm.components import components
from codestrata.llm.storage import stored


def expected(links):
    of = {x: x for link in links for x in link}
    for u, v in links:
        a, b = of[u], of[v]
        of = {x: min(a, b) if c in (a, b) else c for x, c in of.items()}
    return sorted((x, c) for x, c in of.items() if x != c)


def chain(n):
    names = list(range(n))
    random.Random(n).shuffle(names)
    return list(zip(names, names[1:]))


def sparse(n):
    rng = random.Random(n)
    return [(rng.randrange(n), rng.randrange(n)) for _ in range(n * 2 // 3)]


@pytest.mark.parametrize(
    "links",
    [[], [(5, 5)], [(2, 1), (1, 2), (2, 1), (-3, 2), (9, 9)], chain(40), [(0, k) for k in range(1, 60)], [(k, 60) for k in range(60)], sparse(120)],
    ids=["none", "loop", "repeated", "chain", "star at the smallest", "star at the largest", "sparse"],
)
def test_components(spark, links):
    got = components(stored(spark.createDataFrame(links, "u long, v long"), "given"))
    assert got.columns == ["node", "component"]
    assert sorted(map(tuple, got.collect())) == expected(links)
