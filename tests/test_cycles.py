import random

import pytest

from marlstone.operators import graph as G


def closure(pairs):
    """Components by plain reachability."""
    out = {}
    for s, t in pairs:
        out.setdefault(s, set()).add(t)

    def reach(a):
        seen, work = set(), [a]
        while work:
            for b in out.get(work.pop(), ()):
                if b not in seen:
                    seen.add(b)
                    work.append(b)
        return seen

    r = {a: reach(a) for p in pairs for a in p}
    return {a: min({b for b in r[a] if a in r[b]}) for a in r if a in r[a]}


def graphs(seed):
    rng = random.Random(seed)
    loop = lambda *n: list(zip(n, n[1:] + n[:1]))
    out = {
        "chain": [(i, i + 1) for i in range(40)],
        "loop": loop(*rng.sample(range(60), 50)),
        "two": loop(1, 2, 3, 4, 5) + loop(11, 12, 13) + [(5, 11), (20, 1), (13, 30), (30, 31)],
        "self": [(1, 1), (1, 2), (2, 3)],
        "eight": loop(1, 2, 3, 4) + loop(1, 5, 6),
        "pair": loop(8, 9),
    }
    for i in range(8):
        n = rng.randint(5, 40)
        out[f"r{i}"] = list({(rng.randrange(n), rng.randrange(n)) for _ in range(rng.randint(n // 2, 2 * n))})
    return out


def test_tarjan_equals_reachability():
    for seed in range(30):
        for pairs in graphs(seed).values():
            found = G.strong_components(pairs)
            least = {}
            for node, c in found.items():
                least[c] = min(node, least.get(c, node))
            assert {n: least[c] for n, c in found.items()} == closure(pairs)


@pytest.mark.parametrize("local", [1_000_000, 12, 0])
def test_equals_reachability(spark, local):
    made = graphs(5)
    edges = spark.createDataFrame([(k, s, t) for k, p in made.items() for s, t in p + p[:2]], "run_id string, source long, target long").repartition(4)
    got = {(r.run_id, r.node): r.component for r in G.cycles(edges, local).collect()}
    assert got == {(k, n): c for k, p in made.items() for n, c in closure(p).items()}


def test_one_large_loop(spark):
    n = 100_000
    loop = spark.range(n).selectExpr("1 AS run_id", "id AS source", f"(id + 1) % {n} AS target")
    for local in (1_000_000, 20_000):
        out = G.cycles(loop, local)
        assert out.count() == n and out.where("component <> 0").count() == 0
