from __future__ import annotations

import random

from kinescribe.llm import simhash


def components(nodes, pairs):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        parent[find(a)] = find(b)
    groups = {}
    for n in nodes:
        groups.setdefault(find(n), set()).add(n)
    return sorted(map(sorted, groups.values()))


def test_pairs_of_both_joins_reach_what_all_pairs_reach(spark):
    rng = random.Random(8)
    prints = set()
    for _ in range(12):
        fp = rng.getrandbits(63)
        for _ in range(12):
            prints.add(fp)
            for bit in rng.sample(range(63), rng.randrange(1, 5)):
                fp ^= 1 << bit
    nodes = spark.createDataFrame([(p,) for p in prints], "fp long")
    got = [tuple(r) for r in simhash.chain_pairs(nodes).collect()]
    near = [(a, b) for a in prints for b in prints if a < b and (a ^ b).bit_count() <= 4]
    assert {tuple(sorted(p)) for p in got} <= set(near)
    assert components(prints, got) == components(prints, near)
