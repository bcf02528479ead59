"""Kernels of one document."""

import random

from rankloom.operators import proximity as p


def quadratic(features, eos, c):
    """Touch counts by looking at every pair: a pair of node and feature counts in its first class."""
    nodes = sorted((pos, f, n) for f, ps in enumerate(features) for pos, n in ps)
    out = []
    for a in nodes:
        met = {}
        for b in nodes:
            if a[1] == b[1]:
                continue
            x, y = (a, b) if (a[0], nodes.index(a)) < (b[0], nodes.index(b)) else (b, a)
            stop = next((e for e in eos if e >= x[0]), None)
            kinds = [("imm", c.dist_imm, True), ("close", c.dist_close, True)] + ([("same", c.dist_sentence, True)] if eos else []) + [("near", c.dist_near, False)]
            for k, (_, dist, stops) in enumerate(kinds):
                if x[0] + x[2] + dist > y[0] and not (stops and stop is not None and y[0] > stop):
                    met[b[1]] = min(met.get(b[1], 9), k)
                    break
        names = ["imm", "close"] + (["same"] if eos else []) + ["near"]
        out.append((a[0], a[1], *(sum(names[v] == n for v in met.values()) for n in ("imm", "close", "same", "near"))))
    return out


def test_touches():
    rng = random.Random(1)
    for _ in range(60):
        features = [[(x, 1) for x in sorted(rng.sample(range(1, 120), rng.randint(1, 5)))] for _ in range(rng.randint(2, 4))]
        eos = sorted(rng.sample(range(1, 120), rng.randint(0, 5)))
        c = p.Config(dist_sentence=15)
        assert [(x.pos, x.feature, x.imm, x.close, x.same, x.near) for x in p.touches(features, eos, c)] == quadratic(features, eos, c)


def test_weights():
    c = p.Config(cluster=0.5, ffbase=0.1)
    assert p.min_cluster(3, 0.5) == 2 and p.min_cluster(2, 0.0) == 1
    assert p.ff_weight(p.Node(0, 1, 1, imm=2), 3, c) == 1.0
    assert p.ff_weight(p.Node(0, 1, 1, imm=1), 3, c) == 0.0


def test_best_passage_and_neighbours():
    c = p.Config(cluster=0.5, dist_sentence=10)
    nodes = p.touches([[(5, 1), (50, 1)], [(51, 1)]], [48, 55], c)
    assert p.best_passage(nodes, [1.0, 1.0], [48, 55], 2, c, 1) == (49, 55)
    near = p.neighbours([x for x in nodes if x.pos == 50], [1.0, 1.0], [48, 55], 8, 2, c)
    assert set(near) == set(range(49, 55)) and all(v > 0 for v in near.values())


def test_title():
    fields = [p.Field("title", 1, 3, 3, 40), p.Field("chapter", 10, 12, 12, 20)]
    assert p.title_matches([[(1, 1)], [(2, 1)]], fields, 0.7, [False, False], 5) == [(3, 40, 1.0)]
    both = p.title_matches([[(1, 1)], [(2, 1)], [(10, 1)], [(11, 1)]], fields, 0.7, [False] * 4, 5)
    assert both == [(12, 20, 0.5 + 0.5 * 0.7)]
    assert p.title_matches([[(1, 1)], []], fields, 0.7, [False, False], 5) == []
