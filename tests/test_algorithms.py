"""Graph operators against brute force on random graphs."""

import itertools
import random
from collections import defaultdict

import pytest

from repograph.operators import articulation, communities, components, cycles, link, numbering, rank, traverse


def graphs():
    for seed in range(3):
        r = random.Random(seed)
        n = r.choice([8, 14, 20])
        nodes = [f"n{i:02d}" for i in range(n)]
        yield nodes, sorted({(r.choice(nodes), r.choice(nodes)) for _ in range(int(n * r.choice([1.0, 1.5, 2.0])))})


def frames(spark, nodes, edges):
    return spark.createDataFrame(edges, "src string, dst string"), spark.createDataFrame([(x,) for x in nodes], "id string")


def within(edges, start, depth):
    level, seen = {start}, {}
    for hop in range(1, depth + 1):
        level = {a for a, b in edges if b in level}
        for x in level:
            seen.setdefault(x, hop)
    return seen


@pytest.mark.parametrize("nodes, edges", list(graphs()))
def test_reach_and_widest(spark, nodes, edges):
    df, _ = frames(spark, nodes, edges)
    start = spark.createDataFrame([(nodes[0],)], "id string")
    got = {r.id: r.hops for r in traverse.reach(df, start, 4).collect()}
    assert got == within(edges, nodes[0], 4)
    r = random.Random(7)
    votes = {e: r.randint(1, 4) for e in edges}
    voted = spark.createDataFrame([(*e, v) for e, v in votes.items()], "src string, dst string, votes int")
    best = defaultdict(int)
    walks = [(nodes[0], 3)]
    for _ in range(4):
        walks = list({(a, min(m, votes[a, b])) for x, m in walks for a, b in edges if b == x})
        for a, m in walks:
            best[a] = max(best[a], m)
    assert {x.id: x.votes for x in traverse.widest(voted, start, 4).collect()} == dict(best)


@pytest.mark.parametrize("nodes, edges", list(graphs()))
def test_best_paths(spark, nodes, edges):
    r = random.Random(3)
    conf = {e: r.choice([0.4, 0.7, 1.0]) for e in edges}
    df = spark.createDataFrame([(*e, c) for e, c in conf.items()], "src string, dst string, conf double")
    start = spark.createDataFrame([(nodes[0],)], "id string")
    got = {x.id: (x.hops, round(x.conf, 6), list(x.chain)) for x in traverse.best_paths(df, start, 4).collect()}
    hops = {k: v for k, v in within(edges, nodes[0], 4).items() if k != nodes[0]}
    want, level = {}, {nodes[0]: (1.0, [nodes[0]])}
    for hop in range(1, 5):
        new = {}
        for x in (k for k, v in hops.items() if v == hop):
            options = [(-round(level[b][0] * conf[a, b], 6), level[b][1] + [x]) for a, b in edges if a == x and b in level]
            c, chain = min(options)
            new[x] = (-c, chain)
            want[x] = (hop, round(-c, 6), chain)
        level = new
    assert got == want


def closure(nodes, edges):
    reach = {a: {b for x, b in edges if x == a} for a in nodes}
    for k, a, b in itertools.product(nodes, repeat=3):
        if k in reach[a] and b in reach[k]:
            reach[a].add(b)
    return reach


@pytest.mark.parametrize("core", [0, 10_000])
@pytest.mark.parametrize("nodes, edges", list(graphs()))
def test_strong_components_and_cycles(spark, nodes, edges, core):
    df, ids = frames(spark, nodes, edges)
    reach = closure(nodes, edges)
    want = {a: min([b for b in nodes if b in reach[a] and a in reach[b]] + [a]) for a in nodes}
    got = {r.id: r.component for r in components.strongly_connected(df, ids, core).collect()}
    assert got == want
    if core:
        table = spark.createDataFrame(list(want.items()), "id string, component string")
        found = cycles.elementary(df, table, 6)
        have = sorted(tuple(r.path) for r in found.collect())
        simple = {(a, b) for a, b in edges if a != b}

        def grow(path):
            for b in sorted(x for a, x in simple if a == path[-1]):
                if b == path[0] and len(path) > 1:
                    yield (*path, b)
                elif b > path[0] and b not in path and len(path) < 6:
                    yield from grow([*path, b])

        assert have == sorted(c for x in nodes for c in grow([x]))


def test_acyclic_graphs_have_no_cycles(spark):
    nodes = [f"n{i}" for i in range(9)]
    df, ids = frames(spark, nodes, [(a, b) for a, b in itertools.combinations(nodes, 2)])
    c = components.strongly_connected(df, ids)
    assert all(r.id == r.component for r in c.collect())
    assert cycles.elementary(df, c).count() == 0


def pieces(nodes, edges):
    near = defaultdict(set)
    for a, b in edges:
        near[a].add(b)
        near[b].add(a)
    left, out = set(nodes), []
    while left:
        todo = [left.pop()]
        part = set(todo)
        while todo:
            for y in near[todo.pop()] & left:
                left.discard(y)
                part.add(y)
                todo.append(y)
        out.append(part)
    return out


@pytest.mark.parametrize("most", [0, 10**6])
@pytest.mark.parametrize("nodes, edges", list(graphs()))
def test_connected_and_articulation(spark, nodes, edges, most):
    df, ids = frames(spark, nodes, edges)
    if most:
        got = {r.id: r.component for r in components.connected(df, ids).collect()}
        assert got == {x: min(p) for p in pieces(nodes, edges) for x in p}
    simple = [(a, b) for a, b in edges if a != b]
    whole = len(pieces(nodes, simple))
    used = {x for e in simple for x in e}
    want = {}
    for x in nodes:
        rest = pieces([n for n in nodes if n != x], [e for e in simple if x not in e])
        want[x] = int(x in used and len(rest) > whole)
    assert {r.id: r.is_articulation for r in articulation.articulation_points(df, ids, most).collect()} == want


def brute_betweenness(nodes, edges):
    near = defaultdict(set)
    for a, b in edges:
        if a != b:
            near[a].add(b)
            near[b].add(a)
    total = dict.fromkeys(nodes, 0.0)
    dist, count = {}, {}
    for s in nodes:
        d, c, level = {s: 0}, {s: 1}, [s]
        while level:
            new = []
            for v in level:
                for w in near[v]:
                    if w not in d:
                        d[w], c[w] = d[v] + 1, 0
                        new.append(w)
                    if d[w] == d[v] + 1:
                        c[w] += c[v]
            level = new
        dist[s], count[s] = d, c
    for s, t, v in itertools.permutations(nodes, 3):
        if t in dist[s] and v in dist[s] and t in dist[v] and dist[s][v] + dist[v][t] == dist[s][t]:
            total[v] += count[s][v] * count[v][t] / count[s][t]
    return total


@pytest.mark.parametrize("nodes, edges", list(graphs()))
def test_betweenness_both_ways(spark, nodes, edges):
    df, ids = frames(spark, nodes, edges)
    want = brute_betweenness(nodes, edges)
    both = rank.undirected(df)
    for most in (10**6, 0):
        got = {r.id: r.betweenness for r in rank.betweenness(both, ids, samples=1000, most=most).collect()}
        assert got == pytest.approx(want)


@pytest.mark.parametrize("nodes, edges", list(graphs()))
def test_pagerank(spark, nodes, edges):
    df, ids = frames(spark, nodes, edges)
    got = {r.id: r.pagerank for r in rank.pagerank(rank.undirected(df), ids, 7).collect()}
    weight = defaultdict(int)
    for a, b in edges:
        weight[a, b] += 1
        weight[b, a] += 1
    score = dict.fromkeys(nodes, 0.15)
    for _ in range(7):
        score = {x: 0.15 + 0.85 * sum(score[a] * w / sum(v for (s, _), v in weight.items() if s == a) for (a, b), w in weight.items() if b == x) for x in nodes}
    assert got == pytest.approx(score)
    numbers, named = numbering.numbered(df, ids)
    pairs = numbering.weighted(numbers)
    for most in (10**6, 0):
        assert {r.id: r.pagerank for r in rank.pagerank_of_pairs(pairs, named, 7, most=most).collect()} == pytest.approx(score)


def test_arrays_against_brute_force():
    """Strong components and articulation points of many small graphs, of a long path and of a long ring."""
    import numpy as np

    r = random.Random(11)
    for k in range(150):
        n = r.randint(2, 9)
        edges = sorted({(a, b) for a in range(n) for b in range(n) if a != b and r.random() < r.choice((0.1, 0.25, 0.5))})
        reach = closure(range(n), edges)
        src, dst = (np.array([e[i] for e in edges], dtype=np.int64) for i in (0, 1))
        assert components.strong_labels(n, src, dst).tolist() == [min([b for b in range(n) if b in reach[a] and a in reach[b]] + [a]) for a in range(n)], edges
        simple = sorted({(min(e), max(e)) for e in edges})
        used = {x for e in simple for x in e}
        want = [x for x in range(n) if x in used and len(pieces([v for v in range(n) if v != x], [e for e in simple if x not in e])) > len(pieces(range(n), simple))]
        a, b = (np.array([e[i] for e in simple], dtype=np.int64) for i in (0, 1))
        assert articulation.cut_nodes(n, a, b).tolist() == want, simple
    path = np.arange(2000)
    assert articulation.cut_nodes(2001, path, path + 1).tolist() == list(range(1, 2000))
    assert not len(articulation.cut_nodes(2001, np.append(path, 0), np.append(path + 1, 2000)))
    assert set(components.strong_labels(2001, np.append(path, 2000), np.append(path + 1, 0)).tolist()) == {0}


def test_communities_of_joined_cliques(spark):
    cliques = [[f"c{k}x{i}" for i in range(6)] for k in range(4)]
    edges = [e for c in cliques for e in itertools.combinations(c, 2)] + [(cliques[k][0], cliques[(k + 1) % 4][1]) for k in range(4)]
    df, ids = frames(spark, [x for c in cliques for x in c] + ["alone"], edges)
    for most in (10**6, 20):
        got = {r.id: r.community for r in communities.communities(df, ids, most=most).collect()}
        assert got["alone"] == "alone"
        if most > 20:
            assert all(got[x] == c[0] for c in cliques for x in c)


def test_leiden_beats_label_propagation_and_is_connected():
    for seed in range(4):
        r = random.Random(seed)
        n = 60
        edges = [(a, b, 1.0) for a, b in itertools.combinations(range(n), 2) if r.random() < (0.35 if a // 12 == b // 12 else 0.02)]
        found = communities.leiden(n, edges)
        label = list(range(n))
        for _ in range(20):
            for v in range(n):
                near = [label[b if a == v else a] for a, b, _ in edges if v in (a, b)]
                if near:
                    label[v] = max(sorted(set(near)), key=near.count)
        assert communities.modularity(edges, found) >= communities.modularity(edges, label) - 1e-9
        assert communities.modularity(edges, found) > 0.4
        assert found == communities.leiden(n, edges)
        groups = defaultdict(list)
        for v, c in enumerate(found):
            groups[c].append(v)
        for g in groups.values():
            assert len(pieces(g, [(a, b) for a, b, _ in edges if a in g and b in g])) == 1


def test_longest_prefix(spark):
    left = spark.createDataFrame([(1, "x/kit/a"), (2, "x/kitten"), (3, "x/kit"), (4, "y")], "k int, m string")
    right = spark.createDataFrame([("x/kit", "p"), ("x", "q"), ("x/kit/a/b", "r")], "n string, who string")
    got = {r.k: r.who for r in link.longest_prefix(left, "m", right, "n", ["k"]).collect()}
    assert got == {1: "p", 2: "q", 3: "p"}
