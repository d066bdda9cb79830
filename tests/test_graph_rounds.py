"""Hierarchies by pointer doubling and paths by distances, against brute force."""

import random

import pytest

from marlstone.operators import graph


def brute_paths(edges, sources, targets, hops):
    out, front = [], [((s,), 0.0) for s in sources]
    for _ in range(hops):
        front = [((*p, b), w + x) for p, w in front for a, b, x in edges if a == p[-1] and b not in p and (len(p) == 1 or p[-1] not in targets)]
        out += [(p, w) for p, w in front if p[-1] in targets]
    return out


@pytest.mark.parametrize("seed", range(2))
def test_paths_between_sets(spark, seed):
    r = random.Random(seed)
    edges = [(r.randrange(12), r.randrange(12), float(r.randrange(1, 4))) for _ in range(30)]
    edges = [(a, b, w) for a, b, w in edges if a != b]
    df = spark.createDataFrame(edges, "src long, dst long, weight double")
    one = lambda ids: spark.createDataFrame([(i,) for i in ids], "id long")
    sources, targets = set(r.sample(range(12), 2)), set(r.sample(range(12), 3))
    if seed % 2:
        targets |= {min(sources)}
    want = brute_paths(edges, sources, targets, 4)
    got = [(tuple(x.path), x.weight) for x in graph.paths_between(df, one(sources), one(targets), 4).collect()]
    assert sorted(got) == sorted(want)
    short = [(tuple(x.path), x.weight) for x in graph.paths_between(df, one(sources), one(targets), 4, only_shortest=True).collect()]
    least = min((len(p) for p, _ in want), default=0)
    assert sorted(short) == sorted(x for x in want if len(x[0]) == least)
    assert graph.paths_between(df, one([99]), one(targets), 3).count() == 0


def test_shortest_paths_list_no_others(spark):
    """Twenty layers of three nodes, all joined: 3 ** 4 paths of six hops, of billions of walks beyond."""
    layers = [[0], *[[10 * k + j for j in range(3)] for k in range(1, 5)], [1000]]
    edges = [(a, b, 1.0) for x, y in zip(layers, layers[1:]) for a in x for b in y] + [(b, a, 1.0) for x, y in zip(layers, layers[1:]) for a in x for b in y]
    got = graph.shortest_paths(spark.createDataFrame(edges, "src long, dst long, weight double"), 0, 1000, 9).collect()
    assert len(got) == 3**4 and {x.hops for x in got} == {5}


def brute_tree(rows):
    parents = {}
    for i, p in rows:
        if i is not None and p is not None and i != p:
            parents.setdefault(i, set()).add(p)

    def above(i):
        seen, todo = set(), list(parents.get(i, ()))
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += parents.get(x, ())
        return seen

    return {i: above(i) for i in {i for i, _ in rows}}


@pytest.mark.parametrize("kind", ["loops", "several parents", "missing parents", "empty"])
def test_levels_and_totals(spark, kind):
    r = random.Random(3)
    rows = [(i, r.randrange(i) if i and r.random() < 0.9 else None) for i in range(60)]
    rows += {"loops": [(100, 101), (101, 102), (102, 100), (103, 100), (104, 103), (105, 105)], "several parents": [(30, 2), (30, 3)], "missing parents": [(200, 999), (201, 200)]}.get(kind, [])
    rows = [] if kind == "empty" else rows
    tree = spark.createDataFrame(rows, "id long, parent_id long")
    above = brute_tree(rows)
    assert {x.id: x.level for x in graph.tree_levels(tree).collect()} == {i: len(a) + 1 for i, a in above.items()}
    assert {x.id: x.level for x in graph.tree_levels(tree, 3).collect()} == {i: min(3, len(a) + 1) for i, a in above.items()}
    n = {i: r.randrange(5) for i in above if r.random() < 0.7}
    counts = spark.createDataFrame(list(n.items()), "id long, n long")
    want = {i: n.get(i, 0) + sum(n.get(j, 0) for j, a in above.items() if i in a and j != i) for i in above}
    assert {x.id: x["count"] for x in graph.subtree_totals(tree, counts).collect()} == want


@pytest.mark.parametrize("hops", [2, 3, 4])
def test_cycles_of_a_hub(spark, hops):
    r = random.Random(hops)
    edges = {(0, i) for i in range(1, 15)} | {(i, 0) for i in range(1, 15, 2)} | {(r.randrange(15), r.randrange(15)) for _ in range(25)}
    edges = {(a, b) for a, b in edges if a != b}
    want = set()
    front = [(a, b) for a, b in edges if a < b]
    for _ in range(hops - 1):
        want |= {p for p in front if (p[-1], p[0]) in edges}
        front = [(*p, b) for p in front for a, b in edges if a == p[-1] and b > p[0] and b not in p]
    got = [tuple(x.path) for x in graph.cycles(spark.createDataFrame(sorted(edges), "src long, dst long"), hops).collect()]
    assert sorted(got) == sorted(want)


def test_a_long_chain_takes_few_rounds(spark, monkeypatch):
    n, puts = 3000, []
    put = graph.Stash.put
    monkeypatch.setattr(graph.Stash, "put", lambda self, df: (puts.append(1), put(self, df))[1])
    tree = spark.range(n).selectExpr("id", "case when id > 0 then id - 1 end as parent_id")
    got = graph.tree_levels(tree)
    assert len(puts) <= 16
    assert got.where("level != id + 1").count() == 0 and got.count() == n
    totals = graph.subtree_totals(tree, spark.range(n).selectExpr("id", "1L as n"))
    assert totals.where(f"count != {n} - id").count() == 0
