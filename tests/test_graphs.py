"""Graph operators against brute force on small graphs, and the registered queries that SQL can't express."""

import random
from collections import Counter, defaultdict, deque
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadenza import queries
from cadenza.operators import biconnected, centrality, communities, dynamics, graph, orders, searches, summaries, trees, triads

DATA = "/root/testdata/sf0.001"


def neighbours(pairs, nodes=()):
    near = {n: set() for n in nodes}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    return near


def search(near, s):
    dist, paths, order, before = {s: 0}, defaultdict(float, {s: 1.0}), [], defaultdict(list)
    queue = deque([s])
    while queue:
        v = queue.popleft()
        order.append(v)
        for w in near[v]:
            if w not in dist:
                dist[w] = dist[v] + 1
                queue.append(w)
            if dist[w] == dist[v] + 1:
                paths[w] += paths[v]
                before[w].append(v)
    return dist, paths, order, before


def brute_betweenness(pairs, endpoints=False):
    """(of nodes, of edges), summed over ordered pairs."""
    near, node, edge = neighbours(pairs), Counter(), Counter()
    for s in near:
        dist, paths, order, before = search(near, s)
        share = defaultdict(float)
        for w in reversed(order):
            for v in before[w]:
                c = paths[v] / paths[w] * (1 + share[w])
                share[v] += c
                edge[min(v, w), max(v, w)] += c
        for w in order:
            if w != s:
                node[w] += share[w] + endpoints
        node[s] += endpoints * (len(order) - 1)
    return node, edge


def parts(pairs, nodes):
    near, found = neighbours(pairs, nodes), {}
    for n in sorted(near):
        if n not in found:
            found.update(dict.fromkeys(search(near, n)[0], n))
    return found


def frame(spark, rows, columns="a long, b long"):
    return spark.createDataFrame(rows, columns)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def random_pairs(seed, n, m):
    r = random.Random(seed)
    return sorted({tuple(sorted(r.sample(range(1, n + 1), 2))) for _ in range(m)})


# two triangles that share node 3, a bridge to 6, a square behind it, and a component of its own
CACTUS = [(1, 2), (1, 3), (2, 3), (3, 4), (3, 5), (4, 5), (5, 6), (6, 7), (7, 8), (8, 9), (6, 9), (20, 21)]


def test_betweenness_in_groups_of_sources(spark):
    pairs = random_pairs(1, 9, 12) + [(50, 51), (51, 52)]
    e = frame(spark, pairs)
    node, edge = brute_betweenness(pairs)
    got = centrality.betweenness(e, rows=80)  # several groups
    assert rows(got) == [(n, pytest.approx(node[n] / 2)) for n in sorted(neighbours(pairs))]
    assert rows(centrality.edge_betweenness(e)) == [(a, b, pytest.approx(v / 2)) for (a, b), v in sorted(edge.items())]
    n = len(neighbours(pairs))
    ends, _ = brute_betweenness(pairs, endpoints=True)
    assert rows(centrality.betweenness(e, k=1000, endpoints=True, normalized=True)) == [(v, pytest.approx(ends[v] / (n * (n - 1)), abs=1e-9)) for v in sorted(ends)]
    assert not centrality.betweenness(e.where("false")).count()


def test_centralities_take_one_search_of_blocks_and_nodes_go_on_in_the_next_batch(spark, monkeypatch):
    rng = random.Random(8)
    pairs = sorted({(a, b) for a, b in ((rng.randrange(30), rng.randrange(30)) for _ in range(45)) if a < b} | {(0, v) for v in range(1, 12)})
    e, near = spark.createDataFrame(pairs, "a long, b long"), neighbours(pairs)
    n, (node, edge) = len(near), brute_betweenness(pairs)
    searched, tables = centrality.levels, []
    monkeypatch.setattr(centrality, "levels", lambda *a: tables.append(searched(*a)) or tables[-1])
    monkeypatch.setattr(centrality, "drop", lambda *a: None)  # the tables are looked at
    got = {r["node"]: r for r in centrality.centralities(e).collect()}
    want = []
    for v in near:
        far = search(near, v)[0].values()
        want.append((v, round(len(near[v]) / (n - 1), 9), round((len(far) - 1) ** 2 / (sum(far) * (n - 1)), 9), max(far), pytest.approx(node[v] / 2, abs=1e-6)))
    assert len(got) == n and [tuple(got[v[0]]) for v in want] == want
    assert len(tables) == 1  # distances and shares come from one search
    assert all(t.count() <= n for t in tables[0])  # a row of a level holds all sources of a block
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 2)
    try:
        assert rows(centrality.betweenness(e)) == [(v, pytest.approx(node[v] / 2, abs=1e-9)) for v in sorted(near)]
        assert rows(centrality.edge_betweenness(e)) == [(a, b, pytest.approx(v / 2)) for (a, b), v in sorted(edge.items())]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_blocks(spark):
    def brute(pairs):
        nodes = set(neighbours(pairs))
        name = {p: p for p in pairs}

        def root(p):
            while name[p] != p:
                p = name[p]
            return p

        for x in nodes:
            own = parts([p for p in pairs if x not in p], nodes - {x})
            at = [p for p in pairs if x in p]
            for p, q in combinations(at, 2):
                if own[sum(p) - x] == own[sum(q) - x]:
                    a, b = sorted((root(p), root(q)))
                    name[b] = a
        return sorted((*p, *root(p)) for p in pairs)

    for pairs in (CACTUS, random_pairs(4, 16, 19)):
        got = biconnected.blocks(frame(spark, pairs))
        assert rows(got) == brute(pairs)
        if pairs is CACTUS:
            assert rows(biconnected.articulation_points(got)) == [(3, 2), (5, 2), (6, 2)] and rows(biconnected.bridges(got)) == [(5, 6), (20, 21)]


def test_triad_census(spark):
    def kind(triple, arcs):
        own = [(a, b) for a in triple for b in triple if (a, b) in arcs]
        outs, ins = Counter(a for a, _ in own), Counter(b for _, b in own)
        both = sum((b, a) in arcs for a, b in own) // 2
        one = len(own) - 2 * both
        letter = ""
        if (both, one) in ((0, 2), (1, 2)):
            single = [(a, b) for a, b in own if (b, a) not in arcs]
            letter = "D" if len({a for a, _ in single}) == 1 else "U" if len({b for _, b in single}) == 1 else "C"
        elif (both, one) == (1, 1):
            letter = "U" if max(outs.values()) == 2 else "D"
        elif (both, one) == (0, 3):
            letter = "T" if max(outs.values()) == 2 else "C"
        return f"{both}{one}{3 - both - one}{letter}"

    for n, m, seed in ((9, 30, 1), (25, 40, 2), (4, 0, 3)):
        r = random.Random(seed)
        arcs = {tuple(r.sample(range(n), 2)) for _ in range(m)}
        want = Counter(kind(t, arcs) for t in combinations(range(n), 3))
        got = triads.census(frame(spark, [*arcs, *arcs, *((x, x) for x in range(2))]), frame(spark, [(x,) for x in range(n)], "node long"))
        assert dict(rows(got)) == {k: want[k] for k in triads.KINDS}


def test_girvan_newman_query_equals_brute_force(spark):
    pairs = [(r["a"], r["b"]) for r in queries.partner_edges(spark, DATA, sparse=True).collect()]
    got = queries.graph_girvan_newman(spark, DATA).collect()
    left, nodes = list(pairs), set(neighbours(pairs))
    want, now = {}, parts(left, nodes)
    for level in range(3):
        want.update({(level, n): p for n, p in now.items()})
        count = len(set(now.values()))
        while left and len(set(now.values())) == count:
            _, edge = brute_betweenness(left)
            left.remove(min(left, key=lambda e: (-round(edge[e] / 2, 9), e)))
            now = parts(left, nodes)
    assert {(r["level"], r["node"]): r["part"] for r in got} == want
    for level in range(3):
        own = {n: p for (k, n), p in want.items() if k == level}
        ends = Counter(own[x] for p in pairs for x in p)
        q = sum(own[a] == own[b] for a, b in pairs) / len(pairs) - sum((d / 2 / len(pairs)) ** 2 for d in ends.values())
        (said,) = {(r["parts"], r["modularity"]) for r in got if r["level"] == level}
        assert said == (len(ends), pytest.approx(q, abs=1e-6))


def brute_rcm(pairs):
    near, out = neighbours(pairs), []
    own = parts(pairs, ())
    for c in sorted(set(own.values())):
        end, depth = c, 0
        start = c
        while True:
            dist = search(near, start)[0]
            far = max(dist.values())
            if far <= depth:
                break
            depth = far
            end = start = min((n for n in dist if dist[n] == far), key=lambda n: (len(near[n]), n))
        order, seen = [end], {end}
        for v in order:
            fresh = sorted(near[v] - seen, key=lambda n: (len(near[n]), n))
            order += fresh
            seen |= set(fresh)
        out += order[::-1]
    return {n: i for i, n in enumerate(out)}


def test_rcm_queries_equal_brute_force(spark):
    pairs = [(r["a"], r["b"]) for r in queries.partner_edges(spark, DATA).collect()]
    want = brute_rcm(pairs)
    assert dict(rows(queries.graph_rcm(spark, DATA))) == want
    width = lambda at: 2 * max(abs(at[a] - at[b]) for a, b in pairs) + 1
    assert rows(queries.graph_bandwidth(spark, DATA)) == [("id", width({n: n for n in want})), ("rcm", width(want))]
    other = random_pairs(8, 30, 33)
    assert dict(rows(orders.reverse_cuthill_mckee(frame(spark, other)))) == brute_rcm(other)


def test_summaries(spark):
    """Roles and relations of two kinds; sources that share targets."""
    labels = [(n, "r" if n < 5 else "b" if n < 9 else "y") for n in range(1, 13)]
    typed = [(1, 2, "s"), (1, 3, "w"), (1, 5, "s"), (1, 9, "w"), (2, 4, "w"), (2, 10, "w"), (2, 6, "s"), (3, 7, "w"), (4, 8, "w"), (9, 10, "s"), (10, 11, "s"), (9, 12, "s")]
    e = frame(spark, typed, "a long, b long, type string")
    got = summaries.snap_groups(e, frame(spark, labels, "node long, label string"))
    assert rows(got) == [(1, 1), (2, 1), (3, 3), (4, 3), (5, 5), (6, 5), (7, 7), (8, 7), (9, 9), (10, 9), (11, 11), (12, 11)]
    assert rows(summaries.snap_edges(e, got)) == [(1, 1, "s", 1), (1, 3, "w", 2), (1, 5, "s", 2), (1, 9, "w", 2), (3, 7, "w", 2), (9, 9, "s", 1), (9, 11, "s", 2)]
    arcs = [(s, t) for s in (1, 2, 3, 4) for t in (11, 12, 13)] + [(5, 11), (5, 12), (6, 5), (11, 6), (1, 6)]
    small = summaries.dedensify(frame(spark, arcs), threshold=2)
    assert Counter(r["kind"] for r in small.collect()) == {"kept": 5, "in": 4, "out": 3}
    assert rows(summaries.densify(small)) == sorted((str(a), str(b)) for a, b in arcs)


def test_trees(spark):
    codes = {"e": ".", "i": "..", "s": "...", "a": ".-", "t": "-", "n": "-."}
    tree = trees.prefix_tree(frame(spark, [(c,) for c in [*codes.values(), "", None, "..."]], "word string"))
    paths = trees.root_paths(tree).join(tree, "node")
    assert sorted(r["path"] for r in paths.where("is_word").collect()) == sorted(codes.values()) and {r["path"]: r["words"] for r in paths.collect()}["."] == 4
    circuit = [(0, 1), (0, 2), (1, 3), (1, 4), (2, 4), (2, 5), (5, 6)]
    made = trees.branching(frame(spark, circuit), most=8)
    assert Counter(r["node"] for r in made.collect()) == {0: 1, 1: 1, 2: 1, 3: 1, 4: 2, 5: 1, 6: 1}
    labels = frame(spark, [*enumerate(["and", "or", "or", "x", "y", "not", "z"])], "node long, label string")
    assert rows(trees.formulas(made, labels)) == [("0", "((not(z) or y) and (x or y))")]
    with pytest.raises(ValueError, match="8 copies"):
        trees.branching(frame(spark, circuit), most=7)
    with pytest.raises(ValueError, match="cycle"):
        trees.path_counts(frame(spark, [(0, 1), (1, 2), (2, 1)]))


def test_iterated_maps(spark):
    arcs = dynamics.digraph(frame(spark, [(n,) for n in (5, 6, 7)], "n long"), dynamics.collatz)
    got = {r["n"]: (r["tail"], r["cycle"], r["length"]) for r in dynamics.orbits(arcs).collect()}
    assert got[1] == (0, 1, 3) and got[4] == (0, 1, 3) and got[5] == (3, 1, 3) and got[7] == (14, 1, 3) and len(got) == len({*got})
    loops = dynamics.orbits(frame(spark, [(1, 1), (2, 3), (3, 2), (4, 1), (5, 4), (6, 2)], "n long, image long"))
    assert rows(loops) == [(1, 0, 1, 1), (2, 0, 2, 2), (3, 0, 2, 2), (4, 1, 1, 1), (5, 2, 1, 1), (6, 1, 2, 2)]


def test_independent_set_and_beams(spark):
    pairs = random_pairs(3, 40, 70)
    e, nodes = frame(spark, pairs), frame(spark, [(n,) for n in range(1, 46)], "node long")
    chosen = {r["node"] for r in orders.independent_set(e, nodes).collect()}
    near = neighbours(pairs, range(1, 46))
    assert not any(a in chosen and b in chosen for a, b in pairs) and all(n in chosen or near[n] & chosen for n in near)
    values = frame(spark, [(n, float(n % 7)) for n in near], "node long, value double")
    star = frame(spark, [(1, 2), (1, 3), (1, 4), (2, 5), (3, 5), (4, 6)])
    level = orders.beam_search(star, values, 1, 2, per_level=True)
    assert rows(level) == [(0, 1), (1, 3), (1, 4), (2, 5), (2, 6), (3, 2)]  # 2 was not among the best, and is met again
    assert rows(orders.widening_search(star, values, 1, 6.0)) == [(1, 2, 6, 6.0)]
    assert rows(orders.widening_search(star, values, 5, 6.0)) == [(2, 4, 6, 6.0)]  # one best neighbour leads back
    assert not orders.widening_search(star, values, 1, 7.0).count()


def test_triangles_at_a_hub(spark):
    pairs = [(0, n) for n in range(1, 60)] + [(1, 2), (2, 3)]
    assert sorted(sorted((r["x"], r["y"], r["z"])) for r in graph.triangles(frame(spark, pairs)).collect()) == [[0, 1, 2], [0, 2, 3]]
    assert graph.clustering(frame(spark, pairs)).where(F.col("node") == 2).first()["clustering"] == pytest.approx(2 / 3)
    assert rows(communities.modularity_by_level(frame(spark, [(1, 2), (3, 4)]), frame(spark, [(0, n, 1 + 2 * (n > 2)) for n in range(1, 5)], "level int, node long, part long"))) == [(0, 2, 0.5)]


def test_linkage_blocks(spark):
    cliques = [list(range(8)), list(range(10, 15)), [20, 21], [30]]
    exact = [p for c in cliques for p in combinations(c, 2)]
    rnd = random.Random(8)
    mixed = sorted(set(exact) | {tuple(sorted(rnd.sample(range(40), 2))) for _ in range(150)})
    path = [(i, i + 1) for i in range(60)]
    star = [(0, i) for i in range(1, 40)]
    for pairs, names in ((exact, [n for c in cliques for n in c]), (mixed, range(45)), (path, range(61)), (star, range(40)), ([], [1, 2])):
        edges = spark.createDataFrame(pairs, "a long, b long")
        nodes = spark.createDataFrame([(n,) for n in names], "node long")
        got = {r["node"]: r["part"] for r in communities.linkage_blocks(edges, nodes).collect()}
        assert sorted(got) == sorted(names)
        near, blocks = neighbours(pairs, names), defaultdict(set)
        for n, p in got.items():
            blocks[p].add(n)
        assert all(min(b) == p for p, b in blocks.items())
        assert all(y in near[x] for b in blocks.values() for x, y in combinations(sorted(b), 2))  # complete linkage below 2
        assert not any(all(y in near[x] for x in p for y in q) for p, q in combinations(blocks.values(), 2))  # nothing left to join
        again = {r["node"]: r["part"] for r in communities.linkage_blocks(edges.repartition(5), nodes).collect()}
        assert again == got
        if pairs is exact:
            assert sorted(map(sorted, blocks.values())) == cliques


def realisable(degrees):
    """Havel and Hakimi: the largest degree is served by the next largest ones."""
    d = sorted(degrees, reverse=True)
    while d and d[0] > 0:
        k, d = d[0], d[1:]
        if k > len(d) or d[k - 1] <= 0:
            return False
        d = sorted([x - 1 for x in d[:k]] + d[k:], reverse=True)
    return not d or d[-1] >= 0


def test_graphical_sequences(spark):
    rnd = random.Random(4)
    cases = {k: [rnd.choice([0, 1, 1, 2, 3, rnd.randint(0, n)]) for _ in range(n)] for k, n in enumerate([1, 2, 3, 4, 5, 6, 7, 8, 9] * 40)}
    cases |= {1000: [0], 1001: [-1, 1], 1002: [3, 3, 3, 3], 1003: [3, 3, 3, 1], 1004: [4, 4, 2, 2, 2], 1005: [5, 5, 4, 3, 2, 1], 1006: [1] * 500, 1007: [499] * 500, 1008: [10**6, 1]}
    rows = [(k, d) for k, ds in cases.items() for d in ds] + [(2000, None)]
    got = {r["key"]: r for r in graph.graphical(spark.createDataFrame(rows, "key long, degree int").repartition(4)).collect()}
    assert set(got) == set(cases) and 40 < sum(r["graphical"] for r in got.values()) < 300
    for k, ds in cases.items():
        assert (got[k]["n"], got[k]["total"], got[k]["graphical"]) == (len(ds), sum(ds), realisable(ds)), (k, ds)
    assert not graph.graphical(spark.createDataFrame([], "key long, degree int")).count()


def test_partners_equal_the_projection(spark, monkeypatch):
    """Counted in batches and slices, against all pairs: ties, repeats, nulls, a right node that all share, u in several batches."""
    rng = np.random.default_rng(5)
    rows = [(int(a), int(b)) for a, b in zip(rng.integers(-3, 40, 900), rng.integers(0, 60, 900), strict=True)] + [(k, 99) for k in range(40)]
    pairs = spark.createDataFrame([*rows, rows[0], (None, 3), (3, None), (1000, 77)], "left long, right long")
    held = {}
    for a, b in set(rows):
        held.setdefault(a, set()).add(b)
    want = []
    for u in held:
        near = sorted((-len(held[u] & held[v]), v) for v in held if v != u and held[u] & held[v])
        want += [(u, v, -n, k) for k, (n, v) in enumerate(near[:3], 1)]
    assert sorted(map(tuple, graph.partners(pairs, 3).collect())) == sorted(want)
    monkeypatch.setattr(graph, "SLICE", 2)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        assert sorted(map(tuple, graph.partners(pairs, 3).collect())) == sorted(want)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_partner_edges_are_a_table(spark):
    """Plans that read the edges many times don't make the partners again."""
    edges = queries.partner_edges(spark, DATA)
    assert "lineitem" not in " ".join(edges.inputFiles()) and edges.inputFiles()


def test_spanning_forest_reads_its_edges_once(spark, tmp_path):
    """Later rounds go on from what is left: the edges' own table may go after the first."""
    rows = [(a, b, (a * 7 + b * 5) % 11) for a, b in combinations(range(12), 2)]
    reads = spark.sparkContext.accumulator(0)

    def seen(batches):
        for batch in batches:
            reads.add(batch.num_rows)
            yield batch

    edges = spark.createDataFrame(rows, "a long, b long, weight long").mapInArrow(seen, "a long, b long, weight long")
    part, total = {k: k for k in range(12)}, 0
    for w, a, b in sorted((w, a, b) for a, b, w in rows):
        if part[a] != part[b]:
            total, old = total + w, part[a]
            part = {k: part[b] if v == old else v for k, v in part.items()}
    got = graph.spanning_forest(edges).collect()
    assert (len(got), sum(r["weight"] for r in got)) == (11, total) and reads.value == len(rows)


def held_graph(pairs, share):
    names = np.unique(pairs)
    ways = np.searchsorted(names, np.array(sorted([*pairs, *((b, a) for a, b in pairs)])))
    return searches.Graph(share, names, np.searchsorted(ways[:, 0], np.arange(len(names) + 1)), ways[:, 1])


def wide_pairs():
    """A hub of more ways than columns, a long path, random edges and a component of its own."""
    rng = random.Random(12)
    return sorted({*((1, v) for v in range(2, 90)), *((v, v + 1) for v in range(100, 130)), (50, 100), *(tuple(sorted(rng.sample(range(1, 90), 2))) for _ in range(60)), (500, 501), (501, 502)})


def test_graph_centralities_is_searched_in_tasks(spark, monkeypatch):
    """By levels each step of each search was a shuffle."""
    monkeypatch.setattr(centrality, "levels", lambda *_: pytest.fail("searched by joins"))
    pairs = [(r["a"], r["b"]) for r in queries.partner_edges(spark, DATA).collect()]
    near, node = neighbours(pairs), brute_betweenness(pairs)[0]
    want = []
    for v in sorted(near):
        far = search(near, v)[0].values()
        want.append((v, round(len(near[v]) / (len(near) - 1), 9), round((len(far) - 1) ** 2 / (sum(far) * (len(near) - 1)), 9), max(far), pytest.approx(node[v] / 2, abs=1e-6)))
    assert rows(queries.graph_centralities(spark, DATA)) == want
    pairs = wide_pairs()
    near, node = neighbours(pairs), brute_betweenness(pairs)[0]
    got = {r["node"]: r for r in centrality.centralities(frame(spark, pairs), held=2 * len(pairs)).collect()}
    assert {v: (got[v]["eccentricity"], got[v]["betweenness"]) for v in near} == {v: (max(search(near, v)[0].values()), pytest.approx(node[v] / 2, abs=1e-6)) for v in near}
    assert not centrality.centralities(frame(spark, pairs).where("false"), held=4).count()
    with pytest.raises(pytest.fail.Exception):
        centrality.centralities(frame(spark, pairs), held=2 * len(pairs) - 1)


def test_blocks_of_a_task_add_up(monkeypatch):
    """Several blocks of sources for each task, against brute force."""
    pairs = wide_pairs()
    near, (node, edge) = neighbours(pairs), brute_betweenness(pairs)
    monkeypatch.setattr(searches, "PLACES", 3 * len(near))
    share, flow, reached = Counter(), Counter(), {}
    for k in range(2):
        (b,) = searches._node_sums(held_graph(pairs, k), 2)
        for r in b.to_pylist():
            share[r["node"]] += r["share"]
            if r["total"] is not None:
                assert r["node"] not in reached
                reached[r["node"]] = r["total"], r["reached"], r["eccentricity"]
        (b,) = searches._edge_sums(held_graph(pairs, k), 2)
        for r in b.to_pylist():
            flow[r["a"], r["b"]] += r["share"]
            assert r["part"] == (500 if r["a"] >= 500 else 1)
    assert share == pytest.approx(dict(node)) and flow == pytest.approx(dict(edge))
    far = {v: search(near, v)[0].values() for v in near}
    assert reached == {v: (sum(d), len(d) - 1, max(d)) for v, d in far.items()}


def test_graph_edge_betweenness_is_searched_in_tasks(spark, monkeypatch):
    monkeypatch.setattr(centrality, "levels", lambda *_: pytest.fail("searched by joins"))
    pairs = [(r["a"], r["b"]) for r in queries.partner_edges(spark, DATA).collect()]
    want = lambda pairs: [(a, b, pytest.approx(v / 2, abs=1e-6)) for (a, b), v in sorted(brute_betweenness(pairs)[1].items())]
    assert rows(queries.graph_edge_betweenness(spark, DATA)) == want(pairs)
    pairs = wide_pairs()
    assert rows(centrality.edge_betweenness(frame(spark, pairs), held=2 * len(pairs))) == want(pairs)


def test_graph_eccentricity_is_searched_in_tasks(spark, monkeypatch):
    """64 sources at a time, as bits of a word."""
    monkeypatch.setattr(centrality, "levels", lambda *_: pytest.fail("searched by joins"))

    def want(pairs):
        near = neighbours(pairs)
        far = {v: search(near, v)[0].values() for v in near}
        wide = [max(d) for d in far.values()]
        return [(v, max(d), max(d) == min(wide), max(d) == max(wide)) for v, d in sorted(far.items())], sorted(Counter(k for d in far.values() for k in d).items())

    nodes, pairs = want([(r["a"], r["b"]) for r in queries.partner_edges(spark, DATA).collect()])
    assert rows(queries.graph_eccentricity(spark, DATA)) == nodes
    assert rows(queries.graph_path_histogram(spark, DATA)) == pairs
    e = frame(spark, wide_pairs())
    nodes, pairs = want(wide_pairs())
    assert rows(centrality.eccentricities(e, held=searches.HELD)) == nodes and rows(centrality.path_histogram(e, held=searches.HELD)) == pairs
    (b,) = searches._far(held_graph([(v, v + 1) for v in range(299)], 0), 1)  # several words for a node
    assert b.column(1).to_pylist() == [max(v, 299 - v) for v in range(300)]
    monkeypatch.setattr(searches, "WORDS", 1)  # several blocks for a task
    far, count = Counter(), Counter()
    for k in range(2):
        (b,) = searches._far(held_graph(wide_pairs(), k), 2)
        far |= Counter({r["node"]: r["eccentricity"] for r in b.to_pylist()})
        (b,) = searches._pairs(held_graph(wide_pairs(), k), 2)
        count.update({r["distance"]: r["n"] for r in b.to_pylist()})
    assert sorted(far.items()) == [r[:2] for r in nodes] and sorted(count.items()) == pairs


def test_graph_girvan_newman_is_searched_in_tasks(spark, monkeypatch):
    """A part that isn't hurt isn't searched again; components come with the scores."""
    monkeypatch.setattr(communities, "components", lambda *_: pytest.fail("searched by joins"))
    monkeypatch.setattr(communities, "edge_betweenness", lambda *_: pytest.fail("searched by joins"))
    asked, scored = [], communities._scored
    monkeypatch.setattr(communities, "_scored", lambda edges, inside: asked.append(edges.count()) or scored(edges, inside))
    got = communities.girvan_newman(frame(spark, [(3, 4), (1, 2), (1, 3), (2, 3), (4, 5), (4, 6), (5, 6), (8, 9)]), 2, held=100)
    # the bridge, then the smallest edge of two equal triangles, then one of the ways around it
    level = lambda k: sorted((r["node"], r["part"]) for r in got.collect() if r["level"] == k)
    assert level(0) == [*((v, 1) for v in range(1, 7)), (8, 8), (9, 8)]
    assert level(1) == [(1, 1), (2, 1), (3, 1), (4, 4), (5, 4), (6, 4), (8, 8), (9, 8)]
    assert level(2) == [(1, 1), (2, 2), (3, 2), (4, 4), (5, 4), (6, 4), (8, 8), (9, 8)]
    assert asked == [8, 6, 2, 1]
    assert not communities.girvan_newman(frame(spark, [(1, 2)]).where("false"), 2, held=100).count()
    alone = communities.girvan_newman(frame(spark, [(1, 2)]), 2, held=100)
    assert rows(alone) == [(0, 1, 1), (0, 2, 1), (1, 1, 1), (1, 2, 2)]


def test_graph_branching_unfolds_every_arc(spark):
    """The second partners of all suppliers too, not of every third only."""
    pairs = [(r["a"], r["b"]) for r in queries.partner_edges(spark, DATA).collect()]
    got = queries.graph_branching(spark, DATA).collect()
    ways = Counter(r["node"] for r in got)
    ends = {b for _, b in pairs}
    want = {}
    for n in sorted(neighbours(pairs)):
        want[n] = sum(want[a] for a, b in pairs if b == n) if n in ends else 1
    assert ways == want and len({r["copy"] for r in got}) == len(got)
    used = {(int(r["parent"].split(">")[-1]), r["node"]) for r in got if r["parent"]}
    assert used == set(pairs)


def test_graph_spanning_forest_keeps_forests_of_tasks(spark, monkeypatch):
    """A task's edges that close a circle don't leave it, and the forest is that of the whole projection."""
    rng = np.random.default_rng(9)
    pairs = spark.createDataFrame([(int(a), int(b)) for a, b in zip(rng.integers(0, 60, 1500), rng.integers(0, 90, 1500), strict=True)] + [(70, 200), (71, 200), (None, 200), (72, 201), (71, None)], "left long, right long")
    every = {(r["a"], r["b"]): r["weight"] for r in graph.projection(pairs).collect()}
    light = {(r["a"], r["b"]): r["weight"] for r in graph.light_projection(pairs).collect()}
    assert light.items() <= every.items() and len(light) < len(every) / 2
    want = rows(graph.spanning_forest(graph.projection(pairs)))
    assert rows(graph.spanning_forest(graph.light_projection(pairs))) == want and len(want) == 60
    a, b, weight = (np.array(c) for c in zip(*((*e, w) for e, w in every.items()), strict=True))
    assert sorted(zip(*(c[graph._forest(a, b, weight)].tolist() for c in (a, b, weight)), strict=True)) == want
    monkeypatch.setattr(graph, "GATHERED", 50)
    for kept in (10, 1000):
        monkeypatch.setattr(graph, "KEPT", kept)
        (batch,) = graph._lists(pairs, after=True).coalesce(1).sortWithinPartitions("u").toArrow().combine_chunks().to_batches()
        parts = [*graph._light(iter([batch.slice(0, 100), batch.slice(100, 0), batch.slice(100)]))]
        assert (len(parts) > 1) == (kept == 10)
        some = frame(spark, [tuple(r.values()) for p in parts for r in p.to_pylist()], "a long, b long, weight long")
        assert rows(graph.spanning_forest(some)) == want
    monkeypatch.setattr(graph, "projection", lambda *_: pytest.fail("all pairs are shuffled"))
    assert queries.graph_spanning_forest(spark, DATA).count() == len(neighbours([(r["a"], r["b"]) for r in queries.partner_edges(spark, DATA).collect()])) - 1
