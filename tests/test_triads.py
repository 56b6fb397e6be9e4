import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tests import graphs
from tieloom.operators import graph, triads, triangles
from tieloom.staging import staged


def measures(spark, edges, ids, focal=None, **options):
    table = graphs.edge_table(spark, edges)
    egos = graph.focals(graphs.vertex_table(spark, ids, focal))
    annotated = staged(graph.annotated_edges(table, egos), "annotated")
    combined = {r.id: r for r in triads.triad_measures(annotated, egos, **options).collect()}
    alone = {r.id: r for r in triads.brokerage(annotated, egos, **options).collect()}
    cons = {r.id: r.overall_constraint for r in triads.constraint(annotated, **options).collect()}
    assert set(alone) == set(combined)
    for i, row in combined.items():
        assert row.open_triads_count == alone[i].open_triads_count
        assert row.open_triads_per_neighbor == alone[i].open_triads_per_neighbor
        assert row.overall_constraint == cons.get(i)
    return combined


def shown(row):
    return (row.open_triads_count, row.open_triads_per_neighbor, row.overall_constraint)


def test_small_graphs(spark):
    """A star, a triangle, a path, a weighted star and an isolated ego, side by side."""
    star = [(0, v) for v in range(1, 6)]
    triangle = [(11, 12), (12, 13), (11, 13)]
    path = [(21, 22), (22, 23)]
    weighted = [(30, 31, 3), (30, 32, 1)]
    ids = [*range(6), 11, 12, 13, 21, 22, 23, 30, 31, 32, 99]
    m = measures(spark, star + triangle + path + weighted, ids)
    assert shown(m[0]) == (10, 1.0, 0.2)
    assert shown(m[3]) == (0, 0.0, 1.0)
    assert [shown(m[i]) for i in (11, 12, 13)] == [(0, 0.0, 1.125)] * 3
    assert shown(m[22]) == (1, 1.0, 0.5)
    assert shown(m[21]) == (0, 0.0, 1.0)
    assert shown(m[30]) == (1, 1.0, 0.625)
    assert shown(m[99]) == (0, 0.0, None)


def test_canonical_edges(spark):
    raw = graphs.edge_table(spark, [(1, 2, 2), (2, 1, 3), (4, 4, 9), (3, 2, 1)])
    rows = {(r.src, r.dst): r.weight for r in graph.canonical_edges(raw).collect()}
    assert rows == {(1, 2): 5, (2, 3): 1}


@pytest.mark.parametrize("edges_per_cell", [1_000_000, 20])
def test_hubs_against_plain_python(spark, edges_per_cell):
    """Hubs with colours of their own give the numbers of the definition, in large cells and small ones."""
    edges, ids = graphs.hub_network()
    focal = {0, 1} | set(range(0, len(ids), 7))
    m = measures(spark, edges, ids, focal, edges_per_cell=edges_per_cell)
    for ego in focal:
        assert m[ego].open_triads_count == graphs.open_pairs(edges, ego)
        assert m[ego].overall_constraint == pytest.approx(graphs.constraint(edges, ego), abs=5.1e-5)


def test_partitioning_and_direction_do_not_matter(spark):
    edges, ids = graphs.hub_network()
    want = {i: shown(r) for i, r in measures(spark, edges, ids).items()}
    turned = graph.canonical_edges(graphs.edge_table(spark, [(b, a, w) for a, b, w in edges]).repartition(13))
    egos = graphs.vertex_table(spark, ids)
    annotated = staged(graph.annotated_edges(turned, egos), "annotated")
    got = triads.triad_measures(annotated, egos)
    assert {r.id: shown(r) for r in got.collect()} == want


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.sets(st.tuples(st.integers(0, 9), st.integers(0, 9)).filter(lambda e: e[0] < e[1]), min_size=1))
def test_open_and_closed_pairs_add_up(spark, pairs):
    edges = [(a, b, 1) for a, b in pairs]
    nb = graphs.neighbours(edges)
    egos = graphs.vertex_table(spark, range(10))
    annotated = staged(graph.annotated_edges(graphs.edge_table(spark, edges), egos), "annotated")
    got = {r.id: r.open_triads_count for r in triads.brokerage(annotated, egos).collect()}
    closed = {r.id: r.closed_pairs for r in triads.closed_pairs(annotated).collect()}
    for ego in range(10):
        n = len(nb[ego])
        assert got[ego] == graphs.open_pairs(edges, ego) == n * (n - 1) // 2 - closed.get(ego, 0)


@pytest.mark.parametrize("k", [2, 3, 7])
def test_only_copies_of_edges_are_shuffled(spark, k):
    """No more rows than 3 k per edge for k colours, hubs' own included, and every triangle in one cell."""
    edges, ids = graphs.hub_network()
    annotated = staged(graph.annotated_edges(graphs.edge_table(spark, edges), graphs.vertex_table(spark, ids)), "annotated")
    turned, colours = triangles._coloured(triangles.oriented(annotated), k, len(edges))
    assert k <= colours <= 2 * k
    cells = triangles.in_cells(turned, k, colours).collect()
    assert len(cells) <= 3 * colours * len(edges)
    sides = {}
    for r in cells:
        own = sides.setdefault(r.cell, {"ab": set(), "bc": set(), "ac": set()})
        for name, pair in (("ab", (r.i, r.j)), ("bc", (r.j, r.l)), ("ac", (r.i, r.l))):
            if (r.x, r.y) == pair:
                own[name].add((r.low, r.high))
    found = [(a, b, c) for own in sides.values() for a, b in own["ab"] for x, c in own["bc"] if x == b and (a, c) in own["ac"]]
    nb = graphs.neighbours(edges)
    want = {tuple(sorted((a, b, c))) for a, b, *_ in edges for c in set(nb[a]) & set(nb[b])}
    assert len(found) == len(want) and {tuple(sorted(t)) for t in found} == want


def test_no_exchange_carries_paths(spark):
    edges, ids = graphs.hub_network()
    annotated = staged(graph.annotated_edges(graphs.edge_table(spark, edges), graphs.vertex_table(spark, ids)), "annotated")
    plan = triads.constraint(annotated)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("FlatMapGroupsInArrow") == 2  # blocks, then cells
