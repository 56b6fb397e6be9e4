import pytest

from tests import graphs
from tieloom.operators import graph, neighbourhood, second_order, triads
from tieloom.plans.ego_analysis import focal_stats
from tieloom.staging import staged
from tieloom.sources.tables import rows_to_table


def by_id(df):
    return {r.id: r for r in df.collect()}


def test_mix_homophily_and_means(spark):
    edges = graphs.edge_table(spark, [(1, 2), (1, 3), (1, 4), (1, 5), (1, 6), (7, 8)])
    vertices = graphs.vertex_table(
        spark, [1, 2, 3, 4, 5, 7],  # 6 and 8 are not in the vertex table
        focal={1, 5, 7},
        category={2: "male", 3: None, 4: "unknown", 5: "female", 7: None},
        first_pub_year={2: None, 3: 1987},
        pub_count={2: 10, 3: 3, 4: 4, 5: 6},
    )
    egos = graph.focals(vertices)
    mix = by_id(neighbourhood.attribute_mix(edges, egos, vertices))
    assert (mix[1].n_male, mix[1].n_female, mix[1].n_unknown, mix[1].n_missing) == (1, 1, 1, 1)
    assert mix[1].pct_male_first_order == 25.0
    assert 7 not in mix
    homophily = by_id(neighbourhood.homophily(edges, egos, vertices))
    assert homophily[1].pct_homophilic_collabs == 0.25
    assert homophily[5].pct_homophilic_collabs == 1.0
    means = by_id(neighbourhood.neighbour_means(edges, egos, vertices, 1997))
    assert means[1].mean_collab_tenure == 8.0
    assert 7 not in means
    assert means[1].mean_collab_pub_count == 5.75
    degrees = by_id(graph.degree(edges, egos))
    assert degrees[1].degree == 5 and degrees[7].degree == 1


def test_mix_of_any_values(spark):
    """Values are those that occur: text, numbers and arrays, with nulls, repeats and unknown neighbours."""
    edges = graphs.edge_table(spark, [(1, 2), (1, 3), (1, 4), (1, 5), (1, 6), (7, 8)])
    vertices = graphs.vertex_table(
        spark, [1, 2, 3, 4, 5, 7],  # 6 and 8 are not in the vertex table
        focal={1, 5, 7},
        category={1: "x", 2: "x", 3: None, 4: "y", 5: None},
        first_pub_year={2: None, 3: 1987},
        countries={1: ["A", None, "B"], 2: ["B", "B"], 3: ["A", "C"], 4: [], 5: None},
    )
    egos = graph.focals(vertices)
    columns = ["category", "first_pub_year", "countries"]
    rows = neighbourhood.value_mix(edges, egos, vertices, columns).collect()
    got = {(r.attribute, r.value): (r.n, r.share) for r in rows if r.id == 1}
    assert got == {
        ("category", "x"): (1, 0.25), ("category", "y"): (1, 0.25), ("category", None): (2, 0.5),
        ("first_pub_year", "1990"): (2, 0.5), ("first_pub_year", "1987"): (1, 0.25), ("first_pub_year", None): (1, 0.25),
        ("countries", "A"): (1, 0.25), ("countries", "B"): (1, 0.25), ("countries", "C"): (1, 0.25), ("countries", None): (2, 0.5),
    }
    assert {r.id for r in rows} == {1, 5}
    same = {(r.id, r.attribute): (r.n_neighbours, r.n_same, r.share) for r in neighbourhood.own_share(edges, egos, vertices, columns).collect()}
    assert same[1, "category"] == (4, 1, 0.25) and same[1, "countries"] == (4, 2, 0.5)
    assert same[5, "category"] == (1, None, None) and same[5, "countries"] == (1, None, None)
    assert 7 not in {ego for ego, _ in same}
    none = neighbourhood.value_mix(edges.limit(0), egos, vertices, columns)
    assert none.count() == 0


def test_reach_modes(spark):
    edges = graphs.edge_table(spark, [(1, 2), (1, 3), (1, 4), (1, 5), (1, 6)])
    vertices = graphs.vertex_table(
        spark, [1, 2, 3, 4, 5, 6],
        countries={1: ["A", "B"], 2: ["B", "A"], 3: ["C"], 4: [], 5: None, 6: [None]},
    )
    overlap = by_id(neighbourhood.reach(edges, vertices, ["countries"], "overlap"))
    exact = by_id(neighbourhood.reach(edges, vertices, ["countries"], "exact"))
    assert overlap[1].reach == pytest.approx(2 / 3)
    assert exact[1].reach == 1.0
    assert 4 not in overlap and 5 not in overlap
    assert overlap[3].reach == 1.0


@pytest.mark.parametrize("ties_per_block", [1_000_000, 200, 20])
def test_second_order_degree(spark, ties_per_block):
    """Two hubs, egos with either, both or none of them; hubs cut into pieces give the same means."""
    edges, ids = graphs.hub_network()
    egos = graph.focals(graphs.vertex_table(spark, ids, set(range(0, len(ids), 3))))
    annotated = staged(graph.annotated_edges(graphs.edge_table(spark, edges), egos), "annotated")
    got = by_id(second_order.second_order_degree(annotated, ties_per_block))
    for ego in range(0, len(ids), 3):
        want = graphs.second_order_mean(edges, ego)
        assert got[ego].second_order_collab_mean_degree == pytest.approx(want) if want else ego not in got


def test_second_order_moves_blocks_not_paths(spark):
    edges, ids = graphs.hub_network()
    annotated = staged(graph.annotated_edges(graphs.edge_table(spark, edges), graphs.vertex_table(spark, ids)), "annotated")
    plan = second_order.second_order_degree(annotated)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("FlatMapGroupsInArrow") == 1 and "Join Inner" in plan
    assert all("broadcast" in line for line in plan.splitlines() if "Join Inner" in line)  # the numbers of blocks


def test_second_order_of_single_edge_is_absent(spark):
    egos = graphs.vertex_table(spark, [1, 2])
    annotated = graph.annotated_edges(graphs.edge_table(spark, [(1, 2)]), egos)
    assert second_order.second_order_degree(annotated).count() == 0


def test_path_counts(spark):
    edges, ids = graphs.hub_network()
    nb = graphs.neighbours(edges)
    vertices = graphs.vertex_table(spark, ids)
    table = graphs.edge_table(spark, edges)
    paths = by_id(graph.second_order_paths(table, vertices))
    two = by_id(graph.two_paths(table, vertices))
    pairs = by_id(graph.neighbour_pairs(table, vertices))
    total = {v: sum(t.values()) for v, t in nb.items()}
    for i in (0, 1, 5, 40):
        steps = [(q, j) for q in nb[i] for j in nb[q] if j != i]
        assert paths[i].paths == two[i].paths == len(steps)
        strength = sum(nb[i][q] / total[i] * nb[q][j] / total[q] for q, j in steps)
        assert two[i].indirect_strength == pytest.approx(strength)
        assert pairs[i].pairs == len(nb[i]) * (len(nb[i]) - 1) // 2


def test_ego_subgraph_keeps_the_constraint(spark):
    edges, ids = graphs.hub_network()
    table = graphs.edge_table(spark, edges)
    egos = graphs.vertex_table(spark, [9, 50, 170])
    sub = graph.ego_subgraph(table, egos)
    nb = graphs.neighbours(edges)
    members = {9, 50, 170} | {v for e in (9, 50, 170) for v in nb[e]}
    want = {(a, b, w) for a, b, w in edges if a in members or b in members}
    got = [tuple(r) for r in sub.collect()]
    assert len(got) == len(set(got)) == 2 * len(want)
    assert {g for g in got if g[0] < g[1]} == want
    small = triads.constraint(staged(graph.annotated_edges(graph.ego_edges(table, egos), egos), "annotated"))
    whole = triads.constraint(staged(graph.annotated_edges(table, egos), "annotated"))
    assert sorted(small.collect()) == sorted(whole.collect())


def test_focal_stats_has_one_row_per_focal_with_edges(spark):
    edges = graphs.edge_table(spark, [(1, 2), (2, 3)])
    vertices = graphs.vertex_table(spark, [1, 2, 3, 4])
    yearly = rows_to_table(spark, [(1, 2, None)], "id long, `2009` long, `2010` long")
    rows = by_id(focal_stats(edges, vertices, yearly, 2013))
    assert set(rows) == {1, 2, 3}
    assert rows[1]["2009"] == 2 and rows[2]["2009"] is None
    assert rows[2].second_order_collab_mean_degree is not None or rows[2].degree == 2


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plans_have_no_cross_join(spark, small_dir):
    from tieloom.plans.catalogue import QUERIES

    for name in ("focal_stats", "brokerage", "constraint", "second_order_degree", "ego_subgraph", "two_paths"):
        plan = plan_of(QUERIES[name](spark, small_dir))
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name


def test_scans_are_pruned(spark, small_dir):
    from tieloom.plans.catalogue import QUERIES

    plan = plan_of(QUERIES["attribute_mix"](spark, small_dir))
    assert "countries" not in plan and "first_pub_year" not in plan
