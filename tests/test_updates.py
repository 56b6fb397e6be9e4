import random

from tests import graphs
from tieloom.operators import graph, triads, updates
from tieloom.plans import catalogue, part_network
from tieloom.sources.bucketed import overwrite_part
from tieloom.staging import fresh_path, staged


def table(spark, edges):
    return staged(graph.canonical_edges(graphs.edge_table(spark, edges)), "edges")


def rows(df):
    return sorted(map(tuple, df.collect()))


def whole(spark, edges, egos, measure):
    return measure(staged(graph.annotated_edges(table(spark, edges), egos), "annotated"))


def test_updates_equal_whole_runs(spark, seed=1):
    """Hubs, new vertices, pairs that were tied before, egos and others."""
    edges, ids = graphs.hub_network(60, 40, seed)
    rng = random.Random(seed)
    rng.shuffle(edges)
    ids = [*ids, 200, 201, 300]
    before, added = edges[:-25], [*edges[-25:], *[(a, b, 2) for a, b, _ in edges[:3]], (0, 200, 1), (200, 201, 3), (1, 0, 1)]
    egos = graph.focals(graphs.vertex_table(spark, ids, set(ids[::2]) | {0, 200, 300}))
    had, new = table(spark, before), table(spark, added)
    path = fresh_path(spark, "log")
    for step, (old, more) in enumerate([(had.limit(0), had), (had, new), (had, new)]):
        overwrite_part(updates.brokerage_deltas(old, more, egos).selectExpr("*", f"{min(step, 1)} AS step"), path, "step")
    log = spark.read.parquet(path)
    assert rows(updates.brokerage_from(log, egos)) == rows(whole(spark, before + added, egos, lambda a: triads.brokerage(a, egos)))
    earlier = dict(rows(whole(spark, before, egos, triads.constraint)))
    now = dict(rows(updates.constraint_changes(had, new, egos)))
    after = dict(rows(whole(spark, before + added, egos, triads.constraint)))
    assert earlier | now == after
    assert {i for i, v in after.items() if earlier.get(i) != v} <= set(now)
    # what was added goes again
    gone = updates.brokerage_deltas(had, new, egos).selectExpr("id", "-ties AS ties", "-closed AS closed")
    back = updates.brokerage_from(log.select("id", "ties", "closed").unionByName(gone), egos)
    assert rows(back) == rows(whole(spark, before, egos, lambda a: triads.brokerage(a, egos)))


def test_only_touched_egos_have_rows(spark):
    triangles = [(10 * k + a, 10 * k + b, 1) for k in range(5) for a, b in ((0, 1), (1, 2), (0, 2), (2, 3))]
    egos = graph.focals(graphs.vertex_table(spark, [10 * k + v for k in range(5) for v in range(4)]))
    had = table(spark, triangles)
    new = table(spark, [(20, 23, 1)])
    assert rows(updates.brokerage_deltas(had, new, egos)) == [(20, 1, 1), (22, 0, 1), (23, 1, 1)]
    assert {r.id for r in updates.constraint_changes(had, new, egos).collect()} == {20, 21, 22, 23}
    # a tie that grows moves no triad
    heavier = table(spark, [(20, 21, 5)])
    assert rows(updates.brokerage_deltas(had, heavier, egos)) == []
    assert {r.id for r in updates.constraint_changes(had, heavier, egos).collect()} == {20, 21, 22}


def test_nothing_added(spark):
    egos = graph.focals(graphs.vertex_table(spark, [1, 2, 3]))
    had = table(spark, [(1, 2), (2, 3)])
    assert rows(updates.brokerage_deltas(had, had.limit(0), egos)) == []
    assert rows(updates.constraint_changes(had, had.limit(0), egos)) == []
    assert rows(updates.brokerage_deltas(had.limit(0), had.limit(0), egos)) == []


def test_only_the_tables_that_are_read_are_written(spark, small_dir):
    """An update of brokerage needs the vertices of the network, not its edges, yearly counts and rates."""
    part_network._written.clear()
    catalogue.brokerage_update(spark, small_dir)
    assert set(vars(part_network.load(spark, small_dir))) & {"edges", "vertices", "yearly", "rate"} == {"vertices"}
