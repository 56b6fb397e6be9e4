import numpy as np
import pyarrow as pa
import pytest

from tests import graphs
from tieloom.operators import graph, lists, second_order, triads, triangles
from tieloom.staging import staged


def annotated_hubs(spark, step):
    edges, ids = graphs.hub_network()
    focal = set(range(0, len(ids), step))
    egos = graph.focals(graphs.vertex_table(spark, ids, focal))
    return edges, focal, staged(graph.annotated_edges(graphs.edge_table(spark, edges), egos), "annotated")


def ways(df):
    rows = df.groupBy("ego", "alter").agg({"share": "sum", "triads": "sum"}).collect()
    return {(r.ego, r.alter): (round(r["sum(share)"], 12), r["sum(triads)"]) for r in rows}


@pytest.mark.parametrize("paths_per_cell", [4_000_000, 300, 40])
def test_lists_and_grid_find_the_same_triads(spark, paths_per_cell):
    """Lists spread over groups and blocks cut into cells give what the grid gives."""
    edges, focal, annotated = annotated_hubs(spark, 3)
    count, _, paths, _ = lists.totals(annotated)
    options = {"paths_per_cell": paths_per_cell}
    assert ways(triangles.listed_shares(annotated, paths, **options)) == ways(triangles._grid_shares(annotated, count, 200))
    pairs = {r.id: r.closed_pairs for r in triangles.listed_pairs(annotated, paths, **options).collect()}
    assert pairs == {r.id: r.closed_pairs for r in triangles._grid_pairs(annotated, count, 200).collect()}
    nb = graphs.neighbours(edges)
    assert all(len(nb[i]) * (len(nb[i]) - 1) // 2 - pairs.get(i, 0) == graphs.open_pairs(edges, i) for i in focal)


@pytest.mark.parametrize("paths_per_cell", [4_000_000, 300, 40])
def test_lists_and_product_reach_the_same(spark, paths_per_cell):
    edges, focal, annotated = annotated_hubs(spark, 3)
    count, ties, paths, _ = lists.totals(annotated)
    for found in (second_order._listed(annotated, paths, paths_per_cell=paths_per_cell), second_order._product(annotated, 2 * count, ties, 4, 200)):
        rows = {r.id: r["sum(total)"] / r["sum(n)"] for r in found.groupBy("id").sum("total", "n").collect()}
        assert rows == pytest.approx({i: graphs.second_order_mean(edges, i) for i in focal})


def ring(n, reach=3):
    return [(min(v, w), max(v, w)) for v in range(n) for w in ((v + k) % n for k in range(1, reach + 1))]


def sent_entries(spark, monkeypatch, edges, n):
    """Entries of lists that leave the groups, for triads and for second-order degrees."""
    egos = graph.focals(graphs.vertex_table(spark, range(n), set(range(0, n, 10))))
    annotated = staged(graph.annotated_edges(graphs.edge_table(spark, edges), egos), "annotated")
    seen = []
    whole = type(annotated).repartition

    def watched(df, *args):
        if "entries" in df.columns:
            df = staged(df, "seen")
            seen.append(df.groupBy().sum("entries").first()[0])
        return whole(df, *args)

    monkeypatch.setattr(type(annotated), "repartition", watched)
    triads.brokerage(annotated, egos, 100).count()
    second_order.second_order_degree(annotated, 100).count()
    monkeypatch.undo()
    return seen


def test_what_is_sent_grows_with_the_network(spark, monkeypatch):
    """Three times the vertices of equal degree send three times the entries, copies on a grid grow faster."""
    small, large = (sent_entries(spark, monkeypatch, ring(n), n) for n in (200, 600))
    assert len(small) == len(large) == 2
    for few, many in zip(small, large, strict=True):
        assert 0 < many <= 3.3 * few


def test_an_edge_without_triads(spark):
    egos = graphs.vertex_table(spark, [1, 2])
    annotated = staged(graph.annotated_edges(graphs.edge_table(spark, [(1, 2)]), egos), "annotated")
    assert triangles.listed_pairs(annotated, 2).count() == 0
    assert second_order._listed(annotated, 2).count() == 0


def test_lists_are_packed_by_steps_and_bytes():
    """Sorted ids as they are shuffled x."""
    rng = np.random.default_rng(3)
    for values in (rng.integers(-5, 9, 50), rng.integers(0, 1 << 40, 50), np.zeros(0, np.int64), rng.random(7)):
        real = values.dtype.kind == "f"
        assert np.array_equal(lists._unpacked(lists._packed(values), len(values), real), values)
    owner, member = np.repeat(np.arange(400), 50), rng.integers(0, 1_000_000, 20_000)
    ties = pa.table({"owner": owner, "member": member, "value": rng.integers(40, 80, 20_000)})
    needs = pa.table({"block": np.zeros(400, np.int64), "pieces": np.ones(400, np.int32), "owner": np.arange(400)})
    row = lists._send(ties, needs).to_pylist()[0]
    got = lists.Lists(row, False)
    order = np.lexsort((member, owner))
    assert np.array_equal(got.member, member[order]) and np.array_equal(got.value, ties["value"].to_numpy()[order]) and np.array_equal(got.owner, np.arange(400))
    assert len(pa.compress(row["member"], "lz4", asbytes=True)) < 0.75 * 4 * len(member)
