import math

import numpy as np
import pytest

from tessera.operators import grids, navigation as nav
from tessera.operators.grids import Axis


@pytest.fixture(scope="module")
def patch(spark):
    """5 x 5 places, two rows each; h = x + 10 y, flat = 1."""
    rows = [(i * 2 + k, f"2024-01-0{x + 1}", y, float(x + 10 * y) + k, 1.0) for i, (x, y) in enumerate((x, y) for x in range(5) for y in range(5)) for k in (0, 1)]
    df = spark.createDataFrame(rows, "_row_id long, day string, y int, h double, flat double").selectExpr("_row_id", "date(day) as day", "y", "h", "flat")
    return df


def open_surface(df, fields=("h", "flat")):
    grid = grids.build_grid(df, [Axis("day", "temporal", 5), Axis("y", "numeric_ordered", 5)], list(fields))
    grid.edges = grids.edges(grid).persist()
    return grids.Surface(grid)


def test_axes(patch):
    axes, fields = grids.identify_axes(patch)
    assert {a.column: a.kind for a in axes} == {"day": "temporal", "y": "numeric_ordered"}
    assert all(a.size == 5 for a in axes) and fields == ["h", "flat"]


def test_patch(patch):
    found = open_surface(patch).to_dict()
    assert (found["vertices"], found["edges"], found["betti_0"], found["betti_1"]) == (25, 40, 1, 16)
    c = found["face_complex"]
    assert (c["faces"], c["edges"], c["vertices"], c["boundary_edges"], c["boundary_loops"], c["euler_characteristic"], c["genus_estimate"]) == (16, 40, 25, 16, 1, 1, 0.0)
    assert found["surface"] == "bounded_patch" and found["surface_confidence"]["confidence"] == 1.0


def test_measures_against_brute_force(patch):
    s = open_surface(patch)
    g = s.graph
    for i, (day, y) in enumerate(g.coords):
        near = [j for j, (d, z) in enumerate(g.coords) if abs(int(d[-2:]) - int(day[-2:])) + abs(int(z) - int(y)) == 1]
        assert sorted(g.near[i].tolist()) == near
        off = [abs(v[i] - v[near].mean()) / max(abs(v[near].mean()), 1) for v in g.values.values()]
        assert g.curvature[i] == pytest.approx(np.mean(off))
    rows = {(x.c0, x.c1): x for x in grids.measured(s.grid).collect()}
    assert rows["2024-01-01", "0"].morse_0 == "minimum" and rows["2024-01-05", "4"].morse_0 == "maximum" and rows["2024-01-03", "2"].morse_0 == "saddle"
    assert rows["2024-01-03", "2"].forman_ricci == -4 and rows["2024-01-03", "2"].density == 2 and rows["2024-01-03", "2"].morse_1 is None


def test_ring_torus_and_holes(spark):
    rows = [(i, i, math.sin(i), 5.0) for i in range(12)]
    ring = grids.build_grid(spark.createDataFrame(rows, "_row_id long, t int, a double, b double"), [Axis("t", "numeric_ordered", 12)], ["b"])
    ring.axes = grids.wrap_axes(ring) if ring.vertices.count() < 15 else ring.axes
    assert not ring.axes[0].wraps  # a fifth of 12 holds two vertices, too few to tell
    ring.axes = [Axis("t", "numeric_ordered", 12, True, 1)]
    ring.edges = grids.edges(ring)
    assert grids.betti_numbers(grids.Graph(ring)) == (1, 1)
    both = spark.createDataFrame([(x * 5 + y, x, y, 1.0) for x in range(4) for y in range(5)], "_row_id long, x int, y int, v double")
    torus = grids.build_grid(both, [Axis("x", "numeric_ordered", 4, True, 1), Axis("y", "numeric_ordered", 5, True, 1)], ["v"])
    torus.edges = grids.edges(torus)
    found = grids.face_topology(torus)
    assert (found["faces"], found["boundary_edges"], found["face_euler_characteristic"], found["face_genus_estimate_orientable"]) == (20, 0, 0, 1.0)
    assert torus.edges.count() == 80
    hole = spark.createDataFrame([(x * 5 + y, x, y, 1.0) for x in range(5) for y in range(5) if (x, y) != (2, 2)], "_row_id long, x int, y int, v double")
    grid = grids.build_grid(hole, [Axis("x", "numeric_ordered", 5), Axis("y", "numeric_ordered", 5)], ["v"])
    found = grids.face_topology(grid)
    assert (found["faces"], found["boundary_loops"], found["face_euler_characteristic"]) == (12, 2, 0)


def test_wrap_signs(spark):
    df = spark.createDataFrame([(x * 5 + y, x, str(y), float(-7 if x < 2 else 7 if x > 7 else 0)) for x in range(10) for y in range(5)], "_row_id long, x int, y string, v double")
    grid = grids.build_grid(df, [Axis("y", "categorical", 5), Axis("x", "numeric_ordered", 10)], ["v"])
    axes = grids.wrap_axes(grid)
    assert (axes[1].wraps, axes[1].orientation, axes[0].wraps) == (True, -1, False)
    assert grids.product_topology(axes)[0] == "mobius_band"
    grid.edges = grids.edges(grid)
    assert grid.edges.count() == 10 * 5 * 4 + 2 * 9 * 5  # a clique of 5 in each line of y, steps along x


def test_gaps_and_small_tables(spark):
    df = spark.createDataFrame([(0, "a", "1"), (1, None, "2"), (2, "", "x"), (3, "b", None), (4, "a", "3")], "_row_id long, k string, v string")
    grid = grids.build_grid(df, [Axis("k", "categorical", 2)], ["v"])
    grid.edges = grids.edges(grid)
    assert {(x.c0, x.p0, x.f0, x.density) for x in grid.vertices.collect()} == {("a", 0, 2.0, 2), ("", 2, None, 1), ("b", 1, None, 1)}
    assert grid.edges.count() == 6
    assert grids.build_surface(df) is None and grids.build_surface(df.where("false")) is None
    assert grids.identify_axes(df.where("false")) == ([], [])


def test_persistence(spark):
    df = spark.createDataFrame([(i, i, float(v)) for i, v in enumerate([3, 0, 4, 1, 5, 2, 6])], "_row_id long, x int, v double")
    grid = grids.build_grid(df, [Axis("x", "numeric_ordered", 7)], ["v"])
    grid.edges = grids.edges(grid)
    assert [(x["value"], x["persistence"]) for x in grids.persistence(grids.Graph(grid), "v")] == [(1.0, 3.0), (2.0, 3.0)]


def test_navigation(patch):
    s = open_surface(patch)
    start, end = ("2024-01-01", "0"), ("2024-01-05", "4")
    path = nav.geodesic(s, start, end, "h")
    assert path["hops"] == 8 and path["total_cost"] == pytest.approx(44 + 8e-6) and path["waypoints"][0]["morse_type"] == "minimum"
    assert nav.geodesic(s, start, end)["total_cost"] == 8 and nav.geodesic(s, start, start)["hops"] == 0 and "error" in nav.geodesic(s, start, ("x", "y"))
    walk = nav.controlled_walk(s, "y", "h")
    assert [p["mean"] for p in walk["profile"]] == [2.5, 12.5, 22.5, 32.5, 42.5] and walk["sensitivity"] == 40
    disk = nav.orbit(s, ("2024-01-03", "2"), 2, "h")
    assert [p["points"] for p in disk["shell_profiles"]] == [1, 4, 8] and disk["zone_summary"]["points"] == 13
    assert nav.orbit(s, ("2024-01-03", "2"), 2, "h", "ring")["zone_summary"]["points"] == 8
    hill = nav.basin(s, start, "h")
    assert hill["extremum_coord"] == end and hill["basin_summary"]["points"] == 25
    assert nav.trace_extremum(s, end, "h", "valley")["path"][-1]["value"] == 0.5
    assert nav.navigate(s, start, "h")["gradients"]["y: 0 -> 1"]["delta"] == 10
    assert nav.coverage_audit(s) == {"graph": {"vertices": 25, "edges": 40, "components": 1, "isolated_vertices": 0}, "density": {"mean": 2.0, "min": 2, "max": 2}}
    assert [a["wraps"] for a in nav.wrap_audit(s)["axes"]] == [False, False]


def test_spectra(patch):
    s = open_surface(patch)
    path = 2 - 2 * np.cos(np.pi * np.arange(5) / 5)  # the grid is the product of two paths
    expected = np.sort((path[:, None] + path).ravel())
    assert nav.laplacian_spectrum(s, 24)["eigenvalues"] == pytest.approx(expected[:24], abs=1e-5)
    assert nav.laplacian_spectrum(s)["connectivity_label"] == "weakly_connected"
    assert nav.scalar_harmonics(s, "flat")["energy_spectrum"][0]["energy_fraction"] == 1.0
    assert nav.heat_kernel(s, "h")["spectral_gap"] == pytest.approx(expected[1], abs=1e-5)
    far = nav.diffusion_distance(s, [("2024-01-01", "0"), ("2024-01-01", "1"), ("2024-01-05", "4")])["distance_pairs"]
    assert far[-1]["diffusion_distance"] > far[0]["diffusion_distance"] and len(far) == 3
    field = nav.vector_field(s, "h")
    assert field["vertices_analyzed"] == 25 and field["mean_divergence"] == pytest.approx(0, abs=1e-9)
    reeb = nav.reeb_graph(s, "h", 4)
    assert reeb["n_levels"] == 4 and sum(x["size"] for x in reeb["nodes"]) == 24 and reeb["value_range"] == [0.5, 44.5]


def test_whole_build(spark):
    df = spark.createDataFrame([(i, f"g{i % 5}", f"2024-01-{i // 5 % 8 + 1:02d}", float(i % 7), float(i)) for i in range(200)], "_row_id long, g string, day string, a double, b double").selectExpr("_row_id", "g", "date(day) as day", "a", "b")
    found = grids.build_surface(df)
    out = found.to_dict()
    assert {a["column"] for a in out["axes"]} >= {"g", "day"} and out["vertices"] == found.graph.n and out["betti_0"] >= 1
    assert "error" not in nav.vector_field(found, out["fields"][0])
