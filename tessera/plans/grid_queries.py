"""Registered queries of the grid operators, with the same results in DuckDB SQL where it can express them.

The grid spans market segments (unordered) and order years; its fields are the mean order price and account balance.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numeric import r, rounded
from ..operators import grids
from ..operators import navigation as nav
from ..operators.grids import Axis, Grid, Surface

PRICE, BALANCE = FIELDS = ["o_totalprice", "c_acctbal"]


def sales(spark: SparkSession, d: str) -> DataFrame:
    orders, customer = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("orders", "customer"))
    joined = orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
    return joined.select(F.col("o_orderkey").alias("_row_id"), "c_mktsegment", F.year("o_orderdate").alias("year"), *FIELDS)


def grid(spark: SparkSession, d: str) -> Grid:
    df = sales(spark, d)
    segments, years = df.agg(F.count_distinct("c_mktsegment"), F.count_distinct("year")).first()
    out = grids.build_grid(df, [Axis("c_mktsegment", "categorical", segments), Axis("year", "numeric_ordered", years)], FIELDS)
    out.edges = grids.edges(out).persist()
    return out


def surface(spark: SparkSession, d: str) -> Surface:
    return Surface(grid(spark, d))


def corner(s: Surface, last: bool = False) -> tuple:
    """The first vertex by its texts, or the last."""
    return (max if last else min)(s.graph.coords)


def table(spark: SparkSession, rows: list[dict], kinds: str) -> DataFrame:
    names = [k.split(" ")[0] for k in kinds.split(", ")]
    return spark.createDataFrame([tuple(x[n] for n in names) for x in rows], kinds)


def at(row: dict, key: str = "coord") -> dict:
    return row | {"segment": row[key][0], "year": row[key][1]}


def grid_axes(spark, d):
    axes, fields = grids.identify_axes(sales(spark, d))
    return table(spark, [a.to_dict() for a in axes] + [{"column": f, "axis_type": "field", "size": 0} for f in fields], "column string, axis_type string, size long")


def grid_vertices(spark, d):
    return grid(spark, d).vertices.select(F.col("c0").alias("segment"), F.col("c1").alias("year"), "density", rounded(F.col("f0"), 2).alias("price"), rounded(F.col("f1"), 2).alias("balance"))


def grid_edges(spark, d):
    g = grid(spark, d)
    side = lambda to: g.vertices.select(F.col("id").alias(to), F.col("c0").alias(f"{to}_segment"), F.col("c1").alias(f"{to}_year"))
    return g.edges.join(side("src"), "src").join(side("dst"), "dst").select("src_segment", "src_year", "dst_segment", "dst_year")


def grid_measures(spark, d):
    return grids.measured(grid(spark, d)).select(F.col("c0").alias("segment"), F.col("c1").alias("year"), "degree", rounded(F.col("curvature"), 6).alias("curvature"), rounded(F.col("forman_ricci"), 4).alias("forman_ricci"), F.col("morse_0").alias("morse"))


def grid_wraps(spark, d):
    return table(spark, [a.to_dict() for a in grids.wrap_axes(grid(spark, d))], "column string, wraps boolean, wrap_orientation int")


def grid_interactions(spark, d):
    return table(spark, grids.interactions(grid(spark, d)), "gradient_correlation double, direction string, samples long")


def grid_faces(spark, d):
    return table(spark, [grids.face_topology(grid(spark, d))], "faces long, possible_faces long, face_vertex_count long, face_edge_count long, boundary_edges long, nonmanifold_edges long, face_euler_characteristic long")


def grid_surface(spark, d):
    found = surface(spark, d)
    return table(spark, [found.to_dict()], "surface string, vertices long, edges long, betti_0 long, betti_1 long, genus int, orientable boolean")


def grid_persistence(spark, d):
    return table(spark, [at(x) for x in surface(spark, d).persistence.get(PRICE, [])], "segment string, year string, value double, persistence double")


def grid_walk(spark, d):
    return table(spark, [x | {"mean": r(x["mean"], 2), "min": r(x["min"], 2), "max": r(x["max"], 2)} for x in nav.controlled_walk(surface(spark, d), "year", PRICE)["profile"]], "axis_value string, mean double, min double, max double, points long")


def grid_coverage(spark, d):
    found = nav.coverage_audit(surface(spark, d))
    return table(spark, [found["graph"] | found["density"] | {"mean": r(found["density"]["mean"], 4)}], "vertices long, edges long, isolated_vertices long, mean double, min long, max long")


def grid_geodesic(spark, d):
    s = surface(spark, d)
    return table(spark, [at(x) for x in nav.geodesic(s, corner(s), corner(s, True), PRICE)["waypoints"]], "step int, segment string, year string, density long")


def grid_orbit(spark, d):
    s = surface(spark, d)
    return table(spark, nav.orbit(s, corner(s), 3, PRICE)["shell_profiles"], "distance int, points long, mean_value double")


def grid_basin(spark, d):
    s = surface(spark, d)
    found = nav.basin(s, corner(s), PRICE)
    return table(spark, [at(found, "extremum_coord") | found["basin_summary"]], "segment string, year string, points long, max_value double")


def grid_trace(spark, d):
    s = surface(spark, d)
    return table(spark, [at(x) for x in nav.trace_extremum(s, corner(s), PRICE)["path"]], "segment string, year string, value double")


def grid_navigate(spark, d):
    s = surface(spark, d)
    return table(spark, [{"direction": k, "delta": r(x["delta"], 2)} for k, x in nav.navigate(s, corner(s), PRICE)["gradients"].items()], "direction string, delta double")


def grid_spectrum(spark, d):
    return table(spark, [{"mode": i, "eigenvalue": x} for i, x in enumerate(nav.laplacian_spectrum(surface(spark, d))["eigenvalues"])], "mode int, eigenvalue double")


def grid_heat(spark, d):
    return table(spark, [at(x) for x in nav.heat_kernel(surface(spark, d), PRICE)["bottlenecks"]], "segment string, year string, bottleneck_score double")


def grid_harmonics(spark, d):
    return table(spark, nav.scalar_harmonics(surface(spark, d), PRICE)["energy_spectrum"], "mode int, eigenvalue double, cumulative double")


def grid_diffusion(spark, d):
    pairs = nav.diffusion_distance(surface(spark, d))["distance_pairs"]
    return table(spark, [{"source": ", ".join(x["from"]), "target": ", ".join(x["to"])} | x for x in pairs], "source string, target string, diffusion_distance double")


def grid_reeb(spark, d):
    return table(spark, nav.reeb_graph(surface(spark, d), PRICE)["nodes"], "id int, type string, level double, size int")


def grid_vector_field(spark, d):
    found = nav.vector_field(surface(spark, d), PRICE)
    return table(spark, [found | {"mean_divergence": r(found["mean_divergence"], 2), "std_divergence": r(found["std_divergence"], 2)} | found["flow_summary"]], "vertices_analyzed long, mean_divergence double, std_divergence double, n_sources long, n_sinks long")


ALL = (grid_axes, grid_vertices, grid_edges, grid_measures, grid_wraps, grid_interactions, grid_faces, grid_surface, grid_persistence, grid_walk, grid_coverage, grid_geodesic, grid_orbit, grid_basin, grid_trace, grid_navigate, grid_spectrum, grid_heat, grid_harmonics, grid_diffusion, grid_reeb, grid_vector_field)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in ALL}


def oracle_sql() -> dict[str, str]:
    up = lambda x, k: f"floor(({x}) * {10**k} + 0.5) / {10**k}"
    s = "s as (select o_orderkey, c_mktsegment as c0, year(o_orderdate) as y, o_totalprice, c_acctbal from orders join customer on o_custkey = c_custkey)"
    v = f"{s}, v as (select c0, y::varchar as c1, dense_rank() over (order by y) as p, count(*) as density, avg(o_totalprice) as f0, avg(c_acctbal) as f1 from s group by c0, y)"
    e = f"{v}, e as (select a.c0, a.c1, a.p, a.f0, a.f1, b.c0 as d0, b.c1 as d1, b.f0 as g0, b.f1 as g1 from v a join v b on (a.p = b.p and a.c0 <> b.c0) or (a.c0 = b.c0 and abs(a.p - b.p) = 1)), k as (select c0, c1, count(*) as degree from e group by all)"
    off = lambda i: f"abs(any_value(e.f{i}) - avg(g{i})) / greatest(abs(avg(g{i})), 1)"
    # a segment's place is that of its first order
    f = f"{v}, o as (select c0, row_number() over (order by min(o_orderkey)) as i from s group by c0), w as (select i, p from v join o using (c0)), f as (select a.i, a.p from w a join w b on b.i = a.i + 1 and b.p = a.p join w c on c.i = a.i and c.p = a.p + 1 join w d on d.i = a.i + 1 and d.p = a.p + 1), h as (select i, p, 'u' as way from f union all select i, p + 1, 'u' from f union all select i, p, 'r' from f union all select i + 1, p, 'r' from f), n as (select i, p, way, count(*) as c from h group by all), x as (select i, p from f union select i + 1, p from f union select i, p + 1 from f union select i + 1, p + 1 from f)"
    lows = "b as (select *, p <= greatest(1, m // 5) as low, p > m - greatest(1, m // 5) as high from v, (select max(p) as m from v))"
    alike = lambda i: f"1 - least(abs(abs(avg(f{i}) filter (low)) - abs(avg(f{i}) filter (high))) / (abs(avg(f{i}) filter (low)) + abs(avg(f{i}) filter (high))), 1)"
    flip = lambda i: f"((avg(f{i}) filter (low) > 0) <> (avg(f{i}) filter (high) > 0))::int"
    product = lambda fn: f"avg({fn}((g0 - f0) * (g1 - f1)))"
    return {
        "grid_vertices": f"with {v} select c0 as segment, c1 as year, density, {up('f0', 2)} as price, {up('f1', 2)} as balance from v",
        "grid_edges": f"with {e} select c0 as src_segment, c1 as src_year, d0 as dst_segment, d1 as dst_year from e",
        "grid_measures": f"with {e} select e.c0 as segment, e.c1 as year, count(*) as degree, {up(f'(({off(0)}) + ({off(1)})) / 2', 6)} as curvature, {up('4 - count(*) - avg(k.degree)', 4)} as forman_ricci, case when bool_and(g0 > f0) then 'minimum' when bool_and(g0 < f0) then 'maximum' when count_if(g0 > f0) >= 2 and count_if(g0 < f0) >= 2 then 'saddle' else 'regular' end as morse from e join k on k.c0 = e.d0 and k.c1 = e.d1 group by e.c0, e.c1",
        "grid_wraps": f"with {v}, {lows}, t as (select any_value(m) >= 4 and count_if(low) >= 3 and count_if(high) >= 3 and (({alike(0)}) + ({alike(1)})) / 2 >= 0.6 as w, {flip(0)} + {flip(1)} as flips from b) select 'c_mktsegment' as \"column\", false as wraps, 0 as wrap_orientation union all select 'year', w, case when not w then 0 when flips > 1 then -1 else 1 end from t",
        "grid_interactions": f"with {e}, t as (select {product('')} / {product('abs')} as c, count(*) as samples from e) select {up('c', 4)} as gradient_correlation, case when c > 0.1 then 'synergistic' when c < -0.1 then 'antagonistic' else 'weak' end as direction, samples from t where samples >= 10 and abs(c) >= 0.05",
        "grid_faces": f"with {f}, t as (select (select count(*) from f) as faces, (select (count(distinct i) - 1) * (count(distinct p) - 1) from w) as possible_faces, (select count(*) from x) as face_vertex_count, (select count(*) from n) as face_edge_count, (select count(*) from n where c = 1) as boundary_edges, (select count(*) from n where c > 2) as nonmanifold_edges) select *, face_vertex_count - face_edge_count + faces as face_euler_characteristic from t",
        "grid_walk": f"with {v} select c1 as axis_value, {up('avg(f0)', 2)} as mean, {up('min(f0)', 2)} as min, {up('max(f0)', 2)} as max, count(*) as points from v group by c1",
        "grid_coverage": f"with {e} select count(*) as vertices, (select count(*) // 2 from e) as edges, count(*) - (select count(*) from k) as isolated_vertices, {up('avg(density)', 4)} as mean, min(density) as min, max(density) as max from v",
        "grid_navigate": f"with {e} select case when c0 <> d0 then 'c_mktsegment: ' || c0 || ' -> ' || d0 else 'year: ' || c1 || ' -> ' || d1 end as direction, {up('g0 - f0', 2)} as delta from e where (c0, c1) = (select (c0, c1) from v order by c0, c1 limit 1)",
        "grid_vector_field": f"with {e}, t as (select avg(g0 - f0) as d from e group by c0, c1), m as (select avg(d) as m, stddev_pop(d) as sd from t) select count(*) as vertices_analyzed, {up('any_value(m)', 2)} as mean_divergence, {up('any_value(sd)', 2)} as std_divergence, count(*) filter ((d - m) / sd > 1.5) as n_sources, count(*) filter ((d - m) / sd < -1.5) as n_sinks from t, m",
    }
