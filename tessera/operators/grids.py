"""A table as a grid: its axes span coordinates, rows with equal coordinates are one vertex, neighbours along an axis are joined.

A vertex's ``id`` is its place in mixed radix: the place of its value on each axis times the axis's
stride. A step along an axis adds or takes a stride, and all vertices of one line share what is left
of the id without the axis's part, so edges and faces come from equi-joins and groupings on numbers.

Rows reach vertices, edges and their measures by distributed aggregates. What walks the graph (components,
persistence, paths, spectra) works on a collected graph, which is refused beyond ``MOST_VERTICES`` and ``MOST_EDGES``.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace
from functools import reduce
from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.numeric import finite, r, ranged, with_offsets
from .query import is_numeric

MOST_VERTICES, MOST_EDGES, MOST_IDS = 200_000, 4_000_000, 1 << 62
MOST_AXES, MOST_FIELDS, LEAST_ROWS, LEAST_VERTICES = 6, 20, 10, 4
EPSILON = 1e-12


class GridTooLarge(ValueError):
    pass


@dataclass(frozen=True)
class Axis:
    column: str
    kind: str  # numeric_ordered, temporal or categorical
    size: int
    wraps: bool = False
    orientation: int = 0

    @property
    def ordered(self) -> bool:
        return self.kind != "categorical"

    def to_dict(self) -> dict:
        return {"column": self.column, "size": self.size, "ordered": self.ordered, "axis_type": self.kind, "wraps": self.wraps, "wrap_orientation": self.orientation}


@dataclass
class Grid:
    """vertices: id, c0.. (texts), p0.. (places), f0.. (field means), density, first. edges: src, dst, axis, ord, both ways."""

    axes: list[Axis]
    fields: list[str]
    vertices: DataFrame
    edges: DataFrame | None = None

    def release(self) -> None:
        for df in (self.vertices, self.edges):
            if df is not None:
                df.unpersist()

    @property
    def strides(self) -> list[int]:
        out = [1]
        for a in self.axes:  # one place more, for the empty text, which is a coordinate but no value
            out.append(out[-1] * (a.size + 1))
        return out

    def field(self, name: str) -> str:
        return f"f{self.fields.index(name)}"


def kinds(df: DataFrame, types: dict[str, str] | None = None) -> dict[str, str]:
    """numeric, date, string or bool by column; others, timestamps too, are never axes. types overrides."""
    names = {T.StringType: "string", T.DateType: "date", T.BooleanType: "bool"}
    found = {c: "numeric" if is_numeric(df, c) else names.get(type(df.schema[c].dataType), "other") for c in df.columns if c != "_row_id"}
    return found | {c: k for c, k in (types or {}).items() if c in found}


def text(name: str) -> Column:
    return F.col(f"`{name}`").cast("string")


def identify_axes(df: DataFrame, types: dict[str, str] | None = None) -> tuple[list[Axis], list[str]]:
    """Columns that span the grid, and the numeric columns measured on it.

    Dates, strings and booleans of 2 to 6 * sqrt(rows) values are axes; so is the numeric column of
    the best score (how full the grid is with it, how often and how evenly its values repeat, how many there are), if the
    rows are at least 0.3 of the grid's cells. Values are counted for all columns in one shuffle.
    """
    kind = kinds(df, types)
    n = df.count()
    used = [c for c, k in kind.items() if k != "other"]
    if not n or not used:
        return [], []
    cells = df.select(F.explode(F.array(*(F.struct(F.lit(i).alias("c"), text(c).alias("v")) for i, c in enumerate(used)))).alias("x")).select("x.c", "x.v").where("v != ''")
    rows = cells.groupBy("c", "v").count().groupBy("c").agg(F.count("*").alias("u"), F.sum("count").alias("n"), F.sum(F.col("count") * F.log2("count")).alias("h")).collect()
    size, even = dict.fromkeys(used, 0), dict.fromkeys(used, 0.0)
    for x in rows:
        size[used[x.c]] = x.u
        even[used[x.c]] = (math.log2(x.n) - x.h / x.n) / math.log2(x.u) if x.u > 1 else 0.0
    chosen = [c for c in used if kind[c] != "numeric" and 2 <= size[c] <= max(2, int(math.sqrt(n) * 6))]
    numeric = [c for c in used if kind[c] == "numeric" and size[c] >= 2]
    if numeric:
        cell = lambda c: F.coalesce(text(c), F.lit("null"))
        tuples = df.agg(*(F.count_distinct(F.struct(*(cell(x) for x in [*chosen, c]))).alias(f"t{i}") for i, c in enumerate(numeric))).first()
        base = math.prod(size[c] for c in chosen)
        score = [t / (base * size[c]) * math.log1p(n / size[c]) * (0.5 + 0.5 * even[c]) * math.log1p(size[c]) for t, c in zip(tuples, numeric)]
        best = numeric[score.index(max(score))]
        if n / (base * size[best]) >= 0.3:
            chosen.append(best)
    named = {"numeric": "numeric_ordered", "date": "temporal"}
    axes = [Axis(c, named.get(kind[c], "categorical"), size[c]) for c in chosen]
    fields = [c for c in used if kind[c] == "numeric" and c not in chosen]
    if not fields:
        widest = max((a for a in axes if a.kind == "numeric_ordered"), key=lambda a: a.size, default=None)
        if widest:
            axes.remove(widest)
            fields = [widest.column]
    return sorted(axes, key=lambda a: a.size)[:MOST_AXES], fields[:MOST_FIELDS]


def places(df: DataFrame, axis: Axis) -> DataFrame:
    """value, place: an ordered axis counts up its values, another in the order in which they come first."""
    value = text(axis.column)
    first = F.min("_row_id") if "_row_id" in df.columns else F.min(F.lit(0).cast("long"))
    key = value.cast("double") if axis.kind == "numeric_ordered" else F.lit(0.0)
    found = df.select(value.alias("value"), key.alias("key"), *(["_row_id"] if "_row_id" in df.columns else [])).where("value != ''").groupBy("value", "key").agg(first.alias("first"))
    by = ["value"] if axis.kind == "temporal" else ["key", "value"] if axis.ordered else ["first", "value"]
    parts = with_offsets(ranged(found, by), F.lit(1))
    return parts.select("value", (F.col("_offset") + F.row_number().over(Window.partitionBy("_part").orderBy(*by)) - 1).alias("place"))


def build_grid(df: DataFrame, axes: list[Axis], fields: list[str]) -> Grid:
    """Vertices with the mean of each field over their rows. Rows that lack a coordinate belong to none."""
    if math.prod(a.size + 1 for a in axes) > MOST_IDS:
        raise GridTooLarge("the axes span more cells than an id can number")
    first = F.min("_row_id") if "_row_id" in df.columns else F.lit(0).cast("long")
    value = [finite(F.col(f"`{f}`").try_cast("double")) if isinstance(df.schema[f].dataType, T.StringType) else finite(F.col(f"`{f}`").cast("double")) for f in fields]
    rows = df.select(*(text(a.column).alias(f"c{i}") for i, a in enumerate(axes)), *(v.alias(f"f{i}") for i, v in enumerate(value)), *(["_row_id"] if "_row_id" in df.columns else []))
    coords = [f"c{i}" for i in range(len(axes))]
    found = rows.dropna(subset=coords).groupBy(*coords).agg(*(F.avg(f"f{i}").alias(f"f{i}") for i in range(len(fields))), F.count("*").alias("density"), first.alias("first"))
    grid = Grid(axes, fields, found)
    number = F.lit(0).cast("long")
    for i, (a, stride) in enumerate(zip(axes, grid.strides)):
        at = places(df, a).select(F.col("value").alias(f"c{i}"), F.col("place").alias(f"p{i}"))
        found = found.join(at, f"c{i}", "left").withColumn(f"p{i}", F.coalesce(f"p{i}", F.lit(a.size).cast("long")))
        number = number + F.col(f"p{i}") * F.lit(stride)
    grid.vertices = found.withColumn("id", number).persist()
    return grid


def wrap_axes(grid: Grid) -> list[Axis]:
    """Axes with wraps set where the field means of the lowest and highest fifth are alike (0.6 on average), and -1 if more signs differ than agree."""
    tried = [(i, a) for i, a in enumerate(grid.axes) if a.ordered and a.size >= 4]
    if not tried:
        return grid.axes
    aggs, m = [], len(grid.fields)
    for i, a in tried:
        fifth = max(1, a.size // 5)
        low, high = F.col(f"p{i}") < fifth, (F.col(f"p{i}") >= a.size - fifth) & (F.col(f"p{i}") < a.size)
        for side in (low, high):
            aggs += [F.count_if(side), *(F.avg(F.when(side, F.col(f"f{j}"))) for j in range(m))]
    row, out = list(grid.vertices.agg(*(x.alias(f"a{k}") for k, x in enumerate(aggs))).first()), list(grid.axes)
    for k, (i, a) in enumerate(tried):
        low, high = (row[(2 * k + s) * (m + 1) : (2 * k + s + 1) * (m + 1)] for s in (0, 1))
        x, y = (np.array([v or 0.0 for v in side[1:]]) for side in (low, high))
        total = np.abs(x) + np.abs(y)
        told = total >= 1e-9
        if min(low[0], high[0]) < 3 or not told.any():
            continue
        alike = 1 - np.minimum(np.abs(np.abs(x) - np.abs(y))[told] / total[told], 1)
        if alike.mean() >= 0.6:
            signed = told & (np.abs(x) > 1e-9) & (np.abs(y) > 1e-9)
            flips = int(((x > 0) != (y > 0))[signed].sum())
            out[i] = replace(a, wraps=True, orientation=-1 if flips > signed.sum() - flips else 1)
    return out


def edges(grid: Grid) -> DataFrame:
    """src, dst, axis, ord: steps of one place along ordered axes; all others of the line along unordered ones."""
    v, found = grid.vertices, []
    steps = []
    for i, (a, stride) in enumerate(zip(grid.axes, grid.strides)):
        if a.ordered:
            for k, step in enumerate((-1, 1)):
                to = F.col(f"p{i}") + step
                to = F.pmod(to, F.lit(a.size)) if a.wraps else F.when((to >= 0) & (to < a.size), to)
                dst = F.when(F.col(f"p{i}") < a.size, F.col("id") + (to - F.col(f"p{i}")) * F.lit(stride))
                steps.append(F.struct(F.lit(i).alias("axis"), F.lit(k).cast("long").alias("ord"), dst.alias("dst")))
    if steps:
        wanted = v.select(F.col("id").alias("src"), F.explode(F.array(*steps)).alias("s")).select("src", "s.dst", "s.axis", "s.ord").where("dst is not null")
        found.append(wanted.join(v.select(F.col("id").alias("dst")), "dst", "left_semi").select("src", "dst", "axis", "ord"))
    lines = [F.struct(F.lit(i).alias("axis"), (F.col("id") - F.col(f"p{i}") * F.lit(stride)).alias("line"), F.col(f"p{i}").alias("ord")) for i, (a, stride) in enumerate(zip(grid.axes, grid.strides)) if not a.ordered]
    if lines:
        on = v.select("id", F.explode(F.array(*lines)).alias("s")).select("id", "s.*")
        one, other = on.select(F.col("id").alias("src"), "axis", "line"), on.select(F.col("id").alias("dst"), "axis", "line", "ord")
        found.append(one.join(other, ["axis", "line"]).where("src != dst").select("src", "dst", "axis", "ord"))
    return reduce(DataFrame.unionByName, found)


def make(df: DataFrame, axes: list[Axis], fields: list[str]) -> Grid:
    """Vertices, wrapping axes and edges."""
    grid = build_grid(df, axes, fields)
    grid.axes = wrap_axes(grid)
    grid.edges = edges(grid).persist()
    return grid


def measured(grid: Grid) -> DataFrame:
    """Vertices with degree, curvature, forman_ricci and morse_<i> by field (null without neighbours that have the field).

    curvature: how far a field is from its neighbours' mean, against that mean (1 at least), averaged over fields.
    forman_ricci: the mean of 4 - own degree - neighbour's degree.
    """
    m, v = range(len(grid.fields)), grid.vertices
    degree = grid.edges.groupBy("src").agg(F.count("*").alias("degree"))
    near = v.select(F.col("id").alias("dst"), *(F.col(f"f{i}").alias(f"n{i}") for i in m)).join(degree.withColumnRenamed("src", "dst").withColumnRenamed("degree", "dst_degree"), "dst", "left")
    own = v.select(F.col("id").alias("src"), *(f"f{i}" for i in m))
    over = lambda i, sign: F.sum(F.when(F.lit(sign) * (F.col(f"n{i}") - F.col(f"f{i}")) > EPSILON, 1).otherwise(0))
    around = grid.edges.select("src", "dst").join(near, "dst").join(own, "src").groupBy("src").agg(F.count("*").alias("degree"), F.avg("dst_degree").alias("near_degree"), *(x for i in m for x in (F.avg(f"n{i}").alias(f"m{i}"), over(i, 1).alias(f"u{i}"), over(i, -1).alias(f"d{i}"))))
    off = [F.abs(F.col(f"f{i}") - F.col(f"m{i}")) / F.greatest(F.abs(f"m{i}"), F.lit(1.0)) for i in m]
    n = sum((x.isNotNull().cast("int") for x in off), F.lit(0))
    curvature = F.when(n > 0, sum((F.coalesce(x, F.lit(0.0)) for x in off), F.lit(0.0)) / n).otherwise(0.0)
    up, down = (lambda i: F.col(f"u{i}")), (lambda i: F.col(f"d{i}"))
    kind = lambda i: F.when(down(i) + up(i) == 0, None).when(down(i) == 0, "minimum").when(up(i) == 0, "maximum").when((up(i) >= 2) & (down(i) >= 2), "saddle").otherwise("regular")
    out = v.join(around.withColumnRenamed("src", "id"), "id", "left")
    return out.select(*v.columns, F.coalesce("degree", F.lit(0)).alias("degree"), curvature.alias("curvature"), F.coalesce(4 - F.col("degree") - F.col("near_degree"), F.lit(0.0)).alias("forman_ricci"), *(kind(i).alias(f"morse_{i}") for i in m))


def interactions(grid: Grid, top: int = 15) -> list[dict]:
    """Pairs of fields (of the first 10) that rise together or against each other along edges: the mean product of steps over its mean size."""
    pairs = list(combinations(range(min(10, len(grid.fields))), 2))
    if not pairs:
        return []
    names = sorted({i for p in pairs for i in p})
    side = lambda at, to: grid.vertices.select(F.col("id").alias(at), *(F.col(f"f{i}").alias(f"{to}{i}") for i in names))
    step = grid.edges.select("src", "dst").join(side("src", "a"), "src").join(side("dst", "b"), "dst").select(*((F.col(f"b{i}") - F.col(f"a{i}")).alias(f"g{i}") for i in names))
    product = [F.col(f"g{i}") * F.col(f"g{j}") for i, j in pairs]
    row, out = list(step.agg(*(f.alias(f"x{k}{t}") for k, x in enumerate(product) for t, f in enumerate((F.count(x), F.avg(x), F.avg(F.abs(x)))))).first()), []
    for k, (i, j) in enumerate(pairs):
        n, mean, scale = row[3 * k : 3 * k + 3]
        c = mean / scale if n and scale > EPSILON else 0.0
        if n >= 10 and abs(c) >= 0.05:
            out.append({"fields": [grid.fields[i], grid.fields[j]], "gradient_correlation": r(c, 4), "strength": r(abs(c), 4), "direction": "synergistic" if c > 0.1 else "antagonistic" if c < -0.1 else "weak", "samples": n})
    return sorted(out, key=lambda x: -x["strength"])[:top]


def labels(n: int, src: np.ndarray, dst: np.ndarray) -> np.ndarray:
    """The least vertex of each vertex's component: labels go to the smaller one across edges, then pointers are halved."""
    out = np.arange(n)
    while True:
        new = out.copy()
        low = np.minimum(out[src], out[dst])
        np.minimum.at(new, out[src], low)
        np.minimum.at(new, out[dst], low)
        while (new[new] != new).any():
            new = new[new]
        if (new == out).all():
            return out
        out = new


#: Surface, genus, orientable and Euler characteristic.
SURFACES = {"bounded_patch": (0, True, 2), "cylinder": (0, True, 0), "torus": (1, True, 0), "mobius_band": (1, False, 0), "klein_bottle": (2, False, 0)}


def product_topology(axes: list[Axis]) -> tuple[str, int, bool, int]:
    """The surface that the axes' boundaries make."""
    turned, closed = sum(a.wraps and a.orientation == -1 for a in axes), sum(a.wraps and a.orientation == 1 for a in axes)
    if not turned:
        name = ("bounded_patch", "cylinder", "torus")[min(closed, 2)]
    elif closed or turned == len(axes) > 1:
        name = "klein_bottle"
    else:
        name = "mobius_band" if turned < len(axes) else "bounded_patch"
    return (name, *SURFACES[name])


def cells(grid: Grid) -> list[int]:
    """How many cells lie along each axis."""
    return [a.size if a.wraps else a.size - 1 for a in grid.axes]


def face_edges(grid: Grid) -> DataFrame:
    """a, b, faces: the edges around the faces of a grid of two axes, each with its number of faces; face: one of them.

    Each vertex offers itself as a corner to the cells it touches; a cell with four corners is a face.
    """
    (m, n), (_, stride, _) = (a.size for a in grid.axes), grid.strides
    along = []
    for i, (a, most) in enumerate(zip(grid.axes, cells(grid))):
        before = F.pmod(F.col(f"p{i}") - 1, F.lit(a.size)) if a.wraps else F.col(f"p{i}") - 1
        along.append(F.array_compact(F.array(*(F.when(c.between(0, most - 1), c) for c in (F.col(f"p{i}"), before)))))
    corners = grid.vertices.where((F.col("p0") < m) & (F.col("p1") < n)).select(F.explode(along[0]).alias("i"), along[1].alias("js")).select("i", F.explode("js").alias("j"))
    faces = corners.groupBy("i", "j").count().where("count = 4")
    i, j, up, right = F.col("i"), F.col("j"), F.pmod(F.col("i") + 1, F.lit(m)), F.pmod(F.col("j") + 1, F.lit(n))
    at = [x + y * F.lit(stride) for x, y in ((i, j), (up, j), (up, right), (i, right))]
    around = F.array(*(F.struct(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")) for a, b in zip(at, at[1:] + at[:1])))
    return faces.select(F.explode(around).alias("e")).groupBy("e.a", "e.b").agg(F.count("*").alias("faces"))


def face_topology(grid: Grid) -> dict | None:
    """Faces, boundary and genus of a grid of two axes; None for others."""
    if len(grid.axes) != 2 or min(a.size for a in grid.axes) < 2:
        return None
    possible, total = math.prod(cells(grid)), math.prod(a.size for a in grid.axes)
    around = face_edges(grid).persist()
    # each face has four edges, so the edges' faces count each four times
    n_edges, sides, boundary, odd = around.agg(F.count("*"), F.coalesce(F.sum("faces"), F.lit(0)), F.count_if(F.col("faces") == 1), F.count_if(F.col("faces") > 2)).first()
    faces = sides // 4
    occupancy, coverage = grid.vertices.count() / total, faces / possible
    out = {"mode": "graph_heuristic", "faces": faces, "possible_faces": possible, "face_coverage": r(coverage, 4), "occupancy": r(occupancy, 4), "face_vertex_count": 0, "face_edge_count": 0, "boundary_edges": 0, "boundary_loops": 0, "face_euler_characteristic": None, "face_genus_estimate_orientable": None, "confidence": 0.0, "is_manifold": False, "nonmanifold_edges": 0}
    if faces:
        corners = around.select(F.explode(F.array("a", "b")).alias("v")).distinct().count()
        if boundary > MOST_EDGES:
            raise GridTooLarge(f"{boundary} boundary edges")
        ends = np.array([tuple(x) for x in around.where("faces = 1").select("a", "b").collect()], np.int64).reshape(-1, 2)
        known, at = np.unique(ends, return_inverse=True)
        at = at.reshape(-1, 2)
        loops = len(np.unique(labels(len(known), at[:, 0], at[:, 1])))
        chi = corners - n_edges + faces
        sure = min(1.0, 0.55 * coverage + 0.45 * occupancy) * (0.5 if odd else 1)
        out |= {"mode": "nonmanifold_complex" if odd else "validated_2d_faces", "face_vertex_count": corners, "face_edge_count": n_edges, "boundary_edges": boundary, "boundary_loops": loops, "face_euler_characteristic": chi, "face_genus_estimate_orientable": r((2 - loops - chi) / 2, 6), "confidence": r(sure, 4), "is_manifold": not odd, "nonmanifold_edges": odd}
    around.unpersist()
    return out


class Graph:
    """A grid on the driver: arrays by vertex, in the order in which vertices come first; near[i] lists neighbours by axis and place."""

    def __init__(self, grid: Grid):
        self.axes, self.fields = grid.axes, grid.fields
        n, e = grid.vertices.count(), grid.edges.count()
        if n > MOST_VERTICES or e > MOST_EDGES:
            raise GridTooLarge(f"{n} vertices and {e // 2} edges")
        v = measured(grid).orderBy("first", "id").toPandas()
        self.n = n
        self.coords = list(zip(*(v[f"c{i}"] for i in range(len(grid.axes))))) if n else []
        self.at = {c: i for i, c in enumerate(self.coords)}
        self.values = {f: v[f"f{i}"].to_numpy(np.float64) for i, f in enumerate(grid.fields)}
        self.morse = {f: list(v[f"morse_{i}"]) for i, f in enumerate(grid.fields)}
        self.density, self.curvature = v["density"].to_numpy(np.int64), v["curvature"].to_numpy(np.float64)
        e = grid.edges.toPandas().sort_values(["src", "axis", "ord"])
        order = np.argsort(v["id"].to_numpy(), kind="stable")
        place = lambda ids: order[np.searchsorted(v["id"].to_numpy()[order], ids.to_numpy())] if n else np.zeros(0, np.int64)
        self.src, self.dst = place(e["src"]), place(e["dst"])
        by = np.argsort(self.src, kind="stable")
        self.src, self.dst = self.src[by], self.dst[by]
        self.near = np.split(self.dst, np.searchsorted(self.src, np.arange(1, n))) if n else []

    def fields_at(self, i: int) -> dict[str, float]:
        return {f: r(float(x[i]), 6) for f, x in self.values.items() if not math.isnan(x[i])}


def betti_numbers(graph: Graph) -> tuple[int, int]:
    """Components, and independent cycles (edges - vertices + components)."""
    parts = len(np.unique(labels(graph.n, graph.src, graph.dst)))
    return parts, max(0, len(graph.src) // 2 - graph.n + parts)


def persistence(graph: Graph, field: str) -> list[dict]:
    """Minima of a field that merge into deeper ones as the level rises, with the rise between (elder rule), longest first."""
    value = graph.values[field]
    order = np.argsort(value, kind="stable")
    order = order[~np.isnan(value[order])]
    root, out = np.full(graph.n, -1), []

    def top(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i in order.tolist():
        root[i] = i
        for j in graph.near[i].tolist():
            if root[j] < 0 or (a := top(i)) == (b := top(j)):
                continue
            old, young = (a, b) if value[a] <= value[b] else (b, a)  # a root is its component's minimum
            root[young] = old
            if value[i] - value[young] > EPSILON:
                out.append({"vertex": young, "coord": graph.coords[young], "morse_type": "minimum", "field": field, "value": r(float(value[young]), 6), "persistence": r(float(value[i] - value[young]), 6)})
    return sorted(out, key=lambda x: -x["persistence"])


class Surface:
    """A grid with what is known of its shape. graph, betti numbers and persistence are None for grids too large to collect."""

    def __init__(self, grid: Grid):
        self.grid, self.axes, self.fields = grid, grid.axes, grid.fields
        self.product, self.genus, self.orientable, self.euler = product_topology(grid.axes)
        self.faces = face_topology(grid)
        try:
            self.graph = Graph(grid)
        except GridTooLarge:
            self.graph = None
        self.vertices, self.edges = grid.vertices.count(), grid.edges.count() // 2
        self.betti = betti_numbers(self.graph) if self.graph else (None, None)
        pairs = {f: persistence(self.graph, f)[:20] for f in grid.fields[:5]} if self.graph else None
        self.persistence = pairs and {f: p for f, p in pairs.items() if p}
        self.interactions = interactions(grid)
        found = self.faces or {}
        self.name = "graph_only" if not found.get("faces") else self.product if found["is_manifold"] else "nonmanifold_complex"
        self.confidence = {"has_faces": bool(found.get("faces")), "is_edge_manifold": found.get("is_manifold", False), "nonmanifold_edges": found.get("nonmanifold_edges", 0), "face_coverage": found.get("face_coverage", 0.0), "occupancy": found.get("occupancy", 0.0), "classification_mode": found.get("mode", "graph_heuristic"), "confidence": found.get("confidence", 0.0)}

    def to_dict(self) -> dict:
        found = self.faces or {}
        complex_ = {"vertices": found.get("face_vertex_count", 0), "edges": found.get("face_edge_count", 0), "faces": found.get("faces", 0), "boundary_edges": found.get("boundary_edges", 0), "boundary_loops": found.get("boundary_loops", 0), "face_coverage": found.get("face_coverage", 0.0), "occupancy": found.get("occupancy", 0.0), "euler_characteristic": found.get("face_euler_characteristic"), "genus_estimate": found.get("face_genus_estimate_orientable") if self.orientable else None, "crosscap_estimate": None, "is_manifold": found.get("is_manifold", False), "nonmanifold_edges": found.get("nonmanifold_edges", 0)}
        closed = [a.orientation for a in self.axes if a.wraps]
        return {"axes": [a.to_dict() for a in self.axes], "fields": self.fields, "vertices": self.vertices, "edges": self.edges, "surface": self.name, "genus": self.genus, "orientable": self.orientable, "euler_characteristic": self.euler, "betti_0": self.betti[0], "betti_1": self.betti[1], "handles": closed.count(1), "crosscaps": closed.count(-1), "face_complex": complex_, "classification_mode": self.confidence["classification_mode"], "product_topology_label": self.product, "surface_confidence": self.confidence, "interactions": self.interactions}


def build_surface(df: DataFrame, types: dict[str, str] | None = None) -> Surface | None:
    """The table's surface; None with under 10 rows, no axis or field, or under 4 vertices."""
    if df.count() < LEAST_ROWS:
        return None
    axes, fields = identify_axes(df, types)
    if not axes or not fields:
        return None
    grid = build_grid(df, axes, fields)
    if grid.vertices.count() < LEAST_VERTICES:
        return None
    grid.axes = wrap_axes(grid)
    grid.edges = edges(grid).persist()
    return Surface(grid)
