"""Numeric kernels as column expressions, and the small solves that follow one distributed aggregate."""

from __future__ import annotations

import math
from itertools import combinations_with_replacement

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


def rounded(c: Column, digits: int) -> Column:
    """Half up, towards plus infinity: floor(x * 10**k + 0.5) / 10**k."""
    scale = F.lit(float(10**digits))
    return F.floor(c * scale + F.lit(0.5)) / scale


def r(x: float, digits: int) -> float:
    return x if not math.isfinite(x) else math.floor(x * 10**digits + 0.5) / 10**digits


def finite(c: Column) -> Column:
    return F.when(~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))), c)


def permissive(df: DataFrame, name: str) -> Column:
    """The column as a finite double or null: numbers as they are, strings parsed, at need after dropping what can't be in a number."""
    kind, c = df.schema[name].dataType, F.col(f"`{name}`")
    if isinstance(kind, NUMERIC):
        return finite(c.cast("double"))
    if isinstance(kind, T.StringType):
        return F.coalesce(finite(c.try_cast("double")), finite(F.regexp_replace(c, "[^0-9.+\\-eE]", "").try_cast("double")))
    return F.lit(None).cast("double")


def to_float(value: object) -> float | None:
    """The same rule for one Python value."""
    if value is None or isinstance(value, bool):
        return None
    if isinstance(value, (int, float)):
        return float(value) if math.isfinite(value) else None
    if not isinstance(value, str):
        return None
    for text in (value.strip(), "".join(ch for ch in value if ch in "0123456789.+-eE")):
        try:
            if "_" not in text and math.isfinite(x := float(text)):
                return x
        except ValueError:
            pass
    return None


def complete(df: DataFrame, names: list[str]) -> DataFrame:
    """The named columns as doubles, rows complete in all of them."""
    return df.select(*(permissive(df, n).alias(n) for n in names)).dropna()


class Moments:
    """Count, means and centred cross products of columns from one aggregate; further expressions may join in."""

    def __init__(self, df: DataFrame, exprs: dict[str, Column]):
        self.names = list(exprs)
        base = df.select(*(c.alias(f"v{i}") for i, c in enumerate(exprs.values())))
        k = len(exprs)
        pairs = list(combinations_with_replacement(range(k), 2))
        row = base.agg(F.count("*").alias("n"), *(F.avg(f"v{i}") for i in range(k)), *(F.covar_pop(f"v{i}", f"v{j}") for i, j in pairs)).first()
        self.n = row[0]
        self.mean = np.array([x if x is not None else 0.0 for x in row[1 : k + 1]])
        self.cov = np.zeros((k, k))
        for (i, j), x in zip(pairs, row[k + 1 :]):
            self.cov[i, j] = self.cov[j, i] = x or 0.0

    def at(self, names: list[str]) -> list[int]:
        return [self.names.index(n) for n in names]

    def pearson(self, a: str, b: str) -> float:
        i, j = self.at([a, b])
        bottom = math.sqrt(self.cov[i, i] * self.cov[j, j])
        return 0.0 if self.n < 3 or bottom == 0 else float(np.clip(self.cov[i, j] / bottom, -1, 1))

    def beta(self, target: str, given: list[str]) -> np.ndarray | None:
        """Least-squares slopes, None if the design is singular."""
        g, (t,) = self.at(given), self.at([target])
        scale = np.sqrt(np.diag(self.cov)[g])
        if not len(g) or (scale <= 0).any():
            return None
        a = self.cov[np.ix_(g, g)] / np.outer(scale, scale)
        if abs(np.linalg.det(a)) < 1e-12:
            return None
        return np.linalg.solve(a, self.cov[g, t] / scale) / scale

    def r2(self, target: str, given: list[str]) -> float:
        """0 for a singular design, a constant target or too few rows."""
        (t,) = self.at([target])
        b = self.beta(target, given)
        if b is None or self.n < len(given) + 2 or self.cov[t, t] <= 0:
            return 0.0
        return float(np.clip(b @ self.cov[self.at(given), t] / self.cov[t, t], 0, 1))

    def intercept(self, target: str, given: list[str], b: np.ndarray) -> float:
        return float(self.mean[self.at([target])[0]] - b @ self.mean[self.at(given)])


def fit_linear(df: DataFrame, x: str, y: str) -> dict:
    m = Moments(complete(df, [x, y]), {x: F.col(x), y: F.col(y)})
    i, j = m.at([x, y])
    if m.cov[i, i] <= 0:
        return {"slope": 0.0, "intercept": float(m.mean[j]), "r2": 0.0, "corr": 0.0, "samples": m.n}
    slope, corr = m.cov[i, j] / m.cov[i, i], m.pearson(x, y)
    return {"slope": float(slope), "intercept": float(m.mean[j] - slope * m.mean[i]), "r2": corr * corr, "corr": corr, "samples": m.n}


def average_ranks(df: DataFrame, columns: list[str]) -> DataFrame:
    """Adds r_<column>: 1-based ranks, ties sharing their mean. Counts by value are ranked, so rows move by value, never to one task."""
    out = df
    for c in columns:
        counts = df.groupBy(c).agg(F.count("*").alias("_n"))
        ranks = below(counts, c, "_n").select(F.col(c).alias("_v"), (F.col("_below") + (F.col("_n") + 1) / 2).alias(f"r_{c}"))
        out = out.join(ranks, out[c] == ranks["_v"]).drop("_v")
    return out


def ranged(df: DataFrame, by: list[str]) -> DataFrame:
    """Adds _part: the range of the row's key, rising with the key (nulls first).

    The bounds are drawn once and then are constants of the plan. Spark's own range partitions are
    drawn anew by every job, so counts taken in one job needn't hold in the next.
    """
    parts = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    key = F.struct(*(F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(by)))
    keys = df.select(key.alias("k"))
    n = keys.count()
    drawn = keys.where(F.rand(7) < 50 * parts / max(n, 1)).orderBy("k").collect()  # about 50 a range
    bounds = [drawn[i * len(drawn) // parts].k for i in range(1, parts)] if len(drawn) > parts else []
    if not bounds:
        return df.withColumn("_part", F.lit(0))
    kinds = [df.schema[c].dataType for c in by]
    bound = lambda k: F.struct(*(F.lit(v).cast(t).alias(f"k{i}") for i, (v, t) in enumerate(zip(k, kinds))))
    # two levels of about sqrt(parts) comparisons each
    width = math.isqrt(len(bounds) - 1) + 1
    groups = [bounds[i : i + width] for i in range(0, len(bounds), width)]
    reached = lambda array: F.size(F.filter(array, lambda b: b <= key))
    coarse = reached(F.array(*(bound(g[0]) for g in groups[1:]))) if len(groups) > 1 else F.lit(0)
    fine = F.element_at(F.array(*(F.array(*map(bound, g)) for g in groups)), coarse + 1)
    return df.withColumn("_part", coarse * width + reached(fine))


def with_offsets(parts: DataFrame, weight: Column) -> DataFrame:
    """Adds _offset: the total weight of the ranges before the row's own."""
    totals = {p: t for p, t in parts.groupBy("_part").agg(F.sum(weight)).collect()}  # one row a range
    offsets = [0]
    for p in range(max(totals, default=0)):
        offsets.append(offsets[-1] + totals.get(p, 0))
    return parts.withColumn("_offset", F.element_at(F.array(*(F.lit(x).cast("long") for x in offsets)), F.col("_part") + 1))


def below(counts: DataFrame, value: str, n: str) -> DataFrame:
    """Adds _below: the total of ``n`` over smaller values; ranges are summed apart, then offset by the ranges before them."""
    w = Window.partitionBy("_part").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    return with_offsets(ranged(counts, [value]), F.col(n)).withColumn("_below", F.col("_offset") + F.coalesce(F.sum(n).over(w), F.lit(0))).drop("_part", "_offset")


def quantile_edges(df: DataFrame, column: str, bins: int) -> list[float]:
    """Nearest-rank edges: edge b is the value at position round((n - 1) * b / bins), 0-based."""
    values = df.select(F.col(column).alias("v")).dropna()
    counts = below(values.groupBy("v").agg(F.count("*").alias("n")), "v", "n")
    n = values.count()
    if not n:
        return []
    at = [math.floor((n - 1) * b / bins + 0.5) for b in range(bins + 1)]
    hit = F.array(*(F.lit(a) for a in sorted(set(at))))
    rows = counts.where(F.exists(hit, lambda a: (a >= F.col("_below")) & (a < F.col("_below") + F.col("n")))).select("v", "_below", "n").collect()
    out: list[float] = []
    for a in at:
        v = next(x.v for x in rows if x._below <= a < x._below + x.n)
        out.append(max(v, out[-1]) if out else v)
    return out


def percentiles(df: DataFrame, column: str, shares: list[float]) -> list[float] | None:
    """Values at these shares of the way through the sorted values, between two in proportion. Counts by value are ranked in ranges, so no task holds all."""
    values = df.select(F.col(column).alias("v")).dropna()
    counts = below(values.groupBy("v").agg(F.count("*").alias("n")), "v", "n")
    n = values.count()
    if not n:
        return None
    places = [(n - 1) * q for q in shares]
    hit = F.array(*(F.lit(a) for a in sorted({f(x) for x in places for f in (math.floor, math.ceil)})))
    rows = counts.where(F.exists(hit, lambda a: (a >= F.col("_below")) & (a < F.col("_below") + F.col("n")))).select("v", "_below", "n").collect()  # two for each share at most
    at = lambda a: next(x.v for x in rows if x._below <= a < x._below + x.n)
    return [at(math.floor(x)) + (x - math.floor(x)) * (at(math.ceil(x)) - at(math.floor(x))) for x in places]


def bucket(c: Column, edges: list[float]) -> Column:
    """The first i with value <= edges[i + 1], else the last."""
    out = F.lit(len(edges) - 2)
    for i in range(len(edges) - 2, -1, -1):
        out = F.when(c <= F.lit(edges[i + 1]), F.lit(i)).otherwise(out)
    return F.when(c.isNotNull(), out)


def normal_cdf(z: float) -> float:
    return 0.5 * (1 + math.erf(z / math.sqrt(2)))


def chi2_p(x: float, dof: int) -> float:
    """Wilson-Hilferty approximation of the upper tail."""
    if dof <= 0:
        return 1.0
    z = ((x / dof) ** (1 / 3) - (1 - 2 / (9 * dof))) / math.sqrt(2 / (9 * dof))
    return max(0.0, min(1.0, 1 - normal_cdf(z)))


def f_p(f: float, d1: int, d2: int) -> float:
    """Cube-root normal approximation of the upper tail."""
    if f <= 0 or d1 <= 0 or d2 <= 0:
        return 1.0
    a, b, c = 2 / (9 * d1), 2 / (9 * d2), f ** (1 / 3)
    z = ((1 - b) * c - (1 - a)) / math.sqrt(b * c * c + a)
    return max(0.0, min(1.0, 1 - normal_cdf(z)))
