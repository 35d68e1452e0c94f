"""Statistical routines. Each takes a table and returns a dict, or {"error": ...} where there is too little data.

The rows are reduced by distributed aggregates; what is solved or iterated on the driver is bounded by
columns, bins, categories or lags.
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import Moments, average_ranks, below, bucket, chi2_p, complete, f_p, fit_linear, percentiles, permissive, quantile_edges, r, ranged, with_offsets


def numeric_columns(df: DataFrame) -> list[str]:
    from .query import is_numeric

    return [c for c in df.columns if c != "_row_id" and is_numeric(df, c)]


def moments(df: DataFrame, names: list[str]) -> Moments:
    names = list(dict.fromkeys(names))
    return Moments(complete(df, names), {n: F.col(f"`{n}`") for n in names})


def regress(df: DataFrame, target: str, drivers: list[str]) -> dict:
    m = moments(df, [target, *drivers])
    p = len(drivers)
    if m.n < p + 2:
        return {"error": "too few complete rows"}
    b = m.beta(target, drivers)
    if b is None:
        return {"error": "singular design"}
    r2 = m.r2(target, drivers)
    adjusted = 1 - (1 - r2) * (m.n - 1) / (m.n - p - 1) if m.n > p + 1 else r2
    rows = [{"driver": d, "coefficient": r(float(x), 6), "individual_correlation": r(m.pearson(d, target), 4)} for d, x in zip(drivers, b)]
    return {"target": target, "samples": m.n, "intercept": r(m.intercept(target, drivers, b), 6), "r2": r(r2, 6), "adjusted_r2": r(adjusted, 6), "drivers": sorted(rows, key=lambda x: -abs(x["coefficient"]))}


def partial_correlate(df: DataFrame, a: str, b: str, controls: list[str]) -> dict:
    """The correlation of what the controls leave unexplained; a singular design leaves the raw values."""
    m = moments(df, [a, b, *controls])
    if m.n < len(controls) + 3:
        return {"error": "too few complete rows"}
    raw, beta = m.pearson(a, b), (m.beta(a, controls), m.beta(b, controls))
    g, (i, j) = m.at(controls), m.at([a, b])
    w = np.zeros((2, len(m.names)))
    for k, (at, x) in enumerate(zip((i, j), beta)):
        w[k, at] = 1
        if x is not None:
            w[k, g] -= x
    c = w @ m.cov @ w.T
    partial = 0.0 if c[0, 0] <= 0 or c[1, 1] <= 0 else float(np.clip(c[0, 1] / math.sqrt(c[0, 0] * c[1, 1]), -1, 1))
    return {"field_a": a, "field_b": b, "controls": controls, "partial_correlation": r(partial, 4), "raw_correlation": r(raw, 4), "samples": m.n, "change": r(partial - raw, 4)}


def rank_correlate(df: DataFrame, fields: list[str], method: str = "spearman") -> dict:
    fields = fields[:15]
    ranked = average_ranks(complete(df, fields), fields)
    exprs = {f: F.col(f) for f in fields} | {f"r_{f}": F.col(f"r_{f}") for f in fields}
    m = Moments(ranked, exprs)
    if m.n < 5:
        return {"error": "at least 5 complete rows"}
    pairs = []
    for a, b in combinations(fields, 2):
        s, p = m.pearson(f"r_{a}", f"r_{b}"), m.pearson(a, b)
        pairs.append({"field_a": a, "field_b": b, "spearman": r(s, 4), "pearson": r(p, 4), "divergence": r(abs(s - p), 4)})
    return {"fields": fields, "samples": m.n, "method": method, "pairs": pairs, "nonlinear_pairs": [p for p in pairs if p["divergence"] > 0.15]}


def category(df: DataFrame, name: str, bins: int) -> Column:
    """The column's text; for columns that are over 80 % numbers their quantile bucket, "NA" for the rest."""
    v = permissive(df, name)
    row = df.agg(F.count(v), F.count("*")).first()
    if row[1] and row[0] > 0.8 * row[1]:
        return F.coalesce(bucket(v, quantile_edges(df.select(v.alias("v")), "v", bins)).cast("string"), F.lit("NA"))
    return F.coalesce(F.col(f"`{name}`").cast("string"), F.lit("null"))


def chi_squared(df: DataFrame, a: str, b: str, bins: int = 10) -> dict:
    cells = df.select(category(df, a, bins).alias("a"), category(df, b, bins).alias("b")).groupBy("a", "b").count()
    rows = cells.collect()  # one a pair of categories
    n, left, right = sum(x["count"] for x in rows), {}, {}
    for x in rows:
        left[x.a] = left.get(x.a, 0) + x["count"]
        right[x.b] = right.get(x.b, 0) + x["count"]
    if n < 10 or len(left) < 2 or len(right) < 2:
        return {"error": "at least 10 rows and 2 categories of each"}
    # cells without rows add their expectation: together n - sum of the others' expectations
    seen = sum(left[x.a] * right[x.b] / n for x in rows)
    chi = sum((x["count"] - left[x.a] * right[x.b] / n) ** 2 / (left[x.a] * right[x.b] / n) for x in rows) + n - seen
    dof = (len(left) - 1) * (len(right) - 1)
    v = math.sqrt(chi / n / (min(len(left), len(right)) - 1))
    return {"field_a": a, "field_b": b, "samples": n, "chi_squared": r(chi, 4), "dof": dof, "p_value": r(chi2_p(chi, dof), 6), "cramers_v": r(v, 4), "categories_a": len(left), "categories_b": len(right)}


def anova(df: DataFrame, group: str, target: str) -> dict:
    rows = df.select(F.col(f"`{group}`").cast("string").alias("g"), permissive(df, target).alias("v")).dropna().groupBy("g").agg(F.count("*").alias("n"), F.avg("v").alias("mean"), F.var_pop("v").alias("var")).where("n >= 2").orderBy("g").collect()
    if len(rows) < 2:
        return {"error": "at least 2 groups of 2 rows"}
    n = sum(x.n for x in rows)
    grand = sum(x.n * x.mean for x in rows) / n
    between, within = sum(x.n * (x.mean - grand) ** 2 for x in rows), sum(x.n * x.var for x in rows)
    d1, d2 = len(rows) - 1, n - len(rows)
    f = between / d1 / (within / d2) if within > 0 and d2 > 0 else 0.0
    total = between + within
    stats = [{"group": x.g, "n": x.n, "mean": r(x.mean, 4), "std": r(math.sqrt(x.var), 4)} for x in rows]
    return {"group_field": group, "target_field": target, "n_groups": len(rows), "samples": n, "f_statistic": r(f, 4), "p_value": r(f_p(f, d1, d2), 6), "eta_squared": r(between / total if total > 0 else 0.0, 6), "group_stats": stats}


def entropy(counts: np.ndarray) -> float:
    p = counts[counts > 0] / counts.sum()
    return float(-(p * np.log(p)).sum())


def mutual_information(df: DataFrame, fields: list[str], bins: int = 10) -> dict:
    fields = fields[:15]
    rows = complete(df, fields)
    m = Moments(rows, {f: F.col(f) for f in fields})
    if m.n < 20:
        return {"error": "at least 20 complete rows"}
    binned = rows.select(*(bucket(F.col(f), quantile_edges(rows, f, bins)).alias(f) for f in fields))
    pairs = []
    for a, b in combinations(fields, 2):
        table = np.zeros((bins, bins))
        for x in binned.groupBy(a, b).count().collect():
            table[x[0], x[1]] = x[2]
        ha, hb = entropy(table.sum(1)), entropy(table.sum(0))
        mi = max(0.0, ha + hb - entropy(table.ravel()))
        nmi, corr = mi / min(ha, hb) if min(ha, hb) > 0 else 0.0, abs(m.pearson(a, b))
        pairs.append({"field_a": a, "field_b": b, "mutual_info": r(mi, 6), "normalized_mi": r(nmi, 6), "pearson_abs": r(corr, 4), "nonlinear_flag": nmi > 0.1 and nmi > 1.5 * corr})
    return {"fields": fields, "samples": m.n, "bins": bins, "pairs": pairs, "nonlinear_pairs": [p for p in pairs if p["nonlinear_flag"]]}


def copula_tail(df: DataFrame, a: str, b: str, tail: float = 0.05, band: int = 500) -> dict:
    """Tail shares of rank-uniform values, and Kendall's tau over pairs fewer than ``band`` rows apart (in the order of _row_id, else of the values)."""
    keep = ["_row_id"] if "_row_id" in df.columns else []
    rows = df.select(*keep, permissive(df, a).alias("a"), permissive(df, b).alias("b")).dropna()
    ranked = average_ranks(rows, ["a", "b"])
    n = rows.count()
    if n < 30:
        return {"error": "at least 30 complete rows"}
    u, v = F.col("r_a") / (n + 1), F.col("r_b") / (n + 1)
    x = ranked.agg(F.count_if((u > 1 - tail) & (v > 1 - tail)), F.count_if((u < tail) & (v < tail)), F.corr("r_a", "r_b"), F.corr("a", "b")).first()
    numbered = numbered_rows(rows, keep or ["a", "b"]).select("_n", "a", "b").withColumn("_block", F.floor(F.col("_n") / band))
    other = numbered.toDF("m", "c", "d", "blk").withColumn("blk", F.explode(F.array("blk", F.col("blk") - 1)))
    near = numbered.join(other, (F.col("_block") == F.col("blk")) & (F.col("m") > F.col("_n")) & (F.col("m") < F.col("_n") + band))
    sign = F.signum((F.col("a") - F.col("c")) * (F.col("b") - F.col("d")))
    k = near.agg(F.count_if(sign > 0), F.count_if(sign < 0)).first()
    upper, lower = x[0] / (n * tail), x[1] / (n * tail)
    tau = (k[0] - k[1]) / (k[0] + k[1]) if k[0] + k[1] else 0.0
    return {"field_a": a, "field_b": b, "samples": n, "upper_tail_dependence": r(upper, 4), "lower_tail_dependence": r(lower, 4), "tail_asymmetry": r(upper - lower, 4), "kendall_tau": r(tau, 4), "spearman_rho": r(x[2] or 0.0, 4), "pearson_r": r(x[3] or 0.0, 4)}


def numbered_rows(df: DataFrame, by: list[str]) -> DataFrame:
    """Adds _n = 0, 1, ... in the order of ``by``: ranges are numbered apart, then offset by the ranges before them."""
    local = F.row_number().over(Window.partitionBy("_part").orderBy(*by))
    return with_offsets(ranged(df, by), F.lit(1)).withColumn("_n", F.col("_offset") + local - 1).drop("_part", "_offset")


def polynomial_test(df: DataFrame, x: str, y: str, max_degree: int = 3) -> dict:
    rows = complete(df, [x, y])
    s = rows.agg(F.avg(x), F.stddev_pop(x)).first()
    z = (F.col(x) - F.lit(s[0] or 0.0)) / F.lit(s[1] or 1.0)  # the same span as x, better conditioned
    m = Moments(rows, {"y": F.col(y)} | {f"p{d}": F.pow(z, F.lit(float(d))) for d in range(1, max_degree + 1)})
    if m.n < 10:
        return {"error": "at least 10 complete rows"}
    fits = [m.r2("y", [f"p{i}" for i in range(1, d + 1)]) for d in range(1, max_degree + 1)]
    best = 0
    for d in range(1, max_degree):
        if fits[d] > fits[best] + 0.02:
            best = d
    return {"field_x": x, "field_y": y, "samples": m.n, **{f"degree_{d + 1}_r2": r(f, 6) for d, f in enumerate(fits)}, "best_degree": best + 1, "curvature_gain": r(max(fits) - fits[0], 6)}


def interaction_screen(df: DataFrame, target: str, candidates: list[str], top: int = 5) -> dict:
    rows, pairs = complete(df, [target, *candidates]), list(combinations(candidates, 2))
    m = Moments(rows, {c: F.col(c) for c in [target, *candidates]} | {f"{a}*{b}": F.col(a) * F.col(b) for a, b in pairs})
    if m.n < 15:
        return {"error": "at least 15 complete rows"}
    out = []
    for a, b in pairs:
        ra, rb, joint = m.r2(target, [a]), m.r2(target, [b]), m.r2(target, [a, b, f"{a}*{b}"])
        gain = joint - m.r2(target, [a, b])
        better = joint > max(ra, rb)
        kind = "synergy" if better and gain > 0.02 else "suppression" if not better and gain < -0.02 else "additive"
        out.append({"field_a": a, "field_b": b, "r2_a": r(ra, 4), "r2_b": r(rb, 4), "r2_joint": r(joint, 4), "interaction_strength": r(gain, 4), "interaction_type": kind})
    return {"target": target, "samples": m.n, "interactions": sorted(out, key=lambda x: -abs(x["interaction_strength"]))[:top], "total_pairs_tested": len(pairs)}


def feature_importance(df: DataFrame, target: str, candidates: list[str]) -> dict:
    """The fall of R2 when a column is shuffled: its expectation over all shuffles, from moments (a shuffled column keeps its variance and loses its covariances)."""
    m = moments(df, [target, *candidates])
    if m.n < 15:
        return {"error": "at least 15 complete rows"}
    b = m.beta(target, candidates)
    if b is None:
        return {"error": "singular design"}
    g, (t,) = m.at(candidates), m.at([target])
    base = m.r2(target, candidates)
    out = []
    for i, c in enumerate(candidates):
        cov = m.cov.copy()
        k = g[i]
        own = cov[k, k]
        cov[k, :] = cov[:, k] = 0
        cov[k, k] = own
        left = cov[t, t] - 2 * b @ cov[g, t] + b @ cov[np.ix_(g, g)] @ b
        out.append({"field": c, "importance_score": r(float(base - (1 - left / cov[t, t])), 6), "baseline_r2": r(base, 6)})
    return {"target": target, "samples": m.n, "baseline_r2": r(base, 6), "importances": sorted(out, key=lambda x: -x["importance_score"])}


def information_bottleneck(df: DataFrame, inputs: list[str], target: str, beta: float = 1.0, clusters: int = 5, bins: int = 8) -> dict:
    """Hard clustering of the inputs' joint states that keeps what they say of the target; states and bins bound the driver's work."""
    rows = complete(df, [*inputs, target])
    binned = rows.select(F.concat_ws("|", *(bucket(F.col(c), quantile_edges(rows, c, bins)).cast("string") for c in inputs)).alias("s"), bucket(F.col(target), quantile_edges(rows, target, bins)).alias("y"))
    cells = binned.groupBy("s", "y").count().orderBy("s", "y").collect()
    n = sum(x["count"] for x in cells)
    if n < 20:
        return {"error": "at least 20 complete rows"}
    states = sorted({x.s for x in cells})
    joint = np.zeros((len(states), bins))
    for x in cells:
        joint[states.index(x.s), x.y] = x["count"] / n
    px, py = joint.sum(1), joint.sum(0)
    given = joint / px[:, None]
    k = min(clusters, len(states))
    at = np.arange(len(states)) % k

    def info(j: np.ndarray) -> float:
        a, b = j.sum(1, keepdims=True), j.sum(0, keepdims=True)
        return float((j[j > 0] * np.log(j[j > 0] / (a * b)[j > 0])).sum())

    for _ in range(100):
        weight = np.bincount(at, px, k)
        center = np.stack([np.bincount(at, joint[:, i], k) for i in range(bins)], 1) / np.maximum(weight, 1e-12)[:, None]
        with np.errstate(divide="ignore", invalid="ignore"):
            kl = np.where(given[:, None] > 0, given[:, None] * np.log(given[:, None] / np.maximum(center[None], 1e-12)), 0).sum(-1)
        new = (beta * kl - np.log(np.maximum(weight, 1e-12))[None]).argmin(1)
        if (new == at).all():
            break
        at = new
    small = np.stack([np.bincount(at, joint[:, i], k) for i in range(bins)], 1)
    full, kept = info(joint), info(small[small.sum(1) > 0])
    hx, hc = entropy(px), entropy(small.sum(1))
    return {"input_fields": inputs, "target": target, "samples": n, "n_clusters": int((small.sum(1) > 0).sum()), "beta": beta, "preserved_info": r(kept / full if full > 0 else 0.0, 6), "compression_ratio": r(1 - hc / hx if hx > 0 else 0.0, 6), "mi_compressed_target": r(kept, 6), "mi_full_target": r(full, 6), "target_entropy": r(entropy(py), 6)}


def distribution(df: DataFrame, field: str, bins: int = 15) -> dict:
    rows = complete(df, [field])
    q = [0.05, 0.25, 0.5, 0.75, 0.95]
    x = rows.agg(F.count("*"), F.avg(field), F.stddev_pop(field), F.skewness(field), F.kurtosis(field), F.min(field), F.max(field)).first()
    n, mean, std, skew, kurt, low, high = x
    if n < 5:
        return {"error": "at least 5 numbers"}
    quant = percentiles(rows, field, q)
    skew, kurt, width = skew or 0.0, kurt or 0.0, (high - low) / bins
    skew, kurt = (0.0, 0.0) if std <= 1e-12 else (skew, kurt)
    at = F.least(F.floor((F.col(field) - low) / width), F.lit(bins - 1)) if width > 0 else F.lit(0)
    counts = dict(tuple(t) for t in rows.groupBy(at.cast("int").alias("b")).count().collect())
    histogram = [counts.get(i, 0) for i in range(bins)]
    jb = n / 6 * (skew**2 + kurt**2 / 4)
    if abs(skew) < 0.5 and abs(kurt) < 1:
        shape = "normal"
    elif abs(skew) > 1:
        shape = "right_skewed" if skew > 0 else "left_skewed"
    elif kurt > 3:
        shape = "heavy_tailed"
    elif abs(skew) < 0.3 and kurt < -1:
        shape = "uniform"
    else:
        shape = "bimodal" if sum(x < y > z for x, y, z in zip(histogram, histogram[1:], histogram[2:])) > 1 else "moderate_skew"
    return {"field": field, "count": n, "mean": r(mean, 6), "median": r(quant[2], 6), "std": r(std, 6), "skewness": r(skew, 4), "kurtosis": r(kurt, 4), "min": r(low, 6), "max": r(high, 6), "quantiles": {f"p{int(p * 100)}": r(v, 6) for p, v in zip(q, quant)}, "histogram": {"edges": [r(low + i * (width or 1.0), 6) for i in range(bins + 1)], "counts": histogram}, "normality_pvalue": r(math.exp(-jb / 2), 6), "shape_label": shape}


def outliers(df: DataFrame, fields: list[str], method: str = "both", threshold: float | None = None, z_limit: float = 3.0, iqr: float = 1.5, top: int = 50) -> dict:
    """Rows outside z-score or quartile fences; a threshold replaces the z-score alone. Row severity is the sum of |z| over flagged fields."""
    z_limit, fields = threshold or z_limit, fields[:20]
    if "_row_id" not in df.columns:
        df = df.withColumn("_row_id", F.monotonically_increasing_id())
    values = df.select("_row_id", *(permissive(df, f).alias(f) for f in fields))
    x = values.agg(*(e for f in fields for e in (F.count(f), F.avg(f), F.stddev_pop(f)))).first()
    summaries, severity, flags = [], [], []
    for i, f in enumerate(fields):
        n, mean, std = x[3 * i : 3 * i + 3]
        if n < 5:
            continue
        q = percentiles(values, f, [0.25, 0.75])
        z = (F.col(f) - F.lit(mean)) / F.lit(std) if std else F.lit(0.0)
        fence = iqr * (q[1] - q[0])
        by_z, by_q = F.abs(z) > z_limit, (F.col(f) < q[0] - fence) | (F.col(f) > q[1] + fence)
        hit = F.coalesce({"zscore": by_z, "iqr": by_q}.get(method, by_z | by_q), F.lit(False))
        severity.append(F.when(hit, F.abs(z)).otherwise(0.0))
        flags += [F.count_if(hit & (F.col(f) > mean)).alias(f"h{i}"), F.count_if(hit & (F.col(f) <= mean)).alias(f"l{i}"), F.max(F.lit(n)).alias(f"n{i}")]
        summaries.append(i)
    if not summaries:
        return {"error": "at least 5 numbers in a field"}
    counts = values.agg(*flags, F.count("*").alias("rows")).first()
    flagged = values.select("_row_id", sum(severity[1:], severity[0]).alias("severity")).where("severity > 0")
    rows = flagged.orderBy(F.desc("severity"), "_row_id").limit(top).collect()
    bad = flagged.count()
    out = [{"field": fields[i], "outlier_count": counts[f"h{i}"] + counts[f"l{i}"], "high": counts[f"h{i}"], "low": counts[f"l{i}"], "total_values": counts[f"n{i}"]} for i in summaries]
    return {"method": method, "z_threshold": z_limit, "iqr_multiplier": iqr, "field_summaries": out, "top_flagged_rows": [{"row_index": x[0], "severity": r(x[1], 4)} for x in rows], "data_quality_score": r(1 - bad / counts["rows"], 4)}


def benford(df: DataFrame, field: str) -> dict:
    v = permissive(df, field)
    digit = F.regexp_extract(F.abs(v).cast("string"), "[1-9]", 0)
    counts = dict(tuple(x) for x in df.select(digit.alias("d")).where((F.col("d") != "") & v.isNotNull() & (v != 0)).groupBy("d").count().collect())
    n = sum(counts.values())
    if n < 50:
        return {"error": "at least 50 values other than zero"}
    expected = {d: math.log10(1 + 1 / d) for d in range(1, 10)}
    chi = sum((counts.get(str(d), 0) - n * e) ** 2 / (n * e) for d, e in expected.items())
    p = chi2_p(chi, 8)
    digits = [{"digit": d, "observed_pct": r(100 * counts.get(str(d), 0) / n, 2), "expected_pct": r(100 * e, 2), "deviation": r(100 * (counts.get(str(d), 0) / n - e), 2)} for d, e in expected.items()]
    return {"field": field, "sample_size": n, "chi_squared": r(chi, 4), "p_value": r(p, 6), "conformity_label": "conforms" if p > 0.1 else "suspicious" if p > 0.01 else "fails", "digits": digits}


def vif(df: DataFrame, fields: list[str], limit: float = 10.0) -> dict:
    fields = fields[:20]
    m, out = moments(df, fields), []
    for f in fields:
        r2 = m.r2(f, [g for g in fields if g != f])
        v = min(999.0, 1 / (1 - r2)) if r2 < 1 else 999.0
        out.append({"field": f, "vif": r(v, 4), "r2_with_others": r(r2, 6), "collinear": v > limit})
    return {"fields": fields, "samples": m.n, "vif_results": out, "drop_candidates": [x["field"] for x in out if x["collinear"]], "threshold": limit}


class Lcg:
    """The 48-bit linear congruential generator of the Java library's documentation."""

    def __init__(self, seed: int):
        self.state = (seed ^ 0x5DEECE66D) & ((1 << 48) - 1)

    def bits(self, n: int) -> int:
        self.state = (self.state * 0x5DEECE66D + 0xB) & ((1 << 48) - 1)
        x = self.state >> (48 - n)
        return x - (1 << n) if n == 32 and x >= 1 << 31 else x

    def next_int(self, bound: int) -> int:
        if bound & (bound - 1) == 0:
            return (bound * self.bits(31)) >> 31
        while True:
            x = self.bits(31)
            if x - x % bound + bound - 1 < 1 << 31:
                return x % bound


def cluster(df: DataFrame, fields: list[str], k: int | None = None, max_k: int = 8, inits: int = 5, rounds: int = 100, judged: int = 500) -> dict:
    """k-means on z-scores, Lloyd steps as aggregates; without k the one of the best silhouette over ``judged`` rows."""
    fields = fields[:15]
    rows = complete(df, fields)
    m = Moments(rows, {f: F.col(f) for f in fields})
    if m.n < 10:
        return {"error": "at least 10 complete rows"}
    std = np.sqrt(np.diag(m.cov))
    std = np.where(std > 0, std, 1.0)
    z = F.array(*((F.col(f) - F.lit(float(a))) / F.lit(float(b)) for f, a, b in zip(fields, m.mean, std)))
    points = rows.select(z.alias("z")).cache()
    few = np.array([x.z for x in points.orderBy("z").limit(judged).collect()]) if m.n <= judged else np.array([x.z for x in points.orderBy(F.xxhash64("z"), "z").limit(judged).collect()])

    def nearest(centers: np.ndarray) -> Column:
        gaps = [sum(((F.col("z")[i] - F.lit(float(c[i]))) * (F.col("z")[i] - F.lit(float(c[i]))) for i in range(len(fields))), F.lit(0.0)) for c in centers]
        return F.array_position(F.array(*gaps), F.array_min(F.array(*gaps))).cast("int") - 1

    def lloyd(start: np.ndarray) -> np.ndarray:
        centers = start
        for _ in range(rounds):
            got = {x.c: np.array(x[1:]) for x in points.select(nearest(centers).alias("c"), "z").groupBy("c").agg(*(F.avg(F.col("z")[i]) for i in range(len(fields)))).collect()}
            new = np.array([got.get(i, c) for i, c in enumerate(centers)])
            if np.abs(new - centers).max() < 1e-9:
                break
            centers = new
        return centers

    def local(start: np.ndarray) -> tuple[float, np.ndarray]:
        centers = start
        for _ in range(rounds):
            at = ((few[:, None] - centers[None]) ** 2).sum(-1).argmin(1)
            new = np.array([few[at == i].mean(0) if (at == i).any() else centers[i] for i in range(len(centers))])
            if np.allclose(new, centers):
                break
            centers = new
        return float(((few[:, None] - centers[None]) ** 2).sum(-1).min(1).sum()), centers

    def silhouette(centers: np.ndarray) -> float:
        at = ((few[:, None] - centers[None]) ** 2).sum(-1).argmin(1)
        gap = np.sqrt(((few[:, None] - few[None]) ** 2).sum(-1))
        total = 0.0
        for i in range(len(few)):
            own = at == at[i]
            if own.sum() < 2:
                continue
            a = gap[i][own].sum() / (own.sum() - 1)
            b = min((gap[i][at == c].mean() for c in set(at.tolist()) - {int(at[i])}), default=a)
            total += (b - a) / max(a, b) if max(a, b) > 0 else 0.0
        return total / len(few)

    rng, best = Lcg(42), (-2.0, np.zeros((1, len(fields))))
    for n in [k] if k else range(2, min(max_k, len(few) - 1) + 1):
        _, centers = min((local(few[[rng.next_int(len(few)) for _ in range(n)]]) for _ in range(inits)), key=lambda x: x[0])
        best = max(best, (silhouette(centers), centers), key=lambda x: x[0])
    centers = lloyd(best[1])
    sizes = dict(tuple(x) for x in points.groupBy(nearest(centers).alias("c")).count().collect())
    points.unpersist()
    out = [{"cluster": i, "size": sizes.get(i, 0), **{f"{f}_centroid": r(float(c[j] * std[j] + m.mean[j]), 4) for j, f in enumerate(fields)}} for i, c in enumerate(centers)]
    return {"fields": fields, "samples": m.n, "k": len(centers), "silhouette_score": r(silhouette(centers), 4), "clusters": out}


def series(df: DataFrame, field: str, order_by: str, lexical: bool = True) -> DataFrame:
    """_n, v, o: the field's numbers in the order of another column, by its text unless ``lexical`` is off."""
    o = F.col(f"`{order_by}`")
    key = o.cast("string") if lexical else o
    tie = [F.col("_row_id")] if "_row_id" in df.columns else []
    rows = df.select(permissive(df, field).alias("v"), key.alias("o"), *tie).where("v is not null and o is not null")
    return numbered_rows(rows, ["o", *(["_row_id"] if tie else ["v"])]).select("_n", "v", "o")


def in_blocks(s: DataFrame, before: int, after: int, least: int = 10_000) -> tuple[DataFrame, Column, Window]:
    """The series in blocks of rows (column b), each with so many rows before and after it; whether a row is its block's own; a window over a block."""
    size = max(least, 4 * (before + after))
    block = F.floor(F.col("_n") / size)
    shared = s.withColumn("b", F.explode(F.array_distinct(F.array(block, F.floor((F.col("_n") + before) / size), F.floor((F.col("_n") - after) / size)))))
    return shared, F.col("b") == block, Window.partitionBy("b").orderBy("_n")


def autocorrelation(df: DataFrame, field: str, order_by: str, max_lag: int | None = None, lexical: bool = True) -> dict:
    """Rows without a number or an order value are left out; all lags come from one pass over blocks of rows."""
    s = series(df, field, order_by, lexical).select("_n", "v")
    n, mean, var = s.agg(F.count("*"), F.avg("v"), F.var_pop("v")).first()
    if n < 30:
        return {"error": "at least 30 numbers"}
    if var < 1e-12:
        return {"error": "a constant series"}
    most = max_lag or min(20, n // 3)
    shared, own, w = in_blocks(s, 0, most)
    later = shared.select(own.alias("own"), (F.col("v") - mean).alias("v"), *((F.lead("v", k).over(w) - mean).alias(f"w{k}") for k in range(1, most + 1)))
    sums = later.where("own").agg(*(F.sum(F.col("v") * F.col(f"w{k}")) for k in range(1, most + 1))).first()
    acf = [r((x or 0.0) / n / var, 4) for x in sums]
    limit = 2 / math.sqrt(n)
    significant = [k for k, x in enumerate(sums, 1) if abs((x or 0.0) / n / var) > limit]
    peak = next((k + 1 for k in range(1, most - 1) if acf[k] > max(acf[k - 1], acf[k + 1], limit)), None)
    # whether the first lags fall off
    falls = abs(acf[0] - acf[4]) > 0.3 if most > 4 else True
    return {"field": field, "samples": n, "acf_values": [{"lag": k, "acf": x} for k, x in enumerate(acf, 1)], "significant_lags": significant, "significance_threshold": r(limit, 4), "dominant_period": peak, "is_stationary_hint": falls}


def changepoints(df: DataFrame, field: str, order_by: str, segment: int = 10, threshold: float = 2.0, lexical: bool = True) -> dict:
    """Places where the means of the segments before and after differ by over ``threshold`` deviations; the next starts a segment later."""
    s = series(df, field, order_by, lexical)
    n, mean, std = s.agg(F.count("*"), F.avg("v"), F.stddev_pop("v")).first()
    if n < 20:
        return {"error": "at least 20 numbers"}
    out = {"field": field, "samples": n, "changepoints": []}
    if std < 1e-12:
        return out
    shared, own, w = in_blocks(s, segment, segment)
    near = shared.withColumn("before", F.avg("v").over(w.rowsBetween(-segment, -1))).withColumn("after", F.avg("v").over(w.rowsBetween(0, segment - 1)))
    hits = near.where(own & (F.col("_n") >= segment) & (F.col("_n") < n - segment) & (F.abs(F.col("after") - F.col("before")) / std > threshold))
    last = -segment
    for x in hits.orderBy("_n").toLocalIterator():
        if x._n >= last + segment:
            last = x._n
            size_ = abs(x.after - x.before) / std
            out["changepoints"].append({"index": x._n, "order_value": x.o, "mean_before": r(x.before, 4), "mean_after": r(x.after, 4), "magnitude": r(size_, 4), "confidence": r(min(1.0, size_ / (2 * threshold)), 4)})
    return out | {"global_mean": r(mean, 4), "global_std": r(std, 4)}


def ergodicity(df: DataFrame, field: str, order_by: str, windows: tuple = (10, 25, 50, 100), lexical: bool = True) -> dict:
    """How the means of half-overlapping windows spread about the whole mean; how that falls from the first window size to the last, against what independence predicts."""
    s = series(df, field, order_by, lexical)
    n, mean, std = s.agg(F.count("*"), F.avg("v"), F.stddev_pop("v")).first()
    if n < 30:
        return {"error": "at least 30 numbers"}
    out = []
    for w in (w for w in windows if w < n):
        half = max(1, w // 2)
        low, high = F.greatest(F.lit(0), F.floor((F.col("_n") - w) / half) + 1), F.least(F.floor(F.col("_n") / half), F.lit((n - w) // half))
        means = s.where(high >= low).withColumn("c", F.explode(F.sequence(low, high))).groupBy("c").agg(F.avg("v").alias("m"))
        k, center, spread = means.agg(F.count("*"), F.avg("m"), F.sqrt(F.avg((F.col("m") - mean) ** 2))).first()
        out.append({"window": w, "mean_of_means": r(center, 4), "spread_of_means": r(spread, 4), "n_chunks": k})
    ratio = 1.0
    if len(out) > 1 and out[0]["spread_of_means"] > 1e-12:
        ratio = out[-1]["spread_of_means"] / out[0]["spread_of_means"] / math.sqrt(out[0]["window"] / out[-1]["window"])
    return {"field": field, "samples": n, "ensemble_mean": r(mean, 4), "ensemble_std": r(std, 4), "time_averages_by_window": out, "ergodicity_ratio": r(ratio, 4), "is_ergodic": 0.5 < ratio < 2}


def entropy_spectrum(df: DataFrame, field: str, order_by: str, max_scale: int = 10, m: int = 2, most: int = 20_000, lexical: bool = True) -> dict:
    """Multiscale sample entropy. It compares all pairs of places, so longer series than ``most`` are refused, not cut."""
    s = series(df, field, order_by, lexical)
    n, std = s.agg(F.count("*"), F.stddev_pop("v")).first()
    if n < 50 or n > most:
        return {"error": f"from 50 to {most} numbers"}
    tolerance = 0.15 * (std if std > 1e-12 else 1.0)
    values = np.array([x.v for x in s.orderBy("_n").collect()])

    def matches(x: np.ndarray, width: int) -> int:
        view = np.lib.stride_tricks.sliding_window_view(x, width)[: len(x) - width]
        return sum(int((np.abs(view[i + 1 :] - view[i]).max(1) <= tolerance).sum()) for i in range(len(view) - 1))

    out = []
    for scale in range(1, max_scale + 1):
        x = values[: len(values) // scale * scale].reshape(-1, scale).mean(1)
        if len(x) < m + 5:
            break
        longer, shorter = matches(x, m + 1), matches(x, m)
        out.append({"scale": scale, "sample_entropy": r(-math.log(longer / shorter), 4) if longer and shorter else 0.0, "series_length": len(x)})
    found = [x["sample_entropy"] for x in out]
    kind = "insufficient_data"
    if len(found) >= 3:
        falls, rises = found[0] > 1.5 * found[-1], found[-1] > 1.5 * found[0]
        kind = "decreasing" if falls else "increasing" if rises else "scale_invariant" if max(found) / (min(found) + 1e-12) < 1.3 else "mixed"
    return {"field": field, "samples": n, "embedding_dim": m, "tolerance": r(tolerance, 4), "entropy_spectrum": out, "complexity_type": kind}


def rank_gaps(rows: DataFrame, fields: list[str], n: int, block: int = 1 << 18) -> dict[tuple[str, str], float]:
    """For each pair of fields the largest difference of their values of one rank, over ``n`` complete rows.

    Only counts by value are ranked: a value holds a run of ranks, and a pair's difference changes only where a run of either begins.
    Runs are cut at blocks of ranks, so that each block of all fields is gone through on its own.
    """
    each = F.explode(F.array(*(F.struct(F.lit(i).alias("f"), F.col(f"`{f}`").alias("v")) for i, f in enumerate(fields))))
    counts = rows.select(each.alias("x")).groupBy("x.f", "x.v").agg(F.count("*").alias("c")).persist()
    try:
        w = Window.partitionBy("_part").orderBy("f", "v").rowsBetween(Window.unboundedPreceding, -1)
        begins = F.col("_offset") + F.coalesce(F.sum("c").over(w), F.lit(0)) - F.col("f") * F.lit(n)
        runs = with_offsets(ranged(counts, ["f", "v"]), F.col("c")).withColumn("at", begins)
        of = lambda place: F.floor(place / F.lit(block))
        cut = runs.withColumn("block", F.explode(F.sequence(of(F.col("at")), of(F.col("at") + F.col("c") - 1))))
        cut = cut.select("block", F.greatest("at", F.col("block") * block).alias("at"), *(F.when(F.col("f") == i, F.col("v")).alias(f"v{i}") for i in range(len(fields))))
        until = Window.partitionBy("block").orderBy("at").rangeBetween(Window.unboundedPreceding, Window.currentRow)
        held = cut.select(*(F.last(f"v{i}", True).over(until).alias(f"v{i}") for i in range(len(fields))))
        pairs = list(combinations(range(len(fields)), 2))
        gaps = held.agg(*(F.max(F.abs(F.col(f"v{i}") - F.col(f"v{j}"))) for i, j in pairs)).first()
    finally:
        counts.unpersist()
    return {(fields[i], fields[j]): gap for (i, j), gap in zip(pairs, gaps)}


def symmetry_scan(df: DataFrame, fields: list[str]) -> dict:
    """Fields whose values lie alike on either side of the mean, and pairs whose sorted values hardly differ. Constant fields have no reflection."""
    if len(fields) < 2:
        return {"error": "at least two fields"}
    if len(fields) > 15:
        raise ValueError("at most 15 fields")
    rows = complete(df, fields)
    x = rows.agg(F.count("*").alias("n"), *(e for f in fields for e in (F.skewness(f).alias(f"skew_{f}"), F.stddev_pop(f).alias(f"std_{f}"), F.max(F.abs(f)).alias(f"most_{f}")))).first()
    if x.n < 20:
        return {"error": "at least 20 complete rows"}
    found = [{"type": "reflection_symmetry", "field": f, "skewness": r(x[f"skew_{f}"], 4)} for f in fields if x[f"std_{f}"] >= 1e-12 and abs(x[f"skew_{f}"]) < 0.2]
    for (a, b), most in rank_gaps(rows, fields, x.n).items():
        gap = most / max(x[f"most_{a}"], x[f"most_{b}"], 1e-12)
        if gap < 0.1:
            found.append({"type": "permutation_symmetry", "field_a": a, "field_b": b, "ks_distance": r(gap, 4)})
    return {"fields": fields, "samples": x.n, "symmetries": found, "total_symmetries_found": len(found)}


__all__ = [n for n, f in list(globals().items()) if callable(f) and getattr(f, "__module__", "") == __name__] + ["below", "fit_linear"]
