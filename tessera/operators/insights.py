"""What drives a column: the best driver, the rows that surprise, jumps between regimes, spread within buckets, a counterfactual."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import bucket, complete, permissive, quantile_edges, r
from .statistics import numeric_columns


def best_driver(df: DataFrame, target: str, drivers: list[str] | None = None, least: int = 3) -> dict:
    """The driver of the highest R2 (the first of equal ones); pairs of all drivers from one aggregate."""
    drivers = [d for d in (drivers or numeric_columns(df)) if d != target]
    v = {c: permissive(df, c) for c in [target, *drivers]}
    sums = [f for d in drivers for f in (F.regr_count(v[target], v[d]), F.regr_slope(v[target], v[d]), F.regr_intercept(v[target], v[d]), F.regr_r2(v[target], v[d]))]
    row, best = df.agg(*sums).first() if drivers else [], None
    for i, d in enumerate(drivers):
        n, slope, intercept, r2 = row[4 * i : 4 * i + 4]
        r2 = 0.0 if r2 is None or math.isnan(r2) else r2
        if n >= least and slope is not None and (best is None or r2 > best["r2"]):
            best = {"driver": d, "target": target, "slope": slope, "intercept": intercept, "r2": r2, "corr": math.copysign(math.sqrt(r2), slope), "samples": n}
    return best or {"error": "no driver with enough rows"}


def surprises(df: DataFrame, driver: str, target: str, top: int = 10, fit: dict | None = None) -> DataFrame:
    """The rows (by _row_id) farthest from the fitted line."""
    fit = fit or best_driver(df, target, [driver])
    rows = df.select(F.col("_row_id").alias("row_index"), permissive(df, target).alias("actual"), (F.lit(fit["intercept"]) + F.lit(fit["slope"]) * permissive(df, driver)).alias("expected")).dropna()
    rows = rows.withColumn("residual", F.col("actual") - F.col("expected"))
    std = rows.agg(F.stddev_pop("residual")).first()[0] or 1.0
    return rows.withColumn("residual_z", F.col("residual") / F.lit(std)).orderBy(F.abs("residual").desc(), "row_index").limit(top)


def regimes(df: DataFrame, driver: str, target: str, bins: int = 6, threshold: float = 1.0) -> list[dict]:
    """Neighbouring driver buckets whose target means differ by ``threshold`` deviations of these means or more."""
    rows = complete(df, [driver, target])
    edges = quantile_edges(rows, driver, bins)
    if len(edges) < 3:
        return []
    means = {x[0]: x[1] for x in rows.groupBy(bucket(F.col(driver), edges).alias("b")).agg(F.avg(target)).collect()}
    level = [means.get(i, 0.0) for i in range(bins)]
    jumps = [b - a for a, b in zip(level, level[1:])]
    center = sum(jumps) / len(jumps)
    std = math.sqrt(sum((j - center) ** 2 for j in jumps) / len(jumps))
    out = [{"between_bucket": f"{i}->{i + 1}", "driver_range": [edges[i], edges[i + 2]], "target_jump": r(j, 4), "jump_z": r(abs(j - center) / std if std else 0.0, 4)} for i, j in enumerate(jumps)]
    return [x for x in out if x["jump_z"] >= threshold]


def divergence(df: DataFrame, target: str, context: list[str], bins: int = 4, least_rows: int = 10, least_values: int = 5) -> list[dict]:
    """For each bucket of the target the mean spread of the context columns, relative to their means there, widest first.

    Buckets of fewer rows and columns of fewer values in a bucket are left out; a mean of almost 0 counts as 1.
    """
    values = df.select(permissive(df, target).alias("t"), *(permissive(df, c).alias(c) for c in context)).where("t is not null")
    edges = quantile_edges(values, "t", bins)
    if len(edges) < 2:
        return []
    spread = lambda c: F.when(F.count(c) >= least_values, (F.max(c) - F.min(c)) / F.when(F.abs(F.avg(c)) < 1e-12, 1.0).otherwise(F.abs(F.avg(c))))
    rows = values.groupBy(bucket(F.col("t"), edges).alias("b")).agg(F.count("*").alias("n"), F.array_compact(F.array(*map(spread, context))).alias("spreads")).orderBy("b").collect()  # a row for each bucket
    out = [{"target_quantile_bucket": x.b, "target_range": [r(edges[x.b], 6), r(edges[x.b + 1], 6)], "rows": x.n, "latent_spread_score": r(sum(x.spreads) / len(x.spreads), 6)} for x in rows if x.n >= least_rows and x.spreads]
    return sorted(out, key=lambda x: -x["latent_spread_score"])


def counterfactual(df: DataFrame, fit: dict, goal: str = "maximize", target_value: float | None = None) -> dict:
    """What the fitted law suggests to do with the driver, and the value of it at which the target would be reached."""
    slope, intercept, driver, target = fit["slope"], fit["intercept"], fit["driver"], fit["target"]
    up = slope < 0 if goal == "minimize" else slope > 0
    out = {
        "driver": driver,
        "target": target,
        "law": {"formula": f"{target} ≈ {slope:.6f} * {driver} + {intercept:.6f}", "r2": r(fit["r2"], 4), "corr": r(fit["corr"], 4)},
        "suggested_action": {"goal": goal, "driver_direction": "increase" if up else "decrease", "rationale": "the sign of the fitted slope and the goal give the direction"},
    }
    if target_value is not None and abs(slope) > 1e-9:
        now, mean, n = df.agg(F.avg(permissive(df, target)), F.coalesce(F.avg(permissive(df, driver)), F.lit(0.0)), F.count(permissive(df, target))).first()
        if n:
            needed = (target_value - intercept) / slope
            out["reach_value_estimate"] = {"current_target_mean": r(now, 6), "desired_target_value": r(target_value, 6), "required_driver_value": r(needed, 6), "delta_driver_from_mean": r(needed - mean, 6)}
    return out


def insights(df: DataFrame, target: str | None = None, goal: str = "maximize", target_value: float | None = None, top: int = 10, driver_limit: int = 20, context_limit: int = 6) -> dict:
    """The whole chain for one target (the first numeric column if none or another is named)."""
    numbers = numeric_columns(df)
    if not numbers:
        return {"error": "no numeric column"}
    target = target if target in numbers else numbers[0]
    if df.select(F.count(permissive(df, target))).first()[0] < 30:
        return {"error": "at least 30 numbers in the target"}
    others, limit = [c for c in numbers if c != target], max(top, 1)
    fit = best_driver(df, target, others[:driver_limit], 30)
    if "error" in fit:
        return fit
    found = surprises(df, fit["driver"], target, top, fit).collect() if "_row_id" in df.columns else []
    digits = {"slope": 6, "intercept": 6, "r2": 4, "corr": 4}
    return {
        "objective": {"target": target, "goal": goal, "target_value": target_value},
        "discovered_law": {k: r(v, digits[k]) if k in digits else v for k, v in fit.items()},
        "insights": {"surprises": [{k: r(v, 4) if isinstance(v, float) else v for k, v in x.asDict().items()} for x in found], "regime_boundaries": regimes(df, fit["driver"], target)[:limit], "branch_divergence": divergence(df, target, others[:context_limit])[:limit], "counterfactual": counterfactual(df, fit, goal, target_value)},
        "method_notes": ["one-driver linear law", "regimes from quantiles and jumps", "spread of other columns within buckets of the target"],
    }
