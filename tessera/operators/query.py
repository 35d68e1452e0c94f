"""Filters from JSON clauses, sorted pages, aggregates and grouping.

A dataset's row order is its ``_row_id`` column where it has one; sorts end with it, so pages are stable.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.numeric import NUMERIC, below, finite, permissive, rounded, to_float

FUNCTIONS = ("sum", "mean", "median", "min", "max", "std", "count", "count_distinct")
OPERATORS = ("=", "!=", ">", "<", ">=", "<=", "contains", "in", "not_in")
PAGE, GROUPS, AGGREGATES, DEPTH = 50, 50, 20, 20


class InvalidClause(ValueError):
    pass


def is_numeric(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, NUMERIC)


def leaf(df: DataFrame, column: str, op: str, value: object) -> Column:
    """Nulls equal nulls and differ from all else, so "!=" and "not_in" match them; they are neither above nor below anything."""
    if op not in OPERATORS:
        raise InvalidClause(f"unknown operator {op!r}")
    known = column in df.columns
    numeric = known and is_numeric(df, column)
    c = permissive(df, column) if numeric else F.col(f"`{column}`") if known else F.lit(None).cast("string")
    literal = (lambda v: F.lit(to_float(v)).cast("double")) if numeric else (lambda v: F.lit(v if v is None or isinstance(v, str) else json.dumps(v)))
    if not numeric and not isinstance(df.schema[column].dataType if known else T.StringType(), T.StringType):
        c = c.cast("string")
    if op == "=":
        return c.eqNullSafe(literal(value))
    if op == "!=":
        return ~c.eqNullSafe(literal(value))
    if op == "contains" and numeric:  # the texts of both as doubles: 15.0 holds 5.0 and not 1
        return F.coalesce(F.contains(c.cast("string"), literal(value).cast("string")), F.lit(False))
    if op == "contains":
        return F.coalesce(F.contains(F.lower(c.cast("string")), F.lower(F.lit(str(value)))), F.lit(False))
    if op in ("in", "not_in"):
        values = value if isinstance(value, list) else [value]
        inside = reduce(lambda a, b: a | b, [c.eqNullSafe(literal(v)) for v in values], F.lit(False))
        return inside if op == "in" else ~inside
    lit = literal(value)
    test = {">": c > lit, "<": c < lit, ">=": c >= lit, "<=": c <= lit}[op]
    return F.coalesce(test, F.lit(False))


def predicate(df: DataFrame, clause: dict, depth: int = 0, max_clauses: int | None = None) -> Column:
    """A clause is {column, op, value}, {"and": [...]}, {"or": [...]} or {} (all rows); "and" goes before "or"."""
    if depth > DEPTH:
        raise InvalidClause("clauses are nested too deeply")
    if not isinstance(clause, dict):
        raise InvalidClause("a clause is an object")
    if not clause:
        return F.lit(True)
    for word, start, join in (("and", True, lambda a, b: a & b), ("or", False, lambda a, b: a | b)):
        if word in clause:
            return reduce(join, [predicate(df, x, depth + 1, max_clauses) for x in clause[word][:max_clauses]], F.lit(start))
    if "column" not in clause:
        raise InvalidClause(f"unknown clause {sorted(clause)}")
    return leaf(df, clause["column"], clause.get("op", "="), clause.get("value"))


def plain_number(value: object) -> float | None:
    """A number or a text that is one as it stands."""
    try:
        return float(str(value)) if "_" not in str(value) and not isinstance(value, bool) else None
    except ValueError:
        return None


def filter_by_condition(df: DataFrame, column: str, op: str, value: object) -> DataFrame:
    """One comparison that drops nulls; numeric, equal within 1e-9, if both sides are numbers as they stand ("$1,000" isn't), else by text."""
    number, text = plain_number(value), F.col(f"`{column}`").cast("string")
    v, x = F.trim(text).try_cast("double"), F.lit(number).cast("double")
    near = F.abs(v - x) < 1e-9
    as_number = {"=": near, "!=": ~near, ">": v > x, "<": v < x, ">=": v >= x, "<=": v <= x}.get(op, F.lit(False))
    as_text = {"=": text == str(value), "!=": text != str(value)}.get(op, F.lit(False))
    return df.where(text.isNotNull() & F.when(v.isNotNull() & x.isNotNull(), as_number).otherwise(as_text))


def order(df: DataFrame, column: str, descending: bool = True) -> list[Column]:
    """Numbers: ascending nulls last, descending nulls first. Other kinds: by their text, null as "null"."""
    if is_numeric(df, column):
        v = permissive(df, column)
        first = v.desc_nulls_first() if descending else v.asc_nulls_last()
    else:
        v = F.coalesce(F.col(f"`{column}`").cast("string"), F.lit("null"))
        first = v.desc() if descending else v.asc()
    return [first] + [F.col(c) for c in ("_row_id",) if c in df.columns]


def project(df: DataFrame, columns: list[str] | None) -> DataFrame:
    """Known columns in the table's order."""
    keep = [c for c in df.columns if c != "_row_id" and (not columns or c in columns)]
    return df.select(*(f"`{c}`" for c in keep))


def page(df: DataFrame, sort_by: str | None = None, descending: bool = True, offset: int = 0, limit: int = 25, columns: list[str] | None = None, most: int = PAGE) -> DataFrame:
    if sort_by in df.columns:
        df = df.orderBy(*order(df, sort_by, descending))
    elif "_row_id" in df.columns:
        df = df.orderBy("_row_id")
    return project((df.offset(offset) if offset else df).limit(max(0, min(limit, most))), columns)


def query(df: DataFrame, where: str | dict | None = None, sort_by: str | None = None, descending: bool = True, limit: int = 25, columns: list[str] | None = None) -> DataFrame:
    clause = json.loads(where) if isinstance(where, str) and where else where or {}
    return page(df.where(predicate(df, clause)), sort_by, descending, 0, limit, columns)


def aggregate(df: DataFrame, column: str, func: str) -> Column:
    """One aggregate. count takes what is neither null nor ""; count_distinct the texts of what isn't null. sum, mean, std and an even median have 4 digits."""
    if func not in FUNCTIONS:
        raise ValueError(f"unknown function {func!r}")
    text = F.col(f"`{column}`").cast("string")
    if func == "count":
        return F.count(F.when(text != "", F.lit(1)))
    if func == "count_distinct":
        return F.countDistinct(text)
    v = permissive(df, column)
    if func == "median":
        return F.when(F.count(v) % 2 == 0, rounded(F.median(v), 4)).otherwise(F.median(v))
    return {"sum": rounded(F.sum(v), 4), "mean": rounded(F.avg(v), 4), "std": rounded(F.stddev_pop(v), 4), "min": F.min(v), "max": F.max(v)}[func]


def aggregates(df: DataFrame, column: str, funcs: list[str]) -> DataFrame:
    """Several aggregates of a whole column as one row. The median and the distinct count come from counts by value, which are shuffled by value and ranked in
    ranges, so no task holds all values."""
    if unknown := [f for f in funcs if f not in FUNCTIONS]:
        raise ValueError(f"unknown functions {unknown}")
    v, text = permissive(df, column), F.col(f"`{column}`").cast("string")
    counts = df.groupBy(text.alias("t"), v.alias("v")).agg(F.count("*").alias("n"))
    plain = df.agg(*(aggregate(df, column, f).alias(f) for f in funcs if f not in ("median", "count_distinct")), F.count(v).alias("_n"))
    out = plain
    if "count_distinct" in funcs:
        out = out.crossJoin(counts.select("t").where("t is not null").distinct().agg(F.count("*").alias("count_distinct")))  # one row each
    if "median" in funcs:
        n = df.select(F.count(v)).first()[0]
        at = sorted({(n - 1) // 2, n // 2}) if n else []
        by_value = below(counts.where("v is not null").groupBy("v").agg(F.sum("n").alias("n")), "v", "n")
        hit = F.array(*(F.lit(a) for a in at)) if at else F.array().cast("array<int>")
        middle = by_value.select("v", F.size(F.filter(hit, lambda a: (a >= F.col("_below")) & (a < F.col("_below") + F.col("n")))).alias("w")).where("w > 0")
        half = F.sum(F.col("v") * F.col("w")) / F.sum("w")
        out = out.crossJoin(middle.agg((rounded(half, 4) if n % 2 == 0 else half).alias("median")))  # one row each
    return out.select(*funcs)


def group_by(df: DataFrame, keys: list[str], aggs: list[dict], sort_by: str | None = None, descending: bool = True, limit: int | None = GROUPS) -> DataFrame:
    """Partial and final aggregation by native columns; nulls are a group of their own. Sorted numerically, nulls last both ways, then by key."""
    if len(aggs) > AGGREGATES:
        raise ValueError(f"at most {AGGREGATES} aggregates")
    if missing := [k for k in keys if k not in df.columns]:
        raise ValueError(f"unknown columns {missing}")
    named = [aggregate(df, a["column"], a["func"]).alias(a.get("alias") or f"{a['func']}_{a['column']}") for a in aggs]
    out = df.groupBy(*keys).agg(*named)
    if sort_by in out.columns:
        c = F.col(f"`{sort_by}`")
        out = out.orderBy(c.desc_nulls_last() if descending else c.asc_nulls_last(), *keys)
    return out if limit is None else out.limit(limit)


__all__ = ["FUNCTIONS", "OPERATORS", "InvalidClause", "aggregate", "aggregates", "filter_by_condition", "finite", "group_by", "leaf", "order", "page", "predicate", "project", "query"]
