"""JSON payloads as tables: finding the rows, flattening them, typing their columns, describing their nesting."""

from __future__ import annotations

import json
import math
import re
from collections import Counter
from datetime import date, datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.numeric import NUMERIC, percentiles, permissive, r

#: Words that are booleans, kinds in the order that settles ties.
BOOL_WORDS = ("true", "false", "yes", "no", "0", "1", "y", "n", "t", "f")
KINDS = ("numeric", "bool", "date", "datetime", "dict", "list", "string", "mixed")
NUMBER = re.compile(r"[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?")
IDENTIFIER = re.compile(r"[A-Za-z0-9._:/-]{2,64}")
CURRENCY, PERCENT = re.compile(r"[-+]?[$€£¥]\s*[\d,]+(\.\d+)?"), re.compile(r"[-+]?\d+(\.\d+)?\s*%")
COLUMNS, COLUMN_ROWS, EXPLODE_ROWS, EXPLODE_SHARE = 50, 100, 50, 0.3


def jsonish(value: object) -> object:
    """The parsed value of a string that holds a JSON object or array, else the value."""
    if isinstance(value, str) and (t := value.strip())[:1] + t[-1:] in ("{}", "[]"):
        try:
            return json.loads(t)
        except ValueError:
            pass
    return value


def flatten(row: dict, prefix: str = "") -> dict:
    """Nested objects as dotted keys; lists stay."""
    out = {}
    for key, value in row.items():
        value = jsonish(value)
        out |= flatten(value, f"{prefix}{key}.") if isinstance(value, dict) else {f"{prefix}{key}": value}
    return out


def is_list_of_dicts(value: object) -> bool:
    return isinstance(value, list) and bool(value) and all(isinstance(x, dict) for x in value[:5])


def largest_list(data: object, depth: int = 2) -> list:
    """The longest list of objects (two or more) at most ``depth`` objects below; the first of equal ones."""
    best: list = []
    for value in data.values() if isinstance(data, dict) else ():
        found = value if isinstance(value, list) and len(value) >= 2 and isinstance(value[0], dict) else largest_list(value, depth - 1) if isinstance(value, dict) and depth else []
        if len(found) > len(best):
            best = found
    return best


def explode_embedded(rows: list[dict]) -> list[dict]:
    """If enough of the first rows hold a list of objects in one column, a row for each of its items; rows without it are dropped."""
    sample = rows[:EXPLODE_ROWS]
    hits: dict[str, tuple[int, int]] = {}
    for row in sample:
        for k, v in row.items():
            if is_list_of_dicts(v):
                count, items = hits.get(k, (0, 0))
                hits[k] = (count + 1, items + len(v))
    if not hits:
        return rows
    column, (count, _) = max(hits.items(), key=lambda x: x[1])  # most rows, then most items, then the first
    if count < max(2, EXPLODE_SHARE * len(sample)):
        return rows
    return [{k: v for k, v in row.items() if k != column} | {f"{column}.{k}": v for k, v in flatten(item).items()} for row in rows if is_list_of_dicts(row.get(column)) for item in row[column] if isinstance(item, dict)]


def extract_rows(data: object) -> tuple[list[dict], dict]:
    """Rows of a parsed payload and the scalars beside them."""
    if isinstance(data, list):
        rows = [x for x in data if isinstance(x, dict)] if data and isinstance(data[0], dict) else []
        meta: dict = {}
    elif isinstance(data, dict):
        rows, meta = largest_list(data), {k: v for k, v in data.items() if not isinstance(v, (dict, list))}
    else:
        return [], {}
    return explode_embedded([flatten(x) for x in rows if isinstance(x, dict)]), meta


def nesting(data: object, most: int = 12, items: int = 200) -> dict:
    """Depth, nodes, leaves, branching and list lengths by depth, and a signature of the keys' paths."""
    out = {"max_depth": 0, "total_nodes": 0, "total_leaves": 0, "branching_by_depth": {}, "array_lengths_by_depth": {}, "nested_key_count": 0}
    parts: list[str] = []

    def walk(x: object, depth: int) -> None:
        out["total_nodes"] += 1
        out["max_depth"] = max(out["max_depth"], depth)
        if depth >= most or not isinstance(x, (dict, list)):
            out["total_leaves"] += 1
        elif isinstance(x, dict):
            out["branching_by_depth"].setdefault(depth, []).append(len(x))
            out["nested_key_count"] += len(x) if depth else 0
            if depth < 4:
                parts.append("{" + ",".join(sorted(x)[:5]) + "}")
            for v in x.values():
                walk(v, depth + 1)
        else:
            out["array_lengths_by_depth"].setdefault(depth, []).append(len(x))
            if depth < 4:
                parts.append(f"[{len(x)}]")
            for v in x[:items]:
                walk(v, depth + 1)

    walk(data, 0)
    return out | {"path_signature": "→".join(parts[:8])}


def list_kind(value: list) -> str:
    return "list_of_dicts" if is_list_of_dicts(value) else "list_of_scalars"


def kinds_of(value: object) -> list[str]:
    """The kinds a value counts as; a text that looks like money or a share counts as that too."""
    if isinstance(value, bool):
        return ["bool"]
    if isinstance(value, (int, float)):
        return ["numeric"] if math.isfinite(value) else ["string"]
    if isinstance(value, dict):
        return ["dict"]
    if isinstance(value, list):
        return ["list", list_kind(value)]
    text = str(value).strip()
    if text.lower() in BOOL_WORDS:
        return ["bool"]
    if isinstance(parsed := jsonish(text), (dict, list)):
        return ["dict", "json_dict"] if isinstance(parsed, dict) else ["list", list_kind(parsed), "json_list"]
    if NUMBER.fullmatch(text):
        return ["numeric"]
    if re.fullmatch(r"\d{4}-\d{2}-\d{2}", text):
        try:
            date.fromisoformat(text)
            return ["date"]
        except ValueError:
            return ["string"]
    if re.match(r"\d{4}-\d{2}-\d{2}T", text):
        try:
            datetime.fromisoformat(text[:19])
            return ["datetime"]
        except ValueError:
            return ["string"]
    return ["string"] + ["currency"] * bool(CURRENCY.fullmatch(text)) + ["percent"] * bool(PERCENT.fullmatch(text))


def decided(counts: dict, n: int, unique: int, average: float, identifiers: bool) -> dict:
    """Type, confidence, scores and tags of a column from counts by kind, the full values, the distinct ones, the texts' mean length and whether the first texts look like identifiers."""
    share = lambda k: counts.get(k, 0) / n if n else 0.0
    scores = {k: math.floor(share(k) * 1e6 + 0.5) / 1e6 for k in KINDS[:-1]} if n else {}
    ranked = sorted(scores.items(), key=lambda x: (-x[1], KINDS.index(x[0])))
    kind, confidence = ("null", 0.0) if not n else ranked[0]
    second = ranked[1][1] if len(ranked) > 1 else 0.0
    if n and (confidence < 0.7 and second > 0.2 or kind in ("dict", "list") and second > 0.05):
        kind = "mixed"
    tags = []
    if kind in ("string", "date", "datetime", "bool") and unique <= min(50, max(12, int(0.2 * n))):
        tags.append("categorical")
    if kind == "string" and unique / n >= 0.9 and average <= 40 and identifiers:
        tags.append("identifier")
    if kind == "string" and average >= 48:
        tags.append("free_text")
    tags += [tag for k, tag in (("currency", "currency"), ("percent", "percent"), ("json_dict", "json_stringified_dict"), ("json_list", "json_stringified_list")) if share(k) >= 0.6]
    tags += [k for k in ("list_of_dicts", "list_of_scalars") if kind == "list" and share(k) >= 0.6]
    if kind == "dict" and unique / n >= 0.9:
        tags.append("record_like")
    return {"base_type": kind, "confidence": confidence, "candidate_scores": scores, "semantic_tags": tags}


def profile(values: list) -> dict:
    """Counts by kind, distinct values, text length and entropy of one column's values, its type, confidence and tags."""
    full = [v for v in values if v is not None and v != ""]
    counts = Counter(k for v in full for k in kinds_of(v))
    distinct = Counter(json.dumps(v, sort_keys=True, default=str) for v in full)
    texts = [v.strip() for v in full if isinstance(v, str)]
    n = len(full)
    shares = Counter(texts)
    average = sum(map(len, texts)) / len(texts) if texts else 0.0
    found = decided(counts, n, len(distinct), average, bool(texts) and all(IDENTIFIER.fullmatch(t) for t in texts[:200]))
    kind = found["base_type"]
    bits = -sum(c / len(texts) * math.log2(c / len(texts)) for c in shares.values()) if texts else 0.0
    out = {"nulls": len(values) - n, "scanned": len(values), "non_null_count": n, "unique_count": len(distinct), "unique_ratio": round(len(distinct) / n, 6) if n else 0.0, "avg_length": round(average, 6), "string_entropy": round(bits, 6), "value_kind_counts": dict(counts)} | found
    if kind == "numeric":
        x = sorted(float(v) for v in full if "numeric" in kinds_of(v))
        mean = sum(x) / len(x)
        mid = x[len(x) // 2] if len(x) % 2 else round((x[len(x) // 2 - 1] + x[len(x) // 2]) / 2, 6)
        out |= {"min": x[0], "max": x[-1], "mean": round(mean, 6), "median": mid} | ({"std": round(math.sqrt(sum((v - mean) ** 2 for v in x) / len(x)), 6)} if len(x) > 1 else {})
    elif kind in ("string", "bool", "date", "datetime"):
        out["top_values"] = [[v, c] for v, c in Counter(map(str, full)).most_common(5)]
        if kind in ("date", "datetime"):
            out |= {f"min_{kind}": min(map(str, full)), f"max_{kind}": max(map(str, full))}
    return out


def kinds_column(text: Column) -> Column:
    """``kinds_of`` of texts, as an array; of lists in texts only whether each begins with an object is looked at."""
    t = F.trim(text)
    json_text = ((t.startswith("{") & t.endswith("}")) | (t.startswith("[") & t.endswith("]"))) & F.try_parse_json(t).isNotNull()
    whole = lambda x: f"^(?:{x.pattern})$"
    kinds = lambda *x: F.array(*map(F.lit, x))
    like = F.when(t.rlike(whole(CURRENCY)), kinds("string", "currency")).when(t.rlike(whole(PERCENT)), kinds("string", "percent")).otherwise(kinds("string"))
    dated = t.rlike(r"^\d{4}-\d{2}-\d{2}$") & F.try_to_timestamp(t, F.lit("yyyy-MM-dd")).isNotNull()
    timed = t.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}(:\d{2})?") & F.substring(t, 1, 19).try_cast("timestamp_ntz").isNotNull()
    return (
        F.when(F.lower(t).isin(*BOOL_WORDS), kinds("bool"))
        .when(json_text & t.startswith("{"), kinds("dict", "json_dict"))
        .when(json_text, F.when(t.rlike(r"^\[\s*\{"), kinds("list", "list_of_dicts", "json_list")).otherwise(kinds("list", "list_of_scalars", "json_list")))
        .when(t.rlike(whole(NUMBER)), kinds("numeric"))
        .when(dated, kinds("date"))
        .when(timed, kinds("datetime"))
        .otherwise(like)
    )


def profile_frame(df: DataFrame, columns: list[str] | None = None, top: int = 5) -> DataFrame:
    """``profile`` of a table's columns: one row for each, with the same fields (top_values: value and count, the most frequent first, then by value).

    All comes from one shuffle of the distinct values of all columns and their counts, and from moments of the numbers; medians are ranked in ranges. Native numbers, booleans,
    dates and timestamps have their kind, texts that of each value, structs are dicts and arrays lists. A row for each column is small, whatever the table's size.
    """
    spark, names = df.sparkSession, columns or [c for c in df.columns if c != "_row_id"]
    kind_of = {n: df.schema[n].dataType for n in names}
    text = {n: F.to_json(F.col(f"`{n}`")) if isinstance(k, (T.StructType, T.ArrayType, T.MapType)) else F.col(f"`{n}`").cast("string") for n, k in kind_of.items()}
    cells = df.select(F.explode(F.array(*(F.struct(F.lit(n).alias("column"), text[n].alias("value")) for n in names))).alias("c")).select("c.*")
    counts = cells.groupBy("column", "value").agg(F.count("*").alias("n"))
    native = {n: "bool" if isinstance(k, T.BooleanType) else "numeric" if isinstance(k, NUMERIC) else "date" if isinstance(k, T.DateType) else "datetime" if isinstance(k, (T.TimestampType, T.TimestampNTZType)) else "dict" if isinstance(k, (T.StructType, T.MapType)) else "list" if isinstance(k, T.ArrayType) else None for n, k in kind_of.items()}
    texts = [n for n in names if native[n] is None]
    full, is_text = (F.col("value") != "") & F.col("value").isNotNull(), F.col("column").isin(*texts) if texts else F.lit(False)
    kinds = F.when(~full, F.array().cast("array<string>")).when(is_text, kinds_column(F.col("value"))).otherwise(F.array(F.create_map(*(F.lit(x) for n in names for x in (n, native[n] or "string")))[F.col("column")]))
    # entropy is over trimmed texts, so these are counted again where trimming joins some
    valued = counts.withColumn("full", full).withColumn("t", F.when(full & is_text, F.trim("value"))).withColumn("kinds", kinds)
    trimmed = valued.where("t is not null").groupBy("column", "t").agg(F.sum("n").alias("n")).groupBy("column").agg((F.log2(F.sum("n")) - F.sum(F.col("n") * F.log2("n")) / F.sum("n")).alias("bits"))
    ranked = valued.where("full").withColumn("place", F.row_number().over(Window.partitionBy("column").orderBy(F.desc("n"), "value"))).where(F.col("place") <= top)
    best = ranked.groupBy("column").agg(F.sort_array(F.collect_list(F.struct("place", "value", "n"))).alias("best"))  # ``top`` values
    every = ("numeric", "bool", "date", "datetime", "dict", "list", "string", "currency", "percent", "json_dict", "json_list", "list_of_dicts", "list_of_scalars")
    sums = valued.groupBy("column").agg(
        F.sum("n").alias("scanned"), F.coalesce(F.sum(F.when(F.col("full"), F.col("n"))), F.lit(0)).alias("many"), F.count(F.when(F.col("full"), 1)).alias("unique"),
        (F.sum(F.when(F.col("t").isNotNull(), F.col("n") * F.length("t"))) / F.sum(F.when(F.col("t").isNotNull(), F.col("n")))).alias("average"), F.bool_and(F.when(F.col("t").isNotNull(), F.col("t").rlike(f"^(?:{IDENTIFIER.pattern})$"))).alias("identifiers"),
        F.min(F.when(F.col("full"), F.col("value"))).alias("low"), F.max(F.when(F.col("full"), F.col("value"))).alias("high"), *(F.coalesce(F.sum(F.when(F.array_contains("kinds", k), F.col("n"))), F.lit(0)).alias(k) for k in every),
    )
    found = {x["column"]: x for x in sums.join(trimmed, "column", "left").join(best, "column", "left").collect()}  # a row for each column
    numbers = {n: permissive(df, n) for n in names if n in found and isinstance(kind_of[n], (*NUMERIC, T.StringType))}
    moments = df.agg(*(e for v in numbers.values() for e in (F.min(v), F.max(v), F.avg(v), F.stddev_pop(v), F.count(v)))).first() if numbers else []
    moment = {n: moments[5 * i : 5 * i + 5] for i, n in enumerate(numbers)}
    out = []
    for n in names:
        x = found.get(n)
        if x is None:  # a table without rows
            out.append((n, 0, 0, 0, 0, 0.0, 0.0, 0.0, "null", 0.0, [], None, None, None, None, None, None, None, []))
            continue
        told = decided({k: x[k] for k in every if x[k]}, x.many, x.unique, x.average or 0.0, bool(x.identifiers))
        low, high, mean, std, m = moment.get(n, (None,) * 5) if told["base_type"] == "numeric" else (None,) * 5
        median = percentiles(df.select(numbers[n].alias("v")), "v", [0.5])[0] if m else None
        dates = told["base_type"] in ("date", "datetime")
        out.append((n, x.scanned - x.many, x.scanned, x.many, x.unique, r(x.unique / x.many, 6) if x.many else 0.0, r(x.average or 0.0, 6), r(x.bits or 0.0, 6), told["base_type"], told["confidence"], told["semantic_tags"], low, high, r(mean, 6) if m else None, (r(median, 6) if m % 2 == 0 else median) if m else None, r(std, 6) if m and m > 1 else None, x.low if dates else None, x.high if dates else None, [(b["value"], b["n"]) for b in x.best or []] if told["base_type"] in ("string", "bool", "date", "datetime") else []))
    return spark.createDataFrame(out, PROFILE)


PROFILE = "column string, nulls long, scanned long, non_null_count long, unique_count long, unique_ratio double, avg_length double, string_entropy double, base_type string, confidence double, semantic_tags array<string>, min double, max double, mean double, median double, std double, min_date string, max_date string, top_values array<struct<value: string, count: long>>"


def parsed_column(df: DataFrame, column: str) -> DataFrame:
    """The texts of a column that hold JSON objects as a struct of all keys found in any row (null elsewhere), if there are any."""
    value = F.try_parse_json(F.col(f"`{column}`"))
    found = df.where(F.trim(f"`{column}`").startswith("{")).agg(F.schema_of_variant_agg(value)).first()[0]
    if not found or not found.startswith("OBJECT<"):
        return df
    # a variant's schema names objects and void otherwise than a table's
    kind = re.sub(r"\bVOID\b|\bVARIANT\b", "STRING", found.replace("OBJECT<", "STRUCT<"))
    return df.withColumn(column, F.from_json(F.col(f"`{column}`"), kind))


def flatten_frame(df: DataFrame) -> DataFrame:
    """Structs, at any depth, as columns with dotted names; lists stay. A projection of each row, however many there are."""

    def leaves(kind: T.StructType, path: str, name: str) -> list[Column]:
        out = []
        for f in kind:
            inner, full = f"{path}.`{f.name}`" if path else f"`{f.name}`", f"{name}.{f.name}" if name else f.name
            out += leaves(f.dataType, inner, full) if isinstance(f.dataType, T.StructType) else [F.col(inner).alias(full)]
        return out

    return df.select(*leaves(df.schema, "", ""))


def explode_frame(df: DataFrame) -> DataFrame:
    """``explode_embedded`` for a table: the array of structs that most of the first rows fill (then of most items, then the first) becomes rows, its fields dotted columns.

    Rows without it are dropped; a table without one in enough of the first rows only has its structs flattened.
    """
    lists = [f.name for f in df.schema if isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.StructType)]
    if lists:
        sample = df.select(*(F.greatest(F.coalesce(F.size(f"`{c}`"), F.lit(0)), F.lit(0)).alias(f"s{i}") for i, c in enumerate(lists))).limit(EXPLODE_ROWS).collect()
        rows, _, i = max((sum(x[i] > 0 for x in sample), sum(x[i] for x in sample), -i) for i in range(len(lists)))
        if rows >= max(2, EXPLODE_SHARE * len(sample)):
            c = lists[-i]
            rest = [F.col(f"`{x}`") for x in df.columns if x != c]
            df = df.select(*rest, F.explode(f"`{c}`").alias(c))
    return flatten_frame(df)


def columns_of(rows: list[dict]) -> list[str]:
    return list(dict.fromkeys(k for row in rows[:COLUMN_ROWS] for k in row))[:COLUMNS]


def to_dataframe(spark: SparkSession, rows: list[dict], types: dict[str, str]) -> DataFrame:
    """The rows with their position as _row_id: numeric columns as doubles, pure booleans as booleans, all else as text."""
    fields, makers = [T.StructField("_row_id", T.LongType(), False)], []
    for name, kind in types.items():
        values = [row.get(name) for row in rows]
        if kind == "numeric" and all(v is None or v == "" or "numeric" in kinds_of(v) for v in values):
            fields.append(T.StructField(name, T.DoubleType()))
            makers.append(lambda v: None if v is None or v == "" else float(v))
        elif kind == "bool" and all(v is None or isinstance(v, bool) for v in values):
            fields.append(T.StructField(name, T.BooleanType()))
            makers.append(lambda v: v)
        else:
            fields.append(T.StructField(name, T.StringType()))
            makers.append(lambda v: v if v is None or isinstance(v, str) else json.dumps(v))
    return spark.createDataFrame([(i, *(f(row.get(n)) for f, n in zip(makers, types))) for i, row in enumerate(rows)], T.StructType(fields))
