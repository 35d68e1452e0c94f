"""Mixing sources to target weights by pivotal dependent rounding.

Every document of a source is to be copied target / source size times. The whole part is
taken; the fractional parts are rounded in pairs: words go from one document of a pair to the other, in one direction or the other with the
chances that keep both expectations, until a fraction of theirs is 0 or 1. The other document
meets the next one, so the words of a source stay as they are. What is left of a source in a group
of rows, at most one document, meets the leavings of neighbouring groups in a reduction tree; a source's last is rounded alone.

Groups are runs of rows ordered by source, so that a hot source is spread over many, many small sources share one, and
rows without id or with equal ids are like others.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep, numbered

WEIGHTS, SHARE, MOST = (5, 2, 1), 1.5, 2.0
#: Rows that one task of the first level rounds together, and groups that meet in one of the next.
GROUP_ROWS, FAN_IN = 4096, 64
EPS = 1e-12


def targets(rows: DataFrame) -> DataFrame:
    """From kept rows (source, size, place): a row for each source: source, source_size, target, rate, first and last place.

    Sources by code point, null last, weigh WEIGHTS, repeating, and share SHARE of all words; where that is above MOST times a source's own,
    it stops there and the others share the rest by weight. All sums are of whole numbers, so reruns agree.
    """
    own = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.min("place").alias("first"), F.max("place").alias("last"))
    ranked = numbered(own, [F.col("source").asc_nulls_last()], "sources", "rank")
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("rank") % len(WEIGHTS) + 1).cast("int"))
    table = ranked.withColumn("weight", weight).withColumn("most", F.col("source_size") * MOST)
    whole = table.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    level, stopped = 0.0, -1
    while True:  # words for each unit of weight; each round stops more sources or is the last
        over = F.col("most") < F.col("weight") * F.lit(level)
        taken, free, n = table.agg(F.coalesce(F.sum(F.when(over, F.col("source_size"))), F.lit(0)), F.coalesce(F.sum(F.when(~over, F.col("weight"))), F.lit(0)), F.count(F.when(over, 1))).first()
        if n == stopped or not free:
            break
        level, stopped = (SHARE * whole - MOST * taken) / free, n
    target = F.least(F.col("most"), F.col("weight") * F.lit(level))
    rate = F.when(F.col("source_size") > 0, F.least(target / F.col("source_size"), F.lit(MOST))).otherwise(0.0)
    return keep(table.select("source", "source_size", target.alias("target"), rate.alias("rate"), "first", "last"), "targets")


def paired(p: np.ndarray, size: np.ndarray, draw: Iterator[float]) -> int:
    """Round fractions p in place, pair by pair: all but one become 0 or 1, sum(p * size) and every expectation stay. Returns the place of that one, or -1."""
    held = -1
    for i in range(len(p)):
        if p[i] <= EPS or p[i] >= 1 - EPS:
            p[i] = round(p[i])
            continue
        if held < 0:
            held = i
            continue
        a, b = held, i
        up = min(size[a] * (1 - p[a]), size[b] * p[b])  # words that can go from b to a
        down = min(size[a] * p[a], size[b] * (1 - p[b]))
        move = up if next(draw) < down / (up + down) else -down
        p[a] += move / size[a]
        p[b] -= move / size[b]
        held = -1
        for k in (a, b):
            if p[k] <= EPS or p[k] >= 1 - EPS:
                p[k] = round(p[k])
            else:
                held = k
    return held


def draws(depth: int, group: int, n: int) -> Iterator[float]:
    seed = hashlib.blake2b(f"{depth} {group}".encode(), digest_size=8).digest()
    return iter(np.random.Generator(np.random.Philox(int.from_bytes(seed, "big"))).random(n).tolist())


def settle(depth: int) -> callable:
    """A function that rounds the sources of one group of rows; a source that lies within the group is rounded to its end."""
    span = GROUP_ROWS * FAN_IN**depth

    def one(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["first", "size", "place"], ascending=[True, False, True])  # large ones first, so that small ones are left
        draw = draws(depth, int(frame["place"].iloc[0]) // span, 2 * len(frame))
        p, size, first, last = (frame[c].tolist() for c in ("p", "size", "first", "last"))
        edges = np.flatnonzero(np.diff(frame["first"].to_numpy(), prepend=-1, append=-1)).tolist()
        for a, b in zip(edges, edges[1:]):
            part = p[a:b]
            left = paired(part, size[a:b], draw)
            if left >= 0 and first[a] // span == last[a] // span:
                part[left] = float(next(draw) < part[left])
            p[a:b] = part
        return frame.assign(p=p)

    return one


def sized(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")
    return docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), size.alias("size"), F.xxhash64(F.col(id_col).cast("string"), F.col(text_col)).alias("_hash"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """How often to take each document: doc_id, source, size, source_size, target, copies, taken.

    copies is 0, 1 or 2 and taken is size * copies. A source is a group of its own if null. Null, empty and
    blank texts have size 0, take no part in the rounding and get 0 copies. The draws depend on
    sources, ids and texts alone, so reruns agree; repeated rows and rows of null id get a row each, and
    equal ones may be given different numbers of copies. Sources, like rows, are never gathered in one place. Without any row the result is empty.
    """
    rows = numbered(sized(docs, id_col, text_col, source_col), [F.col("source").asc_nulls_last(), F.col("_hash"), F.col("size"), F.col("doc_id")], "sizes", "place")
    table = targets(rows).withColumnRenamed("source", "source2")
    with_rate = (
        rows.join(table, rows["source"].eqNullSafe(table["source2"]))
        .select("doc_id", "source", "size", "source_size", "target", F.floor("rate").cast("int").alias("whole"), (F.col("rate") - F.floor("rate")).alias("p"), "place", "first", "last")
    )
    none = with_rate.where("size = 0").withColumn("whole", F.lit(0)).withColumn("p", F.lit(0.0))
    many, done, depth, todo = rows.count(), [none], 0, with_rate.where("size > 0")
    while True:
        span = GROUP_ROWS * FAN_IN**depth
        level = keep(todo.groupBy(F.floor(F.col("place") / span)).applyInPandas(settle(depth), with_rate.schema), f"mix-{depth}")
        done.append(level.where("p = 0 or p = 1"))
        if span >= many:
            break
        todo, depth = level.where("p > 0 and p < 1"), depth + 1
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    copies = F.col("whole") + F.col("p").cast("int")
    return out.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (F.col("size") * copies).alias("taken"))
