"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

A text's features are the distinct n-grams (n of ``SIZES``) of its lower-cased
characters, hashed to ``BUCKETS``. Each present feature counts as r, the logarithm of the
ratio of its smoothed document frequencies in toxic and other training texts; a logistic
regression with an L1 penalty on top of these gives sparse weights, so that long clean texts
don't add up many small ones. It is fitted on the features that promise most; then every other feature's slope is
looked at, those steeper than the penalty join, and so on until none is left, so the result is that of all
features. The score is the logistic function of the weights' sum.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import blocks, discard, drawn, keep, release, text_bytes, tidy

SIZES = (3, 4, 5)
BUCKETS = 1 << 20
#: At most so many labelled texts of each class are drawn (by a hash of the id) to fit the classifier.
TRAIN_ROWS = 4000
#: An n-gram of fewer sampled texts is no feature.
LEAST_DF = 3
#: The regression begins with the features of the largest |r| * sqrt(document frequency); all others join that a check finds wanting.
START = 20_000
SMOOTH, PENALTY, STEPS, SLACK = 1.0, 2e-4, 300, 1.05
#: Characters that are hashed at once.
WINDOW = 1 << 19
#: Flags (texts by features) that are set in place of sorting, at most.
FLAGS = 1 << 25
_LOWER: list[np.ndarray] = []
_ODD = np.uint64(0x9E3779B97F4A7C15)


def lowered(chars: np.ndarray) -> np.ndarray:
    """Each character of the basic plane in lower case, where that is one character too."""
    if not _LOWER:
        _LOWER.append(np.array([ord(x) if len(x := chr(c).lower()) == 1 else c for c in range(1 << 16)], np.uint64))
    return np.where(chars < 1 << 16, _LOWER[0][np.minimum(chars, (1 << 16) - 1)], chars)


def features(raw: np.ndarray, offsets: np.ndarray, wanted: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Distinct (row, bucket) of each block of rows, ascending. wanted: of these buckets only."""
    bits = np.uint64(BUCKETS.bit_length() - 1)
    if wanted is not None:
        place, buckets_of = np.cumsum(wanted) - 1, np.flatnonzero(wanted)
    for first, last in blocks(offsets, 1 << 20):
        chars = lowered(np.frombuffer(raw[offsets[first] : offsets[last]].tobytes().decode("utf-8", "replace").encode("utf-32-le", "surrogatepass"), np.uint32))
        starts = raw[offsets[first] : offsets[last]] & 0xC0 != 0x80
        ends = np.concatenate([[0], np.cumsum(starts)])[offsets[first : last + 1] - offsets[first]]
        ends[-1] = len(chars)
        rows = np.repeat(np.arange(first, last), np.diff(ends))
        found, met = [], None
        if wanted is not None and (last - first) * len(buckets_of) <= FLAGS:
            met = np.zeros((last - first) * len(buckets_of), bool)  # faster than sorting, where the features are few
        for at in range(0, len(chars), WINDOW):  # windows that overlap by one n-gram
            c, r = chars[at : at + WINDOW + max(SIZES) - 1], rows[at : at + WINDOW + max(SIZES) - 1]
            for n in SIZES:
                if len(c) < n:
                    continue
                h = np.full(len(c) - n + 1, n, np.uint64)
                for i in range(n):
                    h = (h ^ c[i : i + len(h)]) * _ODD
                    h ^= h >> np.uint64(29)
                bucket = (h * _ODD >> (np.uint64(64) - bits)).astype(np.int64)
                own = r[: len(h)] == r[n - 1 : n - 1 + len(h)]
                if wanted is not None:
                    own &= wanted[bucket]
                if met is not None:
                    own = np.flatnonzero(own)
                    met[(r[own] - first) * len(buckets_of) + place[bucket[own]]] = True
                else:
                    found.append(np.unique(r[: len(h)][own] * BUCKETS + bucket[own]))
        if met is not None:
            keys = np.flatnonzero(met)
            yield (keys // max(1, len(buckets_of)) + first, buckets_of[keys % max(1, len(buckets_of))]) if len(keys) else (keys, keys)
        else:
            keys = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
            yield keys // BUCKETS, keys % BUCKETS


def fit(rows: np.ndarray, buckets: np.ndarray, label: np.ndarray, ratio: np.ndarray, before: tuple[np.ndarray, float] | None = None) -> tuple[np.ndarray, float]:
    """Weight of each bucket and intercept, by FISTA on the mean logistic loss plus the L1 penalty. rows ascend; before: from where to begin."""
    used, column = np.unique(buckets, return_inverse=True)
    column, r = column.astype(np.int32), ratio[used]
    n, sign = len(label), np.where(label > 0, 1.0, -1.0)
    w, b = (before[0][used] / r, before[1]) if before else (np.zeros(len(used)), 0.0)
    some, starts = np.unique(rows, return_index=True)
    by_column = rows[np.argsort(column, kind="stable")]
    column_starts = np.cumsum(np.bincount(column, minlength=len(used))) - np.bincount(column, minlength=len(used))
    sums = lambda x, at: np.add.reduceat(x, at) if len(at) else np.zeros(0)
    # sqrt(n) times the step that would be safe if all rows were alike; they aren't, and restarts catch what overshoots
    step = 4 * n**0.5 / (float(sums(r[column] ** 2, starts).max(initial=0)) + 1)
    ahead, bias, t = w.copy(), b, 1.0
    for _ in range(STEPS):
        z = np.full(n, bias)
        z[some] += sums((ahead * r)[column], starts)
        g = -sign / (1 + np.exp(np.clip(sign * z, -50, 50))) / n
        new = ahead - step * r * sums(g[by_column], column_starts)
        new = np.sign(new) * np.maximum(np.abs(new) - step * PENALTY, 0)
        new_b = bias - step * g.sum()
        again = (1 + (1 + 4 * t * t) ** 0.5) / 2
        if ((ahead - new) * (new - w)).sum() > 0:
            again = 1.0  # momentum points uphill: restart it
        ahead, bias = new + (t - 1) / again * (new - w) * (again > 1), new_b + (t - 1) / again * (new_b - b) * (again > 1)
        still = np.abs(new - w).max(initial=abs(new_b - b)) < 1e-6
        w, b, t = new, new_b, again
        if still:
            break
    out = np.zeros(BUCKETS)
    out[used] = w * r
    return out, b


def train_classifier(docs: DataFrame, labels: DataFrame, train: Column, id_col: str, text_col: str, label_col: str, label_id: str, train_rows: int = TRAIN_ROWS, least_df: int = LEAST_DF) -> tuple[np.ndarray, float, float]:
    """Weights by bucket, intercept, and the score of everything if there are not two classes (else nan)."""
    # a document with several labels is toxic if one of them says so
    rows = labels.where(train & F.col(label_id).isNotNull() & F.col(label_col).isin(0, 1)).groupBy(F.col(label_id).alias("text")).agg(F.max(label_col).cast("int").alias("group"), F.lit(1).alias("weight"))
    size = {0: 0, 1: 0} | {r[0]: r[1] for r in rows.groupBy("group").count().collect()}
    none = np.zeros(BUCKETS, np.float32), 0.0
    if not size[0] or not size[1]:
        return *none, 1.0 if size[1] else 0.0
    few = drawn(rows, lambda _: train_rows, 2).select(F.col("group").alias("label"), F.col("text").alias("id"))
    # of several texts of one id the first is learnt from
    found = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(F.col("text").isNotNull()).join(F.broadcast(few), "id")  # at most train_rows of each class
    texts = keep(found.groupBy("id").agg(F.min("text").alias("text"), F.max("label").alias("label")), "toxic-sample")
    spark = docs.sparkSession

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros((2, BUCKETS), np.int64)
        n = np.zeros(2, np.int64)
        for batch in batches:
            label = batch.column(1).to_numpy()
            n += np.bincount(label, minlength=2)
            for rows, buckets in features(*text_bytes(batch.column(0))):
                for k in (0, 1):
                    df[k] += np.bincount(buckets[label[rows] == k], minlength=BUCKETS)
        at = np.flatnonzero(df.sum(0))
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(df[0][at], n[0])), pa.array(np.append(df[1][at], n[1]))], names=["bucket", "df0", "df1"])

    counts = texts.select("text", "label").mapInArrow(tidy(frequencies), "bucket long, df0 long, df1 long").groupBy("bucket").agg(F.sum("df0").alias("df0"), F.sum("df1").alias("df1")).where(f"df0 + df1 >= {least_df} or bucket < 0").toArrow().to_pandas()  # at most BUCKETS rows
    total = counts[counts.bucket < 0]
    if not len(total) or not total.df0.sum() or not total.df1.sum():
        return *none, 1.0 if total.df1.sum() else 0.0
    counts = counts[counts.bucket >= 0].sort_values("bucket")
    n0, n1 = int(total.df0.sum()), int(total.df1.sum())
    r = np.log((counts.df1 + SMOOTH) / (n1 + 2 * SMOOTH)) - np.log((counts.df0 + SMOOTH) / (n0 + 2 * SMOOTH))
    ratio = np.zeros(BUCKETS)
    ratio[counts.bucket] = r
    best = counts.assign(weight=-r.abs() * np.sqrt(counts.df0 + counts.df1)).sort_values(["weight", "bucket"]).head(START)
    active = np.zeros(BUCKETS, bool)
    active[best.bucket] = True
    active &= ratio != 0
    model = None
    while True:
        wanted = spark.sparkContext.broadcast(active)

        def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                label, n = batch.column(1).to_numpy(), batch.num_rows
                found = list(features(*text_bytes(batch.column(0)), wanted.value))
                rows, buckets = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64))
                cut = np.searchsorted(rows, np.arange(n + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(2), pa.array(label), pa.ListArray.from_arrays(pa.array(cut), pa.array(buckets.astype(np.int32)))], names=["id", "label", "buckets"])

        sample = texts.select("text", "label", F.col("id").cast("string").alias("id")).mapInArrow(tidy(chosen), "id string, label int, buckets array<int>").toArrow().sort_by("id")
        label, lists = sample.column("label").to_numpy(), sample.column("buckets").combine_chunks()
        rows = np.repeat(np.arange(len(label), dtype=np.int32), lists.value_lengths().to_numpy())
        weights, bias = model = fit(rows, lists.flatten().to_numpy(), label, ratio, model)
        known = spark.sparkContext.broadcast((weights, bias, ratio * ~active, len(label)))

        def slopes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            w, b, others, n = known.value
            out = np.zeros(BUCKETS, np.int64)  # of 2**-40, so that sums don't depend on their order
            for batch in batches:
                sign = np.where(batch.column(1).to_numpy() > 0, 1.0, -1.0)
                for rows, buckets in features(*text_bytes(batch.column(0)), (w != 0) | (others != 0)):
                    z = b + np.bincount(rows, w[buckets], len(sign))
                    g = np.round(sign / (1 + np.exp(np.clip(sign * z, -50, 50))) * (1 << 40) / n).astype(np.int64)
                    for part in range(0, len(rows), 1 << 20):
                        np.add.at(out, buckets[part : part + (1 << 20)], g[rows[part : part + (1 << 20)]])
            at = np.flatnonzero(out * (others != 0))
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(out[at])], names=["bucket", "slope"])

        missed = texts.select("text", "label").mapInArrow(tidy(slopes), "bucket long, slope long").groupBy("bucket").agg(F.sum("slope").alias("slope")).toArrow()  # at most BUCKETS rows
        at, slope = missed.column("bucket").to_numpy(), missed.column("slope").to_numpy() / (1 << 40)
        more = at[np.abs(slope * ratio[at]) > SLACK * PENALTY]
        wanted.unpersist()
        known.unpersist()
        if not len(more):
            break
        active[more] = True
    # the classes were drawn at different rates
    bias += np.log(size[1] / size[0]) - np.log(max(1, (label > 0).sum()) / max(1, (label == 0).sum()))
    discard(texts)
    return weights.astype(np.float32), float(bias), float("nan")


def toxicity(docs: DataFrame, labels: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", label_id: str = "doc_id", carry: list[str] | None = None, train_rows: int = TRAIN_ROWS, least_df: int = LEAST_DF) -> DataFrame:
    """Score every whole text; train says which rows of ``labels`` may be learnt from.

    carry: columns to return (the id alone if not given). Added: ``score`` (0 to 1) and ``predicted``
    (1 if the score is 0.5 or more); a carried column of one of these names is replaced.
    Null and empty texts get the score of a text without features. Labels other than 0
    and 1 and null ids are left out; of several labels of a document the highest
    counts, of several texts of a labelled id the first by order is learnt from. train_rows: so many labelled texts of each
    class at most are learnt from, drawn by a hash of the id; least_df: n-grams of fewer of these are no features. Without labelled texts of both classes the score is 1 if all are toxic, else 0. Repeated rows each
    get a row.
    """
    carry = [c for c in (carry or [id_col]) if c not in ("score", "predicted")]
    model = docs.sparkSession.sparkContext.broadcast(train_classifier(docs, labels, train, id_col, text_col, label_col, label_id, train_rows, least_df))
    release()  # what the driver trained with
    schema = T.StructType([docs.schema[c] for c in carry] + [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias, constant = model.value
        place = carry.index(text_col) if text_col in carry else len(carry)
        wanted = weights != 0
        for batch in batches:
            z = np.full(batch.num_rows, bias)
            for rows, buckets in features(*text_bytes(batch.column(place)), wanted):
                z += np.bincount(rows, weights[buckets].astype(np.float64), batch.num_rows)
            score = 1 / (1 + np.exp(-np.clip(z, -700, 700))) if np.isnan(constant) else np.full(batch.num_rows, constant)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(carry))), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], names=[*carry, "score", "predicted"])

    # a text that is carried needn't come twice
    return docs.select(*carry, *(() if text_col in carry else (text_col,))).mapInArrow(tidy(predict), schema)
