"""Chroma fingerprints of audio columns, and alignment of recordings by them.

Samples become frames of twelve pitch-class energies; filters over the integral image of these
frames, each quantised to two bits, give one packed 32-bit integer per frame. Recordings
that share integers vote for the difference of their places; at the best offset the bits that differ over the overlap
tell whether they are the same sound.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import keep, numbered, tidy

RATE, FRAME, HOP, PITCHES = 5512, 1024, 256, 12
#: Frames that a filter spans at most.
SPAN = 12
#: Fixed values of this module: kind, first pitch class, pitch classes, frames, and the two thresholds' middle and half width.
FILTERS = tuple((k, p, h, w) for k, p, h, w in ((0, 0, 6, 8), (1, 0, 12, 4), (2, 0, 12, 8), (3, 0, 6, 12), (0, 6, 6, 8), (1, 3, 6, 8), (2, 4, 8, 4), (4, 0, 12, 6), (0, 3, 6, 4), (1, 6, 6, 12), (2, 0, 6, 12), (3, 4, 8, 8), (4, 2, 8, 12), (0, 0, 12, 12), (1, 0, 6, 6), (5, 0, 12, 9)))
LOW, HIGH = -0.25, 0.25
#: Votes and bits' error rate up to which an alignment counts.
LEAST_VOTES, MOST_ERROR = 3, 0.25
#: Places of one key that a task holds; keys with more are looked up in a broadcast table if there are no more than so many of them.
BLOCK, MOST_COMMON = 1024, 500_000


def chroma(samples: np.ndarray) -> np.ndarray:
    """Frames x pitch classes, each frame of length 1; shorter recordings have no frame."""
    if len(samples) < FRAME:
        return np.zeros((0, PITCHES))
    view = np.lib.stride_tricks.sliding_window_view(samples, FRAME)[::HOP]
    power = np.abs(np.fft.rfft(view * np.hamming(FRAME), axis=1)) ** 2
    hertz = np.arange(power.shape[1]) * RATE / FRAME
    use = (hertz >= 80) & (hertz <= 2000)
    note = np.round(12 * np.log2(hertz[use] / 440)).astype(int) % PITCHES
    out = np.zeros((len(view), PITCHES))
    for k in range(PITCHES):
        out[:, k] = power[:, use][:, note == k].sum(1)
    norm = np.sqrt((out**2).sum(1, keepdims=True))
    return np.where(norm > 1e-9, out / np.maximum(norm, 1e-9), 0)


def fingerprint(samples: np.ndarray) -> np.ndarray:
    """One packed integer for each place at which the longest filter fits."""
    frames = chroma(np.nan_to_num(np.asarray(samples, float)))
    n = len(frames) - SPAN + 1
    if n <= 0:
        return np.zeros(0, np.uint32)
    image = np.zeros((len(frames) + 1, PITCHES + 1))
    image[1:, 1:] = frames.cumsum(0).cumsum(1)
    at = np.arange(n)

    def area(t0: int, t1: int, p0: int, p1: int) -> np.ndarray:
        return image[at + t1, p1] - image[at + t0, p1] - image[at + t1, p0] + image[at + t0, p0]

    out = np.zeros(n, np.uint32)
    for kind, p, h, w in FILTERS:
        t2, p2 = w // 2, p + h // 2
        if kind == 0:  # pitch halves
            a, b = area(0, w, p2, p + h), area(0, w, p, p2)
        elif kind == 1:  # time halves
            a, b = area(t2, w, p, p + h), area(0, t2, p, p + h)
        elif kind == 2:  # checkerboard
            a, b = area(0, t2, p2, p + h) + area(t2, w, p, p2), area(0, t2, p, p2) + area(t2, w, p2, p + h)
        elif kind == 3:  # the middle third of pitches against the rest
            a = area(0, w, p + h // 3, p + 2 * h // 3)
            b = area(0, w, p, p + h) - a
        elif kind == 4:  # the middle third of time against the rest
            a = area(w // 3, 2 * w // 3, p, p + h)
            b = area(0, w, p, p + h) - a
        else:  # low and high thirds of pitches
            a, b = area(0, w, p, p + h // 3), area(0, w, p + 2 * h // 3, p + h)
        x = np.log((1 + a) / (1 + b)) * 2
        level = (x > LOW).astype(np.uint32) + (x > 0) + (x > HIGH)
        out = out << np.uint32(2) | (level ^ level >> np.uint32(1))  # Gray code: neighbours differ in one bit
    return out


def fingerprints(media: DataFrame, id_col: str, audio_col: str) -> DataFrame:
    """id, prints (array of packed integers). Audio: array of samples at RATE; null, empty and short audio has none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [fingerprint(np.array(x if x is not None else [], float)) if x is None or len(x) < FRAME else fingerprint(x) for x in batch.column(1).to_numpy(zero_copy_only=False)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([p.astype(np.int64).tolist() for p in prints], pa.list_(pa.int64()))], names=["id", "prints"])

    schema = T.StructType([T.StructField("id", media.schema[id_col].dataType), T.StructField("prints", T.ArrayType(T.LongType()))])
    return media.select(F.col(id_col).alias("id"), audio_col).mapInArrow(tidy(run), schema)


def voters(prints: DataFrame, name: str, at: str) -> DataFrame:
    """The id (as ``name``), place (``at``) and key of each place that votes: neighbouring integers, the first of a run of equal ones."""
    first = "i = 0 or prints[i - 1] <> prints[i] or prints[i] <> prints[i + 1]"
    keys = F.expr(f"if(size(prints) > 1, transform(filter(sequence(0, size(prints) - 2), i -> {first}), i -> struct(i as t, shiftleft(prints[i], 32) | prints[i + 1] as key)), array())")
    return prints.select(F.col("id").alias(name), F.explode(keys).alias("x")).select(name, F.col("x.t").alias(at), "x.key")


def align(queries: DataFrame, library: DataFrame) -> DataFrame:
    """For each query its best recording: query_id, match_id, offset (of the query in it, in frames), votes, overlap, bit_error.

    Both as from ``fingerprints``, with ids of which none is null or repeated. Integers vote as pairs of neighbours, which few recordings share by chance; a run
    of equal pairs (silence, a steady note) votes once, by its start, so what never changes matches nothing. The
    best has the lowest bit error among the offsets with LEAST_VOTES votes or more, ties to more votes, the smaller id and the smaller offset; without one,
    or at an error above MOST_ERROR, the match is null. Recordings of equal prints are compared once, and the smallest id stands for them. A recording in both
    can match itself. Every query gets a row, without a library too.
    """
    spark = library.sparkSession
    alike = library.where("size(prints) > 1").groupBy(F.xxhash64("prints").alias("h1"), F.xxhash64(F.lit(1), "prints").alias("h2")).agg(F.min("id").alias("id"))
    library = library.join(alike.select("id"), "id", "left_semi")
    known, asked = keep(voters(library, "match_id", "mt"), "keys"), voters(queries, "query_id", "qt")
    # a key that many recordings hold is dealt in blocks
    common = keep(known.groupBy("key").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")).where("blocks > 1"), "common")
    common = F.broadcast(common) if common.count() <= MOST_COMMON else common
    known = known.join(common, "key", "left").withColumn("block", F.pmod(F.xxhash64("match_id"), F.coalesce("blocks", F.lit(1))).cast("int")).drop("blocks")
    asked = asked.join(common, "key", "left").withColumn("block", F.explode(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1))).drop("blocks")
    votes = keep(asked.join(known, ["key", "block"]).groupBy("query_id", "match_id", (F.col("mt") - F.col("qt")).alias("offset")).agg(F.count("*").alias("votes")).where(F.col("votes") >= LEAST_VOTES), "votes")
    q, m = queries.select(F.col("id").alias("query_id"), F.col("prints").alias("q")), library.select(F.col("id").alias("match_id"), F.col("prints").alias("m"))
    over = votes.join(q, "query_id").join(m, "match_id")
    first, last = "greatest(0, -offset)", "least(size(q), size(m) - offset)"
    over = over.withColumn("overlap", F.expr(f"cast({last} - {first} as int)")).where("overlap > 0")
    bits = F.expr(f"aggregate(sequence(cast({first} as int), cast({last} as int) - 1), 0, (a, i) -> a + bit_count(q[i] ^ m[cast(i + offset as int)]))")
    scored = over.withColumn("bit_error", bits / (32.0 * F.col("overlap"))).select("query_id", "match_id", "offset", "votes", "overlap", "bit_error").where(F.col("bit_error") <= MOST_ERROR)
    best = scored.groupBy("query_id").agg(F.min(F.struct("bit_error", (-F.col("votes")).alias("less"), "match_id", "offset", "overlap")).alias("x"))
    found = best.select("query_id", "x.match_id", F.col("x.offset").cast("int").alias("offset"), (-F.col("x.less")).alias("votes"), "x.overlap", "x.bit_error")
    return queries.select(F.col("id").alias("query_id")).join(found, "query_id", "left")


def tune(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", note: float = 0.125, excerpts: bool = False) -> DataFrame:
    """id, audio: a made-up recording of each vector, a note for each pair of components. excerpts: the middle of it, from a frame's start on, quieter and with noise.

    The test tables hold no audio; this gives the media operators a column to work on.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        length = int(RATE * note)
        t = np.arange(length) / RATE
        fade = np.minimum(1, np.minimum(np.arange(length), np.arange(length)[::-1]) / 40)
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                rows, out = batch.slice(at, 64), []
                for v in rows.column(1).to_pylist():
                    if v is None:
                        out.append(None)
                        continue
                    v = np.nan_to_num(np.array([x or 0.0 for x in v], float))
                    steps = np.floor(np.abs(v[::2]) * 97 + 31 * (v[::2] > 0)).astype(int) % 24
                    sound = np.concatenate([fade * (np.sin(2 * np.pi * 220 * 2 ** (s / 12) * t) + 0.4 * np.sin(2 * np.pi * 220 * 2 ** ((s + 7) / 12) * t)) for s in steps] or [np.zeros(0)])
                    if excerpts:
                        low, high = len(sound) // 4 // HOP * HOP, 3 * len(sound) // 4
                        sound = 0.6 * sound[low:high] + 0.002 * np.random.default_rng(zlib.crc32(steps.tobytes())).standard_normal(max(0, high - low))
                    out.append(sound.astype(np.float32))
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(out, pa.list_(pa.float32()))], names=["id", "audio"])

    kind = vectors.schema[id_col].dataType.simpleString()
    return vectors.select(id_col, vector_col).mapInArrow(tidy(run), f"id {kind}, audio array<float>")


def recognise(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", every: int = 20) -> DataFrame:
    """id, n_prints, prints_crc32 of every recording, and for ids divisible by ``every`` the alignment of a noisy excerpt with the whole library.

    match_id, offset, votes, overlap, bit_error as from ``align``; null for rows that ask nothing or match nothing. Each row is a recording of its own: repeated ids and rows
    each get theirs, rows without id are in the library but are named null, null and empty vectors have no prints. Of equal recordings the one of the smallest id is named
    (null last). No row: no result; other columns are not read.
    """
    ids = vectors.select(F.col(id_col).alias("own_id"), F.col(vector_col).alias("v"))
    # numbered in the order of ids, so that the smallest row is the smallest id
    rows = numbered(ids, [F.col("own_id").asc_nulls_last(), F.xxhash64("v")], "recordings", "id")
    library = keep(fingerprints(tune(rows, "id", "v"), "id", "audio"), "prints")
    queries = keep(fingerprints(tune(rows.where(F.col("own_id") % every == 0), "id", "v", excerpts=True), "id", "audio"), "excerpts")
    found = align(queries, library)
    names = rows.select("id", "own_id")
    found = found.join(names.select(F.col("id").alias("match_id"), F.col("own_id").alias("named")), "match_id", "left")
    one = library.join(names, "id").join(found, library["id"] == found["query_id"], "left")
    return one.select(F.col("own_id").alias("id"), F.size("prints").cast("long").alias("n_prints"), F.crc32(F.array_join("prints", ",").cast("binary")).alias("prints_crc32"), F.col("named").alias("match_id"), "offset", "votes", "overlap", "bit_error")
