"""Nearest neighbours by inner product with score-aware (anisotropic) product quantisation.

Vectors are cut into subspaces of two dimensions with 16 code words each. The code words and codes
minimise |r|**2 + (ETA - 1) * (r . x / |x|)**2 for the residual r of a vector x: an error along
the vector changes large inner products most, so it weighs more than one across it. A search looks up each
candidate's packed 4-bit codes in the query's tables (two codes at once). An estimate is off by |q| |r| at most,
and |r| is kept with the codes: the exact inner products of the best by the estimate set a bar, and whatever
may reach it within its error is ranked exactly too. So the nearest found are the truly nearest on any rows; how
well the codes fit only decides how many are ranked exactly.

Queries and candidates meet in blocks of bounded size; each block pair gives each of its queries' exact best, and
these are merged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import drawn, keep

WIDTH, CODES = 2, 16
#: Weight of the error along the vector against that across it.
ETA = 4.0
#: Vectors from which code words are learnt, at most (drawn by a hash of the id).
TRAIN_ROWS, ROUNDS = 20_000, 8
NEAREST = 20
#: The best of a block by the estimate, whose exact products set the query's bar.
RERANKED = 400
#: Rows of a block at most; fewer if they would be larger than BLOCK_BYTES in double precision.
CANDIDATE_BLOCK, QUERY_BLOCK, BLOCK_BYTES = 1 << 16, 1 << 15, 32 << 20
#: Candidates that make a task of their own while there are more cores than blocks.
TASK_ROWS = 4096


class Quantiser:
    """Code words [subspace, code, WIDTH]; vectors are padded with zeros to whole subspaces, pairs of them."""

    def __init__(self, sample: np.ndarray, eta: float = ETA, seed: int = 3):
        self.dim, self.extra = sample.shape[1], eta - 1
        self.spaces = -(-self.dim // (2 * WIDTH)) * 2
        x = self.cut(sample)
        rng = np.random.default_rng(seed)
        self.words = np.zeros((self.spaces, CODES, WIDTH))
        for m in range(self.spaces):
            self.words[m] = x[rng.choice(len(x), CODES, replace=len(x) < CODES), m]
        unit = self.unit(x)
        codes = None
        for _ in range(ROUNDS):
            codes = self.assign(x, unit, codes)
            self.update(x, unit, codes)

    def cut(self, vectors: np.ndarray) -> np.ndarray:
        out = np.zeros((len(vectors), self.spaces * WIDTH))
        out[:, : self.dim] = vectors
        return out.reshape(len(vectors), self.spaces, WIDTH)

    @staticmethod
    def unit(x: np.ndarray) -> np.ndarray:
        return x / np.maximum(np.sqrt((x**2).sum((1, 2), keepdims=True)), 1e-300)

    def assign(self, x: np.ndarray, unit: np.ndarray, codes: np.ndarray | None = None) -> np.ndarray:
        """Coordinate descent over subspaces: each takes the word of the least loss given the others' words."""
        n = len(x)
        if codes is None:
            codes = np.stack([((x[:, m, None] - self.words[m]) ** 2).sum(-1).argmin(1) for m in range(self.spaces)], 1)
        along = np.stack([((x[:, m] - self.words[m][codes[:, m]]) * unit[:, m]).sum(1) for m in range(self.spaces)], 1)
        total = along.sum(1)
        for m in range(self.spaces):
            residual = x[:, m, None] - self.words[m]
            here = (residual * unit[:, m, None]).sum(-1)
            rest = (total - along[:, m])[:, None]
            codes[:, m] = ((residual**2).sum(-1) + self.extra * (rest + here) ** 2).argmin(1)
            now = here[np.arange(n), codes[:, m]]
            total += now - along[:, m]
            along[:, m] = now
        return codes

    def update(self, x: np.ndarray, unit: np.ndarray, codes: np.ndarray) -> None:
        """Each word becomes the minimiser over its vectors: (sum of I + extra u u') c = sum of x + extra u (rest + u . x)."""
        along = np.stack([((x[:, m] - self.words[m][codes[:, m]]) * unit[:, m]).sum(1) for m in range(self.spaces)], 1)
        total = along.sum(1)
        for m in range(self.spaces):
            u, at = unit[:, m], codes[:, m]
            rest = total - along[:, m]
            target = x[:, m] + self.extra * u * (rest + (u * x[:, m]).sum(1))[:, None]
            count = np.bincount(at, minlength=CODES)
            left = np.zeros((CODES, WIDTH, WIDTH))
            right = np.stack([np.bincount(at, target[:, i], CODES) for i in range(WIDTH)], 1)
            for i in range(WIDTH):
                for j in range(WIDTH):
                    left[:, i, j] = self.extra * np.bincount(at, u[:, i] * u[:, j], CODES) + (count if i == j else 0)
            used = count > 0
            self.words[m][used] = np.linalg.solve(left[used], right[used][..., None])[..., 0]
            now = ((x[:, m] - self.words[m][at]) * u).sum(1)
            total += now - along[:, m]
            along[:, m] = now

    def encode(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Two 4-bit codes a byte; the lengths of the residuals, rounded up."""
        x = self.cut(vectors)
        unit = self.unit(x)
        codes = self.assign(x, unit, self.assign(x, unit))
        away = np.sqrt(((x - self.words[np.arange(self.spaces), codes]) ** 2).sum((1, 2)))
        codes = codes.astype(np.uint8)
        return codes[:, ::2] | codes[:, 1::2] << 4, (away * (1 + 1e-6)).astype(np.float32)

    def tables(self, queries: np.ndarray) -> np.ndarray:
        """For each query and byte of a code the inner product with each of its 256 values."""
        single = np.einsum("qmd,mcd->qmc", self.cut(queries), self.words)
        low, high = single[:, ::2], single[:, 1::2]
        return (high[..., :, None] + low[..., None, :]).reshape(len(queries), self.spaces // 2, 256).astype(np.float32)


def kth(x: np.ndarray, k: int) -> float:
    """The k-th largest."""
    return np.partition(x, len(x) - k)[len(x) - k]


def best(queries: np.ndarray, codes: np.ndarray, errors: np.ndarray, vectors: np.ndarray, ids: np.ndarray, quantiser: Quantiser, wanted: int, first: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each query (places, exact inner products) of its best, ties to the smaller of ``ids``: all are looked up, those that may be among the best are multiplied.

    Comparisons leave room for rounding, and what isn't a number passes them.
    """
    n, columns = len(vectors), np.ascontiguousarray(codes.T, np.intp)
    wanted, first = min(wanted, n), min(max(first, wanted), n)
    room = (len(queries[0]) + 2) * 2.0**-51 * np.sqrt((vectors**2).sum(1))
    large = np.abs(queries).max(1, keepdims=True)
    unit = queries / large
    unit /= np.sqrt((unit**2).sum(1, keepdims=True))
    for at in range(0, len(queries), 32):
        some = unit[at : at + 32]
        tables = quantiser.tables(some)
        reaches, found = np.zeros((n, len(some)), np.float32), np.empty((n, len(some)), np.float32)
        for table, column in zip(np.ascontiguousarray(tables.transpose(1, 2, 0)), columns):
            reaches += np.take(table, column, axis=0, out=found, mode="clip")
        rounding = (tables.shape[1] + 4) * 2.0**-23 * np.abs(tables).max(2).sum(1, dtype=float) + 1e-36
        alive = []
        for q, reach, error in zip(some, np.ascontiguousarray(reaches.T), rounding):
            few = np.argpartition(reach, n - first)[n - first :]
            bar = np.nextafter(np.float32(kth(vectors[few] @ q - room[few], wanted) - error), np.float32(-np.inf))
            reach += errors
            alive.append(np.flatnonzero(~(reach < bar)))
        many = [j for j, a in enumerate(alive) if 32 * len(a) > n]
        products = dict(zip(many, some[many] @ vectors.T)) if many else {}
        for j, (q, a) in enumerate(zip(some, alive)):
            near = products[j][a] if j in products else vectors[a] @ q
            last = a[~(near + room[a] < kth(near - room[a], wanted))]
            # added up from the left
            score = np.cumsum(vectors[last] * queries[at + j], 1)[:, -1] + 0.0
            top = np.lexsort((ids[last], -score))[:wanted]
            yield last[top], score[top]


def usable(vector: str) -> Column:
    """Not null, not empty, every component finite, not all zero."""
    v = F.col(vector)
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    return v.isNotNull() & F.coalesce(fine, F.lit(False)) & F.exists(v, lambda x: x != 0)


def nearest(vectors: DataFrame, queries: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = NEAREST, reranked: int = RERANKED, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: for each row that ``queries`` selects the k other rows of the largest inner product, exactly those.

    Scores are exact, in double precision; ties go to the smaller id. Vectors that are null, empty, all zero or have
    null or non-finite components, and null ids, take no part. Vectors of different lengths don't meet: each length is an index of its own.
    Every row but the query's own is a candidate, also one of the same id. A query id that is repeated is answered for each of its rows.
    train_rows: code words are learnt from so many vectors at most, drawn by their hash. Without usable rows the result is empty; other columns are not read.
    """
    spark = vectors.sparkSession
    rows = vectors.where(usable(vector_col) & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"), F.coalesce(queries, F.lit(False)).alias("asks"))
    rows = rows.withColumn("dim", F.size("v")).withColumn("h1", F.xxhash64("v")).withColumn("h2", F.xxhash64(F.lit(1), "v"))
    # of equal vectors the k + 1 smallest ids can be wanted; which are left is settled before the shuffle
    few = rows.withColumn("n", F.row_number().over(Window.partitionBy("h1", "h2", "dim").orderBy("id"))).where(F.col("n") <= k + 1)
    classes = few.groupBy("h1", "h2", "dim").agg(F.sort_array(F.collect_list("id")).alias("ids"), F.first("v").alias("v"))
    asking = rows.where("asks").select("id", "h1", "h2", "dim")
    classes = classes.join(asking.select("h1", "h2", "dim").distinct().withColumn("asks", F.lit(True)), ["h1", "h2", "dim"], "left")
    classes = keep(classes.withColumn("asks", F.coalesce("asks", F.lit(False))).withColumn("cls", F.monotonically_increasing_id()), "classes")
    found = None
    for dim, many, asked in sorted(tuple(r) for r in classes.groupBy("dim").agg(F.count("*"), F.count(F.when(F.col("asks"), 1))).collect()):  # a row for each length
        if asked:
            one = searched(classes.where(F.col("dim") == dim), dim, many, asked, k, reranked, train_rows)
            found = one if found is None else found.unionByName(one)
    if found is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    # of a class's answer each of its queries leaves out its own row
    tops = found.join(classes.select("cls", "h1", "h2", "dim"), "cls")
    own = F.expr("cast(array_position(transform(top, x -> x.own and x.vec_id = id), true) as int)")
    mine = asking.join(tops, ["h1", "h2", "dim"]).withColumn("at", own)
    left = F.expr(f"slice(filter(top, (x, i) -> i + 1 <> at), 1, {k})")
    out = mine.select(F.col("id").alias("query_id"), F.posexplode(left).alias("rank", "x"))
    return out.select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), "x.vec_id", "x.score")


def searched(classes: DataFrame, dim: int, many: int, asking: int, k: int, reranked: int, train_rows: int) -> DataFrame:
    """For each class that asks: cls, top (score, vec_id, own: whether it is of the class itself), the best k + 1 rows, the best first."""
    sample = drawn(classes.select(F.col("dim").alias("group"), F.col("v").alias("text"), F.lit(1).alias("weight")), lambda _: train_rows, 6).toArrow().column("text")  # train_rows
    sample = np.array(sorted(sample.to_pylist()), float)
    quantiser = classes.sparkSession.sparkContext.broadcast(Quantiser(sample))
    rows_in = BLOCK_BYTES // (8 * dim) + 1
    groups = max(-(-many // min(CANDIDATE_BLOCK, rows_in)), min(classes.sparkSession.sparkContext.defaultParallelism, -(-many // TASK_ROWS)))
    query_groups = -(-asking // min(QUERY_BLOCK, rows_in))
    block = lambda seed, n: F.pmod(F.xxhash64("cls", F.lit(seed)), F.lit(n)).cast("int")
    kind = classes.schema["v"].dataType.simpleString()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(float)
            codes, errors = quantiser.value.encode(v) if len(v) else ([], [])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(errors, pa.float32())], names=["cls", "low", "v", "code", "error"])

    codes = classes.select("cls", F.col("ids")[0].alias("low"), "v").mapInArrow(encode, f"cls long, low long, v {kind}, code binary, error float")
    candidates = codes.withColumn("cb", block(7, groups)).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(query_groups - 1))))
    asked = classes.where("asks").select("cls", F.lit(None).cast("long").alias("low"), "v", F.lit(None).cast("binary").alias("code"), F.lit(None).cast("float").alias("error"), F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("cb"), block(8, query_groups).alias("qb"))

    def scan(table: pa.Table) -> pa.Table:
        coded = table.column("code").is_valid()
        q, c = table.filter(pc.invert(coded)).combine_chunks(), table.filter(coded).combine_chunks()
        out = []
        if len(q) and len(c):
            code = np.frombuffer(b"".join(c.column("code").to_pylist()), np.uint8).reshape(len(c), -1)
            queries, vectors = (x.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(float) for x in (q, c))
            with np.errstate(all="ignore"):
                out = list(best(queries, code, c.column("error").to_numpy(), vectors, c.column("low").to_numpy(), quantiser.value, k + 1, reranked))
        places = np.concatenate([x[0] for x in out]) if out else np.zeros(0, int)
        asks = np.repeat(q.column("cls").to_numpy()[: len(out)], [len(x[0]) for x in out])
        return pa.table({"cls": asks, "other": c.column("cls").to_numpy()[places], "low": c.column("low").to_numpy()[places], "score": np.concatenate([x[1] for x in out]) if out else np.zeros(0)})

    met = candidates.unionByName(asked).groupBy("cb", "qb").applyInArrow(scan, "cls long, other long, low long, score double")
    # k + 1 classes hold the best k + 1 rows
    ranked = met.withColumn("n", F.row_number().over(Window.partitionBy("cls").orderBy(F.desc("score"), "low"))).where(F.col("n") <= k + 1)
    ranked = ranked.join(classes.select(F.col("cls").alias("other"), "ids"), "other")
    each = ranked.withColumn("vec_id", F.explode("ids")).select("cls", F.struct((-F.col("score")).alias("less"), "vec_id", (F.col("cls") == F.col("other")).alias("own")).alias("x"))
    top = F.transform(F.slice(F.sort_array(F.collect_list("x")), 1, k + 1), lambda x: F.struct((-x["less"]).alias("score"), x["vec_id"].alias("vec_id"), x["own"].alias("own")))
    return each.groupBy("cls").agg(top.alias("top"))  # (k + 1)**2 rows at most in each
