"""Language-model scores by a weighted backoff automaton of word n-grams.

States are contexts counted in the training part: none, one word, or two. A state has arcs for the words that
followed it and a failure arc to its next shorter context. Counts are smoothed by a Dirichlet prior around the shorter context's
distribution: of a context counted C times an arc taken c times weighs (c + m * p) / (C + m), p being what
the shorter context gives the word, and the failure arc m / (C + m). So each state's arcs and
what its failure arc leads to are a distribution. The state without context knows every word; a class
for unknown words gets the mass that discounting frees there. m is set for each order so that, were each token left out in turn, as many would
fail there as n-grams were seen just once. No word, pair or triple is left out.

The automaton is nowhere whole. Texts are held in chunks with a vocabulary of their own. A chunk sends its distinct n-grams to
shards of their hashes (40 bits within a shard of bounded size, delta-coded) and gets their counts back in the same order. With these it has all states and arcs that
its texts can meet, and reads the texts from left to right, carrying the state and adding up logarithms. Each n-gram
goes to a shard by its own hash, once a chunk, so no frequent word or pair makes one shard larger than others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import blocks, keep, mixed, text_bytes, tidy, word_hashes

#: Text in a chunk; a longer text is a chunk of its own.
CHUNK_BYTES = 4 << 20
#: Tokens of the texts whose n-grams a shard gets, on average (of a text's tokens there are as many n-grams of each order).
SHARD_TOKENS = 1 << 19
#: Tokens that are read one after another; further parts of a text start from the state that ends the one before.
STRETCH = 256
END = np.uint64(0x454E44)  # the end of a text; words' hashes are mixed and don't meet it but by chance
ADD = 0.1
#: Histograms of counts have a class for each of 1 to 4, then one for each power of two.
CLASSES = 64
_ODD = np.uint64(0x9E3779B97F4A7C15)


def packed(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """Runs of whole numbers (values[bounds[i] : bounds[i + 1]]) as binaries of seven bits a byte, the last byte below 128."""
    values = values.astype(np.uint64, copy=False)
    size, most = np.ones(len(values), np.int64), int(values.max(initial=0))
    k = 7
    while most >> k:
        size += values >= np.uint64(1 << k)
        k += 7
    ends = np.concatenate([[0], np.cumsum(size)])
    out, first = np.zeros(int(ends[-1]), np.uint8), ends[:-1]
    for k in range(int(size.max(initial=0))):
        more = size > k
        out[first[more] + k] = (values[more] >> np.uint64(7 * k)) & np.uint64(127) | (size[more] > k + 1).astype(np.uint64) << np.uint64(7)
    return binaries(out, ends[bounds])


def unpacked(raw: np.ndarray) -> np.ndarray:
    ends = np.flatnonzero(raw < 128)
    starts = np.concatenate([[0], ends[:-1] + 1]).astype(np.int64)[: len(ends)]
    size = ends - starts + 1
    out = np.zeros(len(ends), np.uint64)
    for k in range(int(size.max(initial=0))):
        more = size > k
        out[more] |= (raw[starts[more] + k].astype(np.uint64) & np.uint64(127)) << np.uint64(7 * k)
    return out


def binaries(data: np.ndarray, bounds: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data).tobytes())])


def pressed(x: np.ndarray) -> bytes:
    """An array of uint32, byte by byte of each number, compressed."""
    return len(x).to_bytes(8, "little") + pa.compress(np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes(), codec="zstd", asbytes=True)


def restored(x: bytes) -> np.ndarray:
    n = int.from_bytes(x[:8], "little")
    return np.ascontiguousarray(np.frombuffer(pa.decompress(x[8:], 4 * n, codec="zstd", asbytes=True), np.uint8).reshape(4, n).T).view("<u4").ravel() if n else np.zeros(0, np.uint32)


def chunked(docs: DataFrame, id_col: str, text_col: str, train: Column) -> DataFrame:
    """One row per chunk: its texts' ids, training flags and token counts, the tokens by local number, the words' hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, part, held, waiting = 0, TaskContext.get().partitionId(), [], 0
        for batch in batches:
            sizes = np.diff(text_bytes(batch.column(1))[1])
            start = 0
            for i, n in enumerate(sizes.tolist()):  # chunks go on over batches
                if waiting and waiting + n > CHUNK_BYTES:
                    held.append(batch.slice(start, i - start))
                    yield chunk(part * (1 << 32) + made, held)
                    made, held, waiting, start = made + 1, [], 0, i
                waiting += n
            held.append(batch.slice(start))
        if sum(b.num_rows for b in held):
            yield chunk(part * (1 << 32) + made, held)

    def chunk(number: int, batches: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(batches).combine_chunks()
        raw, offsets = text_bytes(table.column(1))
        hashed, lengths = [], []
        for i, j in blocks(offsets, CHUNK_BYTES >> 3):
            word, bounds = word_hashes(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            hashed.append(np.insert(word, bounds[1:], END))
            lengths.append(np.diff(bounds) + 1)
        word, count = np.concatenate(hashed), np.concatenate(lengths)
        train = table.column(2).to_numpy(zero_copy_only=False).astype(bool)
        hashes, local, times = np.unique(word, return_inverse=True, return_counts=True)
        order = np.argsort(-times, kind="stable")  # small numbers for frequent words
        rank = np.empty_like(order)
        rank[order] = np.arange(len(order))
        ids = table.column(0).combine_chunks()
        whole = lambda x, kind: pa.ListArray.from_arrays(pa.array([0, table.num_rows], pa.int32()), x if isinstance(x, pa.Array) else pa.array(x, kind))
        return pa.RecordBatch.from_arrays(
            [pa.array([number]), whole(ids.combine_chunks() if isinstance(ids, pa.ChunkedArray) else ids, None), whole(train, pa.bool_()), whole(count, pa.int64())]
            + [pa.array([x], pa.binary()) for x in (pressed(rank[local]), hashes[order].tobytes())]
            + [pa.array([int(count.sum())]), pa.array([int(count[train].sum())])],
            names=names,
        )

    names = ["chunk", "ids", "train", "counts", "tokens", "words", "all_tokens", "train_tokens"]
    kinds = [T.LongType(), T.ArrayType(docs.schema[id_col].dataType), T.ArrayType(T.BooleanType()), T.ArrayType(T.LongType()), T.BinaryType(), T.BinaryType(), T.LongType(), T.LongType()]
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.coalesce(train, F.lit(False)).alias("train")).mapInArrow(tidy(run), T.StructType([T.StructField(n, k) for n, k in zip(names, kinds)]))


def joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of each pair."""
    return mixed(a * _ODD + b)


class Grams:
    """A chunk's distinct words, pairs and triples, each by ascending hash.

    keys[k]: the hashes; at[k]: the tokens that end one; which[k]: the n-gram of each of these; short[k], long[k]: the pair's (triple's) number without its last
    and without its first word, by the next smaller order.
    """

    def __init__(self, words: np.ndarray, tokens: np.ndarray, counts: np.ndarray):
        self.first = np.zeros(len(tokens), bool)
        self.first[np.cumsum(counts) - counts] = True
        order = np.argsort(words)
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        words, tokens = words[order], rank[tokens.astype(np.int64)]
        at2 = np.flatnonzero(~self.first)
        at3 = at2[~self.first[at2 - 1]]
        key2, pair, short2, long2 = self.longer(words, words, tokens[at2 - 1], tokens[at2])
        number = np.full(len(tokens), -1)
        number[at2] = pair
        # a triple is its first two words and its last; its last two are told by any place where it stands
        key3, triple, short3, _ = self.longer(key2, words, number[at3 - 1], tokens[at3])
        long3 = np.zeros(len(key3), np.int64)
        long3[triple] = number[at3]
        self.keys, self.at, self.which = [words, key2, key3], [np.arange(len(tokens)), at2, at3], [tokens, pair, triple]
        self.short, self.long = [None, short2, short3], [None, long2, long3]

    @staticmethod
    def longer(context_keys: np.ndarray, words: np.ndarray, context: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, ...]:
        both, at = np.unique(context << 32 | last, return_inverse=True)
        context, last = both >> 32, both & 0xFFFFFFFF
        key = joined(context_keys[context], words[last])
        order = np.argsort(key)
        moved = np.empty(len(order), np.int64)
        moved[order] = np.arange(len(order))
        return key[order], moved[at], context[order], last[order]


def sent(chunks: DataFrame, bits: int) -> DataFrame:
    """The distinct n-grams of each chunk and their training counts: a row for each chunk and shard, the first ``bits`` of the hash.

    lowK, highK: of the next 40 bits the low three bytes, and what is above them as differences; nK: the counts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, words, tokens, train, counts in zip(*(c.to_pylist() for c in batch.columns)):
                counts = np.array(counts, np.int64)
                grams = Grams(np.frombuffer(words, np.uint64), restored(tokens), counts)
                trained = np.repeat(np.array(train, bool), counts)
                shards = [key >> np.uint64(64 - bits) for key in grams.keys]
                here = np.unique(np.concatenate([x[np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]]))] for x in shards if len(x)]))
                columns = []
                for key, shard, at, which in zip(grams.keys, shards, grams.at, grams.which):
                    bounds = np.append(np.searchsorted(shard, here), len(key))
                    left = key << np.uint64(bits) >> np.uint64(24)
                    high = left >> np.uint64(24)
                    step = np.diff(high, prepend=np.uint64(0))
                    starts = bounds[:-1][np.diff(bounds) > 0]
                    step[starts] = high[starts]
                    low = left.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :3]
                    n = np.bincount(which[trained[at]], minlength=len(key))
                    columns += [binaries(low, 3 * bounds), packed(step, bounds), packed(n, bounds)]
                yield pa.RecordBatch.from_arrays([pa.array(here.astype(np.int64)), pa.array(np.full(len(here), chunk)), *columns], names=names)

    names = ["shard", "chunk", *(f"{x}{k}" for k in (1, 2, 3) for x in ("low", "high", "n"))]
    return chunks.select("chunk", "words", "tokens", "train", "counts").mapInArrow(tidy(run), "shard long, chunk long, " + ", ".join(f"{x} binary" for x in names[2:]))


def class_of(n: np.ndarray) -> np.ndarray:
    """The class of a count: 0 to 3 for 1 to 4, then by powers of two."""
    return np.where(n <= 4, n - 1, 2 + np.ceil(np.log2(np.maximum(n, 1))).astype(np.int64))


def totals(rows: DataFrame) -> DataFrame:
    """For each n-gram sent its count in all chunks (n1, n2, n3 of a chunk and shard, in the order sent).

    tallies, in one row of a shard: for each order by class of the count how many n-grams have it, then the sum of their counts.
    """

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("chunk").combine_chunks()
        m, out, tallies = table.num_rows, [], np.zeros((3, 2, CLASSES), np.int64)
        for k in (1, 2, 3):
            low, at = text_bytes(table.column(f"low{k}"))
            bounds = at // 3
            key = np.zeros((len(low) // 3, 4), np.uint8)
            key[:, :3] = low.reshape(-1, 3)
            step = unpacked(text_bytes(table.column(f"high{k}"))[0]).astype(np.int64)
            run_ = np.concatenate([[0], np.cumsum(step)])
            high = run_[1:] - np.repeat(run_[bounds[:-1]], np.diff(bounds))
            n = unpacked(text_bytes(table.column(f"n{k}"))[0]).astype(np.int64)
            _, which = np.unique(high << 24 | key.view("<u4").ravel().astype(np.int64), return_inverse=True)
            count = np.bincount(which, n).astype(np.int64)
            seen = count[count > 0]
            tallies[k - 1] = np.bincount(class_of(seen), minlength=CLASSES), np.bincount(class_of(seen), seen, CLASSES)
            out.append(packed(count[which], bounds))
        notes = pa.array([tallies.ravel().tolist(), *[None] * (m - 1)], pa.list_(pa.int64()))
        return pa.table([table.column("chunk"), table.column("shard"), *out, notes], names=["chunk", "shard", "n1", "n2", "n3", "tallies"])

    return rows.groupBy("shard").applyInArrow(lambda table: run(table), "chunk long, shard long, n1 binary, n2 binary, n3 binary, tallies array<long>")


def discount(ones: int, twos: int) -> float:
    return float(np.clip(ones / max(1, ones + 2 * twos), 0.1, 0.9))


def strength(contexts: np.ndarray, ones: int) -> float:
    """The weight m of a shorter context's distribution: left out one at a time, as many tokens fail as n-grams were seen once.

    contexts: by class of the count how many contexts have it, and the sum of their counts. A token's context counts one less without it.
    """
    some = contexts[0] > 0
    times, many = contexts[1][some].astype(float), (contexts[1][some] / contexts[0][some]) - 1
    low, high = -7.0, 14.0  # natural logarithms
    for _ in range(60):
        m = np.exp((low + high) / 2)
        low, high = (low, (low + high) / 2) if (times * m / (many + m)).sum() > ones else ((low + high) / 2, high)
    return float(np.exp((low + high) / 2))


class Automaton:
    """The states and arcs that a chunk's texts can meet, from its n-grams and their counts. Logarithms to base 10."""

    def __init__(self, grams: Grams, counts: list[np.ndarray], total: int, unknown: float, off: float, m: tuple[float, float]):
        one, two, three = counts
        self.grams, self.known = grams, [n > 0 for n in counts]
        p1 = np.where(one > 0, (one - off) / max(total, 1), unknown)
        fail1, fail2 = m[0] / (one + m[0]), m[1] / (two + m[1])
        short, long = grams.short[1], grams.long[1]
        p2 = np.where(one[short] > 0, (two + m[0] * p1[long]) / (one[short] + m[0]), p1[long])
        short, long = grams.short[2], grams.long[2]
        p3 = (three + m[1] * p2[long]) / (two[short] + m[1])
        self.arcs = [np.log10(p) for p in (p1, p2, p3)]
        self.failures = [np.log10(fail1), np.log10(fail2)]

    def read(self) -> np.ndarray:
        """The log probability of each token, from left to right; the state is the length of the context, the context ends before the token."""
        g, n = self.grams, len(self.grams.first)
        number = [g.which[0], np.full(n, -1), np.full(n, -1)]
        number[1][g.at[1]], number[2][g.at[2]] = g.which[1], g.which[2]
        known = [k[x] & (x >= 0) if len(k) else np.zeros(n, bool) for k, x in zip(self.known, number)]
        start = np.flatnonzero(g.first)
        length = np.diff(np.append(start, n))
        cut = -(-length // STRETCH)
        inside = np.arange(int(cut.sum())) - np.repeat(np.cumsum(cut) - cut, cut)
        start = np.repeat(start, cut) + STRETCH * inside
        length = np.minimum(np.repeat(length, cut) - STRETCH * inside, STRETCH)
        order = np.argsort(-length, kind="stable")
        start, length = start[order], length[order]
        # a text starts without context, a further stretch from the longest context that ends before it
        state = np.where(g.first[start], 0, np.where(known[1][start - 1], 2, np.where(known[0][start - 1], 1, 0)))
        out = np.zeros(n)
        for step in range(int(length.max(initial=0))):
            at = start[: np.searchsorted(-length, -step)] + step
            now, log = state[: len(at)].copy(), np.zeros(len(at))
            for k in (2, 1):  # fail where the state has no arc for the token
                fails = (now == k) & ~known[k][at]
                log[fails] += self.failures[k - 1][number[k - 1][at[fails] - 1]]
                now[fails] = k - 1
            for k in (0, 1, 2):
                takes = now == k
                log[takes] += self.arcs[k][number[k][at[takes]]]
            out[at] = log
            # the arc leads to the longest context that ends in the token
            state[: len(at)] = np.where(known[1][at] & (now > 0), 2, np.where(known[0][at], 1, 0))
        return out


def score(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, train, n_tokens, n_known, train_tokens, base_score, score (log10).

    train: the rows to learn from. Null, empty and blank texts consist of their end alone.
    Without any training text every token has probability 1 under the model and 1 / (1 + V) = 1 in the base score. Repeated rows and
    null ids each get a row (and each repeat counts if it trains); other columns are not read.
    """
    chunks = keep(chunked(docs, id_col, text_col, train), "chunks")
    total, tokens = chunks.agg(F.coalesce(F.sum("train_tokens"), F.lit(0)), F.coalesce(F.sum("all_tokens"), F.lit(0))).first()
    bits = int(np.ceil(np.log2(max(2, tokens / SHARD_TOKENS))))
    answers = keep(totals(sent(chunks, bits)), "counts")
    tallies = np.zeros((3, 2, CLASSES), np.int64)
    for place, x in answers.select(F.posexplode("tallies")).groupBy("pos").agg(F.sum("col")).collect():  # one row for each class
        tallies.ravel()[place] = x
    off = discount(*tallies[0, 0, :2])
    m = tuple(strength(tallies[k], int(tallies[k + 1, 0, 0])) for k in (0, 1))
    vocabulary = int(tallies[0, 0].sum())
    unknown = off * vocabulary / total if total else 1.0
    floor = total + ADD * (vocabulary + 1)

    def read(left: pa.Table, right: pa.Table) -> pa.Table:
        chunk = {c: left.column(c)[0].as_py() for c in ("counts", "tokens", "words", "train")}
        counts, right = np.array(chunk["counts"], np.int64), right.sort_by("shard").combine_chunks()
        n = [unpacked(text_bytes(right.column(f"n{k}"))[0]).astype(np.int64) for k in (1, 2, 3)]
        grams = Grams(np.frombuffer(chunk["words"], np.uint64), restored(chunk["tokens"]), counts)
        p = Automaton(grams, n, total, unknown, off, m).read()
        known, starts, many = n[0][grams.which[0]], np.cumsum(counts) - counts, len(counts)
        return pa.table({
            "doc_id": pa.chunked_array([x.values for x in left.column("ids")]), "train": pa.array(chunk["train"], pa.bool_()), "n_tokens": pa.array(counts, pa.int64()), "n_known": pa.array(np.add.reduceat(known > 0, starts, dtype=np.int64)),
            "train_tokens": pa.array(np.full(many, total, np.int64)), "base_score": pa.array(np.add.reduceat(np.log10((known + ADD) / floor), starts)), "score": pa.array(np.add.reduceat(p, starts)),
        })

    kind = docs.schema[id_col].dataType.simpleString()
    left, right = chunks.select("chunk", "ids", "train", "counts", "tokens", "words").groupBy("chunk"), answers.select("chunk", "shard", "n1", "n2", "n3").groupBy("chunk")
    return left.cogroup(right).applyInArrow(read, f"doc_id {kind}, train boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
