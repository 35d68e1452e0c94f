"""Language identification by prediction by partial matching (PPM).

For each language a tree of byte contexts of up to four bytes holds the counts of
the bytes that followed. A byte seen after the longest known context costs its
PPM-C share there; one not seen costs the escape and is sought after the next
shorter context. The share that an escape may spend there leaves out the bytes seen
above it, so every context's code is a complete distribution over 256 bytes and code
lengths are exact. Counts are frozen after training. The language with the shortest
code is predicted.

The trees of all languages are merged into one table per order whose rows hold
one code length for each language (integers of 2**-16 bits, so that sums don't depend
on their order): one lookup serves all languages.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import HashIndex, blocks, drawn, release, text_bytes, tidy

#: Bytes in the longest n-gram: a context of four and the byte after it.
LONGEST = 5
#: Code lengths are integers of 1/UNIT bits.
UNIT = 65536
#: At most so many bytes of training text, over all languages and for one.
TRAIN_BYTES, TRAIN_BYTES_EACH = 16 << 20, 1 << 20


def grams(padded: np.ndarray, n: int) -> np.ndarray:
    """Key of the n bytes that end at each position from LONGEST - 1 on."""
    out = np.zeros(len(padded) - LONGEST + 1, np.uint64)
    for i in range(n):
        at = LONGEST - n + i
        out <<= np.uint64(8)
        out |= padded[at : at + len(out)]
    return out


def padded(texts: list[bytes]) -> np.ndarray:
    """The texts, each after LONGEST - 1 zero bytes."""
    gap = bytes(LONGEST - 1)
    return np.frombuffer(b"".join(gap + t for t in texts), np.uint8)


class ContextTree:
    """Frozen PPM statistics of one language: for each n the n-grams' probabilities and the contexts' escape weights."""

    def __init__(self, texts: list[bytes]):
        data = padded(texts)
        own = np.ones(len(data), bool)
        ends = np.cumsum([len(t) + LONGEST - 1 for t in texts]) if texts else np.zeros(0, int)
        for start in np.concatenate([[0], ends[:-1]]).astype(int) if texts else []:
            own[start : start + LONGEST - 1] = False
        own = own[LONGEST - 1 :]
        self.keys, self.p, self.contexts, self.weight = {}, {}, {}, {}
        for n in range(1, LONGEST + 1):
            keys, count = np.unique(grams(data, n)[own], return_counts=True) if len(data) >= LONGEST else (np.zeros(0, np.uint64), np.zeros(0, int))
            context, at, seen = np.unique(keys >> np.uint64(8), return_inverse=True, return_counts=True)
            total = np.bincount(at, count, len(context))
            p = count / (total + seen)[at]
            below = self.cost(keys & np.uint64((1 << 8 * (n - 1)) - 1), n - 1, bits=False) if n > 1 else np.full(len(keys), 1 / 256)
            left = 1 - np.bincount(at, below, len(context))
            full = left < 1e-9  # all 256 bytes were seen: nothing is left for an escape
            weight = np.where(full, 1.0, seen / (total + seen) / np.where(full, 1, left))
            self.keys[n], self.p[n], self.contexts[n], self.weight[n] = keys, p, context, weight

    def cost(self, keys: np.ndarray, n: int, bits: bool = True) -> np.ndarray:
        """Probability, or code length in bits, of the last byte of each key of n bytes after the others."""
        if n == 0:
            return np.full(len(keys), 8.0 if bits else 1 / 256)
        out, seen = lookup(self.keys[n], self.p[n], keys, 0.0)
        if not seen.all():
            miss = keys[~seen]
            weight, _ = lookup(self.contexts[n], self.weight[n], miss >> np.uint64(8), 1.0)
            out[~seen] = weight * self.cost(miss & np.uint64((1 << 8 * (n - 1)) - 1), n - 1, bits=False)
        return -np.log2(out) if bits else out


def lookup(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray, other: float) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return np.full(len(wanted), other), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    seen = keys[at] == wanted
    return np.where(seen, values[at], other), seen


class Model:
    """The merged trees. ``bits(texts)`` gives each text's code length under each language, in 1/UNIT bits."""

    def __init__(self, texts: dict[str, list[bytes]]):
        self.langs = sorted(texts)
        trees = [ContextTree(texts[x]) for x in self.langs]
        whole = lambda costs: np.round(np.stack(costs) * UNIT).astype(np.int32) if costs else np.zeros((0, 0), np.int32)
        self.first = whole([t.cost(np.arange(256, dtype=np.uint64), 1) for t in trees])
        self.tables = {}
        for n in range(2, LONGEST + 1):
            keys = np.unique(np.concatenate([t.keys[n] for t in trees] or [np.zeros(0, np.uint64)]))
            contexts = np.unique(keys >> np.uint64(8))
            escapes = whole([-np.log2(lookup(t.contexts[n], t.weight[n], contexts, 1.0)[0]) for t in trees])
            self.tables[n] = (HashIndex(keys), whole([t.cost(keys, n) for t in trees]), HashIndex(contexts), escapes)

    def add(self, data: np.ndarray, own: np.ndarray, segments: np.ndarray, out: np.ndarray) -> None:
        """Add to out[language, segment] the code lengths of the bytes data[own + LONGEST - 1]; segments: the text of each, ascending."""
        all_keys = grams(data, LONGEST)[own]
        todo = np.arange(len(own))
        for n in range(LONGEST, 1, -1):
            index, costs, contexts, escapes = self.tables[n]
            keys = all_keys[todo] & np.uint64((1 << 8 * n) - 1)
            at = index.find(keys)
            hit = at >= 0
            self.gather(costs, at[hit], segments[todo[hit]], out)
            todo, keys = todo[~hit], keys[~hit]
            if not len(todo):
                return
            up = contexts.find(keys >> np.uint64(8))
            known = up >= 0
            self.gather(escapes, up[known], segments[todo[known]], out)
        self.gather(self.first, data[own[todo] + LONGEST - 1], segments[todo], out)

    @staticmethod
    def gather(costs: np.ndarray, at: np.ndarray, segments: np.ndarray, out: np.ndarray) -> None:
        if len(at):
            starts = np.flatnonzero(np.concatenate([[True], segments[1:] != segments[:-1]]))
            for i, row in enumerate(costs):
                out[i, segments[starts]] += np.add.reduceat(row[at], starts, dtype=np.int64)

    def bits(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """raw, offsets: as from text_bytes. Long texts go through in windows, each with the bytes before it."""
        out = np.zeros((len(self.langs), len(offsets) - 1), np.int64)
        back, most = LONGEST - 1, 1 << 19
        for first, last in blocks(offsets, most):
            text, length = raw[offsets[first] : offsets[last]], np.diff(offsets[first : last + 1])
            segments = np.repeat(np.arange(first, last), length)
            at = np.arange(len(text)) + back * (segments - first)  # each text comes after a gap of zeros
            data = np.zeros(len(text) + back * (last - first), np.uint8)
            data[at + back] = text
            for i in range(0, len(text), most):
                own = at[i : i + most]
                self.add(data[own[0] : own[-1] + LONGEST], own - own[0], segments[i : i + most], out)
        return out


def sampled(docs: DataFrame, text_col: str, lang_col: str, train: Column, most: int = TRAIN_BYTES, most_each: int = TRAIN_BYTES_EACH) -> dict[str, list[bytes]]:
    """Training texts for each language: whole texts, drawn by their hash, at most ``most_each`` bytes for a language and ``most`` for all."""
    text = F.col(text_col)
    rows = docs.where(train & F.col(lang_col).isNotNull() & text.isNotNull()).select(F.col(lang_col).alias("group"), text.alias("text"), F.octet_length(text_col).alias("weight"))
    out: dict[str, list[bytes]] = {}
    for r in sorted(drawn(rows, lambda n: min(most_each, most // max(1, n)), 1).collect()):  # ``most`` bytes
        out.setdefault(r[0], []).append(r[1].encode())
    return out


def identify(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", carry: list[str] | None = None, train_bytes: int = TRAIN_BYTES, train_bytes_each: int = TRAIN_BYTES_EACH) -> DataFrame:
    """Predict the language of every whole text.

    train: the rows from which to learn (of these, null languages and texts are left
    out). carry: columns to return (the id alone if not given). Added: ``lang_pred``, ``score`` (the
    posterior of the prediction under equal priors), ``bits_per_byte`` (code length under it).
    A carried column of one of these names is replaced. train_bytes, train_bytes_each: bounds of the texts learnt
    from, of all languages and of one (whole texts, drawn by their hash; a longer text than the bound is not learnt from).

    Null, empty and letterless texts: ``und``, score 0, null bits. Without any training
    text everything is ``und``. Languages of equal code length: the first by name. Repeated
    rows each get a row.
    """
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(Model(sampled(docs, text_col, lang_col, train, train_bytes, train_bytes_each)))  # bounded by TRAIN_BYTES
    release()  # what the driver trained with
    added = ("lang_pred", "score", "bits_per_byte")
    carry = [c for c in (carry or [id_col]) if c not in added]
    schema = T.StructType([docs.schema[c] for c in carry] + [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("bits_per_byte", T.DoubleType())])

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for batch in batches:
            raw, offsets = text_bytes(batch.column(carry.index(text_col) if text_col in carry else len(carry) + 1))
            letters = batch.column(len(carry)).to_numpy(zero_copy_only=False).astype(bool)
            length, bits = np.diff(offsets), m.bits(raw, offsets)
            known = letters & bool(m.langs)
            best = bits.argmin(0) if m.langs else np.zeros(len(length), int)
            least = bits.min(0) if m.langs else np.zeros(len(length))
            score = 1 / np.exp2(np.maximum(least - bits, -1000 * UNIT) / UNIT).sum(0) if m.langs else np.zeros(len(length))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in range(len(carry)))]
                + [
                    pa.array([m.langs[b] if k else "und" for b, k in zip(best, known)], pa.string()),
                    pa.array(np.where(known, score, 0.0)),
                    pa.array(least / UNIT / np.maximum(length, 1), mask=~known),
                ],
                names=[*carry, *added],
            )

    letters = F.coalesce(F.col(text_col).rlike("\\p{L}"), F.lit(False))
    # a text that is carried needn't come twice
    return docs.select(*carry, letters.alias("_letters"), *(() if text_col in carry else (text_col,))).mapInArrow(tidy(predict), schema)
