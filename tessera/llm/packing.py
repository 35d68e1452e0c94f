"""Packing by concatenating and cutting.

All documents' token streams are laid end to end and cut every ``SEQUENCE`` tokens.
Pass 1 tokenises each document once and writes its ids with its place in its partition's
stream; the totals of the partitions, one row each, are then summed to global offsets. Pass 2
cuts each document where its global range crosses a window's edge. Neither pass shuffles,
and only the last sequence is not full.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


from .common import keep, tidy

SEQUENCE, END = 2048, 1
#: Words whose ids a task remembers; then it starts anew.
CACHE_WORDS = 1_000_000


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordIds:
    """Ids (little-endian, two bytes each if the vocabulary allows) of text between blanks. The tokenizer drops white space and no token spans it.

    Latin-1 texts are lower-cased at once, as the tokenizer would, and a full stop or comma after a word of
    letters is looked up apart. New words of letters alone are encoded many at a time, since each ends with its
    only token that closes a word.
    """

    TOGETHER = 1000

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks share the cores already
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        self.encode = tokenizer.encode_batch_fast
        self.closes = np.zeros(tokenizer.get_vocab_size(), bool)
        for token, i in tokenizer.get_vocab().items():
            self.closes[i] = token.endswith("</w>")
        self.kind = np.dtype("<u2" if len(self.closes) <= 1 << 16 else "<u4")
        #: Tokens that the tokenizer looks for before it lower-cases: they stand for themselves in this spelling only.
        self.reserved = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
        self.known: dict[str, bytes] = {"": b""}
        self.marks = {m: self.whole([m])[0] for m in ".,"}

    def whole(self, words: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.kind).tobytes() for e in self.encode(words, add_special_tokens=False)]

    def letters(self, words: list[str]) -> list[bytes]:
        ids = np.array(self.encode([" ".join(words)], add_special_tokens=False)[0].ids, self.kind)
        ends = np.flatnonzero(self.closes[ids]) + 1
        if len(ends) != len(words) or not len(ids) or ends[-1] != len(ids):
            return self.whole(words)
        data, ends = ids.tobytes(), (self.kind.itemsize * ends).tolist()
        return [data[a:b] for a, b in zip([0, *ends], ends)]

    def learn(self, words: set[str]) -> None:
        plain = [w for w in words if w.isalpha()]
        for new, step in ((plain, self.letters), (list(words.difference(plain)), self.whole)):
            for at in range(0, len(new), self.TOGETHER):
                some = new[at : at + self.TOGETHER]
                self.known.update(zip(some, step(some)))

    def lowered(self, text: str) -> str:
        if not text.isascii():
            try:
                text.encode("latin-1")
            except UnicodeEncodeError:
                return text
        low = text.lower()
        return text if any(t in low for t in self.reserved) else low

    def of(self, texts: list[str]) -> list[bytes]:
        if len(self.known) > CACHE_WORDS:
            self.known = {"": b""}
        words, bounds = [], [0]
        for t in texts:
            words += self.lowered(t).replace("\n", " ").split(" ")
            bounds.append(len(words))
        find, marks = self.known.get, self.marks
        ids = list(map(find, words))
        missing = [i for i, x in enumerate(ids) if x is None]
        new, later = set(), []
        for i in missing:
            w = words[i]
            if (mark := marks.get(w[-1])) and (stem := w[:-1]).isalpha():
                if (x := find(stem)) is not None:
                    ids[i] = x + mark
                    continue
                w = stem
            else:
                mark = b""
            new.add(w)
            later.append((i, w, mark))
        if new:
            self.learn(new)
            for i, w, mark in later:
                ids[i] = self.known[w] + mark
        return [b"".join(ids[a:b]) for a, b in zip(bounds, bounds[1:])]


def tokenized(docs: DataFrame, path: str, id_col: str, text_col: str) -> DataFrame:
    """Each document's ids (with END) as bytes, its partition and its place in that partition's stream."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordIds(path)  # for this task
        part, place, end = TaskContext.get().partitionId(), 0, np.array([END], cache.kind).tobytes()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                rows = batch.slice(at, 256)
                ids = [x + end for x in cache.of([t or "" for t in rows.column(1).to_pylist()])]
                tokens = np.array([len(x) // cache.kind.itemsize for x in ids], np.int64)
                starts = place + np.cumsum(tokens) - tokens
                place += int(tokens.sum())
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(np.full(len(ids), part, np.int32)), pa.array(starts), pa.array(tokens), pa.array(ids, pa.binary())], names=["doc_id", "part", "place", "doc_tokens", "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col)).mapInArrow(tidy(encode), f"doc_id {kind}, part int, place long, doc_tokens long, ids binary")


def pack(docs: DataFrame, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text", length: int = SEQUENCE, digest: bool = False) -> DataFrame:
    """The pieces of all documents: doc_id, start, length, ids (uint32 bytes), doc_tokens, sequence_id, offset.

    digest: in place of the ids their CRC-32, ids_crc32.

    Each token of a document, its closing END included, lies in exactly one piece.
    Null and empty texts have that one token. Repeated rows and null ids are documents like any other. No document:
    no piece. Other columns of ``docs`` are not read.
    """
    stream = keep(tokenized(docs, tokenizer or default_tokenizer(), id_col, text_col), "tokens")
    totals = sorted(tuple(r) for r in stream.groupBy("part").agg(F.max(F.col("place") + F.col("doc_tokens"))).collect())  # a row for each input partition
    parts = np.array([p for p, _ in totals], np.int64)
    before = np.concatenate([[0], np.cumsum([n for _, n in totals])]).astype(np.int64)
    known = docs.sparkSession.sparkContext.broadcast((parts, before))  # 16 bytes for each input partition

    column = "ids_crc32" if digest else "ids"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, before = known.value
        for batch in batches:
            if not batch.num_rows:
                continue
            part, place, tokens = (batch.column(i).to_numpy() for i in (1, 2, 3))
            begin = before[np.searchsorted(parts, part)] + place
            first, last = begin // length, (begin + tokens - 1) // length
            pieces = last - first + 1
            row = np.repeat(np.arange(batch.num_rows), pieces)
            sequence = first[row] + np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            low, high = np.maximum(begin[row], sequence * length), np.minimum((begin + tokens)[row], (sequence + 1) * length)
            start = low - begin[row]
            texts = [memoryview(x.as_buffer()) for x in batch.column(4)]
            width = len(texts[0]) // int(tokens[0])
            wide = [np.frombuffer(x, f"<u{width}").astype("<u4") for x in texts]
            ids = [wide[r][s : s + n] for r, s, n in zip(row.tolist(), start.tolist(), (high - low).tolist())]
            content = pa.array([zlib.crc32(x) for x in ids], pa.int64()) if digest else pa.array([x.tobytes() for x in ids], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(row)), pa.array(start), pa.array(high - low), content, pa.array(tokens[row]), pa.array(sequence), pa.array(low - sequence * length)],
                names=["doc_id", "start", "length", column, "doc_tokens", "sequence_id", "offset"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    return stream.mapInArrow(tidy(cut), f"doc_id {kind}, start long, length long, {column} {'long' if digest else 'binary'}, doc_tokens long, sequence_id long, offset long")
