"""The content-addressed store of ingested payloads and tables, and the calls that answer follow-up requests on them."""

from __future__ import annotations

import contextlib
import contextvars
import functools
import hashlib
import json
import math
import re
import threading
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import query as q
from .sources import payload

THRESHOLD, PREVIEW_ROWS, PREVIEW_CHARS, SLOTS, BYTES = 3000, 3, 1200, 50, 50 << 20


def fingerprint(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def fingerprint_column(text: Column) -> Column:
    """``fingerprint`` of a column of payloads."""
    return F.sha2(text, 256)


def key_column(label: Column, print_: Column, prefix: int = 6) -> Column:
    """``make_key`` of columns."""
    return F.concat(F.regexp_replace(F.regexp_replace(F.lower(F.substring(label, 1, 20)), "[^a-z0-9]", "_"), "^_+|_+$", ""), F.lit("_"), F.substring(print_, 1, prefix))


def make_key(label: str, print_: str, prefix: int = 6) -> str:
    return re.sub("[^a-z0-9]", "_", label[:20].lower()).strip("_") + "_" + print_[:prefix]


def format_number(x: float) -> str:
    for size, mark in ((1e9, "B"), (1e6, "M"), (1e3, "K")):
        if abs(x) >= size:
            return f"{x / size:.1f}{mark}"
    return str(int(x)) if x == int(x) else f"{x:.2f}"


def estimate_bytes(rows: list[dict]) -> int:
    return sum(80 * len(row) for row in rows[:100]) * max(1, len(rows) // 100)


@dataclass
class Slot:
    key: str
    label: str
    fingerprint: str
    df: DataFrame
    col_types: dict
    col_stats: dict
    row_count: int
    byte_size: int
    nesting: dict = field(default_factory=dict)
    created: float = field(default_factory=time.monotonic)
    accesses: int = 0


class Store:
    """Slots by key. One lock; over the limits the slot with the least of accesses (a second each) plus age of birth goes."""

    def __init__(self, spark: SparkSession, slots: int = SLOTS, bytes_: int = BYTES):
        self.spark, self.most_slots, self.most_bytes = spark, slots, bytes_
        self.slots: dict[str, Slot] = {}
        self.lock = threading.RLock()
        self.calls = self.chars_in = self.chars_out = 0

    def track(self, chars_in: int, out: object) -> object:
        self.calls, self.chars_in = self.calls + 1, self.chars_in + chars_in
        self.chars_out += len(out if isinstance(out, str) else json.dumps(out, default=str))
        return out

    def evict(self, needed: int) -> None:
        while self.slots and (len(self.slots) >= self.most_slots or sum(s.byte_size for s in self.slots.values()) + needed > self.most_bytes):
            victim = min(self.slots.values(), key=lambda s: s.accesses + s.created)
            victim.df.unpersist()
            del self.slots[victim.key]

    def ingest(self, text: str, label: str = "data") -> str:
        """A summary of the payload's table; short, unparseable and tableless payloads come back as text."""
        if len(text.encode("utf-16-le")) // 2 <= THRESHOLD:
            return text
        try:
            data = json.loads(text)
        except ValueError:
            return text[:THRESHOLD] + "\n... [truncated]"
        rows, _ = payload.extract_rows(data)
        if len(rows) < 3:
            return text[:THRESHOLD] + "\n... [truncated]"
        print_ = fingerprint(text)
        with self.lock:
            for slot in self.slots.values():
                if slot.fingerprint == print_:
                    slot.accesses += 1
                    return self.track(len(text), self.summary(slot))
            stats = {c: payload.profile([row.get(c) for row in rows]) for c in payload.columns_of(rows)}
            types = {c: s["base_type"] for c, s in stats.items()}
            size = estimate_bytes(rows)
            self.evict(size)
            slot = Slot(make_key(label, print_), label, print_, payload.to_dataframe(self.spark, rows, types).cache(), types, stats, len(rows), size, payload.nesting(data))
            self.slots[slot.key] = slot
            return self.track(len(text), self.summary(slot))

    def register(self, df: DataFrame, label: str) -> str:
        """A table as it is (it needs no _row_id; pages are then in sort order alone), with its columns' types and statistics; its key."""
        print_ = fingerprint(label + df.schema.json() + df._jdf.queryExecution().analyzed().toString())
        stats = {x["column"]: {k: [list(v) for v in x[k]] if k == "top_values" else x[k] for k in x.asDict() if k != "column" and x[k] is not None} for x in payload.profile_frame(df).collect()}
        kinds = {c: "numeric" if isinstance(df.schema[c].dataType, q.NUMERIC) else s["base_type"] for c, s in stats.items()}
        with self.lock:
            self.evict(0)
            slot = Slot(make_key(label, print_), label, print_, df, kinds, stats, df.count(), 0)
            self.slots[slot.key] = slot
        return slot.key

    def summary(self, slot: Slot) -> str:
        parts = []
        for c, t in list(slot.col_types.items())[:12]:
            s = slot.col_stats.get(c, {})
            extra = f" {format_number(s['min'])}..{format_number(s['max'])}" if "min" in s else f" {s['min_' + t]}..{s['max_' + t]}" if f"min_{t}" in s else f" {s['unique_count']} unique" if s else ""
            parts.append(f"{c}:{t[:3]}{extra}")
        preview = json.dumps(self.rows(slot.df.orderBy("_row_id").limit(PREVIEW_ROWS)), default=str)[:PREVIEW_CHARS]
        return f'[{slot.label}] key="{slot.key}" | {slot.row_count} records\nschema: {"; ".join(parts)}\npreview: {preview}\nUse the key with retrieve, aggregate, query, group_by or schema.'

    @staticmethod
    def rows(df: DataFrame) -> list[dict]:
        return [{k: v for k, v in x.asDict(True).items() if k != "_row_id"} for x in df.collect()]

    def slot(self, key: str) -> Slot | None:
        with self.lock:
            found = self.slots.get(key)
            if found:
                found.accesses += 1
            return found

    def answer(self, key: str, make: Callable[[Slot], dict]) -> dict:
        slot = self.slot(key)
        if slot is None:
            return self.track(0, {"error": f"unknown key {key!r}"})
        try:
            return self.track(0, make(slot))
        except (ValueError, KeyError) as e:
            return self.track(0, {"error": str(e)})

    def retrieve(self, key: str, offset: int = 0, limit: int = 25, sort_by: str | None = None, descending: bool = True, columns: list[str] | None = None) -> dict:
        def make(s: Slot) -> dict:
            rows = self.rows(q.page(s.df, sort_by, descending, offset, limit, columns))
            return {"key": key, "label": s.label, "total_rows": s.row_count, "offset": offset, "returned": len(rows), "rows": rows}

        return self.answer(key, make)

    def aggregate(self, key: str, column: str, func: str) -> dict:
        def make(s: Slot) -> dict:
            if column not in s.df.columns:
                raise ValueError(f"unknown column {column!r}")
            value = s.df.agg(q.aggregate(s.df, column, func)).first()[0]
            return {"key": key, "column": column, "func": func, "result": "null" if value is None else value}

        return self.answer(key, make)

    def query(self, key: str, where: str | dict | None = None, sort_by: str | None = None, descending: bool = True, limit: int = 25, columns: list[str] | None = None) -> dict:
        def make(s: Slot) -> dict:
            hit = s.df.where(q.predicate(s.df, json.loads(where) if isinstance(where, str) else where or {}))
            rows = self.rows(q.page(hit, sort_by, descending, 0, limit, columns))
            return {"key": key, "label": s.label, "total_rows": s.row_count, "matched": hit.count(), "returned": len(rows), "rows": rows}

        return self.answer(key, make)

    def group_by(self, key: str, group_cols: list[str] | str, aggs: str | list[dict], sort_by: str | None = None, descending: bool = True, limit: int = 50) -> dict:
        def make(s: Slot) -> dict:
            keys = [c.strip() for c in group_cols.split(",")] if isinstance(group_cols, str) else group_cols
            whole = q.group_by(s.df, keys, json.loads(aggs) if isinstance(aggs, str) else aggs, sort_by, descending, None)
            rows = self.rows(whole.limit(min(limit, q.GROUPS)))
            return {"key": key, "label": s.label, "total_rows": s.row_count, "groups": whole.count(), "returned": len(rows), "rows": rows}

        return self.answer(key, make)

    def schema(self, key: str) -> dict:
        return self.answer(key, lambda s: {"key": key, "label": s.label, "row_count": s.row_count, "byte_size": s.byte_size, "columns": list(s.col_types), "col_types": s.col_types, "col_stats": s.col_stats})

    def keys(self) -> list[dict]:
        return [{"key": s.key, "label": s.label, "row_count": s.row_count, "columns": list(s.col_types)[:10]} for s in self.slots.values()]

    def context_stats(self) -> dict:
        return {"tool_calls": self.calls, "chars_in_raw": self.chars_in, "chars_out_to_llm": self.chars_out, "compression_ratio": math.floor(self.chars_in / max(self.chars_out, 1) * 10 + 0.5) / 10, "est_tokens_out": self.chars_out // 4, "slots": len(self.slots), "mem_bytes": sum(s.byte_size for s in self.slots.values())}


_STORE: contextvars.ContextVar = contextvars.ContextVar("store", default=None)
_RAW: contextvars.ContextVar = contextvars.ContextVar("raw", default=0)


def current(factory: Callable[[], Store] | None = None) -> Store:
    if _STORE.get() is None:
        if factory is None:
            raise LookupError("no store in this context and no factory")
        _STORE.set(factory())
    return _STORE.get()


@contextlib.contextmanager
def raw_mode() -> Iterator[None]:
    """Within it payloads pass untouched; it nests."""
    token = _RAW.set(_RAW.get() + 1)
    try:
        yield
    finally:
        _RAW.reset(token)


def compacting(store: Store, label: str = "tool", threshold: int = THRESHOLD) -> Callable:
    """Decorator: long results of a tool (texts, objects, lists) become summaries; what fails passes through."""

    def wrap(tool: Callable) -> Callable:
        @functools.wraps(tool)
        def run(*args: object, **kwargs: object) -> object:
            out = tool(*args, **kwargs)
            if _RAW.get() or not isinstance(out, (str, dict, list)):
                return out
            try:
                text = out if isinstance(out, str) else json.dumps(out)
                return store.ingest(text, label) if len(text) > threshold else out
            except (TypeError, ValueError):
                return out

        return run

    return wrap
