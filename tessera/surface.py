"""Exports of tables and the tool-calling surface for language-model vendors."""

from __future__ import annotations

import csv
import io
import json
import os
import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .operators import query as q

TYPES = {"csv": "text/csv", "markdown": "text/markdown", "json": "application/json", "jsonl": "application/x-ndjson"}
TOOL_NAME = re.compile("[a-zA-Z0-9_-]{1,64}")


def export_rows(df: DataFrame, sort_by: str | None = None, descending: bool = True, offset: int = 0, limit: int = 200, columns: list[str] | None = None) -> list[dict]:
    return [x.asDict(True) for x in q.page(df, sort_by, descending, offset, limit, columns, limit).collect()]


def export_csv(df: DataFrame, sort_by: str | None = None, descending: bool = True, limit: int = 500, columns: list[str] | None = None) -> str:
    page = q.page(df, sort_by, descending, 0, limit, columns, limit)
    out = io.StringIO()
    writer = csv.writer(out, lineterminator="\n")
    writer.writerow(page.columns)
    writer.writerows(["" if v is None else v for v in row] for row in page.collect())
    return out.getvalue()


def export_markdown(df: DataFrame, sort_by: str | None = None, descending: bool = True, limit: int = 50, columns: list[str] | None = None, width: int = 40, total: int | None = None, label: str = "") -> str:
    page = q.page(df, sort_by, descending, 0, limit, columns, limit)
    rows = page.collect()

    def cell(v: object) -> str:
        text = ("" if v is None else str(v)).replace("|", "\\|").replace("\n", " ")
        return text if len(text) <= width else text[: width - 1] + "…"

    marks = ["---:" if q.is_numeric(page, c) else "---" for c in page.columns]
    lines = [page.columns, marks, *([cell(v) for v in row] for row in rows)]
    whole = df.count() if total is None else total
    named = f" from **{label}**" if label else ""
    return "\n".join("| " + " | ".join(x) + " |" for x in lines) + (f"\n\n*Showing {len(rows)} of {whole} rows{named}.*" if whole > len(rows) else "")


def export_matrix(df: DataFrame, key: str, label: str, total: int, limit: int = 500) -> dict:
    page = q.page(df, None, True, 0, limit, None, limit)
    values = [list(row) for row in page.collect()]
    return {"key": key, "label": label, "headers": page.columns, "values": values, "total_exported": len(values), "total_available": total}


def build_artifact(df: DataFrame, name: str, kind: str, **options: object) -> dict:
    if kind not in TYPES:
        raise ValueError(f"unknown format {kind!r}")
    rows = export_rows(df, **options)
    content = export_csv(df, **options) if kind == "csv" else export_markdown(df, **options) if kind == "markdown" else json.dumps(rows, default=str) if kind == "json" else "\n".join(json.dumps(x, default=str) for x in rows)
    return {"type": "artifact", "filename": f"{name}.{'md' if kind == 'markdown' else kind}", "mime_type": TYPES[kind], "content": content, "row_count": len(rows), "format": kind}


def slot_to_chunk(slot, rows: int = 2, columns: int = 30, sheet: str | None = None) -> dict:
    """A short text about a slot to embed, with what leads back to it."""
    names = list(slot.col_types)[:columns]

    def told(c: str) -> str:
        kind, x = slot.col_types[c], slot.col_stats.get(c, {})
        if kind == "numeric" and "min" in x:
            return f"  {c} ({kind}) range [{x['min']}..{x['max']}] mean={x['mean']}"
        if kind == "string" and x.get("top_values"):
            return f"  {c} ({kind}) {x['unique_count']} unique, top: {[v for v, _ in x['top_values']]}"
        return f"  {c} ({kind}) range [{x['min_date']}..{x['max_date']}]" if "min_date" in x else f"  {c} ({kind})"

    sample = json.dumps(export_rows(slot.df, None, True, 0, rows, names), default=str)
    sample = sample if len(sample) <= 800 else sample[:800] + "...]"
    lines = [f"Dataset: {slot.label} ({slot.row_count} records, {len(slot.col_types)} columns)", f"key: {slot.key} | fingerprint: {slot.fingerprint[:12]}", "Columns:", *map(told, names), f"Sample: {sample}"]
    known = names[:20]
    return {"content": "\n".join(lines)[:6000], "chunk_type": "table", "cell_range": None, "sheet_name": sheet, "metadata": {"key": slot.key, "fingerprint": slot.fingerprint[:16], "label": slot.label, "row_count": slot.row_count, "columns": known, "col_types": {c: slot.col_types[c] for c in known}}}


@dataclass(frozen=True)
class ToolSpec:
    name: str
    description: str
    input_schema: dict
    handler: Callable[[dict], object]
    group: str = "default"


def handle(specs: list[ToolSpec], name: str, arguments: str | dict | None) -> object:
    spec = {s.name: s for s in specs}.get(name)
    if spec is None:
        raise KeyError(f"unknown tool {name!r}")
    return spec.handler(json.loads(arguments or "{}") if isinstance(arguments, (str, type(None))) else arguments)


def safe_handle(specs: list[ToolSpec], name: str, arguments: str | dict | None) -> object:
    try:
        return handle(specs, name, arguments)
    except Exception as e:  # whatever a tool raises is an answer
        return {"error": str(e)}


def strict(schema: dict) -> dict:
    """Objects closed and all their properties required, at every depth."""
    out = {k: strict(v) if isinstance(v, dict) and k != "properties" else v for k, v in schema.items()}
    if schema.get("type") == "object":
        properties = {k: strict(v) for k, v in schema.get("properties", {}).items()}
        out |= {"properties": properties, "required": list(properties), "additionalProperties": False}
    return out


def openai_tools(specs: list[ToolSpec], form: str = "responses", strict_mode: bool = False) -> list[dict]:
    out = []
    for s in specs:
        body = {"name": s.name, "description": s.description, "parameters": strict(s.input_schema) if strict_mode else s.input_schema} | ({"strict": True} if strict_mode else {})
        out.append({"type": "function", **body} if form == "responses" else {"type": "function", "function": body})
    return out


def checked(specs: list[ToolSpec]) -> list[ToolSpec]:
    for s in specs:
        if not TOOL_NAME.fullmatch(s.name):
            raise ValueError(f"bad tool name {s.name!r}")
    return specs


def anthropic_tools(specs: list[ToolSpec], examples: dict[str, list] | None = None) -> list[dict]:
    return [{"name": s.name, "description": s.description + "".join(f"\nExample: {json.dumps(e)}" for e in (examples or {}).get(s.name, [])), "input_schema": s.input_schema} for s in checked(specs)]


def gemini_tools(specs: list[ToolSpec]) -> list[dict]:
    return [{"name": s.name, "description": s.description, "parameters": s.input_schema} for s in checked(specs)]


ADAPTERS = {"openai": openai_tools, "xai": openai_tools, "anthropic": anthropic_tools, "gemini": gemini_tools}


def tools_for(provider: str, specs: list[ToolSpec], **options: object) -> list[dict]:
    if provider not in ADAPTERS:
        raise ValueError(f"unknown provider {provider!r}")
    return ADAPTERS[provider](specs, **options)


def exact_counter(provider: str) -> Callable[[str], int] | None:
    """A provider's own count, where its vocabulary is at hand offline; none asks a network."""
    if provider not in ADAPTERS:
        raise ValueError(f"unknown provider {provider!r}")
    if provider != "openai" or not os.environ.get("TIKTOKEN_CACHE_DIR"):
        return None
    try:
        import tiktoken

        encoding = tiktoken.get_encoding("o200k_base")
    except Exception:  # not installed, or its files aren't in the cache
        return None
    return lambda text: len(encoding.encode(text, disallowed_special=()))


def is_exact(provider: str = "openai") -> bool:
    return exact_counter(provider) is not None


def count_tokens(text: str, provider: str = "openai") -> int:
    """The exact count where there is one, else the estimate ceil(length / 4) in UTF-16 units."""
    exact = exact_counter(provider)
    return exact(text) if exact else -(-(len(text.encode("utf-16-le")) // 2) // 4)


def token_estimate(text: Column) -> Column:
    """The estimate for a column of texts; null has none."""
    units = F.length(text) + F.regexp_count(text, F.lit("[\\x{10000}-\\x{10FFFF}]"))
    return F.ceil(units / 4).cast("long")


def build_tool_specs(store) -> list[ToolSpec]:
    """retrieve, aggregate, query, group_by and schema of a store."""
    text, number, flag, names = {"type": "string"}, {"type": "integer"}, {"type": "boolean"}, {"type": "array", "items": {"type": "string"}}

    def spec(name: str, description: str, required: list[str], **properties: dict) -> ToolSpec:
        schema = {"type": "object", "properties": {"key": text} | properties, "required": ["key", *required]}
        return ToolSpec(name, description, schema, lambda a: getattr(store, name)(**a), "store")

    return [
        spec("retrieve", "A sorted page of rows.", [], offset=number, limit=number, sort_by=text, descending=flag, columns=names),
        spec("aggregate", "One aggregate of a column.", ["column", "func"], column=text, func=text),
        spec("query", "Rows that match a clause.", [], where=text, sort_by=text, descending=flag, limit=number, columns=names),
        spec("group_by", "Aggregates by group.", ["group_cols", "aggs"], group_cols=names, aggs=text, sort_by=text, descending=flag, limit=number),
        spec("schema", "Columns, types and statistics.", []),
    ]
