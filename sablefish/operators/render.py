"""Renderers of small results: JSON envelope, Markdown and console tables, doc pages.

These end a query: they fetch the rows of one page to the driver, ``MOST_ROWS`` at most where no limit is given, and say how many there are.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, Row


MOST_ROWS = 10_000


def one_page(df: DataFrame, limit: int = 0, offset: int = 0) -> tuple[list[dict], int]:
    """Rows of a page as dictionaries, and the number of all rows."""
    total = df.count()
    rows = df.offset(offset).limit(limit or MOST_ROWS)
    return [r.asDict(recursive=True) for r in rows.collect()], total


def as_json(df: DataFrame, limit: int = 0, offset: int = 0) -> str:
    rows, total = one_page(df, limit, offset)
    return json.dumps({"rows": rows, "total": total, "shown": len(rows), "truncated": offset + len(rows) < total}, ensure_ascii=False, default=str)


def cell(value: object) -> str:
    if isinstance(value, (list, dict, Row)):
        return json.dumps(value, ensure_ascii=False, default=str)
    return "" if value is None else str(value)


def as_markdown(df: DataFrame, limit: int = 0, offset: int = 0) -> str:
    rows, total = one_page(df, limit, offset)
    clean = lambda v: cell(v).replace("|", "\\|").replace("\r", "").replace("\n", " ")
    out = ["| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns)]
    out += ["| " + " | ".join(clean(r[c]) for c in df.columns) + " |" for r in rows]
    if offset + len(rows) < total:
        out.append(f"\n_{len(rows)} of {total} rows_")
    return "\n".join(out)


def as_table(df: DataFrame, limit: int = 0, offset: int = 0) -> str:
    rows, total = one_page(df, limit, offset)
    grid = [df.columns, *([cell(r[c]).replace("\n", " ") for c in df.columns] for r in rows)]
    widths = [max(len(row[k]) for row in grid) for k in range(len(df.columns))]
    lines = ["  ".join(v.ljust(w) for v, w in zip(row, widths, strict=True)).rstrip() for row in grid]
    lines.insert(1, "  ".join("-" * w for w in widths))
    return "\n".join([*lines, *([f"({len(rows)} of {total} rows)"] if offset + len(rows) < total else [])])


def doc_page(doc: dict) -> str:
    """A documentation block as a Markdown page."""
    out = [f"# {doc.get('funcao') or doc.get('funcao_id') or ''}", ""]
    for key in ("summary", "description"):
        if doc.get(key):
            out += [doc[key], ""]
    facts = [(k, doc.get(k)) for k in ("tipo", "author", "since", "version", "module_inferido")]
    out += [f"- **{k}**: {v}" for k, v in facts if v]
    if doc.get("deprecated"):
        out.append(f"- **deprecated** {doc.get('deprecated_reason') or ''}".rstrip())
    if doc.get("params"):
        out += ["", "## Parameters", "", "| name | type | description |", "| --- | --- | --- |"]
        out += [f"| {p['name']}{' (optional)' if p['optional'] else ''} | {p['type']} | {p['desc']} |" for p in doc["params"]]
    if doc.get("returns"):
        out += ["", "## Returns", "", *[f"- {r['type']}: {r['desc']}" for r in doc["returns"]]]
    for title, key in (("Examples", "examples"), ("See also", "see"), ("Tables", "tables"), ("Todo", "todos"), ("Notes", "obs"), ("Links", "links")):
        if doc.get(key):
            out += ["", f"## {title}", "", *[f"- {v}" for v in doc[key]]]
    if doc.get("history"):
        out += ["", "## History", "", *[f"- {h['date']} {h['author']} {h['desc']}".rstrip() for h in doc["history"]]]
    return "\n".join(out) + "\n"
