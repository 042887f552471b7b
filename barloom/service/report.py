"""Reports of small result tables: Markdown, JSON, HTML with a plain SVG curve."""

from __future__ import annotations

import html
import json
from collections.abc import Sequence

from pyspark.sql import DataFrame

from barloom.service.experiments import safe

#: Rows a report takes of a table, which shows aggregates; a longer one says that it goes on.
MOST_ROWS = 500


def rows_of(df: DataFrame) -> tuple[list[str], list[list], str]:
    """Column names, rows, and a note if there are more."""
    found = df.limit(MOST_ROWS + 1).collect()
    return df.columns, [[safe(v) for v in r] for r in found[:MOST_ROWS]], f"The first {MOST_ROWS} rows; there are more." if len(found) > MOST_ROWS else ""


def cell(v) -> str:
    if v is None:
        return ""
    return f"{v:.6g}" if isinstance(v, float) else str(v)


def markdown(title: str, tables: dict[str, DataFrame], notes: str = "") -> str:
    parts = [f"# {title}", *([notes] if notes else [])]
    for name, df in tables.items():
        head, rows, more = rows_of(df)
        parts += [f"## {name}", "| " + " | ".join(head) + " |\n|" + " --- |" * len(head) + "".join("\n| " + " | ".join(cell(v).replace("|", "\\|") for v in r) + " |" for r in rows), *([more] if more else [])]
    return "\n\n".join(parts) + "\n"


def as_json(title: str, tables: dict[str, DataFrame]) -> str:
    found = {n: rows_of(df) for n, df in tables.items()}
    return json.dumps({"title": title, "tables": {n: [dict(zip(h, r)) for r in rows] for n, (h, rows, _) in found.items()}, "notes": {n: more for n, (_, _, more) in found.items() if more}}, ensure_ascii=False, indent=1)


def curve(values: Sequence[float], width: int = 720, height: int = 200) -> str:
    """A line of values, scaled into the box."""
    values = [v for v in values if v is not None]
    if len(values) < 2:
        return ""
    low, span = min(values), (max(values) - min(values)) or 1.0
    points = " ".join(f"{i * width / (len(values) - 1):.1f},{height - (v - low) / span * height:.1f}" for i, v in enumerate(values))
    return f'<svg viewBox="0 0 {width} {height}" width="{width}" height="{height}" role="img"><polyline fill="none" stroke="#276" stroke-width="1.5" points="{points}"/></svg>'


def page(title: str, tables: dict[str, DataFrame], curves: dict[str, Sequence[float]] | None = None) -> str:
    body = [f"<h1>{html.escape(title)}</h1>"]
    for name, values in (curves or {}).items():
        body.append(f"<h2>{html.escape(name)}</h2>{curve(values)}")
    for name, df in tables.items():
        head, rows, more = rows_of(df)
        body.append(f"<h2>{html.escape(name)}</h2><table><tr>" + "".join(f"<th>{html.escape(h)}</th>" for h in head) + "</tr>" + "".join("<tr>" + "".join(f"<td>{html.escape(cell(v))}</td>" for v in r) + "</tr>" for r in rows) + "</table>" + (f"<p>{more}</p>" if more else ""))
    return f"<!doctype html><meta charset='utf-8'><title>{html.escape(title)}</title><style>body{{font:14px sans-serif;margin:2em}}td,th{{padding:2px 8px;text-align:right}}</style>" + "".join(body)
