"""Query results as one HTML page; each table holds as many rows as the page is told to show."""

from __future__ import annotations

import html

from pyspark.sql import DataFrame

STYLE = "body{font:14px sans-serif;margin:2em}table{border-collapse:collapse;margin:0 0 2em}td,th{border:1px solid #bbb;padding:.2em .6em;text-align:right}th{background:#eee}caption{text-align:left;font-weight:bold;padding:.4em 0}"


def table(frame: DataFrame, caption: str, rows: int = 200) -> str:
    """The first ``rows`` rows; a note says if there are more."""
    found = frame.limit(rows + 1).collect()
    cell = lambda v: "" if v is None else html.escape(f"{v:.6g}" if isinstance(v, float) else str(v))
    head = "".join(f"<th>{html.escape(c)}</th>" for c in frame.columns)
    body = "".join("<tr>" + "".join(f"<td>{cell(v)}</td>" for v in r) + "</tr>" for r in found[:rows])
    more = f"<p>More than {rows} rows; the first are shown.</p>" if len(found) > rows else ""
    return f"<table><caption>{html.escape(caption)}</caption><tr>{head}</tr>{body}</table>{more}"


def page(title: str, frames: dict[str, DataFrame], facts: dict | None = None, rows: int = 200) -> str:
    listed = "".join(f"<li>{html.escape(str(k))}: {html.escape(str(v))}</li>" for k, v in (facts or {}).items())
    tables = "".join(table(f, name, rows) for name, f in frames.items())
    return f"<!doctype html><html><head><meta charset='utf-8'><title>{html.escape(title)}</title><style>{STYLE}</style></head><body><h1>{html.escape(title)}</h1><ul>{listed}</ul>{tables}</body></html>"


def write(path: str, title: str, frames: dict[str, DataFrame], facts: dict | None = None, rows: int = 200) -> str:
    with open(path, "w", encoding="utf-8") as f:
        f.write(page(title, frames, facts, rows))
    return path
