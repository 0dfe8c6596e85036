"""Self-contained HTML of small summaries; the aggregates are made in Spark, a bounded number of
rows is rendered."""

from __future__ import annotations

from html import escape

from pyspark.sql import DataFrame

ROWS = 500


def table(df: DataFrame, title: str, limit: int = ROWS) -> str:
    rows = df.limit(limit).collect()  # ``limit`` rows at most
    cell = lambda v: escape("" if v is None else f"{v:.4g}" if isinstance(v, float) else str(v))
    head = "".join(f"<th>{escape(c)}</th>" for c in df.columns)
    body = "".join("<tr>" + "".join(f"<td>{cell(v)}</td>" for v in r) + "</tr>" for r in rows)
    return f"<h2>{escape(title)}</h2><table><tr>{head}</tr>{body}</table>"


def bars(values: list[tuple[str, float]], title: str) -> str:
    """A bar chart as inline SVG."""
    top = max([abs(v) for _, v in values], default=1.0) or 1.0
    lines = "".join(f'<text x="0" y="{20 * i + 14}">{escape(k)}</text><rect x="160" y="{20 * i + 3}" width="{300 * abs(v) / top:.1f}" height="14"/><text x="470" y="{20 * i + 14}">{v:.4g}</text>' for i, (k, v) in enumerate(values))
    return f'<h2>{escape(title)}</h2><svg width="560" height="{20 * len(values) + 10}" font-size="12" fill="#357">{lines}</svg>'


def page(title: str, *parts: str) -> str:
    style = "body{font-family:sans-serif}table{border-collapse:collapse}td,th{border:1px solid #ccc;padding:2px 6px;text-align:right}"
    return f"<!doctype html><meta charset=utf-8><title>{escape(title)}</title><style>{style}</style><h1>{escape(title)}</h1>" + "".join(parts)
