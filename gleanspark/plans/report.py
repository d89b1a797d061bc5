"""Reports of small results: JSON, and tables whose columns stand straight with wide characters too."""

from __future__ import annotations

import json
import unicodedata

from pyspark.sql import DataFrame


def display_width(text: str) -> int:
    """Columns that a terminal gives to a text: two to wide characters, none to those that combine with the one before."""
    return sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in text)


def padded(text: str, width: int, right: bool = False) -> str:
    space = " " * max(0, width - display_width(text))
    return space + text if right else text + space


def _shown(value, places: int) -> str:
    if value is None:
        return "-"
    return f"{value:.{places}f}" if isinstance(value, float) else str(value)


def table(rows: list[dict], columns: list[str] | None = None, places: int = 3) -> str:
    """Rows under their headings; numbers stand right, all else left."""
    columns = columns or list(rows[0] if rows else [])
    cells = [[_shown(r.get(c), places) for c in columns] for r in rows]
    widths = [max([display_width(c), *(display_width(x[i]) for x in cells)]) for i, c in enumerate(columns)]
    right = [bool(rows) and all(isinstance(r.get(c), (int, float, type(None))) for r in rows) for c in columns]
    lines = [columns, ["-" * w for w in widths], *cells]
    return "\n".join("  ".join(padded(x, w, r) for x, w, r in zip(line, widths, right)).rstrip() for line in lines)


def as_json(value) -> str:
    """Indented, with characters as they are."""
    return json.dumps(value, ensure_ascii=False, indent=2, default=str)


def rows_of(df: DataFrame, *order: str) -> list[dict]:
    """A result that is small by its nature (one row a metric, group or query), as plain rows."""
    return [r.asDict(recursive=True) for r in (df.orderBy(*order) if order else df).collect()]
