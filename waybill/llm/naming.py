"""Names for an operator's own columns beside those of its caller."""

from __future__ import annotations

from pyspark.sql import DataFrame


def unused(rows: DataFrame, *names: str) -> list[str]:
    """The names, each with so many underscores before it that no column of ``rows`` has it (in any case)."""
    taken = {c.lower() for c in rows.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out
