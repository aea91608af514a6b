"""Helper columns that cannot clash with a user's."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spare(names: list[str], *dfs: DataFrame) -> list[str]:
    """``names``, each lengthened until none of the tables has such a column, whatever the case."""
    taken = {c.lower() for df in dfs for c in df.columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n += "_"
        taken.add(n.lower())
        out.append(n)
    return out
