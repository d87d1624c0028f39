"""Constant tables as column expressions.

They are written as SQL, so that a table of some hundred entries is one call
to the JVM and one constant of the plan.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F


def quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def sql_array(values: Iterable[str]) -> str:
    return f"array({', '.join(values)})"


def string_array(values: Iterable[str]) -> Column:
    return F.expr(sql_array(quoted(v) for v in values))


def sql_map(entries: Mapping[str, str]) -> Column:
    """A map from strings to values that are SQL already."""
    return F.expr(f"map({', '.join(f'{quoted(k)}, {v}' for k, v in entries.items())})")


def string_map(entries: Mapping[str, str]) -> Column:
    return sql_map({k: quoted(v) for k, v in entries.items()})
