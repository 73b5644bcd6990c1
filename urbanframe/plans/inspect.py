"""Physical-plan inspection, so tests can assert which operators a query really uses."""

from __future__ import annotations

import contextlib
import io
import re

from pyspark.sql import DataFrame

_NODE = re.compile(r"^\((\d+)\) ([A-Za-z]+)")


def plan_text(df: DataFrame, mode: str = "formatted") -> str:
    """The text ``df.explain(mode)`` prints."""
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain(mode)
    return buf.getvalue()


def plan_operators(df: DataFrame) -> set[str]:
    """Names of the physical operators in the formatted plan (e.g. ``SortMergeJoin``)."""
    return {m.group(2) for line in plan_text(df).splitlines() if (m := _NODE.match(line.strip()))}
