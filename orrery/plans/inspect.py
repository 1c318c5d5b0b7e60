"""Plans as text, and checks on them."""

from __future__ import annotations

import contextlib
import io

from pyspark.sql import DataFrame


def plan_text(df: DataFrame, mode: str = "formatted") -> str:
    """What explain() prints: simple, extended, codegen, cost or formatted."""
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain(mode)
    return out.getvalue()


def operators(df: DataFrame) -> list[str]:
    """Names of the physical operators, from the top."""
    lines = plan_text(df, "simple").splitlines()
    return [x.lstrip(" :+-*").lstrip("(0123456789) ").split("(")[0].split(" ")[0] for x in lines if x.strip() and not x.startswith("==")]


def exchanges(df: DataFrame) -> int:
    """Number of shuffles."""
    return sum(x == "Exchange" for x in operators(df))


def has_cartesian(df: DataFrame) -> bool:
    return any(x in ("CartesianProduct", "BroadcastNestedLoopJoin") for x in operators(df))
