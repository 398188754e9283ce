"""Plans in stages: each stage adds columns that are expressions of earlier ones.

A window cannot stand inside a window, so every window result is a column of
its own; stages with one partitioning and order share one exchange and one sort,
whatever their frames.  Catalyst prunes the columns that nobody asks for.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame

from barsmith.functions.dialect import Duck, Spark

Stage = dict[str, "str | Callable"]


def _text(expr: str | Callable, dialect) -> str:
    return expr(dialect) if callable(expr) else expr


def needed(stages: list[Stage], wanted: Iterable[str]) -> list[Stage]:
    """Only the columns that wanted ones depend on, by name."""
    import re

    found, out = set(wanted), []
    for stage in reversed(stages):
        kept = {n: e for n, e in stage.items() if n in found}
        for e in kept.values():
            for d in (Spark, Duck):
                try:
                    found |= set(re.findall(r"\w+", _text(e, d)))
                except TypeError:  # an expression of one dialect only
                    pass
        if kept:
            out.append(kept)
    return out[::-1]


def apply(df: DataFrame, stages: list[Stage]) -> DataFrame:
    for stage in stages:
        df = df.selectExpr("*", *(f"{_text(e, Spark)} AS `{n}`" for n, e in stage.items()))
    return df


def select(df: DataFrame, columns: dict[str, str | Callable]) -> DataFrame:
    return df.selectExpr(*(f"{_text(e, Spark)} AS `{n}`" for n, e in columns.items()))


def to_sql(base: str, source: str, stages: list[Stage], columns: dict[str, str | Callable], tail: str = "") -> str:
    """The same plan as one statement: base is a list of common table expressions, source the last of them."""
    parts, prev = [base], source
    for i, stage in enumerate(stages):
        made = ", ".join(f'{_text(e, Duck)} AS "{n}"' for n, e in stage.items())
        parts.append(f"st{i} AS (SELECT *, {made} FROM {prev})")
        prev = f"st{i}"
    picked = ", ".join(f'{_text(e, Duck)} AS "{n}"' for n, e in columns.items())
    return f"WITH {', '.join(parts)} SELECT {picked} FROM {prev} {tail}"


def rounded(x: str, digits: int = 6) -> str:
    """A number rounded for comparison: halves go up, also where a float lies a hair below one, and no zero is negative."""
    return f"floor(CAST({x} AS DOUBLE) * {10**digits} + 0.500001) / CAST({10**digits} AS DOUBLE)"


def shown(x: str, digits: int = 6) -> str:
    """``rounded`` in Spark, whose floor is a long: a number too large for one is whole already."""
    y = f"(CAST({x} AS DOUBLE) * {10**digits} + 0.500001)"
    return f"CASE WHEN abs({y}) < 9e15 THEN CAST(floor({y}) AS DOUBLE) ELSE {y} END / CAST({10**digits} AS DOUBLE)"


def significant(x: str, digits: int = 6) -> str:
    """As rounded below 1, from 1 on to so many digits in all, from 1e15 on the logarithm: for columns whose sizes differ widely."""
    x = f"CAST({x} AS DOUBLE)"
    large = f"WHEN abs({x}) >= 1e15 THEN sign({x}) * (1e15 + floor(log10(abs({x})) * 1e6 + 0.5))"
    over = f"ceil(log10(abs({x}))) - {digits}"
    # powers of ten are whole numbers, which engines agree on
    up, down = f"power(CAST(10 AS DOUBLE), CAST({digits} AS DOUBLE) - greatest(CAST(0 AS DOUBLE), ceil(log10(abs({x})))))", f"power(CAST(10 AS DOUBLE), {over})"
    return f"CASE WHEN {x} = 0 THEN CAST(0 AS DOUBLE) {large} WHEN {over} > 0 THEN floor({x} / {down} + 0.500001) * {down} ELSE floor({x} * {up} + 0.500001) / {up} END"
