"""Factor expressions: a nested call tree, checked and compiled to a factor plan.

A node is a number, text or None (a literal), {"var": name}, or
{"func": name, "args": {...} or [...]}.  Equal sub-trees become one column.
Arguments are bound by keyword, so leaving an optional one out cannot shift the
others; sizes given as whole floats become integers.
"""

from __future__ import annotations

import inspect
import json
from typing import Any

from pyspark.sql import DataFrame

from barsmith.operators.factor import OPERATORS, FactorPlan

WHOLE = ("window", "axis", "span", "halflife", "periods_per_year", "ddof")


def normalise(node: Any) -> Any:
    """The tree with every call's arguments as a dict by parameter name."""
    if not isinstance(node, dict):
        return node
    if "var" in node:
        return {"var": str(node["var"])}
    name = node.get("func")
    if name not in OPERATORS:
        raise ValueError(f"unknown operator {name!r}")
    names = [p for p in inspect.signature(OPERATORS[name]).parameters][1:]
    given = node.get("args", {})
    if isinstance(given, list):
        if len(given) > len(names):
            raise ValueError(f"{name} takes {len(names)} arguments, not {len(given)}")
        given = dict(zip(names, given))
    if name == "power" and "p" in given:
        given = {("p_" if k == "p" else k): v for k, v in given.items()}
    if unknown := set(given) - set(names):
        raise ValueError(f"{name} has no argument {', '.join(sorted(unknown))}")
    missing = [p.name for p in list(inspect.signature(OPERATORS[name]).parameters.values())[1:] if p.default is p.empty and p.name not in given]
    if missing:
        raise ValueError(f"{name} needs {', '.join(missing)}")
    out = {}
    for k, v in given.items():
        v = normalise(v)
        if k in WHOLE and isinstance(v, float) and v == int(v):
            v = int(v)
        out[k] = v
    return {"func": name, "args": out}


def from_json(text: str) -> Any:
    """The checked tree of an expression written as JSON."""
    try:
        return normalise(json.loads(text))
    except json.JSONDecodeError as e:
        raise ValueError(f"not a JSON expression: {e}") from e


def compile_node(plan: FactorPlan, node: Any, variables: set[str]) -> Any:
    if not isinstance(node, dict):
        return node
    if "var" in node:
        if node["var"] not in variables:
            raise ValueError(f"unknown variable {node['var']!r}")
        return node["var"]
    args = {k: compile_node(plan, v, variables) for k, v in node["args"].items()}
    return OPERATORS[node["func"]](plan, **args)


def compile_factor(tree: Any, variables: set[str]) -> tuple[FactorPlan, str]:
    """A plan and the name of the column that holds the factor."""
    plan = FactorPlan()
    out = compile_node(plan, normalise(tree), variables)
    if not isinstance(out, str):
        out = plan.let(f"CAST({out!r} AS DOUBLE)")
    return plan, out


def factor_values(panel: DataFrame, tree: Any, name: str = "factor") -> DataFrame:
    """panel with the value of a factor expression (a tree, or its JSON text) over its columns."""
    tree = from_json(tree) if isinstance(tree, str) else tree
    plan, out = compile_factor(tree, set(panel.columns))
    return plan.apply(panel).selectExpr(*(f"`{c}`" for c in panel.columns), f"`{out}` AS `{name}`")
