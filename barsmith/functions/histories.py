"""Passes over whole groups of ordered rows: some groups at a time, side by side in one table.

A window's row number makes Spark deal and sort the rows, so a pass shares its
exchange with the windows before it.  Arrow batches are put together until they
hold whole groups; only a group that is longer than a step is held alone.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from barsmith.functions.dialect import DATE, KEY

#: Rows of whole groups that a step takes together.
ROWS = 8192
NUMBER = "_no"


class Groups:
    """Rows of whole groups, each from its row number 1 on."""

    def __init__(self, t: pa.Table, order: str = DATE):
        self.table, self.order = t.combine_chunks(), order
        self.no = t.column(NUMBER).to_numpy()
        self.first = np.flatnonzero(self.no == 1)
        self.code = np.cumsum(self.no == 1) - 1

    def __len__(self) -> int:
        return len(self.no)

    def values(self, name: str) -> np.ndarray:
        """A column of numbers, NaN for null."""
        return self.table.column(name).to_numpy().astype(float)

    def days(self, name: str) -> np.ndarray:
        """A column of dates as days since 1970."""
        return self.table.column(name).combine_chunks().cast(pa.int32()).to_numpy(zero_copy_only=False).astype(np.int64)

    def last_rows(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """For each row the span [lo, hi) of the last n rows of its group, itself included."""
        at = np.arange(len(self))
        return at + 1 - np.minimum(self.no, n), at + 1

    def since(self, rows: np.ndarray, start: np.ndarray) -> np.ndarray:
        """For some rows the first row of their group whose day is after a start day."""
        return np.searchsorted((self.code << 32) + self.days(self.order), (self.code[rows] << 32) + start, side="right")

    def scale(self, x: np.ndarray) -> np.ndarray:
        """The largest size of a group's values, on each of its rows; 1 where there is none."""
        most = np.fmax.reduceat(np.abs(x), self.first)
        return np.where(most > 0, most, 1.0)[self.code]


def numbered(by: str = KEY, order: str = DATE) -> str:
    return f"row_number() OVER (PARTITION BY {by} ORDER BY {order}) AS {NUMBER}"


def whole_groups(batches):
    """The rows of an iterator of batches, by group, as tables of some whole groups each."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        starts = np.flatnonzero(b.column(NUMBER).to_numpy() == 1)
        if held and len(starts) and sum(x.num_rows for x in held) + starts[-1] >= ROWS:
            cut = int(starts[-1])
            yield pa.Table.from_batches([*held, b.slice(0, cut)])
            held, b = [], b.slice(cut)
        held.append(b)
    if sum(b.num_rows for b in held):
        yield pa.Table.from_batches(held)


def along(df: DataFrame, made: list[str], f: Callable[[Groups], dict[str, np.ndarray]], by: str = KEY, order: str = DATE) -> DataFrame:
    """df with columns of doubles (NaN becomes null) that f makes from whole groups of rows."""
    names = df.columns

    def each(batches):
        for t in whole_groups(batches):
            got = f(Groups(t, order))
            t = t.select(names)
            for n in made:
                t = t.append_column(n, pa.array(got[n].astype(float), mask=np.isnan(got[n])))
            yield from t.combine_chunks().to_batches()

    kinds = ", ".join(f"`{n}` {k}" for n, k in df.dtypes)
    return df.selectExpr("*", numbered(by, order)).mapInArrow(each, f"{kinds}, " + ", ".join(f"`{n}` double" for n in made))
