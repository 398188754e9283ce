"""Arrow and NumPy views of whole texts: bytes, words and lines of a batch at once."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import tidy

#: Bytes of text that are looked at together; a longer text stands alone.
SLICE_BYTES = 1 << 20


_holder: list = [None, None]


def claim(owner: str, drop: Callable[[], None]) -> None:
    """Let an operator remember words in this Python worker; what another one remembered before goes.

    Workers serve one stage after another, so their memories would add up."""
    if _holder[0] != owner:
        if _holder[1] is not None:
            _holder[1]()
            tidy()
        _holder[:] = [owner, drop]


@dataclass
class Texts:
    """Some rows of a batch. starts/ends: each text's bytes in raw; codes: each word's place in vocab,
    rows after rows; bounds: row i has codes[bounds[i]:bounds[i + 1]]."""

    first: int
    array: pa.Array
    raw: np.ndarray
    starts: np.ndarray
    codes: np.ndarray
    bounds: np.ndarray
    vocab: pa.Array


def slices(column: pa.Array, split: bool = True):
    """Runs of rows of a text column as Texts; null counts as empty. Words lie between ASCII white space."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = pc.binary_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(sizes)
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + SLICE_BYTES, side="right")))
        part = pa.concat_arrays([column.slice(lo, hi - lo)])
        offs = np.frombuffer(part.buffers()[1], dtype=np.int64, count=hi - lo + 1 + part.offset)[part.offset :]
        data = part.buffers()[2]
        raw = np.frombuffer(data, dtype=np.uint8)[: offs[-1]] if data is not None else np.empty(0, np.uint8)
        codes, bounds, vocab = np.empty(0, np.int64), np.zeros(hi - lo + 1, np.int64), pa.array([], pa.large_string())
        if split:
            plain = pc.replace_substring_regex(part, "[\\x09-\\x0D]", " ") if (raw < 14).any() and ((raw >= 9) & (raw <= 13)).any() else part
            lists = pc.split_pattern(plain, " ")
            coded = lists.flatten().dictionary_encode()
            codes, vocab = coded.indices.to_numpy().astype(np.int64), coded.dictionary
            counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
            blank = pc.index(vocab, pa.scalar("", pa.large_string())).as_py()
            if blank >= 0:
                real = codes != blank
                before = np.concatenate([[0], np.cumsum(real)])
                at = np.concatenate([[0], np.cumsum(counts)])
                bounds, codes = before[at], codes[real]
            else:
                bounds = np.concatenate([[0], np.cumsum(counts)])
        yield Texts(lo, part, raw, offs, codes, bounds, vocab)
        lo = hi


def row_sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of values (1 or 2 dimensions) between bounds, 0 for empty rows."""
    n = len(bounds) - 1
    if not len(values):
        return np.zeros((n, *values.shape[1:]))
    padded = np.concatenate([values, np.zeros((1, *values.shape[1:]), values.dtype)])  # empty rows may begin at the end
    out = np.add.reduceat(padded, bounds[:-1], axis=0)
    out[bounds[:-1] == bounds[1:]] = 0
    return out
