"""Exponential averages of arrays, a block of values at once."""

from __future__ import annotations

import numpy as np

#: Values that an exponential average takes at once.
_BLOCK = 64


def decay(x: np.ndarray, alpha: float, start: float) -> np.ndarray:
    """state = alpha * x + (1 - alpha) * state along x, from a start on; a block of values is one matrix product."""
    out = np.empty(len(x))
    power = (1 - alpha) ** np.arange(_BLOCK + 1)
    lower = alpha * np.tril(power[np.abs(np.subtract.outer(np.arange(_BLOCK), np.arange(_BLOCK)))])
    for lo in range(0, len(x), _BLOCK):
        n = min(_BLOCK, len(x) - lo)
        out[lo : lo + n] = lower[:n, :n] @ x[lo : lo + n] + power[1 : n + 1] * start
        start = out[lo + n - 1]
    return out
