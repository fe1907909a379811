"""Which requests a limit allows, for times in arrays."""

from __future__ import annotations

import numpy as np


def allowed(at: np.ndarray, before: np.ndarray, limit: int, window_ms: int) -> tuple[np.ndarray, np.ndarray]:
    """Which of the ascending times are allowed after the allowed times ``before``, and the last ``limit`` allowed ones.

    A request is allowed if fewer than limit allowed ones lie in the window before it, so the k-th
    allowed one is the first request after the (k-1)-th that is not less than window_ms
    later than the (k-limit)-th.  That place is found by binary search, for limit
    allowed requests at a time, and the refused ones in between are never looked at.
    """
    if limit <= 0 or window_ms <= 0:
        return np.ones(len(at), bool), before
    ok, step = np.zeros(len(at), bool), np.arange(limit)
    later = np.searchsorted(at, at + window_ms)
    free = np.concatenate([np.zeros(limit - len(before), np.int64), np.searchsorted(at, before + window_ms)])  # where each of the last limit ones no longer counts
    start = 0
    while start < len(at):
        next_ones = np.maximum(np.maximum.accumulate(free - step), start) + step
        next_ones = next_ones[next_ones < len(at)]
        ok[next_ones] = True
        if len(next_ones) < limit:
            break
        free, start = later[next_ones], int(next_ones[-1]) + 1
    return ok, np.concatenate([before, at[ok]])[-limit:]
