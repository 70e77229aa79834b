"""One-dimensional Butterworth low-pass, run forward and backward, for each series."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def butterworth(order: int, cut: float) -> tuple[np.ndarray, np.ndarray]:
    """Numerator and denominator of a digital low-pass; ``cut`` is a share of the Nyquist frequency."""
    w = 4 * math.tan(math.pi * cut / 2)
    poles = [w * complex(math.cos(a), math.sin(a)) for a in (math.pi * (2 * k + order + 1) / (2 * order) for k in range(order))]
    z = [(4 + p) / (4 - p) for p in poles]
    gain = np.real(w**order / np.prod([4 - p for p in poles]))
    return gain * np.poly([-1.0] * order), np.real(np.poly(z))


def _one_way(b: np.ndarray, a: np.ndarray, x: np.ndarray) -> np.ndarray:
    n = len(b) - 1
    # the state that a constant input would have left
    comp = np.eye(n) - np.array([[-a[i + 1] if j == 0 else 1.0 if j == i + 1 else 0.0 for j in range(n)] for i in range(n)])
    state = np.linalg.solve(comp, b[1:] - a[1:] * b[0]) * x[0]
    y = np.empty_like(x)
    for i, v in enumerate(x):
        y[i] = b[0] * v + state[0]
        for k in range(n - 1):
            state[k] = state[k + 1] + b[k + 1] * v - a[k + 1] * y[i]
        state[n - 1] = b[n] * v - a[n] * y[i]
    return y


def two_way(x: np.ndarray, order: int, cut: float) -> np.ndarray:
    """Zero-phase filtering with odd extension at both ends."""
    b, a = butterworth(order, cut)
    pad = min(3 * (order + 1), len(x) - 1)
    if pad < 1:
        return x.copy()
    ext = np.concatenate([2 * x[0] - x[pad:0:-1], x, 2 * x[-1] - x[-2 : -pad - 2 : -1]])
    y = _one_way(b, a, _one_way(b, a, ext)[::-1])[::-1]
    return y[pad : pad + len(x)]


def lowpass_series(series: DataFrame, step_days: float, days: float = 3.0, order: int = 3, ts: str = "ts", val: str = "val", keys: Sequence[str] = ("series",)) -> DataFrame:
    """Each series with ``low``; values are taken to be evenly spaced by ``step_days``."""
    cut = min(0.999, 2 * step_days / days)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in series.schema) + ", low double"

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(ts, ignore_index=True)
        frame["low"] = two_way(frame[val].to_numpy(float), order, cut)
        return frame

    return series.groupBy(*keys).applyInPandas(run, schema)
