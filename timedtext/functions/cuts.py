"""Where a window is cut: the point inside a pause that lies nearest to a mark.

A point keeps ``margin`` from both ends of its pause (half the pause where that is shorter), lies within
``search`` of the mark and more than ``least_after`` behind the last cut. Of equally near ones the earlier pause wins.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def pause_point(a: Column, b: Column, mark: Column, margin: float) -> Column:
    pad = F.least(F.lit(margin), (b - a) / 2)
    return F.least(F.greatest(mark, a + pad), b - pad)


def may_cut(point: Column, mark: Column, after: Column, search: float, least_after: float) -> Column:
    return (F.abs(point - mark) <= search) & (point > after + least_after)


def nearest_pause_of(starts: np.ndarray, stops: np.ndarray, mark: float, after: float, search: float, margin: float, least_after: float = 1.0) -> float | None:
    """The point for a task that holds the pauses as arrays, in order; None where none will do."""
    pad = np.minimum(margin, (stops - starts) / 2)
    points = np.minimum(np.maximum(mark, starts + pad), stops - pad)
    far = np.where((np.abs(points - mark) <= search) & (points > after + least_after), np.abs(points - mark), np.inf)
    return float(points[far.argmin()]) if len(far) and np.isfinite(far.min()) else None


def may_end(edge: float, window: float, search: float, seen: float, total: float, ended: bool) -> bool:
    """Whether the window that began at ``edge`` can be ended by what has come up to ``seen``: all of its search range, and no tail under a quarter of a window can be left.

    ``total`` is 0 until the length is known. Until then more than a quarter of a window must have come after the mark.
    """
    return (ended or seen - edge >= window + search) and edge + window < (total or seen) - window / 4
