"""Isotonic calibration from binned counts: pool adjacent violators over a table of fixed size."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def binned_counts(scored: DataFrame, raw: Column, label: Column, low: float, high: float, bins: int) -> list[tuple[int, float, float]]:
    """(bin, rows, sum of labels) of raw scores in equal bins; at most `bins` rows reach the driver."""
    k = F.least(F.lit(bins - 1), F.greatest(F.lit(0), F.floor((raw - low) / (high - low) * bins))).cast("int")
    rows = scored.groupBy(k.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.sum(label).alias("y")).collect()
    return sorted((int(r["bin"]), float(r["n"]), float(r["y"])) for r in rows if r["bin"] is not None)


def isotonic(counts: list[tuple[int, float, float]], low: float, high: float, bins: int) -> tuple[np.ndarray, np.ndarray]:
    """Knots (x, y) of the calibrated score, to be interpolated; y rises with x. Without rows, y is 0.5."""
    if not counts:
        return np.array([low, high]), np.array([0.5, 0.5])
    blocks: list[list[float]] = []  # rows, labels, first bin, last bin
    for k, n, y in counts:
        blocks.append([n, y, k, k])
        while len(blocks) > 1 and blocks[-2][1] / blocks[-2][0] >= blocks[-1][1] / blocks[-1][0]:
            last = blocks.pop()
            blocks[-1] = [blocks[-1][0] + last[0], blocks[-1][1] + last[1], blocks[-1][2], last[3]]
    width = (high - low) / bins
    x, y = [], []
    for n, s, a, b in blocks:
        x += [low + a * width, low + (b + 1) * width]
        y += [(s + 0.5) / (n + 1)] * 2 if 0 < s < n else [(s + 0.05) / (n + 0.1)] * 2
    return np.array(x), np.maximum.accumulate(np.array(y))
