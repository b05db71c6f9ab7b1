"""Scores of states and admission of nodes on W and a directed layer of dependencies.

A node depends on others by bit masks (bit j of needs[i]: i needs j). States are bit masks of at most 62 nodes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from sparkscape.operators.landscape import spins

# Weights of the score, its labels' thresholds, bounds of the criteria.
WEIGHTS, LABELS = (0.20, 0.50, 0.30), ((0.630, "COHESIVE"), (0.50, "SPURIOUS_HIGH"), (0.30, "SPURIOUS_MEDIUM"))
THETA, EPSILON, CAPACITY = 0.10, 0.005, 0.138


def satisfied(states: np.ndarray, needs: list[int], n: int) -> np.ndarray:
    """(state, node): share of the node's dependencies that are up in the state; 1 without any."""
    on = ((states[:, None] >> np.arange(n)) & 1).astype(float)
    mask = ((np.array(needs, dtype=np.int64)[:, None] >> np.arange(n)) & 1).astype(float)
    total = mask.sum(axis=1)
    return np.where(total > 0, on @ mask.T / np.maximum(total, 1), 1.0)


def cohesion(states: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Mean of w_ij s_i s_j over pairs."""
    n = len(w)
    s = spins(states, n).astype(float)
    return ((s @ w) * s).sum(axis=1) / 2 / max(1, n * (n - 1) // 2)


def scores(states: np.ndarray, w: np.ndarray, needs: list[int]) -> dict[str, np.ndarray]:
    """cs_norm (cohesion from -0.05..0.05 to 0..1), direction (mean of the active nodes' shares, 0 without), density (mean weight within the
    active nodes over that of as many largest weights, in -1..1, 0 for fewer than two) and their weighted sum."""
    n = len(w)
    on = ((states[:, None] >> np.arange(n)) & 1).astype(float)
    k = on.sum(axis=1)
    norm = np.clip((cohesion(states, w) + 0.05) / 0.10, 0.0, 1.0)
    direction = np.where(k > 0, (satisfied(states, needs, n) * on).sum(axis=1) / np.maximum(k, 1), 0.0)
    pairs = (k * (k - 1) / 2).astype(int)
    best = np.concatenate([[0.0], np.cumsum(np.sort(w[np.triu_indices(n, 1)])[::-1])])
    most = best[pairs] / np.maximum(pairs, 1)
    inside = ((on @ w) * on).sum(axis=1) / 2 / np.maximum(pairs, 1)
    density = np.where((k >= 2) & (np.abs(most) >= 1e-10), np.clip(inside / np.where(np.abs(most) < 1e-10, 1.0, most), -1.0, 1.0), 0.0)
    a, b, c = WEIGHTS
    return {"cs_norm": norm, "direction": direction, "density": density, "score": a * norm + b * direction + c * density}


def label(score: float) -> str:
    return next((name for least, name in LABELS if score >= least), "SPURIOUS_LOW")


def scored(states: DataFrame, w: np.ndarray, needs: list[int]) -> DataFrame:
    """run, cs_norm, direction, density, score, label of rows run, state."""

    def run(batches):
        for b in batches:
            x = scores(b.column("state").to_numpy(zero_copy_only=False).astype(np.int64), w, needs)
            cols = [pa.array(np.round(v, 6)) for v in x.values()]
            yield pa.RecordBatch.from_arrays([b.column("run"), *cols, pa.array([label(round(s, 6)) for s in x["score"]], pa.string())], names=["run", *x, "label"])

    return states.select("run", "state").mapInArrow(run, "run bigint, cs_norm double, direction double, density double, score double, label string")


def candidates(states: DataFrame, w: np.ndarray, needs: list[int], patterns: int = 0) -> DataFrame:
    """run, node_id, c1..c4, admitted, score, failed of every node that is down in a state (column state, run as its name).

    c1: tied to an active node by at least THETA; c2: cohesion falls by at most EPSILON; c3: some of its dependencies are met (or it has none);
    c4: stored patterns are below the capacity. The score is that of the state with the node up.
    """
    n = len(w)

    def run(batches):
        for b in batches:
            out = []
            for r, x in zip(b.column("run").to_pylist(), b.column("state").to_pylist()):
                now = np.array([x], dtype=np.int64)
                up = np.array([x | 1 << i for i in range(n)], dtype=np.int64)
                active = [j for j in range(n) if x >> j & 1]
                met, cs, own, after = satisfied(now, needs, n)[0], cohesion(now, w)[0], scores(up, w, needs)["score"], cohesion(up, w)
                for i in range(n):
                    if not x >> i & 1:
                        c = (bool(active) and float(np.abs(w[i, active]).max()) >= THETA, bool(after[i] >= cs - EPSILON), bool(met[i] > 0), patterns / n < CAPACITY)
                        out.append((r, i, *c, all(c), round(float(own[i]), 6), ",".join(f"C{k + 1}" for k in range(4) if not c[k])))
            cols = list(zip(*out)) or [()] * 9
            types = [pa.int64(), pa.int32(), *[pa.bool_()] * 5, pa.float64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["run", "node_id", "c1", "c2", "c3", "c4", "admitted", "score", "failed"])

    return states.select("run", "state").mapInArrow(run, "run bigint, node_id int, c1 boolean, c2 boolean, c3 boolean, c4 boolean, admitted boolean, score double, failed string")
