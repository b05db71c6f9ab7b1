"""The landscape of a W of any number of nodes.

``landscape`` holds a state in one 64-bit number, so it ends at 62 nodes and can list all
states of small ones. Here a state is a packed bit string (bit i of the whole, low bits first: node i
is +1) and orbits are named by the smallest hexadecimal text of their states. The kernels
step all runs of a batch with one matrix product; W travels with the kernel, n * n numbers for n
nodes, and runs are spread over tasks. Weights are integers below 2**53 in sum, so fields are exact.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkscape.operators.landscape import unit

MODES = ("uniform", "weighted", "boltzmann")
CELLS = 4_000_000  # numbers of one matrix product; larger sets of states go in parts


def matrix(edges: DataFrame, n: int) -> np.ndarray:
    """Dense symmetric matrix of i < j, raw edges: at most n * n / 2 rows, taken as columns."""
    t = edges.select("i", "j", "raw").toArrow()
    w = np.zeros((n, n))
    i, j = t.column("i").to_numpy(), t.column("j").to_numpy()
    w[i, j] = w[j, i] = t.column("raw").to_numpy()
    return w


def packed(s: np.ndarray) -> list[bytes]:
    return [r.tobytes() for r in np.packbits(s > 0, axis=1, bitorder="little")]


def spins(states: list[bytes], n: int) -> np.ndarray:
    if not states:
        return np.zeros((0, n))
    bits = np.unpackbits(np.frombuffer(b"".join(states), np.uint8).reshape(len(states), -1), axis=1, count=n, bitorder="little")
    return bits.astype(np.float64) * 2 - 1


def step(s: np.ndarray, w: np.ndarray) -> np.ndarray:
    h = s @ w
    return np.where(h == 0, s, np.sign(h))


def narrowed(w: np.ndarray) -> np.ndarray:
    """W in single precision where all its fields are integers that this holds exactly."""
    return w.astype(np.float32) if w.size and np.abs(w).sum(axis=1).max() < 1 << 24 and (w == np.rint(w)).all() else w


def relax(s: np.ndarray, w: np.ndarray, most: int = 200):
    """(first, second, period, tail, terminal) of each state: the two phases of its orbit, as spins; they are equal for period 1.

    W is symmetric, so that orbits have period 1 or 2; period 0 where none closes in ``most`` steps.
    """
    n, w = len(s), narrowed(w)
    s = s.astype(w.dtype)
    first, second, last = s.copy(), s.copy(), s.copy()
    period, tail = np.zeros(n, np.int32), np.zeros(n, np.int32)
    open_, before, now = np.arange(n), s, step(s, w)
    fixed = (now == before).all(axis=1)
    period[open_[fixed]] = 1
    open_, before, now = open_[~fixed], before[~fixed], now[~fixed]
    for t in range(1, most):
        if not len(open_):
            break
        after = step(now, w)
        one, two = (after == now).all(axis=1), (after == before).all(axis=1)
        two &= ~one
        for found, p, at in ((one, 1, t), (two, 2, t - 1)):
            k = open_[found]
            period[k], tail[k] = p, at
            first[k], second[k] = (now[found], now[found]) if p == 1 else (before[found], now[found])
            last[k] = now[found] if p == 1 or (most - at) % 2 else before[found]
        rest = ~(one | two)
        open_, before, now = open_[rest], now[rest], after[rest]
    return first, second, period, tail, last


def names(first: np.ndarray, second: np.ndarray, period: np.ndarray) -> list[str | None]:
    return [min(a.hex(), b.hex()) if p else None for a, b, p in zip(packed(first), packed(second), period)]


def orbit_names(s: np.ndarray, w: np.ndarray, most: int = 200) -> list[str | None]:
    part = max(1, CELLS // max(1, s.shape[1]))
    out: list[str | None] = []
    for k in range(0, len(s), part):
        a, b, p, _, _ = relax(s[k : k + part], w, most)
        out += names(a, b, p)
    return out


def relaxed(states: DataFrame, w: np.ndarray, most: int = 200) -> DataFrame:
    """The rows (run, state) with orbit, period, tail, terminal, kind.

    kind: fixed, mirrored (the phases of period 2 are each other's negative), paired (other period 2), open.
    """
    if (w != w.T).any():
        raise ValueError("W must be symmetric")
    n = len(w)

    def run(batches):
        for b in batches:
            a, c, p, t, last = relax(spins(b.column("state").to_pylist(), n), w, most)
            mirrored = (a == -c).all(axis=1)
            kind = np.where(p == 0, "open", np.where(p == 1, "fixed", np.where(mirrored, "mirrored", "paired")))
            yield pa.RecordBatch.from_arrays(
                [b.column("run"), b.column("state"), pa.array(names(a, c, p), pa.string()), pa.array(p), pa.array(t), pa.array(packed(last), pa.binary()), pa.array(kind.tolist(), pa.string())],
                names=["run", "state", "orbit", "period", "tail", "terminal", "kind"],
            )

    return states.select("run", "state").mapInArrow(run, "run bigint, state binary, orbit string, period int, tail int, terminal binary, kind string")


# --- sampling of first states


def strengths(w: np.ndarray) -> list[int] | None:
    """Marginal activity of each node for weighted sampling; None (uniform) where W is empty or fewer nodes than a sample can hold have any."""
    fi = np.abs(w).sum(axis=1)
    if fi.sum() <= 0 or np.count_nonzero(fi) < max(1, round(0.7 * len(w))):
        return None
    return [int(x) for x in fi]


def chosen(spark: SparkSession, runs: int, n: int, seed: int = 0, weights: list[int] | None = None) -> DataFrame:
    """run, n_act, active: max(1, rint((0.3 + 0.4 u) n)) nodes without replacement, equally likely or by weights.

    Keyed by digests, so a run's nodes don't depend on partitions: the least digests are taken or, with
    weights, the least -ln(u) / weight, which draws one after the other in proportion to the weights.
    """
    r = spark.range(runs).select(F.col("id").alias("run"))
    n_act = F.greatest(F.lit(1), F.rint((F.lit(0.3) + F.lit(0.4) * unit(F.lit(seed), "run", F.lit("act"))) * n).cast("int"))
    if weights is None:
        key = lambda i: F.md5(F.concat_ws(":", F.lit(seed), "run", i))
    else:
        given = F.array(*(F.lit(float(x)) for x in weights))
        u = lambda i: (unit(F.lit(seed), "run", i) * 4294967296.0 + 0.5) / 4294967296.0
        key = lambda i: F.when(F.get(given, i) > 0, F.round(-F.log(u(i)) / F.get(given, i), 15)).otherwise(float("inf"))
    ranked = F.array_sort(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.struct(key(i).alias("k"), i.alias("i"))))
    return r.withColumn("n_act", n_act).select("run", "n_act", F.transform(F.slice(ranked, 1, F.col("n_act")), lambda x: x["i"]).alias("active"))


def states_of(active: DataFrame, n: int) -> DataFrame:
    """run, state of rows run, active (nodes that are +1)."""

    def run(batches):
        for b in batches:
            s = np.zeros((b.num_rows, n), bool)
            col = b.column("active")
            s[np.repeat(np.arange(b.num_rows), col.value_lengths().to_numpy()), col.flatten().to_numpy()] = True
            yield pa.RecordBatch.from_arrays([b.column("run"), pa.array(packed(s), pa.binary())], names=["run", "state"])

    return active.select("run", F.col("active").cast("array<int>").alias("active")).mapInArrow(run, "run bigint, state binary")


def beta_c(w: np.ndarray) -> float | None:
    """1 / (0.5 n mean of the positive weights), of w over its largest absolute; None without positive ones."""
    top = np.abs(w).max() if w.size else 0
    positive = w[w > 0] / top if top else w[:0]
    return 1.0 / (0.5 * len(w) * positive.mean()) if positive.size else None


def sampled(spark: SparkSession, w: np.ndarray, runs: int, mode: str = "uniform", seed: int = 0, warmup: int | None = None) -> DataFrame:
    """run, state by a mode: uniform, weighted by the nodes' activity, or boltzmann: uniform, then ``warmup``
    (default: n) single-node updates at the landscape's own temperature, all runs of a batch at once."""
    if mode not in MODES:
        raise ValueError(f"mode is one of {MODES}")
    n = len(w)
    s0 = states_of(chosen(spark, runs, n, seed, strengths(w) if mode == "weighted" else None), n)
    beta = beta_c(w) if mode == "boltzmann" else None
    return s0 if beta is None else warmed(s0, w, beta, n if warmup is None else warmup, seed)


def warmed(states: DataFrame, w: np.ndarray, beta: float, updates: int, seed: int = 0) -> DataFrame:
    """run, state after single-node Glauber updates, p(+1) = 1 / (1 + exp(-2 beta h)); each run has its own keyed numbers."""
    n, scaled = len(w), w / (np.abs(w).max() or 1)

    def run(batches):
        for b in batches:
            runs = b.column("run").to_pylist()
            s = spins(b.column("state").to_pylist(), n)
            draws = np.stack([np.random.Generator(np.random.Philox(key=[seed, r])).random(2 * updates) for r in runs]) if runs else np.zeros((0, 2 * updates))
            rows = np.arange(len(runs))
            for k in range(updates):
                i = np.minimum((draws[:, 2 * k] * n).astype(int), n - 1)
                h = (scaled[i] * s).sum(axis=1)
                s[rows, i] = np.where(draws[:, 2 * k + 1] < 1 / (1 + np.exp(np.clip(-2 * beta * h, -700, 700))), 1.0, -1.0)
            yield pa.RecordBatch.from_arrays([b.column("run"), pa.array(packed(s), pa.binary())], names=["run", "state"])

    return states.select("run", "state").mapInArrow(run, "run bigint, state binary")


# --- distance to the border of a basin


def basin_distance(states: DataFrame, w: np.ndarray, k_max: int = 4, exhaustive: int = 2, samples: int = 500, seed: int = 0) -> DataFrame:
    """run, distance, exact, evaluated: fewest flips, up to k_max, that change the orbit.

    All sets of k nodes are tried for k <= exhaustive or where there are at most ``samples``; else ``samples`` keyed
    random sets, whose finding is an upper bound (exact false). distance is null where nothing up to k_max changes
    the orbit; exact then tells whether all sets were tried. evaluated counts the sets up to the first that changes it.
    """
    n = len(w)

    def run(batches):
        for b in batches:
            s = spins(b.column("state").to_pylist(), n)
            home, out = orbit_names(s, w), []
            for r, x, own in zip(b.column("run").to_pylist(), s, home):
                found, tried, whole = None, 0, True
                g = np.random.Generator(np.random.Philox(key=[seed, r]))
                for k in range(1, min(k_max, n) + 1):
                    every = k <= exhaustive or comb(n, k) <= samples
                    whole &= every
                    sets = np.array(list(combinations(range(n), k))) if every else np.stack([g.choice(n, k, replace=False) for _ in range(samples)])
                    turned = np.repeat(x[None, :], len(sets), axis=0)
                    turned[np.arange(len(sets))[:, None], sets] *= -1
                    at = next((i for i, o in enumerate(orbit_names(turned, w)) if o != own), None)
                    if at is not None:
                        found, whole, tried = k, every, tried + at + 1
                        break
                    tried += len(sets)
                out.append((r, found, whole, tried))
            cols = list(zip(*out)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.bool_(), pa.int64()))], names=["run", "distance", "exact", "evaluated"])

    return states.select("run", "state").mapInArrow(run, "run bigint, distance int, exact boolean, evaluated bigint")


# --- measures


def margin(n_eff: Column, first: Column, floor: Column) -> Column:
    """1 - ln floor / ln N0: how far the effective number can fall from N0; null where N0 is at most 1 or unknown."""
    return F.when((first > 1) & (floor > 0) & n_eff.isNotNull(), 1 - F.log(floor) / F.log(first))


def dyadic(edges: DataFrame, bits: int = 20) -> DataFrame:
    """n, n_dyadic: weights w, and those that are exactly k / 2**bits, whose sums have no rounding."""
    return edges.agg(F.count("*").alias("n"), F.count_if(F.col("w") * float(1 << bits) == F.floor(F.col("w") * float(1 << bits))).alias("n_dyadic"))
