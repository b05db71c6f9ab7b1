"""The landscape of W: relaxation to orbits, basins, effective number, distance, cohesion.

States are bit masks of at most 62 nodes (bit i set: node i is +1). Weights are integers, so
the sign of a field is exact and independent of the order of summation; a field of 0 keeps
the node. W must be symmetric: then every orbit has period 1 or 2, and its name is its
smallest state. The dense matrix (at most 62 x 62) travels with the kernel; runs or states
are spread over tasks and never gathered.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MOST = 62


def matrix(edges: DataFrame, n: int) -> np.ndarray:
    """Dense symmetric integer matrix of i < j, raw edges; at most n * n / 2 rows are read."""
    if n > MOST:
        raise ValueError(f"at most {MOST} nodes")
    w = np.zeros((n, n), dtype=np.int64)
    for r in edges.select("i", "j", "raw").collect():
        w[r[0], r[1]] = w[r[1], r[0]] = r[2]
    return w


def spins(states: np.ndarray, n: int) -> np.ndarray:
    return (((states[:, None] >> np.arange(n)) & 1) * 2 - 1).astype(np.int64)


def step(states: np.ndarray, w: np.ndarray) -> np.ndarray:
    """One synchronous step of all states."""
    n = len(w)
    s = spins(states, n)
    h = s @ w
    up = (h > 0) | ((h == 0) & (s > 0))
    return (up.astype(np.int64) << np.arange(n)).sum(axis=1)


def relax(states: np.ndarray, w: np.ndarray, most: int = 200):
    """orbit, period, tail, terminal of each state; period 0 and orbit -1 where none closes in ``most`` steps."""
    before, now = states.copy(), step(states, w)
    orbit = np.full(len(states), -1, dtype=np.int64)
    period, tail = np.zeros(len(states), np.int32), np.zeros(len(states), np.int32)
    last = states.copy()
    open_ = np.arange(len(states))
    fixed = now == before
    for t in range(1, most + 1):
        if t == 1:
            orbit[open_[fixed]], period[open_[fixed]] = before[fixed], 1
            last[open_[fixed]] = before[fixed]
            open_, before, now = open_[~fixed], before[~fixed], now[~fixed]
            continue
        if not len(open_):
            break
        nxt = step(now, w)
        one, two = nxt == now, (nxt == before) & (nxt != now)
        orbit[open_[one]], period[open_[one]], tail[open_[one]], last[open_[one]] = now[one], 1, t - 1, now[one]
        orbit[open_[two]], period[open_[two]], tail[open_[two]] = np.minimum(now[two], before[two]), 2, t - 2
        last[open_[two]] = np.where((most - (t - 2)) % 2 == 0, before[two], now[two])
        rest = ~(one | two)
        open_, before, now = open_[rest], now[rest], nxt[rest]
    return orbit, period, tail, last


def relaxed(states: DataFrame, w: np.ndarray, most: int = 200) -> DataFrame:
    """The rows (run, state) with orbit, period, tail, terminal."""
    if (w != w.T).any():
        raise ValueError("W must be symmetric")

    def run(batches):
        for b in batches:
            s = b.column("state").to_numpy(zero_copy_only=False).astype(np.int64)
            o, p, t, last = relax(s, w, most)
            yield pa.RecordBatch.from_arrays([b.column("run"), b.column("state"), pa.array(o), pa.array(p), pa.array(t), pa.array(last)], names=["run", "state", "orbit", "period", "tail", "terminal"])

    return states.select("run", "state").mapInArrow(run, "run bigint, state bigint, orbit bigint, period int, tail int, terminal bigint")


def all_states(spark: SparkSession, n: int) -> DataFrame:
    """run, state: every state of n nodes."""
    return spark.range(1 << n).select(F.col("id").alias("run"), F.col("id").alias("state"))


def unit(*parts) -> Column:
    """A number in [0, 1) from a keyed digest."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def sampled(spark: SparkSession, runs: int, n: int, seed: int = 0) -> DataFrame:
    """run, n_act, state: n_act = max(1, rint((0.3 + 0.4 u) n)) nodes of smallest digests are +1."""
    r = spark.range(runs).select(F.col("id").alias("run"))
    n_act = F.greatest(F.lit(1), F.rint((F.lit(0.3) + F.lit(0.4) * unit(F.lit(seed), "run", F.lit("act"))) * n).cast("int"))
    ranked = F.array_sort(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.struct(F.md5(F.concat_ws(":", F.lit(seed), "run", i)).alias("k"), i.alias("i"))))
    state = F.aggregate(F.slice(ranked, 1, F.col("n_act")), F.lit(0).cast("bigint"), lambda a, x: a + F.pow(F.lit(2.0), x["i"]).cast("bigint"))
    return r.withColumn("n_act", n_act).select("run", "n_act", state.alias("state"))


def basins(runs: DataFrame) -> DataFrame:
    """orbit, period, n, mass, largest first; masses sum to 1."""
    g = runs.groupBy("orbit", "period").agg(F.count("*").alias("n"))
    total = runs.agg(F.count("*").alias("total"))
    return g.crossJoin(total).select("orbit", "period", "n", F.round(F.col("n") / F.col("total"), 9).alias("mass"))  # total: one row


def n_eff(runs: DataFrame) -> DataFrame:
    """n_runs, n_orbits, n_eff = (sum n)^2 / sum n^2; null where there are no runs."""
    g = runs.groupBy("orbit").agg(F.count("*").alias("n"))
    return g.agg(F.sum("n").alias("n_runs"), F.count("*").alias("n_orbits"), F.round(F.pow(F.sum("n").cast("double"), 2) / F.sum(F.col("n").cast("double") * F.col("n")), 9).alias("n_eff"))


def distance(now: Column, first: Column) -> Column:
    """1 - ln N / ln N0; null where N0 is null or at most 1, or N is not positive."""
    return F.when((first > 1) & (now > 0), 1 - F.log(now) / F.log(first))


def cohesion(states: DataFrame, w: np.ndarray, column: str = "terminal") -> DataFrame:
    """run, cs: mean over node pairs of w_ij s_i s_j, with w = raw / max |raw|."""
    n, top = len(w), np.abs(w).max() or 1

    def run(batches):
        for b in batches:
            s = spins(b.column(1).to_numpy(zero_copy_only=False).astype(np.int64), n)
            cs = ((s @ w) * s).sum(axis=1) / 2 / top / (n * (n - 1) / 2)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(cs)], names=["run", "cs"])

    return states.select("run", column).mapInArrow(run, "run bigint, cs double")


def flips(states: DataFrame, w: np.ndarray) -> DataFrame:
    """run, distance: fewest flips (1 or 2) that change the orbit; null where no two do."""
    n = len(w)
    masks = np.array([1 << i for i in range(n)] + [(1 << i) | (1 << j) for i in range(n) for j in range(i + 1, n)], dtype=np.int64)

    def run(batches):
        for b in batches:
            s = b.column("state").to_numpy(zero_copy_only=False).astype(np.int64)
            home = relax(s, w)[0]
            out = []
            for x, o in zip(s, home):
                moved = relax(x ^ masks, w)[0] != o
                out.append(1 if moved[:n].any() else 2 if moved.any() else None)
            yield pa.RecordBatch.from_arrays([b.column("run"), pa.array(out, pa.int32())], names=["run", "distance"])

    return states.select("run", "state").mapInArrow(run, "run bigint, distance int")


def between(w: np.ndarray, quarter: int) -> np.ndarray:
    """4 ((1 - l) W + l E) for l = quarter / 4, E the collapse matrix (all pairs at max |W|): integer."""
    e = np.full_like(w, np.abs(w).max())
    np.fill_diagonal(e, 0)
    return (4 - quarter) * w + quarter * e


def boltzmann(spark: SparkSession, w: np.ndarray, runs: int, beta: float, warmup: int, seed: int = 0) -> DataFrame:
    """run, state after ``warmup`` single-node Glauber updates; each run has its own keyed numbers, a batch of runs moves at once."""
    n = len(w)

    def run(batches):
        for b in batches:
            keys = b.column(0).to_pylist()
            u = np.stack([np.random.Generator(np.random.Philox(key=[seed, r])).random(n + 2 * warmup) for r in keys])
            s, rows = np.where(u[:, :n] < 0.5, 1, -1).astype(np.int64), np.arange(len(keys))
            for k in range(warmup):
                i = np.minimum((u[:, n + 2 * k] * n).astype(int), n - 1)
                h = (w[i] * s).sum(axis=1)
                s[rows, i] = np.where(u[:, n + 2 * k + 1] < 1 / (1 + np.exp(np.clip(-2 * beta * h, -700, 700))), 1, -1)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(((s > 0).astype(np.int64) << np.arange(n)).sum(axis=1))], names=["run", "state"])

    return spark.range(runs).mapInArrow(run, "run bigint, state bigint")


def asynchronous(states: DataFrame, w: np.ndarray, sweeps: int = 50, seed: int = 0) -> DataFrame:
    """run, terminal, sweeps: single-node updates in keyed random order until a sweep changes nothing; a batch of runs moves at once."""
    n = len(w)

    def run(batches):
        for b in batches:
            s = spins(b.column("state").to_numpy(zero_copy_only=False).astype(np.int64), n)
            draw = [np.random.Generator(np.random.Philox(key=[seed, r])) for r in b.column("run").to_pylist()]
            done, open_ = np.full(len(s), sweeps, np.int32), np.arange(len(s))
            for k in range(1, sweeps + 1):
                order = np.stack([draw[i].permutation(n) for i in open_]) if len(open_) else np.zeros((0, n), int)
                moved = np.zeros(len(open_), bool)
                for p in range(n):
                    at = order[:, p]
                    turn = (w[at] * s[open_]).sum(axis=1) * s[open_, at] < 0
                    s[open_[turn], at[turn]] *= -1
                    moved |= turn
                done[open_[~moved]] = k
                open_ = open_[moved]
                if not len(open_):
                    break
            yield pa.RecordBatch.from_arrays([b.column("run"), pa.array(((s > 0).astype(np.int64) << np.arange(n)).sum(axis=1)), pa.array(done)], names=["run", "terminal", "sweeps"])

    return states.select("run", "state").mapInArrow(run, "run bigint, terminal bigint, sweeps int")
