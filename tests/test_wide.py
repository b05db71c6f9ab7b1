import numpy as np
import pytest

from sparkscape.operators import landscape as L
from sparkscape.operators import wide as W


def random_w(n, seed, low=-3):
    g = np.random.default_rng(seed)
    w = np.triu(g.integers(low, 4, (n, n)), 1).astype(float)
    return w + w.T


def brute(s, w, most=200):
    """(orbit as set of states, period, tail, terminal) step by step."""
    seen, seq = {}, []
    s = tuple(s)
    while s not in seen:
        seen[s] = len(seq)
        seq.append(s)
        h = w @ np.array(s)
        s = tuple(1.0 if x > 0 else -1.0 if x < 0 else y for x, y in zip(h, s))
    tail = seen[s]
    period = len(seq) - tail
    return frozenset(seq[tail:]), period, tail, seq[tail + (most - tail) % period]


@pytest.mark.parametrize("n,seed", [(5, 1), (9, 2), (70, 3), (146, 4)])
def test_relax_equals_stepping(n, seed):
    w = random_w(n, seed)
    s = np.where(np.random.default_rng(seed).random((60, n)) < 0.5, 1.0, -1.0)
    s[0] = 1.0
    a, b, p, t, last = W.relax(s, w)
    for k in range(len(s)):
        orbit, period, tail, terminal = brute(s[k], w)
        assert (frozenset((tuple(a[k]), tuple(b[k]))), p[k], t[k], tuple(last[k])) == (orbit, period, tail, terminal)


def test_packing_and_agreement_with_narrow(spark):
    n, w = 8, random_w(8, 5)
    s = W.spins([bytes([x]) for x in range(256)], n)
    assert W.packed(s) == [bytes([x]) for x in range(256)]
    wide = W.relaxed(spark.createDataFrame([(x, bytes([x])) for x in range(256)], "run bigint, state binary"), w)
    narrow = L.relaxed(L.all_states(spark, n), w.astype(np.int64))
    both = wide.select("run", "orbit", "period", "tail").join(narrow.selectExpr("run", "orbit as o", "period as p", "tail as t"), "run").collect()
    assert len(both) == 256 and all((int(r.orbit, 16), r.period, r["tail"]) == (r.o, r.p, r.t) for r in both)


def test_modes_of_sampling(spark):
    w = random_w(100, 6, low=0)
    w[:, 90:] = w[90:, :] = 0
    for mode in W.MODES:
        rows = W.sampled(spark, w, 200, mode).collect()
        assert sorted(r.run for r in rows) == list(range(200)) and {len(r.state) for r in rows} == {13}
        assert W.sampled(spark, w, 200, mode).collect() == rows
    taken = [set(r.active) for r in W.chosen(spark, 300, 100, 0, W.strengths(w)).collect()]
    assert all(30 <= len(t) <= 70 and not t & set(range(90, 100)) for t in taken)
    assert W.strengths(np.zeros((5, 5))) is None and W.strengths(np.pad(random_w(3, 1, low=1), (0, 7))) is None
    heavy = W.chosen(spark, 2000, 4, 1, [8, 1, 1, 1]).where("n_act = 1").collect()
    share = sum(r.active == [0] for r in heavy) / len(heavy)
    assert abs(share - 8 / 11) < 0.07


@pytest.mark.parametrize("n,samples", [(6, 500), (14, 20)])
def test_basin_distance_equals_trying_all(spark, n, samples):
    w = np.ones((n, n)) - np.eye(n)
    w[0, 1] = w[1, 0] = -1
    s = np.where(np.random.default_rng(n).random((20, n)) < 0.5, 1.0, -1.0)
    got = {r.run: r for r in W.basin_distance(spark.createDataFrame(list(enumerate(map(bytes, W.packed(s)))), "run bigint, state binary"), w, samples=samples).collect()}
    from itertools import combinations

    for k, x in enumerate(s):
        home, first = brute(x, w)[0], None
        for d in range(1, 5):
            for c in combinations(range(n), d):
                y = x.copy()
                y[list(c)] *= -1
                if brute(y, w)[0] != home:
                    first = d
                    break
            if first:
                break
        r = got[k]
        assert (r.distance == first and r.evaluated > 0) if r.exact else (r.distance is None or r.distance >= first)


def test_empty(spark):
    none = spark.createDataFrame([], "run bigint, state binary")
    assert W.relaxed(none, random_w(70, 1)).count() == 0 and W.basin_distance(none, random_w(70, 1)).count() == 0
    with pytest.raises(ValueError):
        W.sampled(spark, random_w(4, 1), 3, "other")
