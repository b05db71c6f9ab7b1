import pytest
from pyspark.sql import functions as F

from sparkscape.functions import text as T
from sparkscape.operators import criterion as K
from sparkscape.operators import extraction as X
from sparkscape.operators import nulls as U
from sparkscape.sources import runs


def test_run_files_round_trip(spark, tmp_path):
    run = f"file://{tmp_path}/run"
    assert runs.read(spark, run, "device_log").count() == 0
    m = spark.createDataFrame([("d1", "hola", "2024-03-01 10:00:00", 7), ("d2", None, "2024-03-02 10:00:00", 8)], "device_id string, text string, written_at_utc string, extra int")
    runs.append(m, run, "channel_messages")
    runs.append(m.limit(1), run, "channel_messages")
    rows = runs.read(spark, run, "channel_messages").collect()
    assert sorted((r.device_id, r.text, r.tick) for r in rows) == [("d1", "hola", None), ("d1", "hola", None), ("d2", None, None)] and "extra" not in rows[0].asDict()
    assert runs.read(spark, run, "channel_messages", "2024-03-02", "2024-03-02").count() == 1
    for name in runs.FILES:
        runs.append(spark.createDataFrame([], "device_id string"), run, name)
    with pytest.raises(ValueError):
        runs.append(m, run, "other")


def test_declaration_is_stable_and_tells_parameters_apart(spark):
    assert X.digest(X.declaration()) == X.digest(X.declaration(stop=tuple(reversed(T.STOP_WORDS)))) != X.digest(X.declaration(top_k=21))
    rows = X.declared(spark, top_k=5).collect()
    assert len(rows) == 8 and len({r.sha256 for r in rows}) == 1 and '"top_k":5' in rows[-1].parameters


CANDIDATES = [
    ("one", "a", 0.9, 0), ("one", "b", 0.5, 50), ("trace", "a", 0.9, 3), ("trace", "b", 0.88, 12), ("many", "a", 0.9, 12), ("many", "b", 0.9, 12), ("many", "c", 0.1, 0),
    ("nan", "a", float("nan"), 20), ("none", "a", None, 20), ("twice", "a", 0.9, 12), ("twice", "a", 0.9, 12),
]


def test_steps_of_the_rule(spark):
    c = spark.createDataFrame(CANDIDATES, "g string, name string, value double, laps int")
    got = {r.g: (r.value, r.origin, r.margin) for r in K.decide(c, ["g"]).collect()}
    assert got == {"one": ("a", "field", 0.4), "trace": ("b", "trace", None), "many": ("a,b", "undecided", 0.8), "nan": ("", "UNKNOWN", None), "none": ("", "UNKNOWN", None), "twice": ("a", "field", None)}
    assert {r.g: r.origin for r in K.decide(c, ["g"], kappa=0.9).collect()}["many"] == "escalated"
    named = {r.g: (r.value, r.origin) for r in K.decide(c, ["g"], context=F.col("name") == "b").collect()}
    assert named["many"] == ("b", "context")


def test_audit_of_decisions(spark):
    d = K.audited(spark.createDataFrame([(i, "a,b") for i in range(2000)], "g int, value string"), ["g"])
    n = d.where("audited").count()
    assert 140 < n < 260 and d.where("audited").count() == n
    seen = spark.createDataFrame([(i, "a" if i % 4 else "z") for i in range(1000)], "g int, name string")
    r = K.divergence(d, seen, ["g"]).first()
    assert (r.n, r.n_audited, r.census_rate) == (2000, n, 0.25) and abs(r.sample_rate - 0.25) < 0.15
    assert K.divergence(d, seen.limit(0), ["g"]).first().census_rate is None


def test_ranks_over_ranges_equal_sorting(spark):
    rows = [(g, f"k{(i * 7919) % 1000:04}", i) for g in range(3) for i in range(400)]
    df = spark.createDataFrame(rows, "g bigint, k string, v int").repartition(5)
    got = {(r.g, r.k): r.place for r in U.ranked(df, ["g"], ["k"], "place").collect()}
    for g in range(3):
        for place, k in enumerate(sorted(k for h, k, _ in rows if h == g), 1):
            assert got[g, k] == place
    every = U.ranked(df.select("g", "k"), [], ["g", "k"]).collect()
    assert sorted(r.k for r in every if isinstance(r.k, int)) == list(range(1, 1201)) or len(every) == 1200
    assert U.ranked(df.limit(0), ["g"], ["k"]).count() == 0


def test_shuffled_values_are_a_permutation(spark):
    cells = spark.createDataFrame([(i, i % 5) for i in range(200)], "a int, x int")
    out = U.shuffled(cells, ["a"], "x", 3).collect()
    for run in range(3):
        own = [r for r in out if r.run == run]
        assert sorted(r.a for r in own) == list(range(200)) and sorted(r.x for r in own) == sorted(i % 5 for i in range(200))
    assert [r.x for r in sorted((r for r in out if r.run == 0), key=lambda r: r.a)] != [r.x for r in sorted((r for r in out if r.run == 1), key=lambda r: r.a)]


def test_entities_of_html(spark):
    df = spark.createDataFrame([(1, "a &amp; b &#39;c&#x27; &nbsp;&eacute; &unknown; &"), (2, None), (3, "")], "k int, text string")
    assert [r.text for r in T.entities_decoded(df, "text").orderBy("k").collect()] == ["a & b 'c' \xa0é &unknown; &", None, ""]


def test_columns_cut_from_dump_lines(spark):
    from sparkscape.sources import files as D

    lines = [r"(1, 'a,b)', NULL, 'it''s \'q\'', 5),", "(2)", "no row", None, "( 7 , 8\t)"]
    df = spark.createDataFrame([(k, x) for k, x in enumerate(lines)], "k int, line string")
    got = df.orderBy("k").select(*(D.sql_column(F.col("line"), p).alias(f"c{p}") for p in range(5)), D.sql_column(F.col("line"), 0, 2).alias("two"), D.fast_count(F.col("line")).alias("n")).collect()
    assert tuple(got[0])[:5] == ("1", "'a,b)'", "NULL", lines[0].split("NULL, ")[1].rsplit(", 5", 1)[0], "5") and got[0].two == "1"
    assert tuple(got[1])[:2] == ("2", "") and got[1].two == "" and got[2].c0 == "" and got[3].c0 is None and tuple(got[4])[:3] == ("7", "8", "")
    assert D.fast_count(F.lit("x")) is not None and spark.range(1).select(D.fast_count(F.lit("INSERT INTO t VALUES (1,2), (3,4),(5,6);")).alias("n")).first().n == 3


def test_strengths_stay_and_poles_share_out():
    import numpy as np

    from sparkscape.operators import analytics as A

    g = np.random.default_rng(0)
    w = np.triu(g.integers(-3, 4, (9, 9)), 1)
    w = w + w.T
    x = A.same_strength(w, 1)
    assert np.allclose(x.sum(axis=1), np.abs(w).sum(axis=1)) and (x >= 0).all() and not np.allclose(x, np.abs(w)) and (x == x.T).all()
    rows = A.two_poles(w.astype(float), np.triu(np.abs(w), 1), 200, 300, 3)
    for field in ("base", "delta"):
        assert abs(sum(s for f, _, s in rows if f == field) - 1) < 1e-5
    assert A.compared(w, [0, 1, 2], [0, 1, 2], 0.1)["verdict"] == "EQUIVALENT"


def test_tail_fit_prefers_the_law_the_sizes_follow():
    import numpy as np

    from sparkscape.operators import analytics as A

    g, x = np.random.default_rng(1), np.arange(2, 201)
    p, e = x**-2.0, np.exp(-0.2 * x)
    power, decay = (A.power_or_exponential(list(g.choice(x, 400, p=q / q.sum())), 200) for q in (p, e))
    assert abs(power["tau"] - 2) < 0.2 and power["r"] > 0 and abs(decay["rate"] - 0.2) < 0.05 and decay["r"] < 0
    assert A.power_or_exponential([1, 1, 2, 3], 10)["tau"] is None
    b = A.beliefs(np.ones((5, 5)) - np.eye(5), 500, 0.1, 0.1, 0.1, 2, fixed=(0,))
    assert b.shape == (5, 3) and (np.abs(b) <= 1).all() and (b[0] == A.beliefs(np.ones((5, 5)) - np.eye(5), 1, 0.1, 0.1, 0.1, 2, fixed=(0,))[0]).all()


def test_scores_and_criteria_equal_their_definition(spark):
    import numpy as np

    from sparkscape.operators import gatekeeper as G

    n, g = 6, np.random.default_rng(4)
    w = np.triu(g.uniform(-1, 1, (n, n)), 1)
    w, needs = w + w.T, [0b000010, 0, 0b011000, 0b000001, 0, 0b000110]
    for x in range(1 << n):
        on = [i for i in range(n) if x >> i & 1]
        s = [1 if x >> i & 1 else -1 for i in range(n)]
        cs = np.mean([w[i, j] * s[i] * s[j] for i in range(n) for j in range(i + 1, n)])
        share = lambda i: sum(x >> j & 1 for j in range(n) if needs[i] >> j & 1) / bin(needs[i]).count("1") if needs[i] else 1.0
        inside = [w[i, j] for i in on for j in on if i < j]
        best = sorted((w[i, j] for i in range(n) for j in range(i + 1, n)), reverse=True)[: len(inside)]
        density = float(np.clip(np.mean(inside) / np.mean(best), -1, 1)) if len(on) >= 2 and abs(np.mean(best)) >= 1e-10 else 0.0
        want = 0.2 * np.clip((cs + 0.05) / 0.1, 0, 1) + 0.5 * (np.mean([share(i) for i in on]) if on else 0.0) + 0.3 * density
        assert abs(G.scores(np.array([x]), w, needs)["score"][0] - want) < 1e-12
    states = spark.createDataFrame([(x, x) for x in (0, 1, 5, 63)], "run bigint, state bigint")
    rows = {(r.run, r.node_id): r for r in G.candidates(states, w, needs).collect()}
    assert set(rows) == {(x, i) for x in (0, 1, 5, 63) for i in range(n) if not x >> i & 1}
    assert rows[0, 1].c1 is False and "C1" in rows[0, 1].failed and rows[0, 1].c3 and not rows[0, 0].c3 and all(r.admitted == (r.failed == "") for r in rows.values())
    assert [G.label(x) for x in (0.7, 0.5, 0.3, 0.1)] == ["COHESIVE", "SPURIOUS_HIGH", "SPURIOUS_MEDIUM", "SPURIOUS_LOW"]
