import json
import os
import subprocess
import sys

import numpy as np
import pytest

import __spark_entry__ as entry
import compare
from sparkscape.functions import text as T
from sparkscape.operators import analytics as A
from sparkscape.operators import corpus as C
from sparkscape.operators import landscape as L
from sparkscape.operators import votes as V
from sparkscape.sources import files
from pyspark.sql import functions as F

SAME = "doc_freq tfidf_scores border_register w_edges phi_pmi opposition_flag vote_drops symmetrized_edges triangles components null_sign_shuffle basin_masses conjugate_orbits mean_cs stop_signal cycles trust_decide session_devices order_brand_w copresence_corr stream_dedupe p1_found p5_found".split()


@pytest.mark.parametrize("name", SAME)
def test_equals_sql(spark, name):
    d = "/root/testdata/sf0.01"
    df = entry.queries()[name](spark, d)
    cur = compare.views(d).execute(entry.oracle_sql()[name])
    cols = [c[0] for c in cur.description]
    assert sorted(cols) == sorted(df.columns)
    assert compare.rows(df.columns, df.collect()) == compare.rows(cols, cur.fetchall())


def test_every_sql_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 150


def units(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "unit_id bigint, text string")


def test_markers_are_whole_words_in_either_form(spark):
    texts = ["distribution", "But no", "peró", "pero", "no estoy de acuerdo.", "that's wrong", None, "", "abut butter"]
    got = [r[0] for r in units(spark, texts).orderBy("unit_id").select(T.opposes(F.col("text"))).collect()]
    assert got == [False, True, False, True, True, True, False, False, False]


def test_tokens_in_decomposed_text_and_ngrams(spark):
    r = units(spark, ["información y más cosas", None, "", "a b", "x" * 200_000]).orderBy("unit_id").select(T.analyze(F.col("text"), (), 2).alias("t")).collect()
    assert [x.t for x in r][:4] == [["información", "más", "cosas", "información más", "más cosas"], [], [], []]
    assert len(r[4].t[0]) == 200_000


def test_selection_rules_at_the_cut(spark):
    s = spark.createDataFrame([("a", 2, 2, 0.9), ("b", 2, 2, 0.5), ("c", 2, 2, 0.5), ("d", 2, 2, 0.5), ("e", 2, 2, 0.1)], "term string, df int, tf int, score double")
    chosen = lambda k, prev=None: sorted(r.term for r in C.register(s, k, prev).where("selected").collect())
    assert chosen(4) == ["a", "b", "c", "d"] and chosen(2) == ["a"] and chosen(2, ["c"]) == ["a", "c"] and chosen(2, []) == ["a"] and chosen(9) == list("abcde")


def test_no_texts_no_nodes(spark):
    u = units(spark, [None, "", " "])
    n, e = C.signed_w(u, 5)
    assert n.count() == 0 and e.count() == 0
    assert C.status(n, e).first().n_nodes == 0


def test_unsigned_presence_has_no_frustration_and_marked_units_do(spark):
    plain = ["alpha beta gamma", "alpha beta gamma", "alpha beta delta", "gamma delta beta"]
    n, e = C.signed_w(units(spark, plain), 10, stop=())
    assert e.where("raw < 0").count() == 0
    _, e = C.signed_w(units(spark, plain + ["but alpha beta"] * 4), 10, stop=("but",))
    assert e.where("raw < 0").count() > 0


@pytest.mark.parametrize("seed", range(6))
def test_relaxation_against_plain_iteration(seed):
    g = np.random.default_rng(seed)
    n = 8
    w = np.triu(g.integers(-2, 3, (n, n)), 1)
    w = w + w.T
    states = np.arange(1 << n)
    orbit, period, tail, last = L.relax(states, w)
    nxt = L.step(states, w)
    for s in states:
        path, x = [], s
        while x not in path:
            path.append(x)
            x = nxt[x]
        cycle = path[path.index(x) :]
        assert (orbit[s], period[s], tail[s]) == (min(cycle), len(cycle), path.index(x))
        x = s
        for _ in range(200):
            x = nxt[x]
        assert last[s] == x
    assert set(period) <= {1, 2}
    full = (1 << n) - 1
    assert (nxt[states ^ full] == (nxt ^ full)).all()


def test_period_two_and_collapse():
    w = np.array([[0, -1], [-1, 0]])
    assert L.relax(np.array([0, 3]), w)[1].tolist() == [2, 2]
    w = np.ones((5, 5), int) - np.eye(5, dtype=int)
    assert len(set(L.relax(np.arange(32), w)[0])) == 2


def test_samples_are_nested_and_within_bounds(spark):
    a = [tuple(r) for r in L.sampled(spark, 50, 10).orderBy("run").collect()]
    b = [tuple(r) for r in L.sampled(spark, 20, 10).orderBy("run").collect()]
    assert a[:20] == b and all(3 <= r[1] <= 7 and bin(r[2]).count("1") == r[1] for r in a)


def graph(spark, pairs):
    return spark.createDataFrame([(a, b, 1 if (a + b) % 2 else -1) for a, b in pairs], "a bigint, b bigint, sign int")


def test_components_and_core_of_several_parts(spark):
    chain = [(i, i + 1) for i in range(1, 40)]
    e = graph(spark, chain + [(100, 101), (101, 102), (100, 102), (200, 201)])
    sizes = {r[0]: r[1] for r in V.components(e).groupBy("component").count().collect()}
    assert sizes == {1: 40, 100: 3, 200: 2}
    assert sorted(r[0] for r in V.core(e, 2).collect()) == [100, 101, 102]
    assert V.components(graph(spark, [(1, 2)]).where("a > 5")).count() == 0


def test_triangles_of_a_hub(spark):
    e = graph(spark, [(0, i) for i in range(1, 30)] + [(i, i + 1) for i in range(1, 29)])
    t = {tuple(r)[:3] for r in V.triangles(e).collect()}
    assert t == {(0, i, i + 1) for i in range(1, 29)}


def test_shuffled_signs_keep_their_number(spark):
    e = graph(spark, [(i, i + k) for i in range(1, 20) for k in (1, 2)])
    neg = e.where("sign < 0").count()
    for r in V.shuffled_signs(e, 5).groupBy("run").agg(F.count_if(F.col("sign") < 0).alias("n")).collect():
        assert r.n == neg


def test_topology_of_known_complexes():
    ring = np.zeros((4, 4), int)
    for i in range(4):
        ring[i, (i + 1) % 4] = ring[(i + 1) % 4, i] = 1
    assert A.betti(ring, 0.5) == {"n_edges": 4, "n_triangles": 0, "h0": 1, "h1": 1, "h2": 0, "chi": 0}
    full = np.ones((4, 4), int) - np.eye(4, dtype=int)
    b = A.betti(full, 0.5)
    assert (b["h0"], b["h1"], b["h2"]) == (1, 0, 1) and A.orientable(full, 0.5) and A.orientable(ring, 0.5) is None


def test_planted_groups_are_found():
    w = np.full((8, 8), -1)
    w[:4, :4] = w[4:, 4:] = 3
    np.fill_diagonal(w, 0)
    assert A.ward(w, 2) == [1] * 4 + [2] * 4
    side, cut = A.fiedler(w)
    assert len(set(side[:4])) == len(set(side[4:])) == 1 and side[0] != side[4] and cut == 0
    assert A.spectral_kmeans(w, 2) == [0] * 4 + [1] * 4


def test_smallest_landscapes_by_direct_count():
    for code, n_eff in A.smallest_landscapes(3, 0, 27):
        w = np.zeros((3, 3), int)
        w[np.triu_indices(3, 1)] = [(code // 3**k) % 3 - 1 for k in range(3)]
        w += w.T
        counts = np.unique(L.relax(np.arange(8), w)[0], return_counts=True)[1]
        assert n_eff == pytest.approx(64 / (counts**2).sum())


def test_rank_sum_against_counting():
    a, b = [1, 2, 2, 5], [2, 3, 4]
    u = sum((x > y) + 0.5 * (x == y) for x in a for y in b)
    assert A.rank_sum(a, b)["u"] == u


def test_files_round_trip(spark, tmp_path):
    p = str(tmp_path)
    with open(f"{p}/x.jsonl", "w") as f:
        f.write('{"a": 1}\nbroken\n\n{"a": null, "b": 2}\n')
    r = files.read_lines(spark, f"{p}/x.jsonl", "a int").collect()
    assert [x._unparsed for x in r if x._unparsed] == ["broken"]
    with open(f"{p}/d.sql", "w") as f:
        f.write("CREATE TABLE x;\nINSERT INTO `post` VALUES (1,'a),(b',NULL),(2,'it''s','y');\nINSERT INTO `other` VALUES (1);\n")
    d = files.read_dump(spark, f"{p}/d.sql", {"post": ["id", "t", "u"]}).collect()
    assert [x.row for x in d] == [{"id": "1", "t": "a),(b", "u": None}, {"id": "2", "t": "it's", "u": "y"}]
    n, e = C.signed_w(units(spark, ["alpha beta", "alpha beta", "alpha gamma", "gamma beta"]), 5, stop=())
    assert files.write_w(n, e, f"{p}/w").first().n == n.count()
    chat = units(spark, ["**user** (10:00): hello\n---\n**assistant** (10:01): bye"])
    assert [(x.role, x.body) for x in files.chat_turns(chat).orderBy("pos").collect()] == [("user", "hello"), ("assistant", "bye")]


def test_stream_panel_equals_batch_fold(spark):
    got = {r.rec_id: r for r in entry.queries()["stream_panel"](spark, "/root/testdata/sf0.001").collect()}
    rows = sorted((r for r in spark.read.parquet("/root/testdata/sf0.001/monitor_trajectory.parquet").collect() if r.series and r.rec_id), key=lambda r: (r.series, r.t, r.rec_id))
    n, rej = {}, {}
    for r in rows:
        n[r.series] = n.get(r.series, 0) + 1
        rej[r.series] = rej.get(r.series, 0) + ((json.loads(r.panel) if r.panel else {}).get("n_rejected_pairs") or 0)
    last = {}
    for r in got.values():
        last[r.series] = max(last.get(r.series, (0, 0)), (r.n, r.rejected))
    assert last == {s: (n[s], float(rej[s])) for s in n}


def test_swaps_keep_degrees_and_weights():
    g = np.random.default_rng(0)
    w = np.triu(g.integers(-1, 2, (9, 9)), 1)
    w = w + w.T
    x = A.swapped(w, 100, 1)
    assert (x == x.T).all() and sorted(x[x != 0]) == sorted(w[w != 0]) and ((x != 0).sum(axis=0) == (w != 0).sum(axis=0)).all() and (x != w).any()


def test_collapse_distribution_is_one():
    for n in (5, 6, 9):
        d = A.collapse_distribution(n, 12)
        assert sum(p for _, p in d) == pytest.approx(1) and all(1 <= v <= 12 for v, _ in d)


def test_screen_finds_planted_groups_only():
    w = np.full((10, 10), 1)
    w[:5, :5] = w[5:, 5:] = 20
    np.fill_diagonal(w, 0)
    assert A.screen(w, 2, 400, 0)["verdict"] == "FRONTIER"
    assert A.screen(np.zeros((4, 4), int), 2, 5, 0)["verdict"] == "NOT MEASURABLE"


def test_loose_json(spark):
    u = units(spark, ['say {"a": 1} now', "none", None, "{broken"])
    assert [r[0] for r in u.orderBy("unit_id").select(files.loose_json(F.col("text"))).collect()] == ['{"a": 1}', None, None, None]


def test_workers_find_the_package_from_any_folder(tmp_path):
    root = os.path.dirname(os.path.abspath(entry.__file__))
    code = f"""
import sys; sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
s = SparkSession.builder.master('local[2]').config('spark.sql.shuffle.partitions', '2').config('spark.ui.enabled', 'false').getOrCreate()
import __spark_entry__ as e
assert e.queries()['p1_found'](s, '/root/testdata/sf0.001').count() > 0
assert e.queries()['smallest_landscapes'](s, '/root/testdata/sf0.001').count() == 729
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
