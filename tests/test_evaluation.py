import numpy as np
import pytest

from sparkscape.operators import corpus as C
from sparkscape.operators import evaluation as E

SCHEMA = "rec_id bigint, series string, t bigint, device_id string, text string, ts timestamp, received_at timestamp, panel string, words int"
WORDS = "señal panel matriz borde nodo campo ciclo lumbre brasa umbral tensión deriva silencio mapa voto hilo".split()


def texts(n, seed=1):
    g = np.random.default_rng(seed)
    return [" ".join(g.choice(WORDS, 5)) + (" sin embargo" if g.random() < 0.4 else "") for _ in range(n)]


def frame(spark, rows):
    return spark.createDataFrame([(i, s, t, d, x, None, None, None, 1) for i, s, t, d, x in rows], SCHEMA)


def channel_rows(n=75, series="a", seed=1):
    return [(k, series, k, f"dev-{k % 3}" if k % 10 else None, x) for k, x in enumerate(texts(n, seed))]


def test_corpus_gives_the_w_of_signed_w(spark):
    own = texts(60)
    u = spark.createDataFrame(list(enumerate(own)), "unit_id bigint, text string")
    nodes, edges = C.signed_w(u, 6)
    want = {r.node_id: r.term for r in nodes.collect()}
    rows = E.messages(frame(spark, [(k, "a", k, "d", x) for k, x in enumerate(own)])).orderBy("t").collect()
    c = E.Corpus(6)
    for r in rows:
        c.add(r.words, r.opposes)
    got, raw = c.build()
    assert got == [want[k] for k in range(len(want))]
    assert {(r.i, r.j): r.raw for r in edges.collect() if r.raw} == {(i, j): raw[i, j] for i in range(len(got)) for j in range(i + 1, len(got)) if raw[i, j]}


def test_policy_and_panels(spark):
    rows = channel_rows()
    got = {r.rec_id: r for r in E.evaluated(frame(spark, rows), 6).collect()}
    assert len(got) == 75 and all(got[k]["mode"] == "accumulation" for k in range(29))
    first = min(k for k, r in got.items() if r["mode"] == "evaluation")
    assert got[first].cause == "first" and got[first].sha_before is None and got[first].n_devices == 3 and got[first].corpus_size == 30
    assert got[74].corpus_size == sum(d is not None for _, _, _, d, _ in rows)  # the system's messages aren't in it
    assert got[70]["mode"] == "evaluation"  # though measured
    seen = [r for r in (got[k] for k in range(75)) if r["mode"] == "evaluation"]
    for a, b in zip(seen, seen[1:]):
        assert (b.reset is not None) == (a.w_sha != b.w_sha)
        if a.w_sha == b.w_sha:
            assert b.delta_sum == a.delta_sum + 2 * b.n_expelled and b.torn_sum == a.torn_sum + 2 * b.n_torn and b.n_eff0 == a.n_eff0
        else:
            assert b.delta_sum == 2 * b.n_expelled and b.d_ckm in (0.0, None)
    assert all(r.n_declared == r.n_accepted + r.n_expelled + r.n_torn and r.n_expelled <= r.n_rejected <= r.n_expelled + r.n_torn for r in seen)
    causes = {r.cause for r in got.values()} - {None}
    assert causes <= {"first", "structural", "volume", "time"} and "volume" in causes | {"structural"}


def test_state_survives_being_stored(spark):
    rows = E.messages(frame(spark, channel_rows())).orderBy("t").collect()
    a, b = E.Channel(6), E.Channel(6)
    for r in rows:
        b = E.load(E.dump(b))
        assert a.message(r.words, r.opposes, r.device_id, r.system) == b.message(r.words, r.opposes, r.device_id, r.system)


def test_registers(spark):
    p = E.evaluated(frame(spark, channel_rows() + [(1000 + k, "b", k, "x", t) for k, t in enumerate(texts(40, 2))]), 6).cache()
    register = E.version_register(p).orderBy("series", "version").collect()
    assert {r.series for r in register} == {"a"}  # b has one device only
    assert [r.version for r in register] == list(range(1, len(register) + 1)) and sum(r.n_messages for r in register) == p.where("w_sha is not null").count()
    s = E.signed(p).collect()
    assert all(r.known for r in s) and s and {r.rec_id for r in s if r.current} >= {max(r.rec_id for r in s)}
    d = E.decisions(p).collect()
    assert {r.no_rebuild for r in d if r.series == "b"} == {"few texts", "few devices"}
    assert all(r.w_changed == (r.sha_before != r.sha_after) for r in d)


def test_nulls_blanks_and_empty(spark):
    rows = [(1, "a", None, None, "x"), (2, None, 1, "d", "texto"), (3, "a", 1, "d", None), (4, "a", 2, "d", "  "), (5, "a", 3, None, "uno dos tres"), (5, "a", 3, None, "uno dos tres")]
    assert {r.rec_id for r in E.evaluated(frame(spark, rows)).collect()} == {1, 5}
    assert E.evaluated(frame(spark, [])).count() == 0


@pytest.mark.parametrize("before,after,want", [(None, (["a"], "x"), None), ((["a"], "x"), (["a"], "x"), None), ((["a"], "x"), (["a", "b"], "y"), "N"), ((["a", "b"], "x"), (["b", "a"], "y"), "nodes"), ((["a"], "x"), (["a"], "y"), "weights")])
def test_kinds_of_change(before, after, want):
    assert E.change(before, after) == want


def test_stream_over_several_batches_equals_the_fold(spark, tmp_path):
    """Four files, one a batch; the last brings a late message, which is taken when it comes."""
    from sparkscape.streaming import channel as X

    rows = channel_rows(66) + [(500 + k, "b", k, f"d{k % 2}", x) for k, x in enumerate(texts(50, 5))]
    late = [r for r in rows if r[0] == 20]
    rows = [r for r in rows if r[0] != 20]
    for k in range(3):
        part = [r for r in rows if r[2] // 25 == k]
        frame(spark, part).coalesce(1).write.parquet(f"{tmp_path}/in/f{k}")
    frame(spark, late).coalesce(1).write.parquet(f"{tmp_path}/in/f3")
    import glob, os  # noqa: E401

    for k in range(4):
        for f in glob.glob(f"{tmp_path}/in/f{k}/*.parquet"):
            os.utime(f, (1_700_000_000 + k, 1_700_000_000 + k))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    got = {r.rec_id: r for r in X.drained(X.evaluated(stream, 6)).collect()}
    order = sorted(rows, key=lambda r: (r[2] // 25, r[1], r[2])) + late
    want = {}
    for s in "ab":
        c = E.Channel(6)
        own = [r for r in order if r[1] == s]
        words = {r.rec_id: r for r in E.messages(frame(spark, own)).collect()}
        for r in own:
            m = words[r[0]]
            want[r[0]] = E.row(s, r[0], r[2], c.message(m.words, m.opposes, m.device_id, m.system))
    assert {k: tuple(v) for k, v in got.items()} == want
