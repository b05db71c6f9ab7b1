import itertools
import os
import random
import unicodedata
from collections import Counter, defaultdict

import pyarrow as pa
import pytest
import regex
import xxhash

from sparkscape.llm import pairs as P
from sparkscape.llm import terms as T

REC = "src string, rec_id bigint, text string, term string, n int"
TEXTS = ["uno dos tres_x", "Uno UNO información", "información", None, "", "  ", "a bb ccc", "ß straße ǅ x²y ⅷⅷⅷ 日本語", "x" * 50_000 + " fin", "uno dos tres_x", "İstanbul"]


def frame(spark, texts, src="d"):
    return spark.createDataFrame([(src, i, t, "clash", 1) for i, t in enumerate(texts)], REC)


def brute_terms(texts):
    out = []
    for t in texts:
        s = unicodedata.normalize("NFC", t or "").lower()
        runs, cur = [], ""
        for c in s + " ":
            if c == "_" or unicodedata.category(c)[0] == "L":
                cur += c
            else:
                runs += [cur] if len(cur) >= 3 else []
                cur = ""
        out.append(runs)
    return out


def test_frequencies_equal_counting(spark):
    got = {r.term: (r.occurrences, r.records, r.is_rare, r.is_common) for r in T.frequencies(frame(spark, TEXTS)).collect()}
    terms = brute_terms(TEXTS)
    tf, df, n = Counter(x for t in terms for x in t), Counter(x for t in terms for x in set(t)), sum(map(bool, terms))
    assert got == {t: (tf[t], df[t], df[t] <= 2, df[t] * 10 > n) for t in tf}
    assert {(r.term, r.mark) for r in T.marked(frame(spark, TEXTS)).collect()} == {(t, m) for t in tf for m, on in (("rare", df[t] <= 2), ("common", df[t] * 10 > n)) if on}


def test_terms_of_an_empty_table(spark):
    assert T.frequencies(frame(spark, [])).count() == 0 and T.marked(frame(spark, [])).count() == 0
    assert T.frequencies(frame(spark, [None, "", "1 2"])).count() == 0


def test_latest_delivery_counts_once(spark):
    t = spark.createDataFrame([(1, "old text", "2024-01-01"), (1, "new text", "2024-01-02"), (2, None, None), (None, "gone", "2024-01-01")], "rec_id bigint, text string, received_at string")
    assert {(r.rec_id, r.text) for r in T.latest(t).collect()} == {(1, "new text"), (2, None)}


@pytest.mark.parametrize("budget", [10, 60, 10_000])
def test_radix_recursion_sums_exactly(tmp_path, budget):
    g = random.Random(budget)
    rows = [("s", f"t{g.randrange(400)}", g.randrange(5), 1) for _ in range(3000)] + [("s", "hot", 1, 1)] * 1500
    a = T.RadixAggregator(str(tmp_path), budget)
    for k in range(0, len(rows), 50):
        cols = list(zip(*((*r, xxhash.xxh3_64_intdigest(r[0] + "\0" + r[1]) - (1 << 63)) for r in rows[k : k + 50])))
        a.add(pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, T.PART)], schema=T.PART))
    got = {}
    for b in a.finish():
        for s, t, tf, df in zip(*(c.to_pylist() for c in b.columns)):
            assert (s, t) not in got
            got[(s, t)] = (tf, df)
    want = defaultdict(lambda: [0, 0])
    for s, t, tf, df in rows:
        want[(s, t)][0] += tf
        want[(s, t)][1] += df
    assert got == {k: tuple(v) for k, v in want.items()}
    assert (a.depth > 1) == (budget == 10) or budget == 60
    assert os.listdir(tmp_path) == []


def test_equal_hashes_dont_recurse_for_ever(tmp_path):
    a = T.RadixAggregator(str(tmp_path), 4)
    for k in range(40):
        a.add(pa.RecordBatch.from_arrays([pa.array(["s"]), pa.array([f"t{k}"]), pa.array([1]), pa.array([1]), pa.array([-7])], schema=T.PART))
    assert sum(b.num_rows for b in a.finish()) == 40


def brute_pairs(baskets, least, share, lift):
    out = {}
    for src in {s for s, _ in baskets}:
        own = [b for (s, _), b in baskets.items() if s == src and b]
        n, one = len(own), Counter(x for b in own for x in b)
        two = Counter(p for b in own for p in itertools.combinations(sorted(b), 2))
        for (a, b), m in two.items():
            if m >= least and m * share >= n and m * n >= lift * one[a] * one[b]:
                out[(src, a, b)] = (one[a], one[b], m, n)
    return out


def rows_of(table):
    return {(r.src, r.term_a, r.term_b): (r.n_a, r.n_b, r.n_ab, r.total) for r in table.scores().collect()}


def changed(spark, baskets):
    return spark.createDataFrame([(s, i, None if b is None else list(b)) for (s, i), b in baskets.items()], P.BASKET)


def make(g, ids):
    return {(s, i): {f"w{g.randrange(14)}" for _ in range(g.randrange(7))} | ({"hot"} if g.random() < 0.4 else set()) for s in ("d", "m") for i in ids}


def test_changes_keep_the_table_exact(spark, tmp_path):
    """Load, then change, remove, add and empty baskets: always the counts of a fresh load, also in a table opened again."""
    g = random.Random(3)
    now = make(g, range(60))
    t = P.PairTable(spark, least=2, share=40, lift=1, path=f"file://{tmp_path}/t", buckets=3)
    t.apply(changed(spark, now))
    assert rows_of(t) == brute_pairs(now, 2, 40, 1) != {}
    steps = [{**{("d", i): {"w1", "w2", "w3"} for i in range(0, 20, 3)}, ("m", 5): None, ("m", 6): set()}, make(g, range(55, 75)), {k: None for k in now if k[0] == "m" and k[1] < 40}]
    for step in steps:
        t = P.PairTable(spark, path=f"file://{tmp_path}/t")
        t.apply(changed(spark, step))
        now = {k: v for k, v in {**now, **step}.items() if v}
        assert rows_of(t) == brute_pairs(now, 2, 40, 1)


def test_items_that_leave_and_come_back_are_counted_anew(spark):
    t = P.PairTable(spark, least=2, share=10, lift=1, buckets=4)
    base = {("d", i): {"a", "b", "c"} if i < 4 else {"x", "y"} for i in range(12)}
    t.apply(changed(spark, base))
    gone = {("d", i): {"z", "c"} for i in range(4)}
    t.apply(changed(spark, gone))
    assert {r["item"] for r in t.tracked().collect()} == {"c", "z", "x", "y"}
    back = {("d", i): {"a", "b"} for i in range(2, 9)}
    t.apply(changed(spark, back))
    assert rows_of(t) == brute_pairs({**base, **gone, **back}, 2, 10, 1)


def test_only_touched_buckets_are_rewritten(spark):
    """A change of two records, with marginals in the band before and after, writes their pairs' and items' buckets alone."""
    t = P.PairTable(spark, least=1, share=1000, lift=1, buckets=64)
    now = {("d", i): {f"a{i % 20}", f"b{i % 20}"} for i in range(100)}
    t.apply(changed(spark, now))
    old = dict(t.state["pairs"]), dict(t.state["marginals"])
    step = {("d", 200): {"a3", "b3"}, ("d", 201): {"a3", "b3"}}
    t.apply(changed(spark, step))
    assert len(t.rewritten["pairs"]) == 1 and len(t.rewritten["marginals"]) <= 3
    assert sum(v != old[0].get(b) for b, v in t.state["pairs"].items()) == 1
    assert rows_of(t) == brute_pairs({**now, **step}, 1, 1000, 1)


def test_old_versions_go_but_results_handed_out_stay(spark, tmp_path):
    t = P.PairTable(spark, least=1, share=1000, lift=1, path=f"file://{tmp_path}/t", buckets=2)
    for k in range(4):
        t.apply(changed(spark, {("d", k): {"a", "b", f"c{k}"}}))
        if k:
            assert before.count() > 0
        before = t.scores()
    assert len(os.listdir(tmp_path / "t" / "pairs")) <= 4 and len(os.listdir(tmp_path / "t" / "log")) == 4


def test_a_long_record_goes_in_strips(spark, monkeypatch):
    monkeypatch.setattr(P, "HELD", 5_000)
    now = {("d", i): {f"w{k:04}" for k in range(700)} for i in range(2)}
    t = P.PairTable(spark, least=2, share=2, lift=1, buckets=2)
    t.apply(changed(spark, now))
    assert t.scores().count() == 700 * 699 // 2


def test_pairs_of_texts_and_their_halves(spark):
    texts = ["uno dos tres"] * 6 + ["uno cuatro", None, "", "cinco seis"] * 30
    want = brute_pairs({("d", i): set(t) for i, t in enumerate(brute_terms(texts))}, 5, 500, 2)
    for f in (P.together, P.in_two_steps):
        assert {(r.src, r.term_a, r.term_b) for r in f(frame(spark, texts), 5, 500, 2).collect()} == set(want)


def test_pairs_of_an_empty_table(spark):
    assert P.together(frame(spark, [])).count() == 0
    assert P.together(frame(spark, [None, "", "solo"])).count() == 0
    t = P.PairTable(spark, buckets=2)
    t.apply(changed(spark, {("d", 1): {"a"}}).where("rec_id > 5"))
    t.apply(spark.createDataFrame([("d", 1, ["a", "a", None, "b"])] * 1, P.BASKET))
    assert t.totals().first().total == 1


def test_term_pattern_is_that_of_categories():
    sample = "".join(map(chr, itertools.chain(range(0x20, 0x3000), range(0xA000, 0xD7FF))))
    ours = set(regex.findall(r"[\p{L}_]", sample))
    assert len(ours ^ {c for c in sample if c == "_" or unicodedata.category(c)[0] == "L"}) <= 200  # newer letters only
