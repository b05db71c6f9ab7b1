"""Blocks: equal to brute force over several chunks and shapes, and disk in proportion to the texts."""

import random
from pathlib import Path

import pytest

from sparkscape.operators import blocks as B
from sparkscape.session import shared_dir

WORDS = [f"{a}{b}{c}" for a in "bcdfg" for b in ("ara", "elo", "ipu") for c in "mnrst"]


def collection(n, large):
    rnd = random.Random(5)
    texts = []
    for k in range(n):
        own = [rnd.sample(WORDS[: rnd.choice((12, 30, 75))], rnd.randint(3, 11)) for _ in range(rnd.randint(1, 3))]
        texts.append(("ab"[rnd.random() < 0.3], f"v{rnd.randint(1, 5)}", "\n\n".join(map(" ".join, own))))
    if large:  # more tokens than a byte counts, and others that such a set contains
        long = [f"{a}{b}" for a in WORDS for b in WORDS[:5]]
        texts += [("a", "v1", " ".join(long)), ("a", "v2", " ".join(long[:300])), ("a", "v4", " ".join(long[:270] + WORDS[:40])), ("a", "v3", " ".join([*long[100:120], *WORDS[:3]]))]
    return [*texts, (None, "v1", "one two three four five"), ("a", None, "one two three four five"), ("a", "v2", None), ("c", "v1", "x y"), ("d", "v1", "alone alone with five words here")]


def brute(texts, theta):
    own, held = {}, set()
    for series, version, text in texts:
        for block in (text or "").split("\n\n") if series and version else ():
            t = frozenset(w for w in block.split() if len(w) > 2)
            if len(t) >= 5:
                own.setdefault((series, t), set()).add(version)
    for s, a in own:
        held |= {(s, a, b) for r, b in own if r == s and a != b and len(a & b) >= theta * len(a) - 1e-9}
    return own, held


def digest(t):
    import hashlib

    return hashlib.sha256("\n".join(sorted(t)).encode()).hexdigest()


@pytest.mark.parametrize("chunk", [B.CHUNK, 9_000])
@pytest.mark.parametrize("theta", [0.8, 0.5])
def test_turnover_is_as_by_brute_force(spark, chunk, theta):
    texts = collection(260, True)
    own, held = brute(texts, theta)
    seen = {k: set(v) for k, v in own.items()}
    for s, a, b in held:
        seen[s, a] |= own[s, b]
    want = set()
    for s in {s for s, _ in own}:
        v = sorted(set().union(*(x for (r, _), x in own.items() if r == s)))
        for a, b in zip(v, v[1:], strict=False):
            k = [x for x in own if x[0] == s]
            leaves, arrives = [x for x in k if a in own[x] and b not in seen[x]], [x for x in k if b in own[x] and a not in seen[x]]
            want.add((s, a, b, sum(a in own[x] for x in k), sum(b in own[x] for x in k), len(leaves), sum(max(seen[x]) <= b for x in leaves), len(arrives), sum(min(seen[x]) < a for x in arrives)))
    got = B.turnover(spark.createDataFrame(texts, "series string, version string, text string"), theta, chunk=chunk)
    assert {tuple(r) for r in got.collect()} == want and got.count() == len(want)
    assert B.turnover(spark.createDataFrame([], "series string, version string, text string"), theta, chunk=chunk).count() == 0


def disk(spark, run):
    """Bytes that ``run`` shuffles and leaves in the shared folder."""
    gw, jvm = spark.sparkContext._gateway, spark.sparkContext._jvm
    lists = lambda: spark.sparkContext._jsc.sc().statusStore().stageList(jvm.java.util.ArrayList(), False, False, gw.new_array(jvm.double, 0), jvm.java.util.ArrayList())
    shared = Path(shared_dir(spark).removeprefix("file:"))
    at = lambda: (sum((s := x.apply(i)).shuffleWriteBytes() + s.diskBytesSpilled() for x in [lists()] for i in range(x.size())), {p: p.stat().st_size for p in shared.rglob("*") if p.is_file()})
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    n, files = at()
    run()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    m, now = at()
    return m - n + sum(v for p, v in now.items() if p not in files)


def crowded(spark):
    """Sets of one series that all share tokens: pairs of them are many times their text."""
    rnd = random.Random(3)
    texts = [("a", f"v{k % 4}", " ".join(rnd.sample(WORDS, 25))) for k in range(3000)]
    return sum(len(t) for *_, t in texts), spark.createDataFrame(texts, "series string, version string, text string").repartition(4).cache()


def test_turnover_takes_disk_in_proportion_to_the_texts(spark):
    size, texts = crowded(spark)
    texts.count()
    assert disk(spark, lambda: B.turnover(texts).collect()) < 3 * size


@pytest.mark.parametrize("chunk", [B.CHUNK, 9_000])
@pytest.mark.parametrize("theta", [0.8, 0.5])
def test_containment_is_as_by_brute_force(spark, chunk, theta):
    texts = collection(260, True)
    want = {(s, digest(a), digest(b)) for s, a, b in brute(texts, theta)[1]}
    got = [tuple(r) for r in B.contained(spark.createDataFrame(texts, "series string, version string, text string"), theta, chunk=chunk).collect()]
    assert set(got) == want and len(got) == len(want)


def test_containment_takes_disk_in_proportion_to_the_texts(spark):
    size, texts = crowded(spark)
    texts.count()
    assert disk(spark, lambda: B.contained(texts).collect()) < 3 * size
