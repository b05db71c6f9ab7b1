"""Items of varying length into containers of fixed capacity.

Pattern packing: lengths are counted (a histogram of at most ``capacity`` bars); patterns of
up to three documents that fill a container exactly are enumerated; how often each is used
is fitted to the histogram by non-negative least squares and rounded down to what is there;
what is left is packed by length, longest first, each container then filled with the longest
that still fits. All of this looks at the histogram only, so its time and size depend on the
capacity, not on the number of documents.

Documents then get a number among those of their length, and the plan tells from length and
number which container that is.
"""

from __future__ import annotations

from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkscape.llm import bpe
from sparkscape.session import cut

CAPACITY = 2048
PATTERNS = 20_000  # patterns fitted, those with the most documents; the rest is left to the residual packing
SWEEPS = 30
GROUP = 200_000  # documents of a length numbered in one task


def few_document_patterns(hist: np.ndarray, capacity: int, most: int = PATTERNS) -> list[tuple[int, ...]]:
    """Patterns of one to three lengths that sum to the capacity, the ``most`` that could fill the most containers.

    All are enumerated, about capacity ** 2 / 12 of them."""
    there = np.flatnonzero(hist[: capacity + 1])
    there = there[there > 0]
    found = [np.array([[capacity, 0, 0]])] if hist[capacity] else []
    for a in map(int, there):  # a >= b >= c
        gap = capacity - a
        if a >= gap > 0 and hist[gap]:
            found.append(np.array([[a, gap, 0]]))
        b = np.arange(max(1, (gap + 1) // 2), min(a, gap - 1) + 1)
        b = b[(hist[b] > 0) & (hist[gap - b] > 0)]
        found.append(np.stack([np.full(len(b), a), b, gap - b], axis=1))
    if not found:
        return []
    p = np.concatenate(found)
    # How many containers the scarcest length allows, its repeats within the pattern counted.
    times = (p[:, :, None] == p[:, None, :]).sum(axis=2)
    have = np.where(p > 0, np.concatenate([[np.iinfo(np.int64).max], hist[1:]])[p] / times, np.inf).min(axis=1)
    order = np.lexsort((p[:, 2], p[:, 1], p[:, 0], -have))[:most]
    return [tuple(int(n) for n in row if n) for row in p[order]]


def fit(hist: np.ndarray, patterns: list[tuple[int, ...]], sweeps: int = SWEEPS) -> list[float]:
    """Repeat counts x >= 0 that minimize |A x - hist|^2, by cyclic coordinate descent."""
    rest = hist.astype(float).tolist()
    columns = [[(n, p.count(n)) for n in dict.fromkeys(p)] for p in patterns]
    norms = [sum(m * m for _, m in c) for c in columns]
    x = [0.0] * len(patterns)
    for _ in range(sweeps):
        moved = 0.0
        for j, c in enumerate(columns):
            step = 0.0
            for n, m in c:
                step += rest[n] * m
            step = max(step / norms[j], -x[j])
            if step:
                x[j] += step
                moved = max(moved, abs(step))
                for n, m in c:
                    rest[n] -= step * m
        if moved < 0.01:
            break
    return x


def plan(hist: np.ndarray, capacity: int) -> list[tuple[dict[int, int], int]]:
    """(lengths with multiplicity, repeats) that use up the histogram exactly."""
    left = hist.astype(np.int64).tolist()
    out: list[tuple[dict[int, int], int]] = []

    def use(pattern: dict[int, int], times: int) -> None:
        out.append((pattern, times))
        for n, m in pattern.items():
            left[n] -= m * times

    patterns = few_document_patterns(hist, capacity)
    x = fit(hist, patterns)
    for j in sorted(range(len(patterns)), key=lambda j: -x[j]):
        pattern = {n: patterns[j].count(n) for n in patterns[j]}
        times = min(int(x[j] + 0.5), *(left[n] // m for n, m in pattern.items()))
        if times > 0:
            use(pattern, times)
    there = [n for n in range(1, capacity + 1) if left[n]]
    while there:
        pattern: dict[int, int] = {}
        room, k = capacity, len(there)
        while room > 0 and (k := min(k, bisect_right(there, room))) > 0:
            n = there[k - 1]
            m = min(room // n, left[n])
            pattern[n] = m
            room -= n * m
            k -= 1
        use(pattern, min(left[n] // m for n, m in pattern.items()))
        there = [n for n in there if left[n]] if any(not left[n] for n in pattern) else there
    return out


class Slots:
    """Where the k-th item of a length goes."""

    def __init__(self, planned: list[tuple[dict[int, int], int]]):
        rows: dict[int, list[tuple[int, int, int]]] = {}
        ends: dict[int, int] = {}
        self.containers = 0
        for pattern, times in planned:
            for n, m in pattern.items():
                at = ends.get(n, 0)
                rows.setdefault(n, []).append((at, self.containers, m))
                ends[n] = at + times * m
            self.containers += times
        self.rows = {n: tuple(np.array(c, dtype=np.int64) for c in zip(*r)) for n, r in rows.items()}

    def containers_of(self, lengths: np.ndarray, numbers: np.ndarray) -> np.ndarray:
        out = np.empty(len(lengths), dtype=np.int64)
        for n in np.unique(lengths):
            own = lengths == n
            starts, bases, multiples = self.rows[int(n)]
            k = np.searchsorted(starts, numbers[own], side="right") - 1
            out[own] = bases[k] + (numbers[own] - starts[k]) // multiples[k]
        return out


def parts(lengths: DataFrame, capacity: int) -> DataFrame:
    """doc_id, first, last, size: each document of at most the capacity whole, a longer one in runs of it.

    Documents without tokens are no items. ``last`` is exclusive.
    """
    n, k = F.col("n_tokens"), F.explode(F.sequence(F.lit(0), F.floor((F.col("n_tokens") - 1) / capacity).cast("int"))).alias("k")
    cutup = lengths.where("n_tokens > 0").select("doc_id", "n_tokens", k)
    first = (F.col("k") * capacity).cast("int")
    last = F.least(first + capacity, n).cast("int")
    return cutup.select("doc_id", first.alias("first"), last.alias("last"), (last - first).alias("size"))


def pack(lengths: DataFrame, capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """container_id, n_tokens, n_items, items [(doc_id, first, last)] from doc_id, n_tokens rows.

    Repeated doc_ids are items of their own. A document is split only if it alone exceeds
    the capacity. Empty input gives no rows.
    """
    items = cut(parts(lengths, capacity))
    bars = items.groupBy("size").count().collect()  # at most ``capacity`` rows
    hist = np.zeros(capacity + 1, dtype=np.int64)
    for r in bars:
        hist[r[0]] = r[1]
    slots = items.sparkSession.sparkContext.broadcast(Slots(plan(hist, capacity)))
    # A length may hold a third of all items: numbers are given by length and salt.
    salts = int(hist.max() // group) + 1
    salted = items.withColumn("salt", F.pmod(F.xxhash64("doc_id", "first"), F.lit(salts)).cast("int"))
    counts = salted.groupBy("size", "salt").agg(F.count("*").alias("n"))
    before = counts.select("size", "salt", (F.sum("n").over(Window.partitionBy("size").orderBy("salt")) - F.col("n")).alias("before"))
    rank = F.row_number().over(Window.partitionBy("size", "salt").orderBy("doc_id", "first"))
    numbered = salted.join(before, ["size", "salt"]).select("doc_id", "first", "last", "size", (F.col("before") + rank - 1).alias("number"))

    def run(batches):
        for b in batches:
            at = slots.value.containers_of(b.column("size").to_numpy(), b.column("number").to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(at), *(b.column(c) for c in ("doc_id", "first", "last"))], names=["container_id", "doc_id", "first", "last"])

    placed = numbered.mapInArrow(run, "container_id bigint, doc_id bigint, first int, last int")
    listed = F.array_sort(F.collect_list(F.struct("doc_id", "first", "last")))
    return placed.groupBy("container_id").agg(F.sum(F.col("last") - F.col("first")).alias("n_tokens"), F.count("*").alias("n_items"), listed.alias("items"))


def containers(documents: DataFrame, capacity: int = CAPACITY, vocabulary: str = bpe.VOCABULARY) -> DataFrame:
    """``pack`` of the documents' texts, measured in tokens of the vocabulary."""
    return pack(bpe.lengths(documents, vocabulary), capacity)


def summary(documents: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """n_containers, n_tokens, least (containers that any packing needs), fill."""
    c = containers(documents, capacity).agg(F.count("*").alias("n_containers"), F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("n_tokens"))
    return c.select("n_containers", "n_tokens", F.ceil(F.col("n_tokens") / capacity).alias("least"), F.expr(f"try_divide(n_tokens, n_containers * {capacity})").alias("fill"))


def checked(documents: DataFrame, capacity: int = CAPACITY, vocabulary: str = bpe.VOCABULARY) -> DataFrame:
    """One row of what must hold: lost and doubled token ranges, containers over the capacity, documents split though they
    fit, sums that aren't those of the items, and whether there are at most 1 % more containers than any packing needs."""
    n = cut(bpe.lengths(documents, vocabulary))
    c = cut(pack(n, capacity))
    items = c.select("container_id", "n_tokens", F.explode("items").alias("x")).select("container_id", "x.*")
    by_doc = items.groupBy("doc_id").agg(F.sum(F.col("last") - F.col("first")).alias("taken"), F.count("*").alias("parts"), F.count_distinct("first").alias("firsts"), F.max("last").alias("end"))
    j = n.where("n_tokens > 0").groupBy("doc_id").agg(F.sum("n_tokens").alias("whole"), F.count("*").alias("rows"), F.max("n_tokens").alias("most")).join(by_doc, "doc_id", "full")
    docs = j.agg(
        F.count_if(F.coalesce(F.col("taken"), F.lit(0)) < F.coalesce(F.col("whole"), F.lit(0))).alias("lost"),
        F.count_if((F.coalesce(F.col("taken"), F.lit(0)) > F.coalesce(F.col("whole"), F.lit(0))) | ((F.col("rows") == 1) & (F.col("firsts") < F.col("parts")))).alias("doubled"),
        F.count_if((F.col("most") <= capacity) & (F.col("parts") > F.col("rows"))).alias("split"),
    )
    sums = c.select("n_tokens", F.aggregate("items", F.lit(0).cast("bigint"), lambda a, x: a + x["last"] - x["first"]).alias("own"))
    total = sums.agg(F.count_if(F.col("own") > capacity).alias("over"), F.count_if(F.col("own") != F.col("n_tokens")).alias("wrong_sum"), (F.count("*") * 100 <= F.ceil(F.coalesce(F.sum("own"), F.lit(0)) / capacity) * 101).alias("near_least"))
    return docs.crossJoin(total)  # one row each
