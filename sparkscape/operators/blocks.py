"""Blocks of texts and which of them another state of the collection contains.

A block is contained in another of its series if that has at least a share theta of its
distinct tokens. Equal token sets are one row with the versions they occur in, so copies cost
nothing.

The sets of a series are dealt into chunks; a task holds the index of one chunk and streams
every set of the series past it. Shared tokens are counted exactly, a byte for each set of the
chunk: rare tokens by their lists of sets, then frequent ones by adding dense rows, the rarest first,
until few sets can still have enough; bit masks of the frequent tokens decide those. Pairs of sets
exist only inside the task and leave it as results, so what is shuffled are the sets, as many
times as their series has chunks, and nothing is kept on disk besides.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkscape.functions import text as T
from sparkscape.session import cut

# Characters of text whose sets make one chunk.
CHUNK = 24_000_000
# A token that more than one in so many sets of a chunk hold has a dense row.
DENSE = 32
# Frequent tokens are added so many at a time, until at most one set in FEW is left to look at singly.
STEP, FEW = 6, 512
# Pairs that a task holds before it hands them on.
PAIRS = 20_000


def sets(texts: DataFrame, least: int = 5) -> DataFrame:
    """series, h, tokens, own: the distinct token sets of blocks (parted by blank lines) of at least ``least`` tokens.

    h is binary, tokens are joined by line feeds, own are the versions that have the block.
    Texts are rows (series, version, text); null series, versions and texts have none."""
    b = texts.where("series is not null and version is not null and text is not null").select("series", "version", F.explode(F.split("text", r"\n\s*\n")).alias("block"))
    t = b.select("series", "version", F.array_distinct(T.tokens(F.col("block"))).alias("t")).where(F.size("t") >= least)
    t = t.select("series", "version", F.array_join(F.array_sort("t"), "\n").alias("tokens"))
    return t.withColumn("h", F.unhex(F.sha2("tokens", 256))).groupBy("series", "h").agg(F.first("tokens").alias("tokens"), F.collect_set("version").alias("own"))


class Index:
    """The sets of one chunk by their tokens."""

    def __init__(self, rows: pa.Table, theta: float):
        self.theta, self.rows, self.n = theta, rows, rows.num_rows
        words = pc.split_pattern(rows["tokens"].combine_chunks(), "\n")
        coded = words.flatten().dictionary_encode()
        self.words, ids = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False)
        df = np.bincount(ids, minlength=len(self.words))
        self.lists = np.repeat(np.arange(self.n, dtype=np.int32), np.diff(words.offsets.to_numpy()))[np.argsort(ids, kind="stable")]
        self.ends = np.cumsum(df)
        self.starts = self.ends - df
        often = np.flatnonzero(df * DENSE > self.n)
        often = often[np.argsort(df[often], kind="stable")]  # the rarest first
        self.row = np.full(len(self.words), -1, np.int32)
        self.row[often] = np.arange(len(often))
        self.room = -(-self.n // 8) * 8
        self.dense = np.zeros((len(often), self.room), np.uint8)
        self.bits = np.zeros((self.n, len(often) // 64 + 1), np.uint64)
        for k, w in enumerate(often):
            own = self.lists[self.starts[w] : self.ends[w]]
            self.dense[k, own] = 1
            self.bits[own, k >> 6] |= np.uint64(1 << (k & 63))

    def holders(self, rows: pa.Table, own: bool) -> Iterator[tuple[int, np.ndarray]]:
        """Each set of ``rows`` that others of the chunk contain, and these; own: the rows are the chunk's."""
        words = pc.split_pattern(rows["tokens"].combine_chunks(), "\n")
        offsets = words.offsets.to_numpy()
        ids = pc.fill_null(pc.index_in(words.flatten(), value_set=self.words), -1).to_numpy(zero_copy_only=False)
        size = np.diff(offsets)
        need = np.maximum(1, np.ceil(self.theta * size - 1e-9)).astype(np.int64)
        dense = np.where(ids >= 0, self.row[ids], -1)
        sparse = (ids >= 0) & (dense < 0)
        until = lambda which: np.concatenate([[0], np.cumsum(which)])[offsets].tolist()
        at_s, at_d, d = until(sparse), until(dense >= 0), dense[dense >= 0]
        probe = np.repeat(np.arange(len(size)), size)[dense >= 0]
        d = d[np.lexsort((d, probe))]
        masks = np.zeros((len(size), self.bits.shape[1]), np.uint64)
        np.bitwise_or.at(masks, (probe, d >> 6), np.uint64(1) << (d & 63).astype(np.uint64))
        starts, ends = self.starts[ids[sparse]].tolist(), self.ends[ids[sparse]].tolist()
        counts = {False: np.zeros(self.room, np.uint8), True: np.zeros(self.room, np.uint16)}
        for i, (least, large) in enumerate(zip(need.tolist(), (size > 255).tolist(), strict=True)):
            s0, s1, left = at_s[i], at_s[i + 1], d[at_d[i] : at_d[i + 1]]
            if least > s1 - s0 + len(left):
                continue
            n = counts[large]
            n.fill(0)
            if s1 > s0:
                lists = [self.lists[a:b] for a, b in zip(starts[s0:s1], ends[s0:s1], strict=True)]
                np.add.at(n, np.concatenate(lists), n.dtype.type(1))
            step = max(0, len(left) - least + STEP)  # then a result has so many of the tokens counted so far
            while True:
                for r in left[:step].tolist():
                    np.add(n, self.dense[r], out=n)
                left, step = left[step:], STEP
                flags = n >= least - len(left)
                if not len(left) or np.count_nonzero(flags) * FEW <= self.n:
                    break
            found = where(flags)
            if own:
                found = found[found != i]
            if len(found) and len(left):
                mask, w = masks[i], int(left[0]) >> 6
                mask[:w] = 0
                mask[w] &= FULL << np.uint64(left[0] & 63)  # what is left, as rows go by rarity
                found = found[n[found] + np.bitwise_count(self.bits[found] & mask).sum(1, dtype=np.int64) >= least]
            if len(found):
                yield i, found


EIGHT, FULL = np.arange(8), np.uint64(2**64 - 1)


def where(flags: np.ndarray) -> np.ndarray:
    """Places of those that are set, by eights; there are as many flags as a multiple of eight."""
    at = np.flatnonzero(flags.view(np.uint64) != 0)
    at = (at[:, None] * 8 + EIGHT).ravel()
    return at[flags[at]]


def _hex(h: pa.Array) -> pa.Array:
    text = b"".join(h.to_pylist()).hex().encode()
    return pa.StringArray.from_buffers(len(h), pa.py_buffer(np.arange(0, len(text) + 1, 64, dtype=np.int32)), pa.py_buffer(text))


class Pairs:
    """Results as rows series, h, other."""

    schema = "series string, h string, other string"

    def __init__(self, index: Index):
        self.other = _hex(index.rows["h"].combine_chunks())

    def rows(self, probes: pa.Table, held: Iterator[tuple[int, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        h = _hex(probes["h"].combine_chunks())
        for a, b in gathered(held):
            yield pa.RecordBatch.from_arrays([pa.repeat(probes["series"][0], len(a)), h.take(pa.array(a)), self.other.take(pa.array(b))], ["series", "h", "other"])


class Versions:
    """Results as rows series, h, own, more: every set once with its chunk, and wherever others contain it, with their versions."""

    schema = "series string, h binary, own array<string>, more array<string>"

    def __init__(self, index: Index):
        own = index.rows["own"].combine_chunks()
        coded = own.flatten().dictionary_encode()
        self.names, self.ids, offsets = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), own.offsets.to_numpy()
        self.starts, self.sizes, self.index = offsets[:-1] - offsets[0], np.diff(offsets), index

    def rows(self, probes: pa.Table, held: Iterator[tuple[int, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        v, found = max(1, len(self.names)), [np.zeros(0, np.int64)]
        for a, b in gathered(held):
            size = self.sizes[b]
            ids = self.ids[np.repeat(self.starts[b] - np.cumsum(size) + size, size) + np.arange(size.sum())]
            found.append(np.unique(np.repeat(a, size) * v + ids))
        key = np.unique(np.concatenate(found))
        n = np.bincount(key // v, minlength=probes.num_rows)
        more = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), self.names.take(pa.array(key % v)))
        t = pa.table([probes["series"], probes["h"], probes["own"], more], ["series", "h", "own", "more"])
        if probes is not self.index.rows:
            t = t.filter(pa.array(n > 0))
        yield from t.combine_chunks().to_batches()


def gathered(held: Iterator[tuple[int, np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs as two arrays, some PAIRS at a time."""
    a, b, n = [], [], 0
    for i, found in held:
        a.append(i)
        b.append(found)
        n += len(found)
        if n >= PAIRS:
            yield np.repeat(np.array(a, np.int64), [len(x) for x in b]), np.concatenate(b)
            a, b, n = [], [], 0
    if a:
        yield np.repeat(np.array(a, np.int64), [len(x) for x in b]), np.concatenate(b)


def held(texts: DataFrame, theta: float, least: int, chunk: int, result: type) -> DataFrame:
    """``result`` of all sets against all chunks of their series."""
    length = texts.where("series is not null").groupBy("series").agg(F.sum(F.length("text")).alias("n"))
    # Only series of several chunks: no more rows than the collection has chunks.
    large = F.broadcast(length.where(F.col("n") > chunk).select("series", F.ceil(F.col("n") / chunk).cast("int").alias("chunks")))
    s = sets(texts, least).join(large, "series", "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    s = s.withColumn("place", F.pmod(F.xxhash64("h"), F.col("chunks")).cast("int")).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    dealt = s.select("series", "chunk", (F.col("chunk") != F.col("place")).alias("guest"), "h", "tokens", "own")

    def run(batches):
        key, own, index, out = None, [], None, None

        def ready():
            nonlocal index, out
            if index is None and own:
                rows = pa.Table.from_batches(own).combine_chunks()
                index = Index(rows, theta)
                out = result(index)
                yield from out.rows(rows, index.holders(rows, True))

        for batch in batches:
            series, chunks = batch["series"].to_pylist(), batch["chunk"].to_numpy()
            guest = batch["guest"].to_numpy(zero_copy_only=False)
            at = 0
            while at < batch.num_rows:
                now = (series[at], chunks[at], guest[at])
                end = at + 1
                while end < batch.num_rows and (series[end], chunks[end], guest[end]) == now:
                    end += 1
                if now[:2] != key:
                    yield from ready()
                    key, own, index, out = now[:2], [], None, None
                part, at = batch.slice(at, end - at), end
                if not now[2]:
                    own.append(part)
                    continue
                yield from ready()
                if index is not None:
                    rows = pa.Table.from_batches([part])
                    yield from out.rows(rows, index.holders(rows, False))
        yield from ready()

    return dealt.repartition("series", "chunk").sortWithinPartitions("series", "chunk", "guest").mapInArrow(run, result.schema)


def contained(texts: DataFrame, theta: float = 0.8, least: int = 5, chunk: int = CHUNK) -> DataFrame:
    """series, h, other: token sets and the other sets of their series that contain them."""
    return held(texts, theta, least, chunk, Pairs)


def turnover(texts: DataFrame, theta: float = 0.8, least: int = 5, chunk: int = CHUNK) -> DataFrame:
    """series, version, next, n_from, n_to, leaves, never_back, arrives, returns: distinct blocks from each version of a series to the one after it.

    A block leaves if nothing in the next version contains it (never_back: nor in a later one), arrives if nothing in the
    version before contains it; of these it returns if a still earlier version does."""
    sets = held(texts, theta, least, chunk, Versions).groupBy("series", "h").agg(F.array_sort(F.first("own")).alias("own"), F.flatten(F.collect_list("more")).alias("more"))
    # Blocks of the same versions count together.
    seen = cut(sets.select("series", "own", F.array_sort(F.array_union("own", "more")).alias("seen")).groupBy("series", "own", "seen").agg(F.count("*").alias("n")))
    steps = seen.select("series", F.explode("own").alias("version")).distinct().groupBy("series").agg(F.array_sort(F.collect_set("version")).alias("v"))
    steps = steps.select("series", F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.size("v") - 1, F.lit(1))), lambda i: F.struct(F.get("v", i - 1).alias("version"), F.get("v", i).alias("next")))).alias("s")).select("series", "s.*").where("next is not null")
    j = seen.join(steps, "series")
    has = lambda c, v: F.array_contains(c, F.col(v))
    count = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0))
    leaves, arrives = has("own", "version") & ~has("seen", "next"), has("own", "next") & ~has("seen", "version")
    later, earlier = F.exists("seen", lambda x: x > F.col("next")), F.exists("seen", lambda x: x < F.col("version"))
    return j.groupBy("series", "version", "next").agg(
        count(has("own", "version")).alias("n_from"), count(has("own", "next")).alias("n_to"), count(leaves).alias("leaves"), count(leaves & ~later).alias("never_back"),
        count(arrives).alias("arrives"), count(arrives & earlier).alias("returns"),
    )
