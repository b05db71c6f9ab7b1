"""Pairs of items in the same record: an incrementally maintained, persistent pair table.

In a folder of the shared file system lie

- the log of changed baskets: each change's item sets beside the sets they replace, so that the
  log adds up to what holds now, whatever part of it is read;
- the marginals (records per item), in hash buckets;
- the tracked items with their ids, and the pairs of tracked items with joint count and
  association ratio n_ab / (n_a * n_b), in hash buckets;
- a manifest of one version a change. A table opened again, by any session, goes on from the
  newest one; a change becomes visible with its manifest, or not at all.

``apply`` takes changed baskets, emits signed deltas of marginals and pairs, merges them into
the buckets they touch, leaves the other buckets' files as they are, and makes the ratios anew of
pairs with a changed count or marginal only. ``scores`` reads the ratios under the present total.

Which pairs are kept is decided exactly, before any pair is formed: with the wanted least
joint count c, least share s and least lift f, a pair (a, b) can only qualify if both items
occur in at least max(c, s*N) and in at most N/f records, as n_ab <= min(n_a, n_b). An item is
tracked from when it is in that band until it leaves a band twice as wide on either side, so
that N's growth moves few items. At most 2 * (mean items a record) / s items are tracked,
however large the collection: that bounds their dictionary, which is broadcast. An item that
is tracked anew gets a new id and is counted from the log; pairs of ids no longer in
use are ignored and go when their bucket is next rewritten.
"""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkscape.llm.terms import terms_of
from sparkscape.session import cut, shared_dir

HELD = 2_000_000  # pair codes a task holds before it sums them
BUCKET_MB = 8  # of input files a bucket, if that makes more buckets than shuffle partitions
ID_BITS = 31
BASKET = "src string, rec_id bigint, items array<string>"
LOGGED = f"{BASKET}, old array<string>, bucket int"
MARGINAL = "src string, item string, n bigint"
TRACKED = "src string, item string, id bigint, n bigint, total bigint"
PAIR = "a bigint, b bigint, n_ab bigint, ratio double"


def none():
    return F.array().cast("array<string>")


def baskets(texts: DataFrame) -> DataFrame:
    """src, rec_id, items: the distinct terms of each text, sorted; empty for null and empty texts."""

    def run(batches):
        for b in batches:
            sets = [sorted(set(terms_of(t))) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(sets, pa.list_(pa.string()))], names=["src", "rec_id", "items"])

    return texts.select("src", "rec_id", "text").mapInArrow(run, BASKET)


class Folder:
    """Small files and listings in a folder of the session's file system."""

    def __init__(self, spark: SparkSession, path: str):
        jvm = spark._jvm
        self.at = jvm.org.apache.hadoop.fs.Path
        self.root = path
        self.fs = self.at(path).getFileSystem(spark._jsc.hadoopConfiguration())
        self.jvm = jvm

    def names(self, path: str) -> list[str]:
        p = self.at(path)
        return sorted(s.getPath().getName() for s in self.fs.listStatus(p)) if self.fs.exists(p) else []

    def read(self, path: str) -> str:
        stream = self.fs.open(self.at(path))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def write_new(self, path: str, text: str) -> None:
        """All of it or nothing; an error if the file is there."""
        draft = self.at(f"{path}.{uuid.uuid4().hex}")
        out = self.fs.create(draft)
        out.write(bytearray(text.encode()))
        out.close()
        if self.fs.exists(self.at(path)) or not self.fs.rename(draft, self.at(path)):
            self.fs.delete(draft, False)
            raise RuntimeError(f"{path} was written by another session")

    def drop(self, path: str) -> None:
        self.fs.delete(self.at(path), True)


def input_buckets(df: DataFrame) -> int:
    """Shuffle partitions, or more by the size of the files read."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    size = sum(int(str(leaves.apply(k).stats().sizeInBytes())) for k in range(leaves.size()))
    wanted = math.ceil(size / 2**20 / BUCKET_MB) if size < 2**50 else 0
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), wanted)


class PairTable:
    """Marginal and pair counts of a collection of baskets, kept up under changes.

    ``path`` names a table to go on with or to begin; its parameters are those it was begun with.
    """

    def __init__(self, spark: SparkSession, least: int = 5, share: int = 500, lift: int = 20, path: str | None = None, buckets: int | None = None):
        self.spark = spark
        self.path = path or f"{shared_dir(spark)}/pairs-{uuid.uuid4().hex}"
        self.folder = Folder(spark, self.path)
        found = [n for n in self.folder.names(f"{self.path}/manifest") if n.endswith(".json")]
        if found:
            self.state = json.loads(self.folder.read(f"{self.path}/manifest/{found[-1]}"))
        else:
            self.state = {"version": 0, "least": least, "share": share, "lift": lift, "buckets": buckets, "next_id": 0, "log": {}, "marginals": {}, "pairs": {}, "tracked": None}
        self.least, self.share, self.lift = (self.state[k] for k in ("least", "share", "lift"))
        self.rewritten: dict[str, list[int]] = {}  # buckets the last change wrote

    # -- files

    def bucket(self, *cols: str):
        return F.pmod(F.xxhash64(*cols), F.lit(self.state["buckets"])).cast("int").alias("bucket")

    def read(self, table: str, schema: str, buckets=None) -> DataFrame:
        """A bucketed table, or given buckets of it, with the bucket."""
        place = self.state[table]
        chosen = [(b, place[b]) for b in place if buckets is None or int(b) in buckets]
        if not chosen:
            return self.spark.createDataFrame([], f"{schema}, bucket int")
        # Folders of one version are read at once; the bucket comes from the folder's name.
        versions: dict[str, list[str]] = {}
        for b, v in chosen:
            versions.setdefault(v, []).append(f"{self.path}/{table}/{v}/bucket={b}")
        parts = [self.spark.read.schema(f"{schema}, bucket int").option("basePath", f"{self.path}/{table}/{v}").parquet(*p) for v, p in versions.items()]
        whole = parts[0]
        for p in parts[1:]:
            whole = whole.unionByName(p)
        return whole

    def write(self, state: dict, table: str, rows: DataFrame, touched) -> None:
        """Rows with their bucket become the whole content of the touched buckets."""
        v = self.put(table, state["version"], rows)
        there = {n.removeprefix("bucket=") for n in self.folder.names(f"{self.path}/{table}/{v}")}
        state[table] = {b: p for b, p in self.state[table].items() if int(b) not in touched} | {b: v for b in map(str, touched) if b in there}
        self.rewritten[table] = sorted(touched)

    def put(self, table: str, version: int, rows: DataFrame) -> str:
        v = f"v{version:06d}-{uuid.uuid4().hex[:8]}"
        rows.repartitionById(self.state["buckets"], F.col("bucket")).write.partitionBy("bucket").parquet(f"{self.path}/{table}/{v}")
        return v

    def commit(self, state: dict) -> None:
        before, self.state = self.state, state
        self.folder.write_new(f"{self.path}/manifest/{state['version']:06d}.json", json.dumps(state))
        # What neither this version nor the one before it names is dropped: results handed out before this change stay readable.
        for table in ("marginals", "pairs"):
            used = set(state[table].values()) | set(before[table].values())
            for v in self.folder.names(f"{self.path}/{table}"):
                if v not in used and int(v[1:7]) <= state["version"]:
                    self.folder.drop(f"{self.path}/{table}/{v}")

    def logged(self, versions) -> DataFrame | None:
        """Segments of the log, each under its version; None for none."""
        whole = None
        for k in versions:
            part = self.spark.read.schema(LOGGED).parquet(f"{self.path}/log/{self.state['log'][k]}").withColumn("segment", F.lit(int(k)))
            whole = part if whole is None else whole.unionByName(part)
        return whole

    # -- changes

    def apply(self, changed: DataFrame) -> None:
        """Merges changed baskets (src, rec_id, items); null or empty items remove the record.

        Each (src, rec_id) may come once; rows with a null in either name no record and are
        dropped. Null and repeated items of a basket are dropped.
        """
        if self.state["buckets"] is None:
            self.state["buckets"] = input_buckets(changed)
        state = json.loads(json.dumps(self.state)) | {"version": self.state["version"] + 1}
        self.rewritten = {}
        rows = self._log(state, changed)
        delta = self._marginal_deltas(rows)
        self._merge_marginals(state, delta)
        marginals = PairTable.read(self._with(state), "marginals", MARGINAL)
        tracked, kept = self._track(state, marginals)
        self._merge_pairs(state, rows, tracked, kept)
        self.commit(state)

    def _with(self, state: dict) -> PairTable:
        t = object.__new__(PairTable)
        t.__dict__ |= self.__dict__ | {"state": state}
        return t

    def _log(self, state: dict, changed: DataFrame) -> DataFrame:
        """Writes the changed baskets beside those they replace; gives them back."""
        new = changed.where("src is not null and rec_id is not null").select("src", "rec_id", F.array_sort(F.array_distinct(F.array_compact(F.coalesce("items", none())))).alias("items"), self.bucket("src", "rec_id"))
        log = self.logged(self.state["log"])
        if log is None:
            rows = new.where("size(items) > 0").withColumn("old", none())
        else:
            new = cut(new)
            touched = [r[0] for r in new.select("bucket").distinct().collect()]
            own = log.where(F.col("bucket").isin(touched)).join(new.select("src", "rec_id"), ["src", "rec_id"], "left_semi")
            last = own.groupBy("src", "rec_id").agg(F.max_by("items", "segment").alias("old"))
            rows = new.join(last, ["src", "rec_id"], "left").withColumn("old", F.coalesce("old", none())).where("items <> old")
        v = self.put("log", state["version"], rows.select("src", "rec_id", "items", "old", "bucket"))
        state["log"][str(state["version"])] = v
        return self.spark.read.schema(LOGGED).parquet(f"{self.path}/log/{v}")

    def _marginal_deltas(self, rows: DataFrame) -> DataFrame:
        """src, item, n, summed in each task; item '' counts the records with items."""

        def run(batches):
            held: list[pa.Table] = []
            size = 0

            def sums() -> pa.Table:
                t = pa.concat_tables(held).group_by(["src", "item"]).aggregate([("n", "sum")]).rename_columns(["src", "item", "n"])
                return t.filter(pc.not_equal(t.column("n"), 0))

            for b in batches:
                src = b.column(0)
                for col, sign in ((b.column(1), 1), (b.column(2), -1)):
                    flat, own = pc.list_flatten(col), src.take(pc.list_parent_indices(col))
                    full = src.filter(pc.greater(pc.list_value_length(col), 0))
                    for s, item in ((own, flat), (full, pa.array([""] * len(full), pa.string()))):
                        if len(s):
                            one = pa.table({"src": s, "item": item, "n": pa.array(np.full(len(s), sign), pa.int64())})
                            held.append(one.group_by(["src", "item"]).aggregate([("n", "sum")]).rename_columns(["src", "item", "n"]))
                            size += held[-1].num_rows
                if size > HELD // 2:
                    held, size = [s := sums()], 0
                    if s.num_rows > HELD // 4:
                        yield from s.combine_chunks().to_batches()
                        held = []
            if held:
                yield from sums().combine_chunks().to_batches()

        return rows.select("src", "items", "old").mapInArrow(run, MARGINAL).withColumn("bucket", self.bucket("src", "item"))

    def _merge_marginals(self, state: dict, delta: DataFrame) -> None:
        if not self.state["marginals"]:
            touched = range(state["buckets"])
        else:
            delta = cut(delta.groupBy("bucket", "src", "item").agg(F.sum("n").alias("n")).where("n <> 0"))
            touched = [r[0] for r in delta.select("bucket").distinct().collect()]
            delta = delta.unionByName(self.read("marginals", MARGINAL, touched))
        merged = delta.repartitionById(state["buckets"], F.col("bucket")).groupBy("bucket", "src", "item").agg(F.sum("n").alias("n")).where("n <> 0")
        self.write(state, "marginals", merged, touched)

    def _track(self, state: dict, marginals: DataFrame) -> tuple[DataFrame, DataFrame]:
        """The items tracked after this change (TRACKED), and those before it."""
        total = marginals.where("item = ''").select("src", F.col("n").alias("total"))
        m = marginals.where("item <> ''").join(F.broadcast(total), "src")  # one row a source
        # The wider band; of what wasn't tracked, the narrow one.
        wide = m.where((2 * F.col("n") >= self.least) & (2 * F.col("n") * self.share >= F.col("total")) & (F.col("n") * self.lift <= 2 * F.col("total")))
        was = self.tracked()
        band = (F.col("n") >= self.least) & (F.col("n") * self.share >= F.col("total")) & (F.col("n") * self.lift <= F.col("total"))
        now = wide.join(was.select("src", "item", "id"), ["src", "item"], "left").where(F.col("id").isNotNull() | band)
        # Numbered in one task: their number is bounded (see above).
        fresh = F.row_number().over(Window.partitionBy(F.col("id").isNull()).orderBy("src", "item")) - 1 + state["next_id"]
        now = now.withColumn("id", F.coalesce("id", fresh.cast("bigint"))).select("src", "item", "id", "n", "total")
        v = f"v{state['version']:06d}-{uuid.uuid4().hex[:8]}"
        now.coalesce(1).write.parquet(f"{self.path}/tracked/{v}")
        state["tracked"] = v
        now = self.spark.read.schema(TRACKED).parquet(f"{self.path}/tracked/{v}")
        state["next_id"] = max(state["next_id"], (now.agg(F.max("id")).first()[0] or 0) + 1)
        if state["next_id"] >= 1 << ID_BITS:
            raise ValueError("the pair table has given out all its item ids; load it anew")
        return now, was

    def _merge_pairs(self, state: dict, rows: DataFrame, tracked: DataFrame, was: DataFrame) -> None:
        first_new = self.state["next_id"]
        entered = tracked.where(F.col("id") >= first_new)
        source = rows.select("src", "items", "old", F.lit(True).alias("whole"))
        before = self.logged(self.state["log"]) if self.state["log"] and entered.take(1) else None
        if before is not None:  # newly tracked items are counted from the whole log
            source = source.unionByName(before.select("src", "items", "old", F.lit(False).alias("whole")))
        delta = self._pair_deltas(source, tracked, first_new).withColumn("bucket", self.bucket("a", "b"))
        if not self.state["pairs"]:
            touched = range(state["buckets"])
        else:
            delta = cut(delta.groupBy("bucket", "a", "b").agg(F.sum("n_ab").alias("n_ab")).where("n_ab <> 0"))
            then = was.select("id", F.col("n").alias("n_then"))
            affected = tracked.join(then, "id").where("n <> n_then").select("id")
            old = self.read("pairs", PAIR)
            marked = old.join(F.broadcast(affected.withColumnRenamed("id", "a")), "a", "left_semi").select("bucket").union(old.join(F.broadcast(affected.withColumnRenamed("id", "b")), "b", "left_semi").select("bucket"))
            touched = [r[0] for r in delta.select("bucket").union(marked).distinct().collect()]
            delta = delta.unionByName(self.read("pairs", PAIR, touched).drop("ratio"))
        merged = delta.repartitionById(state["buckets"], F.col("bucket")).groupBy("bucket", "a", "b").agg(F.sum("n_ab").alias("n_ab")).where("n_ab <> 0")
        # Bounded sides (see above); pairs of ids no longer tracked go.
        a, b = (F.broadcast(tracked.select(F.col("id").alias(x), F.col("n").alias(f"n_{x}"))) for x in "ab")
        scored = merged.join(a, "a").join(b, "b").withColumn("ratio", F.col("n_ab") / (F.col("n_a").cast("double") * F.col("n_b")))
        self.write(state, "pairs", scored.select("a", "b", "n_ab", "ratio", "bucket"), touched)

    def _pair_deltas(self, source: DataFrame, tracked: DataFrame, first_new: int) -> DataFrame:
        """a, b, n_ab: signed counts of pairs of tracked ids (a < b), summed in each task.

        Rows that aren't ``whole`` give only pairs with a newly tracked item.
        """
        sink = pa.BufferOutputStream()
        listed = tracked.select("src", "item", "id").toArrow()
        with pa.ipc.new_stream(sink, listed.schema) as w:
            w.write_table(listed)
        code = self.spark.sparkContext.broadcast(sink.getvalue().to_pybytes())

        def run(batches):
            names = pa.ipc.open_stream(code.value).read_all()
            ids: dict[str, dict[str, int]] = {}
            for s, t, i in zip(*(names.column(k).to_pylist() for k in range(3))):
                ids.setdefault(s, {})[t] = i
            del names
            codes: list[np.ndarray] = []
            signs: list[np.ndarray] = []
            held, kept_code, kept_n = 0, np.empty(0, np.int64), np.empty(0, np.int64)
            corners: dict[int, tuple] = {}

            def strips(k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
                """Index pairs i < j < k, at most about HELD at once."""
                if k <= 512:
                    if k not in corners:
                        corners[k] = np.triu_indices(k, 1)
                    yield corners[k]
                    return
                high = max(1, HELD // k)
                for at in range(0, k - 1, high):
                    i, j = np.nonzero(np.arange(k)[None, :] > np.arange(at, min(k - 1, at + high))[:, None])
                    yield i + at, j

            def fold():
                nonlocal held, kept_code, kept_n
                if codes:
                    kept_code, at = np.unique(np.concatenate([kept_code, *codes]), return_inverse=True)
                    kept_n = np.bincount(at, weights=np.concatenate([kept_n, *signs]), minlength=len(kept_code)).astype(np.int64)
                    codes.clear(), signs.clear()
                    held = 0

            def emit():
                nonlocal kept_code, kept_n
                alive = kept_n != 0
                c = kept_code[alive]
                out = pa.RecordBatch.from_arrays([pa.array(c >> ID_BITS), pa.array(c & ((1 << ID_BITS) - 1)), pa.array(kept_n[alive])], names=["a", "b", "n_ab"])
                kept_code, kept_n = np.empty(0, np.int64), np.empty(0, np.int64)
                return out

            def coded(src: list, col: pa.ListArray) -> Iterator[np.ndarray]:
                """The sorted ids of each row's tracked items; distinct items are looked up once a batch."""
                flat = pc.list_flatten(col).dictionary_encode()
                if isinstance(flat, pa.ChunkedArray):
                    flat = flat.combine_chunks()
                words, at = flat.dictionary.to_pylist(), flat.indices.to_numpy(zero_copy_only=False)
                tables = {s: np.fromiter((ids.get(s, {}).get(t, -1) for t in words), np.int64, len(words)) for s in set(src)}
                ends = np.cumsum(pc.fill_null(pc.list_value_length(col), 0).to_numpy(zero_copy_only=False))
                lo = 0
                for s, hi in zip(src, ends):
                    own = tables[s][at[lo:hi]]
                    own = own[own >= 0]
                    own.sort()
                    yield own
                    lo = hi

            for batch in batches:
                src = batch.column(0).to_pylist()
                for col, sign in ((batch.column(1), 1), (batch.column(2), -1)):
                    for own, whole in zip(coded(src, col), batch.column(3).to_pylist()):
                        if len(own) < 2 or not whole and own[-1] < first_new:
                            continue
                        for i, j in strips(len(own)):
                            c = (own[i] << ID_BITS) | own[j]
                            if not whole:  # ids are sorted, so the second is new if any is
                                c = c[own[j] >= first_new]
                            codes.append(c)
                            signs.append(np.full(len(c), sign, dtype=np.int64))
                            held += len(c)
                            if held > HELD:
                                fold()
                                if len(kept_code) > 2 * HELD:
                                    yield emit()
            fold()
            yield emit()

        return source.mapInArrow(run, "a bigint, b bigint, n_ab bigint")

    # -- results

    def tracked(self) -> DataFrame:
        v = self.state["tracked"]
        return self.spark.read.schema(TRACKED).parquet(f"{self.path}/tracked/{v}") if v else self.spark.createDataFrame([], TRACKED)

    def totals(self) -> DataFrame:
        """src, total: records with at least one item."""
        return self.read("marginals", MARGINAL).where("item = ''").select("src", F.col("n").alias("total"))

    def scores(self) -> DataFrame:
        """src, term_a, term_b, n_a, n_b, n_ab, total, lift of the pairs that qualify."""
        t = self.tracked()
        a = F.broadcast(t.select(F.col("id").alias("a"), "src", F.col("item").alias("ta"), F.col("n").alias("na"), "total"))
        b = F.broadcast(t.select(F.col("id").alias("b"), F.col("item").alias("tb"), F.col("n").alias("nb")))
        pairs = self.read("pairs", PAIR).where(F.col("n_ab") >= self.least).join(a, "a").join(b, "b").where(F.col("n_ab") * self.share >= F.col("total"))
        big = F.col("n_ab").cast("decimal(38,0)") * F.col("total") >= F.lit(self.lift).cast("decimal(18,0)") * F.col("na").cast("decimal(18,0)") * F.col("nb")
        turned = F.col("ta") > F.col("tb")
        either = lambda x, y: F.when(turned, F.col(y)).otherwise(F.col(x))
        lift = F.col("n_ab") * F.col("total") / (F.col("na").cast("double") * F.col("nb"))
        near = F.col("ratio") * F.col("total") >= self.lift * (1 - 1e-9)  # the exact test is for these alone
        return pairs.where(near & big).select("src", F.least("ta", "tb").alias("term_a"), F.greatest("ta", "tb").alias("term_b"), either("na", "nb").alias("n_a"), either("nb", "na").alias("n_b"), "n_ab", "total", lift.alias("lift"))


def after(changes: list[DataFrame], least: int = 5, share: int = 500, lift: int = 20) -> DataFrame:
    """Scores of the term pairs of a collection after changes (src, rec_id, text), loaded one after the other.

    Wanted are pairs with n_ab >= least, n_ab * share >= N and n_ab * N >= lift * n_a * n_b.
    Null and empty texts are no records. Empty input gives no rows.
    """
    t = PairTable(changes[0].sparkSession, least, share, lift)
    for texts in changes:
        t.apply(baskets(texts))
    return t.scores()


def together(texts: DataFrame, least: int = 5, share: int = 500, lift: int = 20) -> DataFrame:
    """The scores of a collection loaded as one change."""
    return after([texts], least, share, lift)


def in_two_steps(texts: DataFrame, least: int = 5, share: int = 500, lift: int = 20) -> DataFrame:
    """The same scores after two changes (even, then odd rec_id): all rows are used."""
    return after([texts.where("pmod(rec_id, 2) = 0"), texts.where("pmod(rec_id, 2) <> 0")], least, share, lift)


def deliveries(documents: DataFrame, trajectory: DataFrame, first: float = 0.9) -> list[DataFrame]:
    """Both sources as two changes in the order they came in: what arrived by the time when the given
    share of the documents had, then the rest, with records delivered again in their last form.

    What has no time of arrival is in the first change; rows without an id are dropped.
    """
    by = documents.agg(F.percentile_approx("loaded_at", first, 1000).alias("by")).first().by
    late = lambda c: F.coalesce(F.col(c) > F.lit(by), F.lit(False)) if by is not None else F.lit(False)
    docs = documents.select(F.lit("documents").alias("src"), F.col("doc_id").alias("rec_id"), "text", late("loaded_at").alias("late"))
    each = F.struct("received_at", "text")
    t = trajectory.where("rec_id is not null").groupBy("rec_id").agg(F.max(F.when(~late("received_at"), each)).alias("one"), F.max(each).alias("last"))
    name = F.lit("monitor_trajectory").alias("src")
    early = docs.where("not late").drop("late").unionByName(t.where("one is not null").select(name, "rec_id", F.col("one.text").alias("text")))
    return [early, docs.where("late").drop("late").unionByName(t.where(late("last.received_at")).select(name, "rec_id", F.col("last.text").alias("text")))]
