"""Occurrences and records of every distinct term, by recursive radix partitioning.

1. Texts are cut into terms in Arrow batches; each task keeps one counter and sends
   only its totals, so a term that a third of all rows share costs one row a task.
2. Totals are partitioned by the top bits of the term's hash (one shuffle).
3. Each partition is aggregated by DuckDB. A partition larger than ``budget`` rows is
   spilled to the shared folder by the next hash bits; parts still too large are
   split again, and those that fit are streamed from their file through DuckDB, which may
   itself put what it holds into the shared folder.

Definition of a term: the text in NFC, lower-cased, then each longest run of at least
three letters (Unicode category L) and underscores.
"""

from __future__ import annotations

import unicodedata
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkscape.session import cut, shared_dir

TERM = regex.compile(r"[\p{L}_]{3,}")
FLUSH = 200_000  # distinct terms a task holds before it sends totals
BUDGET = 500_000  # rows DuckDB aggregates at once
DIGIT = 4  # hash bits per recursive split
PART = pa.schema([("src", pa.string()), ("term", pa.string()), ("tf", pa.int64()), ("df", pa.int64()), ("h", pa.int64())])
TOTAL = pa.schema(list(PART)[:4])


def terms_of(text: str | None) -> list[str]:
    """The terms of a text in order, repeats included; none for null and empty texts."""
    return TERM.findall(unicodedata.normalize("NFC", text).lower()) if text else []


def latest(trajectory: DataFrame) -> DataFrame:
    """src, rec_id, text of monitor records; of one delivered twice, the later delivery.

    Only the three columns are read. Rows without rec_id are dropped: they name no record.
    """
    last = trajectory.where("rec_id is not null").groupBy("rec_id").agg(F.max(F.struct("received_at", "text"))["text"].alias("text"))
    return last.select(F.lit("monitor_trajectory").alias("src"), "rec_id", "text")


def records(documents: DataFrame, trajectory: DataFrame) -> DataFrame:
    """src, rec_id, text of both sources."""
    docs = documents.select(F.lit("documents").alias("src"), F.col("doc_id").alias("rec_id"), "text")
    return docs.unionByName(latest(trajectory))


def task_totals(texts: DataFrame) -> DataFrame:
    """src, term, tf, df, h of each task; term '' counts the records with at least one term."""

    def run(batches):
        tf: dict[str, Counter] = {}
        df: dict[str, Counter] = {}

        def flush():
            rows = [(s, t, n, df[s][t], xxhash.xxh3_64_intdigest(f"{s}\0{t}") - (1 << 63)) for s in tf for t, n in tf[s].items()]
            tf.clear(), df.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [()] * 5, PART)], schema=PART)

        for batch in batches:
            for s, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = terms_of(text)
                if found:
                    if s not in tf:
                        tf[s], df[s] = Counter(), Counter()
                    tf[s].update(found)
                    df[s].update(set(found))
                    tf[s][""] += 1
                    df[s][""] += 1
            if sum(map(len, tf.values())) > FLUSH:
                yield flush()
        yield flush()

    return texts.select("src", "text").mapInArrow(run, "src string, term string, tf bigint, df bigint, h bigint")


class RadixAggregator:
    """Sums rows of PART by (src, term) within bounded memory.

    Rows wait in memory up to ``budget``; then they go to 2**DIGIT spill files by the hash
    bits after the first ``used``, in a folder of the shared file system that ends with the task.
    """

    def __init__(self, folder: str, budget: int = BUDGET, used: int = 0):
        self.folder, self.budget, self.used = folder, budget, used
        self.held: list[pa.RecordBatch] = []
        self.rows = 0
        self.spills: list = []
        self.sizes = [0] * (1 << DIGIT)
        self.made = ""
        self.depth = 0

    def add(self, batch: pa.RecordBatch) -> None:
        self.held.append(batch)
        self.rows += batch.num_rows
        if self.rows > self.budget:
            self.compact()
            if self.rows > self.budget // 2:
                self.spill()

    def compact(self) -> None:
        """Repeated terms among the held rows are summed before anything goes to disk."""
        self.held = self.sums(self.held, keep_hash=True).to_batches()
        self.rows = sum(b.num_rows for b in self.held)

    def open(self) -> None:
        self.fs, base = pafs.FileSystem.from_uri(self.folder) if "://" in self.folder or self.folder.startswith("file:") else (pafs.LocalFileSystem(), self.folder)
        self.made = f"{base}/radix-{uuid.uuid4().hex}"
        self.fs.create_dir(self.made, recursive=True)

    def spill(self) -> None:
        if not self.spills:
            self.open()
            self.spills = [pa.ipc.new_file(self.fs.open_output_stream(f"{self.made}/{k}"), PART) for k in range(1 << DIGIT)]
        shift = np.uint64(64 - self.used - DIGIT)
        for table in self.held:
            digits = ((table.column("h").to_numpy().view(np.uint64) >> shift) & np.uint64((1 << DIGIT) - 1)).astype(np.int8)
            order = np.argsort(digits, kind="stable")
            sorted_, ends = table.take(pa.array(order)), np.cumsum(np.bincount(digits, minlength=1 << DIGIT))
            for k, end in enumerate(ends):
                start = ends[k - 1] if k else 0
                if end > start:
                    self.spills[k].write(sorted_.slice(start, end - start))
                    self.sizes[k] += int(end - start)
        self.held, self.rows = [], 0

    def sums(self, batches, keep_hash: bool = False) -> pa.Table:
        """Rows, given as batches in memory or one by one, summed by DuckDB."""
        import duckdb

        held = pa.RecordBatchReader.from_batches(PART, iter(batches))
        # Spilling of its own goes to the shared folder where that is a local path; elsewhere DuckDB keeps to memory, which the budget bounds.
        own = f"{self.made}/duckdb" if self.made and isinstance(self.fs, pafs.LocalFileSystem) else ""
        with duckdb.connect(config={"threads": 1, "memory_limit": "300MB", "temp_directory": own}) as con:
            con.register("held", held)
            got = con.sql(f"select src, term, sum(tf)::bigint as tf, sum(df)::bigint as df{', any_value(h) as h' if keep_hash else ''} from held group by src, term").to_arrow_table()
        return got.cast(PART if keep_hash else TOTAL)

    def finish(self) -> Iterator[pa.RecordBatch]:
        try:
            if not self.spills:
                if self.rows:
                    yield from self.sums(self.held).combine_chunks().to_batches()
                return
            self.spill()
            for w in self.spills:
                w.close()
            used = self.used + DIGIT
            for k, size in enumerate(self.sizes):
                with self.fs.open_input_file(f"{self.made}/{k}") as f, pa.ipc.open_file(f) as r:
                    rows = (r.get_batch(i) for i in range(r.num_record_batches))
                    if size <= self.budget or used + DIGIT > 64:  # fits, or equal hashes throughout
                        self.depth = max(self.depth, 1)
                        if size:
                            yield from self.sums(rows).combine_chunks().to_batches()
                        continue
                    part = RadixAggregator(self.folder, self.budget, used)
                    try:
                        for batch in rows:
                            part.add(batch)
                        yield from part.finish()
                    finally:
                        part.close()
                    self.depth = max(self.depth, 1 + part.depth)
        finally:
            self.close()

    def close(self) -> None:
        if self.made:
            self.fs.delete_dir(self.made)
            self.made = ""


def aggregate(totals: DataFrame, budget: int | None = None) -> DataFrame:
    """src, term, tf, df over all tasks; ``totals`` as ``task_totals`` gives them."""
    spark = totals.sparkSession
    folder, budget = shared_dir(spark), BUDGET if budget is None else budget
    bits = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) - 1).bit_length()
    radix = F.shiftrightunsigned("h", 64 - bits).cast("int")

    def run(batches):
        own = RadixAggregator(folder, budget, bits)
        try:
            for batch in batches:
                own.add(batch.cast(PART) if batch.schema != PART else batch)
            yield from own.finish()
        finally:
            own.close()

    return totals.repartitionById(1 << bits, radix).mapInArrow(run, "src string, term string, tf bigint, df bigint")


def frequencies(texts: DataFrame, rare: int = 2, common: int = 10, budget: int | None = None) -> DataFrame:
    """src, term, occurrences, records, is_rare, is_common of every term.

    Rare: in at most ``rare`` records; common: in more than 1/``common`` of the records of
    its src that have a term. Both can hold in a very small src. Null, empty and blank texts
    have no terms; repeated texts count each time, as they are different records.
    """
    counts = cut(aggregate(task_totals(texts), budget))
    n = counts.where("term = ''").select("src", F.col("df").alias("n"))
    # One row a source: the broadcast side is bounded by the number of sources.
    return counts.where("term <> ''").join(F.broadcast(n), "src").select("src", "term", F.col("tf").alias("occurrences"), F.col("df").alias("records"), (F.col("df") <= rare).alias("is_rare"), (F.col("df") * common > F.col("n")).alias("is_common"))


def marked(texts: DataFrame) -> DataFrame:
    """src, term, mark: a row for each mark of a term ('rare', 'common')."""
    f = frequencies(texts)
    marks = F.array_compact(F.array(F.when(F.col("is_rare"), F.lit("rare")), F.when(F.col("is_common"), F.lit("common"))))
    return f.where("is_rare or is_common").select("src", "term", F.explode(marks).alias("mark"))
