"""Files whose records change shape: one table of consistent columns, and an ordered log of changes.

One pass over the lines gives every file's header schema: dotted path -> element of the
type lattice. Its elements are sets of kinds (bit masks) and its join is their union, so that
headers fold in any order: records in their task, tasks in a file, files in the whole
collection. ``column_type`` is the promotion of such a set: null < integer < double,
boolean, array < string. What changes is read off the headers of neighbouring files; only
for renames are the lines of the files in question read again, once.
"""

from __future__ import annotations

import hashlib
import json
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkscape.session import cut, fixed_rows

KINDS = {dict: "object", list: "array", str: "string", bool: "boolean", int: "number", float: "number", type(None): "null"}
# Bits of the lattice's elements. Integers beyond 2^53 aren't exact as double, those beyond 64 bits in no number type.
NULL, INTEGER, LONG, HUGE, DOUBLE, BOOLEAN, ARRAY, STRING, OBJECT = (1 << k for k in range(9))
NUMBER = INTEGER | LONG | HUGE | DOUBLE
NAMED = ((OBJECT, "object"), (ARRAY, "array"), (STRING, "string"), (BOOLEAN, "boolean"), (NUMBER, "number"))
HEAD = "series string, file_seq bigint, file_id bigint, path string, kinds int, low double, high double"
FLUSH = 100_000
MOST_PATHS = 20_000  # fields of the whole collection; a table can't have more columns, so a larger union schema is refused


def kind_of(value) -> str:
    return KINDS[type(value)]


def element(value) -> int:
    """The lattice element of one value."""
    t = type(value)
    if t is int:
        return INTEGER if -(2**53) <= value <= 2**53 else LONG if -(2**63) <= value < 2**63 else HUGE
    return {float: DOUBLE, str: STRING, bool: BOOLEAN, list: ARRAY, dict: OBJECT}.get(t, NULL)


def column_type(kinds: int) -> str:
    """The type that holds all values of a set of kinds unchanged.

    Objects have no column of their own: their members are columns. Where a path is an
    object in some records and a value in others, the value keeps its own column.
    """
    kinds &= ~(NULL | OBJECT)
    if kinds and not kinds & ~(INTEGER | LONG):
        return "bigint"
    if kinds and not kinds & ~(INTEGER | DOUBLE):
        return "double"
    return {BOOLEAN: "boolean", ARRAY: "array", 0: "null"}.get(kinds, "string")


def promote(a: str, b: str) -> str:
    """Least upper bound of two kinds or types in null < integer < double (number), boolean, array < string."""
    element_of = {"null": NULL, "object": OBJECT, "boolean": BOOLEAN, "array": ARRAY, "string": STRING, "number": DOUBLE, "double": DOUBLE, "integer": INTEGER, "bigint": INTEGER}
    if a == b or b in ("null", "object"):
        return a
    if a in ("null", "object"):
        return b
    both = column_type(element_of[a] | element_of[b])
    return "number" if both == "double" and "number" in (a, b) else both


def members(record: dict, prefix: str = "") -> Iterator[tuple[str, object]]:
    """(dotted path, value) of every member; arrays aren't entered. Not recursive, so any depth goes."""
    stack = [(prefix, record)]
    while stack:
        at, node = stack.pop()
        for k, v in node.items():
            yield at + k, v
            if type(v) is dict:
                stack.append((at + k + ".", v))


def record_of(line: str | None) -> dict | None:
    """The JSON object of a line; None for null, blank or broken lines and other values."""
    try:
        d = json.loads(line) if line else None
    except (ValueError, RecursionError):
        return None
    return d if type(d) is dict else None


def headers(lines: DataFrame) -> DataFrame:
    """series, file_seq, file_id, path, kinds: one row per path of a file; path '' marks the file itself, with the range of its t.

    Lines that hold no JSON object add nothing but the file's mark. A file with a t that is no number has the whole range.
    """

    def run(batches):
        seen: dict[tuple, int] = {}
        low: dict[tuple, float] = {}
        high: dict[tuple, float] = {}

        def flush():
            cols = list(zip(*((*k, v, low.get(k), high.get(k)) for k, v in seen.items()))) or [()] * 7
            types = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.float64(), pa.float64()]
            out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["series", "file_seq", "file_id", "path", "kinds", "low", "high"])
            seen.clear(), low.clear(), high.clear()
            return out

        for batch in batches:
            for f, s, q, line in zip(*(batch.column(c).to_pylist() for c in ("file_id", "series", "file_seq", "line_json"))):
                mark = (s, q, f, "")
                seen[mark] = 0
                d = record_of(line)
                if d is not None:
                    for p, v in members(d):
                        key = (s, q, f, p)
                        seen[key] = seen.get(key, 0) | element(v)
                    t = d.get("t")
                    if t is not None:
                        a, b = t_range(t)
                        low[mark], high[mark] = min(low.get(mark, a), a), max(high.get(mark, b), b)
            if len(seen) > FLUSH:
                yield flush()
        yield flush()

    rows = lines.select("file_id", "series", F.col("file_seq").cast("bigint").alias("file_seq"), "line_json").mapInArrow(run, HEAD)
    # A file's headers meet in one task: as many rows as it has paths, times the tasks that read it.
    return rows.repartition("series", "file_seq").groupBy("series", "file_seq", "file_id", "path").agg(F.bit_or("kinds").cast("int").alias("kinds"), F.min("low").alias("low"), F.max("high").alias("high"))


def t_range(t) -> tuple[float, float]:
    """The place of a t on the number line; everything for what isn't there."""
    if type(t) in (int, float) and t == t:
        try:
            return float(t), float(t)
        except OverflowError:
            pass
    return -math.inf, math.inf


def neighbours(heads: DataFrame) -> DataFrame:
    """One row per file with its forerunner (file_seq one lower): series, file_seq, file_id, old_id and, per change, arrays of paths.

    only_new, only_old: paths in one of them; retyped: paths in both with a type in both files and
    other sets of types; low, high: where their records' t can be the same. A first file, or one whose forerunner isn't there, has no row. A row is as large
    as two files' schemas.
    """
    files = heads.groupBy("series", "file_seq", "file_id").agg(F.map_from_entries(F.collect_list(F.struct("path", "kinds"))).alias("fields"), F.min("low").alias("low"), F.max("high").alias("high"))
    older = files.select("series", (F.col("file_seq") + 1).alias("file_seq"), F.col("file_id").alias("old_id"), F.col("fields").alias("old"), F.col("low").alias("low_"), F.col("high").alias("high_"))
    both = files.join(older, ["series", "file_seq"])
    # The set of types as the rules count it: all numbers are one.
    types = lambda k: k.bitwiseAND(F.lit(BOOLEAN | ARRAY | STRING | OBJECT)) + F.when(k.bitwiseAND(F.lit(NUMBER)) != 0, F.lit(DOUBLE)).otherwise(F.lit(0))
    new_names, old_names = F.map_keys("fields"), F.map_keys("old")
    a = lambda p: types(F.element_at("fields", p))
    b = lambda p: types(F.element_at("old", p))
    shared = F.array_intersect(new_names, old_names)
    return both.select(
        "series", "file_seq", "file_id", "old_id", F.greatest("low", "low_").alias("low"), F.least("high", "high_").alias("high"),
        F.array_except(new_names, old_names).alias("only_new"),
        F.array_except(old_names, new_names).alias("only_old"),
        F.filter(shared, lambda p: (a(p) != 0) & (b(p) != 0) & (a(p) != b(p))).alias("retyped"),
    )


def canonical(value) -> str:
    """Equal JSON values of the same kind give equal texts; 1 and 1.0 are equal."""
    if type(value) is float and value.is_integer():
        value = int(value)
    if type(value) in (dict, list):
        value = json.loads(json.dumps(value), parse_float=lambda x: int(float(x)) if float(x).is_integer() else float(x))
    return kind_of(value) + json.dumps(value, sort_keys=True)


def renames(lines: DataFrame, differences: DataFrame) -> DataFrame:
    """file_id, old_id, path, old_path of the fields that were renamed.

    Candidates (a path only in the older and one only in the newer file under one parent)
    are compared by a 128-bit digest of their values over the records with a t in both
    files, and joined on that digest, so never pair by pair. Only lines of files with
    candidates are read.
    """
    parent = lambda p: F.regexp_replace(p, r"\.?[^.]*$", "")
    common = F.array_intersect(F.transform("only_new", parent), F.transform("only_old", parent))
    under = lambda side: F.filter(side, lambda p: F.array_contains(F.col("common"), parent(p)))
    pairs = differences.withColumn("common", common).where("size(common) > 0 and low <= high").select("file_id", "old_id", "low", "high", under("only_new").alias("new"), under("only_old").alias("old"))
    side = lambda at, old, paths: F.struct(F.col(at).alias("at"), F.lit(old).alias("is_old"), F.col(paths).alias("paths"))
    sides = pairs.select(F.col("file_id").alias("pair"), "old_id", "low", "high", F.explode(F.array(side("file_id", False, "new"), side("old_id", True, "old"))).alias("s")).select("pair", "old_id", "low", "high", "s.*")
    own = lines.select(F.col("file_id").alias("at"), "line_json").where("line_json is not null").join(sides, "at")

    def run(batches):
        last, d = None, None
        for batch in batches:
            out = []
            for pair, old_id, is_old, paths, line, low, high in zip(*(batch.column(c).to_pylist() for c in ("pair", "old_id", "is_old", "paths", "line_json", "low", "high"))):
                if line != last:  # a line of two pairs comes twice in a row
                    last, d = line, record_of(line)
                    values = None
                if d is None or d.get("t") is None:
                    continue
                a, b = t_range(d["t"])
                if b < low or a > high:
                    continue
                if values is None:
                    values = dict(members(d))
                t = canonical(d["t"])
                h = int.from_bytes(hashlib.md5(t.encode("utf-8", "surrogatepass")).digest()[:8], "big", signed=True)
                for p in paths:
                    v = values.get(p)
                    m = hashlib.md5((t + "\0" + canonical(v)).encode("utf-8", "surrogatepass")).digest()
                    out.append((pair, old_id, is_old, p, h, int.from_bytes(m[:8], "big", signed=True), int.from_bytes(m[8:], "big", signed=True), v is not None))
            cols = list(zip(*out)) or [()] * 8
            types = [pa.int64(), pa.int64(), pa.bool_(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["pair", "old_id", "is_old", "path", "t", "h1", "h2", "holds"])

    cells = own.mapInArrow(run, "pair bigint, old_id bigint, is_old boolean, path string, t bigint, h1 bigint, h2 bigint, holds boolean").distinct()
    cells = cut(cells)
    shared = cells.groupBy("pair", "t").agg(F.max("is_old").alias("a"), F.min("is_old").alias("b")).where("a and not b").select("pair", "t")
    digest = cells.join(shared, ["pair", "t"], "left_semi").groupBy("pair", "old_id", "is_old", "path").agg(
        F.count("*").alias("n"), F.bit_xor("h1").alias("x1"), F.bit_xor("h2").alias("x2"), F.sum(F.col("h1").cast("decimal(38,0)")).alias("s"), F.max("holds").alias("holds")
    )
    # Paths of one digest meet in one row; as many as a schema has.
    name = F.struct("is_old", "path")
    met = digest.where("holds").groupBy("pair", "old_id", parent(F.col("path")).alias("parent"), "n", "x1", "x2", "s").agg(F.collect_list(name).alias("all"))
    split = lambda old: F.transform(F.filter("all", lambda x: x["is_old"] == old), lambda x: x["path"])
    new = met.select(F.col("pair").alias("file_id"), "old_id", F.explode(split(F.lit(False))).alias("path"), split(F.lit(True)).alias("olds"))
    return new.select("file_id", "old_id", "path", F.explode("olds").alias("old_path"))


def log(lines: DataFrame) -> DataFrame:
    """series, file_seq, position, file_id, change, field, old_field: every change of a file against its forerunner.

    Ordered within a file: renamed, removed, added, type, each by field; position counts from 0.
    A rename whose values never meet (no common t, or nulls only) is an added and a
    removed field. A field that matches several others is reported with each of them.
    Empty input gives no rows.
    """
    # The headers are read once; both they and the differences are as small as the schemas.
    d = cut(neighbours(headers(lines)).where("size(only_new) + size(only_old) + size(retyped) > 0"))
    return _log(d, renames(lines, d))


def _log(d: DataFrame, renamed: DataFrame) -> DataFrame:
    pairs = renamed.groupBy("file_id", "old_id").agg(F.collect_set(F.struct(F.col("path").alias("field"), F.col("old_path").alias("old_field"))).alias("renamed"))
    all_ = d.join(pairs, ["file_id", "old_id"], "left").withColumn("renamed", F.coalesce("renamed", F.array().cast("array<struct<field: string, old_field: string>>")))
    row = lambda rank, change, field, old: F.struct(F.lit(rank).alias("rank"), field.alias("field"), old.alias("old_field"), F.lit(change).alias("change"))
    plain = lambda rank, change, paths: F.transform(paths, lambda p: row(rank, change, p, F.lit("")))
    gone = lambda side, member: F.array_except(side, F.transform("renamed", lambda r: r[member]))
    rows = F.array_sort(F.concat(
        F.transform("renamed", lambda r: row(0, "renamed", r["field"], r["old_field"])),
        plain(1, "removed", gone(F.col("only_old"), "old_field")),
        plain(2, "added", gone(F.col("only_new"), "field")),
        plain(3, "type", F.col("retyped")),
    ))
    return all_.select("series", "file_seq", "file_id", F.posexplode(rows).alias("position", "r")).select("series", "file_seq", "position", "file_id", "r.change", "r.field", "r.old_field")


def changes(lines: DataFrame) -> DataFrame:
    """file_id, change, field, old_field: the rows of the log, in no order."""
    return log(lines).select("file_id", "change", "field", "old_field")


def ordered_log(lines: DataFrame) -> DataFrame:
    """The log by series, file and position (sorted by ranges, in parallel)."""
    return log(lines).orderBy("series", "file_seq", "position", "file_id")


def fold(heads: DataFrame) -> DataFrame:
    """path, kinds, n_files: the headers of all files folded into the union schema, and in how many files a path is."""
    return heads.where("path <> ''").groupBy("path").agg(F.bit_or("kinds").cast("int").alias("kinds"), F.count("*").alias("n_files"))


def typed_schema(lines: DataFrame) -> DataFrame:
    """path, type, n_files of the union schema; objects, which have no column, and nulls have the type null."""
    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([column_type(k) for k in b.column(1).to_pylist()], pa.string()), b.column(2)], names=["path", "type", "n_files"])

    return fold(headers(lines)).mapInArrow(run, "path string, type string, n_files bigint")


def union_schema(heads: DataFrame) -> list[tuple[str, str]]:
    """(path, type) of the union schema, sorted by path. More than MOST_PATHS paths are refused."""
    rows = fixed_rows(fold(heads), MOST_PATHS)
    return sorted((r.path, column_type(r.kinds)) for r in rows if r.kinds & ~OBJECT)


def rename_groups(links: list[tuple[str, str]], weight: dict[str, int]) -> dict[str, str]:
    """path -> name of its group of renamed paths: the one in most files, then the first by name.

    Links are (old, new) paths; their number is bounded by the schema, not by the data.
    Members of a renamed object follow it.
    """
    root: dict[str, str] = {}

    def find(p: str) -> str:
        while root.setdefault(p, p) != p:
            p = root[p]
        return p

    for a, b in links:
        a, b = find(a), find(b)
        if a != b:
            keep, drop = sorted((a, b), key=lambda p: (-weight.get(p, 0), p))
            root[drop] = keep
    out = {}
    for p in sorted({*weight, *root}):
        parts = p.split(".")
        for k in range(1, len(parts) + 1):
            head = ".".join(parts[:k])
            new = find(head) if head in root else head
            if new != head:
                parts[:k] = new.split(".")
        if ".".join(parts) != p:
            out[p] = ".".join(parts)
    return out


def read_unified(lines: DataFrame) -> DataFrame:
    """All files as one table with renamed fields under one name: ``unified`` after one pass over the headers.

    Schemas of more than MOST_PATHS paths, or as many renames, are refused."""
    heads = cut(headers(lines))
    folded = fixed_rows(fold(heads), MOST_PATHS)
    links = [tuple(r) for r in fixed_rows(renames(lines, cut(neighbours(heads))).select("old_path", "path").distinct(), MOST_PATHS)]
    schema = sorted((r.path, r.kinds) for r in folded if r.kinds & ~OBJECT)
    return unified(lines, schema, rename_groups(sorted(links), {r.path: r.n_files for r in folded}))


def unified(lines: DataFrame, schema: list[tuple[str, int]], named: dict[str, str] | None = None) -> DataFrame:
    """All files as one table: file_id, line_no and one column per path of the union schema (path, kinds).

    Dots in paths become two underscores. Columns have the promoted type (bigint, double,
    boolean, else text; numbers, arrays and objects in it as JSON without blanks), which holds every
    value unchanged; what is absent or null is null. Paths that ``named``
    gives one name share a column (the first of them that isn't null). A line that holds no
    JSON object gives a row of nulls with corrupt_line set.
    """
    named = named or {}
    sources: dict[str, list[str]] = {}
    kinds: dict[str, int] = {}
    for p, k in schema:
        n = named.get(p, p)
        sources.setdefault(n, []).append(p)
        kinds[n] = kinds.get(n, 0) | k
    paths = sorted(sources)
    taken, names = {"file_id", "line_no", "corrupt_line"}, []
    for p in paths:
        n = p.replace(".", "__")
        while n.lower() in taken:  # Spark's names don't tell case apart
            n += "_"
        taken.add(n.lower())
        names.append(n)
    types = {p: column_type(kinds[p]) for p in paths}
    ddl = ", ".join(["file_id bigint", "line_no int", "corrupt_line string", *(f"`{n}` {types[p] if types[p] in ('bigint', 'double', 'boolean') else 'string'}" for n, p in zip(names, paths))])
    reads = {
        "bigint": (lambda v: v if type(v) is int else None, pa.int64()),
        "double": (lambda v: float(v) if type(v) in (int, float) else None, pa.float64()),
        "boolean": (lambda v: v if type(v) is bool else None, pa.bool_()),
    }
    other = (lambda v: v if v is None or type(v) is str else None if type(v) is dict else json.dumps(v, ensure_ascii=False, separators=(",", ":")), pa.string())

    def run(batches):
        for batch in batches:
            lines_ = batch.column("line_json").to_pylist()
            rows = [record_of(x) for x in lines_]
            flat = [dict(members(d)) if d is not None else {} for d in rows]
            arrays = [batch.column("file_id"), batch.column("line_no"), pa.array([None if d is not None else x for d, x in zip(rows, lines_)], pa.string())]
            for p in paths:
                read, kind = reads.get(types[p], other)
                own = sources[p]
                if len(own) == 1:
                    values = [read(d.get(own[0])) for d in flat]
                else:
                    values = [next((x for q in own if (x := read(d.get(q))) is not None), None) for d in flat]
                arrays.append(pa.array(values, kind))
            yield pa.RecordBatch.from_arrays(arrays, names=["file_id", "line_no", "corrupt_line", *names])

    return lines.select("file_id", F.col("line_no").cast("int").alias("line_no"), "line_json").mapInArrow(run, ddl)
