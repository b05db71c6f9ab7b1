"""Loading of forum dumps with malformed records set apart.

Records are parsed in blocks on a columnar path (Arrow kernels: one anchored
pattern for the whole record, then casts, range and calendar checks on whole
columns). The columnar path accepts a block only if every record in it is
certainly valid. A block it refuses is bisected until single records remain,
and only those meet the strict scanner, which names the reason or, for valid
records in unusual spelling, returns the values.

Everything runs inside ``mapInArrow``: no shuffle, no state across tasks, so
any split of the input gives the same rows.
"""

from __future__ import annotations

import datetime
import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkscape.session import fixed_rows

BLANKS = " \t\r\n"
BLOCK = 64
OUT = (
    "line_id bigint, dump_file string, table_name string, fmt string, line_no int, "
    "kind string, reason string, vals array<string>"
)
_TS = re.compile(r"[0-9]{4}-[0-9]{2}-[0-9]{2} [0-9]{2}:[0-9]{2}:[0-9]{2}", re.A)
_DIGITS = re.compile(r"[0-9]+", re.A)


class Refused(Exception):
    """The columnar path cannot vouch for the block."""


class Column:
    """A declared column of a dump table."""

    __slots__ = ("name", "kind", "nullable", "low", "high")

    def __init__(self, name, kind, nullable, low, high):
        self.name, self.kind, self.nullable = name, kind, bool(nullable)
        self.low, self.high = low, high

    def holds(self, value: str | None) -> bool:
        if value is None:
            return self.nullable
        if self.kind == "int":
            if not _DIGITS.fullmatch(value):
                return False
            n = int(value) if len(value) < 4000 else int(value.lstrip("0")[:40] or "0")
            return (self.low is None or n >= self.low) and (self.high is None or n <= self.high)
        if self.kind == "timestamp":
            if not _TS.fullmatch(value):
                return False
            try:
                datetime.datetime.strptime(value, "%Y-%m-%d %H:%M:%S")
            except ValueError:
                return False
            return int(value[17:19]) < 60
        return True


# --- strict scanner ---------------------------------------------------------


def scan_sql(s: str) -> tuple[str | None, list[str | None]]:
    """(problem, fields) of one trimmed SQL record."""
    fields: list[str | None] = []
    n, closed = len(s), False
    opened = s[:1] == "("
    i = 1 if opened else 0
    while True:
        while i < n and s[i] in BLANKS:
            i += 1
        if i < n and s[i] == "'":
            i += 1
            part = []
            while True:
                if i >= n:
                    return "quoting", fields
                c = s[i]
                if c == "\\":
                    if i + 1 >= n:
                        return "quoting", fields
                    part.append(s[i + 1])
                    i += 2
                elif c == "'":
                    if s[i + 1 : i + 2] == "'":
                        part.append("'")
                        i += 2
                    else:
                        i += 1
                        break
                else:
                    part.append(c)
                    i += 1
            while i < n and s[i] in BLANKS:
                i += 1
            if i < n and s[i] not in ",)":
                return "quoting", fields
            fields.append("".join(part))
        else:
            j = i
            while j < n and s[j] not in ",)":
                if s[j] == "'":
                    return "quoting", fields
                j += 1
            raw = s[i:j].strip(BLANKS)
            fields.append(None if raw.upper() == "NULL" else raw)
            i = j
        if i >= n:
            break
        if s[i] == ")":
            closed = True
            i += 1
            break
        i += 1
    whole = opened and closed and not s[i:].strip(",;" + BLANKS)
    return (None if whole else "column_count"), fields


def scan_csv(s: str) -> tuple[str | None, list[str | None]]:
    """(problem, fields) of one trimmed CSV record."""
    fields: list[str | None] = []
    n, i = len(s), 0
    while True:
        while i < n and s[i] in BLANKS:
            i += 1
        if i < n and s[i] == '"':
            i += 1
            part = []
            while True:
                j = s.find('"', i)
                if j < 0:
                    return "quoting", fields
                part.append(s[i:j])
                if s[j + 1 : j + 2] == '"':
                    part.append('"')
                    i = j + 2
                else:
                    i = j + 1
                    break
            while i < n and s[i] in BLANKS:
                i += 1
            if i < n and s[i] != ",":
                return "quoting", fields
            fields.append("".join(part))
        else:
            j = s.find(",", i)
            j = n if j < 0 else j
            if '"' in s[i:j]:
                return "quoting", fields
            fields.append(s[i:j].strip(BLANKS) or None)
            i = j
        if i >= n:
            return None, fields
        i += 1


def diagnose(s: str, fmt: str, columns: list[Column]) -> tuple[str | None, list[str | None]]:
    """The reason of one trimmed record, or None with its field values."""
    problem, fields = (scan_sql if fmt == "sql" else scan_csv)(s)
    if problem == "quoting":
        return problem, []
    if problem or len(fields) != len(columns):
        return "column_count", []
    if not all(c.holds(v) for c, v in zip(columns, fields)):
        return "invalid_value", []
    return None, fields


# --- columnar path ----------------------------------------------------------


def record_pattern(fmt: str, columns: list[Column]) -> str:
    """Anchored pattern of a record in its common spellings; a subset of the valid ones."""
    b = r"[ \t\r\n]*"
    parts = []
    for k, c in enumerate(columns):
        if fmt == "sql":
            null = "[nN][uU][lL][lL]"
            parts.append(
                {
                    "int": f"{b}(?:(?P<v{k}>[0-9]{{1,18}})|'(?P<q{k}>[0-9]{{1,18}})'|{null}){b}",
                    "timestamp": rf"{b}(?:'(?P<v{k}>\d{{4}}-\d\d-\d\d \d\d:\d\d:\d\d)'|{null}){b}",
                }.get(c.kind, rf"{b}(?:(?P<v{k}>'(?:[^'\\]|\\(?:.|\n)|'')*')|{null}){b}")
            )
        else:
            parts.append(
                {
                    "int": f'{b}(?:(?P<v{k}>[0-9]{{1,18}})|"(?P<q{k}>[0-9]{{1,18}})"|){b}',
                    "timestamp": rf'{b}(?:(?P<v{k}>\d{{4}}-\d\d-\d\d \d\d:\d\d:\d\d)|"(?P<q{k}>\d{{4}}-\d\d-\d\d \d\d:\d\d:\d\d)"|){b}',
                }.get(c.kind, rf'{b}(?:(?P<q{k}>"(?:[^"]|"")*")|(?P<v{k}>[^", \t\r\n](?:[^",]*[^", \t\r\n])?)|){b}')
            )
    body = ",".join(parts)
    return rf"\A\({body}\)[,; \t\r\n]*\z" if fmt == "sql" else rf"\A{body}\z"


class Block:
    """Columnar parse of records of one table and format.

    ``extract`` runs the record pattern over all records at hand in one kernel call; blocks are
    slices of its result, so bisecting copies and matches nothing again.
    """

    def __init__(self, fmt: str, columns: list[Column], keep: bool = True):
        self.fmt, self.columns, self.keep = fmt, columns, keep
        self.pattern = record_pattern(fmt, columns)

    def extract(self, lines: pa.Array) -> tuple[pa.Array, list[pa.Array]]:
        """(which records match, the columns' texts with null for null)."""
        got = pc.extract_regex(lines, self.pattern)
        fields = {f.name: got.field(i) for i, f in enumerate(got.type)}
        out = []
        for k, c in enumerate(self.columns):
            # A group that took no part in the match comes back as ''; texts are
            # captured with their quotes, so '' always means null.
            v, quoted = fields[f"v{k}"], fields.get(f"q{k}")
            if c.kind == "text":
                out.append(self.text(v, quoted))
                continue
            if quoted is not None:
                v = pc.if_else(pc.not_equal(quoted, ""), quoted, v)
            out.append(pc.if_else(pc.equal(v, ""), pa.scalar(None, pa.string()), v))
        return got.is_valid(), out

    def text(self, v: pa.Array, quoted: pa.Array | None) -> pa.Array:
        null = pa.scalar(None, pa.string())
        if self.fmt == "sql":
            inner = pc.replace_substring_regex(pc.utf8_slice_codeunits(v, 1, -1), r"(?s)\\(.)|'(')", r"\1\2")
            return pc.if_else(pc.equal(v, ""), null, inner)
        inner = pc.replace_substring(pc.utf8_slice_codeunits(quoted, 1, -1), '""', '"')
        return pc.if_else(pc.not_equal(quoted, ""), inner, pc.if_else(pc.equal(v, ""), null, v))

    def vouch(self, matches: pa.Array, columns: list[pa.Array]) -> None:
        """Raises Refused unless every record of the block is valid for certain."""
        if matches.true_count < len(matches):
            raise Refused
        for c, v in zip(self.columns, columns):
            if v.null_count and not c.nullable:
                raise Refused
            if c.kind == "int":
                n = pc.min_max(pc.cast(v, pa.int64()))
                low, high = n["min"].as_py(), n["max"].as_py()
                if low is not None and (low < (c.low if c.low is not None else low) or high > (c.high if c.high is not None else high)):
                    raise Refused
            elif c.kind == "timestamp":
                t = pc.strptime(v, format="%Y-%m-%d %H:%M:%S", unit="s", error_is_null=True)
                if t.null_count != v.null_count:
                    raise Refused
                if pc.any(pc.not_equal(pc.strftime(t, format="%Y-%m-%d %H:%M:%S"), v)).as_py():
                    raise Refused

    def load(self, lines: pa.Array, matches: pa.Array, columns: list[pa.Array], at: int, found: list) -> None:
        """Fills found[at:] with (reason, values), bisecting what the columnar path refuses."""
        try:
            self.vouch(matches, columns)
        except (Refused, pa.ArrowInvalid):
            n = len(lines)
            if n == 1:
                found[at] = diagnose(lines[0].as_py(), self.fmt, self.columns)
                return
            half = n // 2
            self.load(lines.slice(0, half), matches.slice(0, half), [c.slice(0, half) for c in columns], at, found)
            self.load(lines.slice(half), matches.slice(half), [c.slice(half) for c in columns], at + half, found)
            return
        if not self.keep:
            found[at : at + len(lines)] = [(None, None)] * len(lines)
            return
        for k, row in enumerate(zip(*(c.to_pylist() for c in columns))):
            found[at + k] = (None, list(row))

    def load_all(self, lines: pa.Array, block: int) -> list:
        found: list = [None] * len(lines)
        matches, columns = self.extract(lines)
        for at in range(0, len(lines), block):
            self.load(lines.slice(at, block), matches.slice(at, block), [c.slice(at, block) for c in columns], at, found)
        return found


def declared(dump_column: DataFrame) -> dict[str, list[Column]]:
    """Columns by table, from the (fixed, small) table of declared columns."""
    out: dict[str, list] = {}
    for r in fixed_rows(dump_column.select("table_name", "ordinal", "column_name", "data_type", "is_nullable", "min_value", "max_value")):
        out.setdefault(r[0], []).append((r[1], Column(*r[2:])))
    return {t: [c for _, c in sorted(cs, key=lambda x: x[0])] for t, cs in out.items()}


def load_records(dump_line: DataFrame, dump_column: DataFrame, block: int = BLOCK, keep: bool = True) -> DataFrame:
    """One row per line: kind is 'valid', 'malformed' (with reason) or 'other'.

    ``vals`` holds the fields of a valid record as text, in declared order (null without ``keep``). Null and
    blank lines, comments, INSERT heads and CSV heads are 'other'. A record of a table
    without declared columns, or of another format, is 'malformed' as column_count.
    Repeats are kept. Extra columns of the input are ignored.
    """
    columns = declared(dump_column)
    heads = {t: ",".join(c.name for c in cs) for t, cs in columns.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks: dict[tuple, Block] = {}
        for batch in batches:
            lines = pc.utf8_trim(batch.column("line"), characters=BLANKS)
            tables, fmts = batch.column("table_name").to_pylist(), batch.column("fmt").to_pylist()
            kinds = ["other"] * len(lines)
            reasons: list = [None] * len(lines)
            vals: list = [None] * len(lines)
            groups: dict[tuple, list[int]] = {}
            for i, s in enumerate(lines.to_pylist()):
                if not s:
                    continue
                t, f = tables[i], fmts[i]
                if f == "sql" and s.startswith(("--", "INSERT INTO")) or f == "csv" and (s[0] == "#" or s == heads.get(t)):
                    continue
                if t not in columns or f not in ("sql", "csv"):
                    kinds[i], reasons[i] = "malformed", "column_count"
                    continue
                groups.setdefault((t, f), []).append(i)
            for (t, f), ids in groups.items():
                b = blocks.setdefault((t, f), Block(f, columns[t], keep))
                for i, (reason, v) in zip(ids, b.load_all(lines.take(pa.array(ids)), block)):
                    kinds[i], reasons[i], vals[i] = ("malformed", reason, None) if reason else ("valid", None, v if keep else None)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("line_id"),
                    batch.column("dump_file"),
                    batch.column("table_name"),
                    batch.column("fmt"),
                    batch.column("line_no").cast(pa.int32()),
                    pa.array(kinds, pa.string()),
                    pa.array(reasons, pa.string()),
                    pa.array(vals, pa.list_(pa.string())),
                ],
                names=["line_id", "dump_file", "table_name", "fmt", "line_no", "kind", "reason", "vals"],
            )

    return dump_line.select("line_id", "dump_file", "table_name", "fmt", "line_no", "line").mapInArrow(run, OUT)


def malformed(dump_line: DataFrame, dump_column: DataFrame) -> DataFrame:
    """line_id and reason of each malformed record."""
    return load_records(dump_line, dump_column, keep=False).where("kind = 'malformed'").select("line_id", "reason")


def typed(dump_line: DataFrame, dump_column: DataFrame, name: str) -> DataFrame:
    """The valid records of one table with typed columns (and line_id); an int of a column without declared bounds
    that is beyond 64 bits is null."""
    spark_type = {"int": "bigint", "timestamp": "timestamp_ntz", "text": "string"}
    columns = declared(dump_column).get(name, [])
    rows = load_records(dump_line.where(F.col("table_name") == name), dump_column).where("kind = 'valid'")
    return rows.select("line_id", *(F.col("vals")[k].try_cast(spark_type.get(c.kind, "string")).alias(c.name) for k, c in enumerate(columns)))
