"""Files: state documents, JSON lines, multi-row SQL dumps, CSV pairs, W with manifest, paragraphs."""

from __future__ import annotations

import io
import xml.etree.ElementTree as ET
import zipfile

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkscape.operators.dirty_rows import BLANKS, scan_sql


# A field of an INSERT row: quoted (a backslash takes the next character, '' is a quote) or up to the next comma or bracket.
_FIELD = r"(?:'(?:[^'\\]|\\.|'')*'|[^',()]*?)"


def sql_column(line: Column, place: int, among: int | None = None) -> Column:
    """The field at a place (from 0) of a row ``(a, b, ...)`` of a dump, as it stands, without blanks around it; '' where the row has no such
    field. Fields after it aren't read. With ``among``, all of the first so many fields must be there, and be followed by another."""
    head = r"^\s*\(" + "".join(rf"\s*{_FIELD}\s*," for _ in range(place))
    tail = "".join(rf",\s*{_FIELD}\s*" for _ in range((among or place + 1) - place - 1)) + ("," if among else "[,)]")
    return F.regexp_extract(line, rf"{head}\s*({_FIELD})\s*{tail}", 1)


def fast_count(line: Column) -> Column:
    """Rows of an INSERT line by its row ends, without parsing it."""
    return F.when(line.contains("("), F.size(F.split(line, r"\),\s*\(")))


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def first_existing(spark: SparkSession, paths: list[str]) -> str | None:
    """The first of several paths that is there."""
    return next((p for p in paths if exists(spark, p)), None)


def read_state(spark: SparkSession, path: str, schema: str, defaults: dict | None = None) -> DataFrame:
    """A whole-document JSON state; missing keys take their defaults, null ones stay null only without one."""
    df = spark.read.schema(schema).json(path, multiLine=True)
    return df.fillna(defaults) if defaults else df


def write_state(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def read_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; a line that doesn't parse is kept whole in ``_unparsed``, the rest of it null."""
    return spark.read.schema(f"{schema}, _unparsed string").json(path, mode="PERMISSIVE", columnNameOfCorruptRecord="_unparsed")


def append_lines(df: DataFrame, path: str) -> None:
    """Appends rows as JSON lines with the time of writing."""
    df.withColumn("written_at_utc", F.current_timestamp()).write.mode("append").json(path)


def read_pairs(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Author pairs from CSV with a header, self pairs left out."""
    return spark.read.schema(schema).csv(path, header=True).where("self_pair = 0")


def write_pairs(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def write_w(nodes: DataFrame, edges: DataFrame, path: str) -> DataFrame:
    """Writes nodes and edges as parquet, and returns the manifest: n, edges by sign, digest of the sorted edges."""
    nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    edges.write.mode("overwrite").parquet(f"{path}/edges")
    e = edges.sparkSession.read.parquet(f"{path}/edges")
    cells = F.array_sort(F.collect_list(F.concat_ws(":", "i", "j", "raw")))  # at most top_k ** 2 / 2 of them
    m = e.agg(F.sha2(F.array_join(cells, "\n"), 256).alias("sha256"), F.count_if(F.col("raw") < 0).alias("edges_neg"), F.count_if(F.col("raw") > 0).alias("edges_pos"), F.count_if(F.col("raw") == 0).alias("edges_zero"))
    return m.crossJoin(nodes.agg(F.count("*").alias("n")))


def records_of(line: str) -> list[list[str | None]]:
    """The value groups of one INSERT line, quote-aware; an unclosed last group is left out."""
    at, out = line.upper().find(" VALUES"), []
    at = line.find("(", at) if at >= 0 else -1
    while at >= 0:
        i, quoted = at + 1, False
        while i < len(line) and (quoted or line[i] != ")"):
            if quoted and line[i] == "\\":
                i += 1
            elif line[i] == "'":
                quoted = not quoted
            i += 1
        if i >= len(line):
            break
        problem, fields = scan_sql(line[at : i + 1].strip(BLANKS))
        if problem is None:
            out.append(fields)
        at = line.find("(", i + 1)
    return out


def read_dump(spark: SparkSession, path: str, columns: dict[str, list[str]]) -> DataFrame:
    """table_name, row (map of column to text) of a dump with many rows per INSERT line.

    ``columns`` names the tables wanted and their columns; other tables are skipped before
    anything is parsed. A row shorter than the columns gives a map without the rest.
    """
    wanted = {t.lower(): c for t, c in columns.items()}
    text = spark.read.text(path).where(F.col("value").startswith("INSERT INTO"))
    named = text.select(F.lower(F.regexp_extract("value", r"^INSERT INTO `?(\w+)`?", 1)).alias("table_name"), "value").where(F.col("table_name").isin(*wanted))

    def run(batches):
        for b in batches:
            names, maps = [], []
            for t, line in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for fields in records_of(line):
                    names.append(t)
                    maps.append(list(zip(wanted[t], fields)))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(maps, pa.map_(pa.string(), pa.string()))], names=["table_name", "row"])

    return named.mapInArrow(run, "table_name string, row map<string,string>")


def docx_paragraphs(content: bytes) -> list[str]:
    """Non-blank paragraph texts of a word-processor document; none for a broken file."""
    try:
        root = ET.fromstring(zipfile.ZipFile(io.BytesIO(content)).read("word/document.xml"))
    except (zipfile.BadZipFile, KeyError, ET.ParseError):
        return []
    w = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    texts = ("".join(t.text or "" for t in p.iter(f"{w}t")) for p in root.iter(f"{w}p"))
    return [t for t in texts if t.strip()]


def read_paragraphs(spark: SparkSession, path: str) -> DataFrame:
    """path, pos, paragraph of .docx, .md and text files in a folder."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(batches):
        for b in batches:
            rows = []
            for p, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                parts = docx_paragraphs(c) if p.endswith(".docx") else [x.strip() for x in c.decode("utf-8", "replace").split("\n\n")]
                rows += [(p, k, t) for k, t in enumerate(x for x in parts if x and not x.startswith(("#", "|", "---")))]
            cols = list(zip(*rows)) or [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int32(), pa.string()))], names=["path", "pos", "paragraph"])

    return files.mapInArrow(run, "path string, pos int, paragraph string")


def chat_turns(texts: DataFrame) -> DataFrame:
    """unit_id, pos, role, said, body of chat exports: blocks split at ---, each with a ``role (time)`` head."""
    blocks = texts.select("unit_id", F.posexplode(F.split("text", r"(?m)^---\s*$")).alias("pos", "block"))
    head = r"^\s*\**(\w+)\**\s*\(([^)]*)\)\s*:?\s*"
    t = blocks.where(F.col("block").rlike(head))
    return t.select("unit_id", "pos", F.lower(F.regexp_extract("block", head, 1)).alias("role"), F.regexp_extract("block", head, 2).alias("said"), F.regexp_replace(F.regexp_replace("block", head, ""), r"\s+$", "").alias("body"))


def loose_json(column):
    """The first {...} of a model's answer, as JSON text that parses; null otherwise."""
    cut = F.regexp_extract(column, r"(?s)(\{.*\})", 1)
    return F.when(F.get_json_object(cut, "$").isNotNull(), cut)
