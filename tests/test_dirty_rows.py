import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sparkscape.operators import dirty_rows as D

POST = [D.Column("discussion_id", "int", 0, 1, 2147483647), D.Column("post_id", "int", 0, 1, 2147483647), D.Column("author_id", "int", 1, 1, 2147483647), D.Column("posted_at", "timestamp", 1, None, None), D.Column("title", "text", 1, None, None)]

CASES = [
    ("sql", "(1,2,3,'2024-02-29 10:00:00','x'),", None),
    ("sql", "( 1 ,'002',NULL,null,NULL );, ;", None),
    ("sql", "(1,2,3,NULL,'a''b\\'c, (d)\ne')", None),
    ("sql", "(1,2,3,NULL,)", None),
    ("sql", "(1,2,3,NULL,'x'", "column_count"),
    ("sql", "1,2,3,NULL,'x')", "column_count"),
    ("sql", "(1,2,3,NULL,'x') y", "column_count"),
    ("sql", "(1,2,3,NULL)", "column_count"),
    ("sql", "(1,2,3,NULL,'x)", "quoting"),
    ("sql", "(1,2,3,NULL,'x\\')", "quoting"),
    ("sql", "(1,2,3,NULL,'it's')", "quoting"),
    ("sql", "(1,2,3,NULL,it's)", "quoting"),
    ("sql", "(1,'2,3,NULL,'x')", "quoting"),
    ("sql", "(0,2,3,NULL,'x')", "invalid_value"),
    ("sql", "(NULL,2,3,NULL,'x')", "invalid_value"),
    ("sql", "(1,２,3,NULL,'x')", "invalid_value"),
    ("sql", "(1,+2,3,NULL,'x')", "invalid_value"),
    ("sql", "(1,2147483648,3,NULL,'x')", "invalid_value"),
    ("sql", "(1,,3,NULL,'x')", "invalid_value"),
    ("sql", "(1,2,3,'2023-02-29 10:00:00','x')", "invalid_value"),
    ("sql", "(1,2,3,'2023-02-28 10:00:60','x')", "invalid_value"),
    ("sql", "(1,2,3,'2023-2-28 10:00:00','x')", "invalid_value"),
    ("sql", "(" + "0" * 30 + "1,2,3,NULL,'x')", None),
    ("csv", '1,2,3,2024-02-29 10:00:00,x', None),
    ("csv", ' 1 ,"2", , ,"a ""b"", c\nd" ', None),
    ("csv", "1,2,,,", None),
    ("csv", '1,2,,,"x', "quoting"),
    ("csv", '1,2,,,"x"y', "quoting"),
    ("csv", '1,2,,,x"y', "quoting"),
    ("csv", "1,2,,,x,", "column_count"),
    ("csv", '"",2,,,x', "invalid_value"),
    ("csv", "1, ,,,x", "invalid_value"),
    ("csv", '1," 2",,,x', "invalid_value"),
]


@pytest.mark.parametrize("fmt,line,reason", CASES)
def test_reasons(fmt, line, reason):
    assert D.diagnose(line.strip(D.BLANKS), fmt, POST)[0] == reason


def both(fmt, lines, block):
    return D.Block(fmt, POST).load_all(pa.array(lines, pa.string()), block)


@pytest.mark.parametrize("fmt", ["sql", "csv"])
@pytest.mark.parametrize("block", [1, 4, 64])
def test_columnar_path_equals_scanner_on_cases(fmt, block):
    lines = [c[1].strip(D.BLANKS) for c in CASES if c[0] == fmt] * 3
    assert both(fmt, lines, block) == [D.diagnose(x, fmt, POST) if D.diagnose(x, fmt, POST)[0] is None else (D.diagnose(x, fmt, POST)[0], []) for x in lines]


pieces = st.lists(st.sampled_from(["1", "22", "0", "'", "''", '"', '""', ",", "(", ")", "\\", " ", "NULL", "x", "2024-02-29 10:00:00", ";", "é", "\n"]), max_size=24).map("".join)


@settings(max_examples=400, deadline=None)
@given(st.sampled_from(["sql", "csv"]), st.lists(pieces, min_size=1, max_size=6))
def test_columnar_path_equals_scanner(fmt, bodies):
    lines = [x for b in bodies for x in (b.strip(D.BLANKS), f"(1,2,3,NULL,'{b}')", f'1,2,3,,"{b}"')]
    for line, got in zip(lines, both(fmt, lines, 64)):
        want = D.diagnose(line, fmt, POST)
        assert got == (want if want[0] is None else (want[0], []))


SCHEMA = "line_id bigint, dump_file string, table_name string, fmt string, line_no int, line string, loaded_at timestamp, reason string, kind int, vals string"
COLS = "table_name string, ordinal int, column_name string, data_type string, is_nullable int, min_value bigint, max_value bigint"


def columns(spark):
    return spark.createDataFrame([("post", 1, "discussion_id", "int", 0, 1, 99), ("post", 2, "title", "text", 1, None, None)], COLS)


def test_lines_nulls_repeats_and_clashing_columns(spark):
    lines = ["(1,'a')", "(1,'a')", "(x,'a')", None, "  ", "-- c", "INSERT INTO `post` VALUES", "(1,'" + "z" * 300_000 + "')"]
    rows = [(i, "f", "post", "sql", i, x, None, "r", 1, "v") for i, x in enumerate(lines)] + [(90, None, None, None, None, "(1,2)", None, "r", 1, "v"), (91, "f", "post", "csv", 1, "discussion_id,title", None, "", 0, "")]
    df = spark.createDataFrame(rows, SCHEMA)
    assert {tuple(r) for r in D.malformed(df, columns(spark)).collect()} == {(2, "invalid_value"), (90, "column_count")}
    good = D.typed(df, columns(spark), "post").orderBy("line_id").collect()
    assert [(r.line_id, r.discussion_id, len(r.title)) for r in good] == [(0, 1, 1), (1, 1, 1), (7, 1, 300_000)]


def test_empty_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert D.malformed(empty, columns(spark)).count() == 0
    assert D.typed(empty, columns(spark), "post").count() == 0
    assert D.malformed(empty, spark.createDataFrame([], COLS)).count() == 0
