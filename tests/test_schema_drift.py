import json

import pytest

from sparkscape.operators import schema_drift as S

SCHEMA = "file_id bigint, series string, file_seq int, file_name string, line_no int, line_json string, kind string, path int"


def frame(spark, files):
    """files: {(series, seq): [record or text]}"""
    rows = []
    for k, ((s, q), recs) in enumerate(files.items()):
        rows += [(k, s, q, "n", i, r if r is None or isinstance(r, str) else json.dumps(r), "x", 1) for i, r in enumerate(recs)]
    return spark.createDataFrame(rows, SCHEMA)


def brute(files):
    """The rules of the change log, straight from the records."""
    out, ids = set(), {k: i for i, k in enumerate(files)}
    recs = {k: [S.record_of(r if r is None or isinstance(r, str) else json.dumps(r)) for r in v] for k, v in files.items()}
    for (s, q), i in ids.items():
        if (s, q - 1) not in ids:
            continue
        new, old = ([dict(S.members(d)) for d in recs[k] if d is not None] for k in ((s, q), (s, q - 1)))
        kinds = lambda rs: {p: {S.kind_of(r[p]) for r in rs if p in r} - {"null"} for p in {p for r in rs for p in r}}
        kn, ko = kinds(new), kinds(old)
        common = {json.dumps(r["t"]) for r in new if r.get("t") is not None} & {json.dumps(r["t"]) for r in old if r.get("t") is not None}
        at = lambda rs, p: {(json.dumps(r["t"]), S.canonical(r.get(p))) for r in rs if r.get("t") is not None and json.dumps(r["t"]) in common}
        used = set()
        for a in kn.keys() - ko.keys():
            for b in ko.keys() - kn.keys():
                if a.rpartition(".")[0] == b.rpartition(".")[0] and at(new, a) == at(old, b) and any(v != "nullnull" for _, v in at(new, a)):
                    out.add((i, "renamed", a, b))
                    used |= {("n", a), ("o", b)}
        out |= {(i, "added", p, "") for p in kn.keys() - ko.keys() if ("n", p) not in used}
        out |= {(i, "removed", p, "") for p in ko.keys() - kn.keys() if ("o", p) not in used}
        out |= {(i, "type", p, "") for p in kn.keys() & ko.keys() if kn[p] and ko[p] and kn[p] != ko[p]}
    return out


FILES = {
    ("a", 1): [{"t": 1, "agent_id": "x", "p": {"d": 1, "m": "u", "gone": [1]}}, {"t": 2, "agent_id": "y", "p": {"d": None, "m": "v"}}, {"t": 2, "agent_id": "y", "p": {"d": None, "m": "v"}}, None, "", "{broken", "[1]"],
    ("a", 2): [{"t": 2, "device_id": "y", "p": {"d": "3", "n": "v"}}, {"t": 3, "device_id": "z", "p": {"d": "1", "n": None, "o": {"q": 1.0}}}],
    ("a", 3): [{"t": 3, "device_id": "z", "p": {"d": 5, "o": {"q": 1}, "k": None}}, {"t": 4, "device_id": None, "p": 7}],
    ("a", 5): [{"t": 9}],
    ("b", 1): [{"t": 1, "x": 1, "y": 1}],
    ("b", 2): [{"t": 1, "z": 1, "w": 1.0}],
    ("b", 3): [None],
    ("c", 1): ["{}"],
    ("c", 2): [{"a": "é" * 5000}],
}


def test_changes_equal_brute_force(spark):
    got = {tuple(r) for r in S.changes(frame(spark, FILES)).collect()}
    assert got == brute(FILES)
    assert (1, "renamed", "device_id", "agent_id") in got and (1, "renamed", "p.n", "p.m") in got and (1, "type", "p.d", "") in got


def test_unified_columns(spark):
    df = S.read_unified(frame(spark, FILES))
    rows = {(r.file_id, r.line_no): r.asDict() for r in df.collect()}
    assert "agent_id" not in df.columns or "device_id" not in df.columns
    who = "device_id" if "device_id" in df.columns else "agent_id"
    assert rows[(0, 0)][who] == "x" and rows[(1, 1)][who] == "z"
    assert rows[(0, 0)]["p__d"] == "1" and rows[(1, 0)]["p__d"] == "3"
    assert rows[(2, 1)]["p"] == 7.0 and rows[(0, 5)]["corrupt_line"] == "{broken"
    assert df.count() == sum(map(len, FILES.values()))


def test_log_is_ordered(spark):
    rows = S.ordered_log(frame(spark, FILES)).collect()
    assert [(r.series, r.file_seq, r.position) for r in rows] == sorted((r.series, r.file_seq, r.position) for r in rows)
    assert {(r.file_id, r.change, r.field, r.old_field) for r in rows} == brute(FILES)
    assert [(r.change, r.field) for r in rows if r.file_id == 1] == [("renamed", "device_id"), ("renamed", "p.n"), ("removed", "p.gone"), ("added", "p.o"), ("added", "p.o.q"), ("type", "p.d")]


def test_no_value_changes_in_its_column(spark):
    files = {("a", 1): [{"i": 2**53 + 1, "d": 1, "m": 2**53 + 1, "h": 2**70, "b": True, "l": [1, {"x": 2}]}], ("a", 2): [{"i": -5, "d": 0.5, "m": 0.1, "h": 1, "b": None, "l": None}]}
    df = S.read_unified(frame(spark, files))
    assert {n: t for n, t in df.dtypes if len(n) == 1} == {"i": "bigint", "d": "double", "m": "string", "h": "string", "b": "boolean", "l": "string"}
    one, two = sorted(df.collect(), key=lambda r: r.file_id)
    assert (one.i, one.d, one.m, one.h, one.b, one.l) == (2**53 + 1, 1.0, str(2**53 + 1), str(2**70), True, '[1,{"x":2}]') and (two.i, two.m, two.h) == (-5, "0.1", "1")


def test_too_many_paths_are_refused(spark, monkeypatch):
    monkeypatch.setattr(S, "MOST_PATHS", 3)
    with pytest.raises(ValueError):
        S.read_unified(frame(spark, FILES))


def test_empty(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert S.changes(empty).count() == 0 and S.read_unified(empty).count() == 0


def test_lattice_is_commutative_associative_and_has_a_top():
    kinds = ["null", "boolean", "number", "array", "string"]
    for a in kinds:
        for b in kinds:
            assert S.promote(a, b) == S.promote(b, a)
            for c in kinds:
                assert S.promote(S.promote(a, b), c) == S.promote(a, S.promote(b, c))
    assert S.promote("number", "boolean") == "string"
