import json

import pytest

from sparkscape.operators import nested as N

TR = "rec_id bigint, series string, panel string, item string, child int"
SW = "sweep_id bigint, record_json string, src string"


def test_rows_links_and_forms(spark):
    panel = {"thermostat": [None, {}, {"zone": "z", "alpha_trajectory": [{"alpha": 0.5}, None, {"alpha": 0.1}]}, 7], "G_state": {"top_coactivations": [{"a": "x", "b": "y", "weight": 1}, None]}}
    t = spark.createDataFrame(
        [(1, "s", json.dumps(panel), "c", 1), (1, "s", json.dumps(panel), "c", 1), (2, "s", json.dumps({"thermostat": {"zone": 1, "alpha_trajectory": "no"}}), "c", 1), (3, "s", None, "c", 1), (4, "s", "{broken", "c", 1), (5, "s", "[1]", "c", 1), (6, "s", "{}", "c", 1), (None, None, json.dumps({"thermostat": {}}), None, None)], TR
    )
    w = spark.createDataFrame(
        [(1, json.dumps({"A_post_per_alpha": {"0.00": 1, "0.50": None, "1.0": 2, "x": 3}}), "c"), (2, json.dumps([None, {"A_post_per_alpha": [{"alpha": 0.1, "A_post": 4}, {"alpha": 0.2, "A_post": None}, [0.3, 5]]}, {}]), "c"), (3, None, "c"), (4, json.dumps({"A_post_per_alpha": "[[0.4, 1]]"}), "c")], SW
    )
    got = {tuple(r) for r in N.found(t, w).collect()}
    m, r = "monitor_trajectory", "reg_sweep_stop_perdida_v1"
    assert got == {
        (m, 1, "thermostat", "", "1"), (m, 1, "thermostat", "", "2"), (m, 1, "alpha_trajectory", "2", "0"), (m, 1, "alpha_trajectory", "2", "2"),
        (m, 1, "top_coactivations", "", "0"), (m, 1, "top_coactivations", "", "1"), (m, 2, "thermostat", "", "0"), (m, None, "thermostat", "", "0"),
        (r, 1, "a_post_per_alpha", "0", "0.0"), (r, 1, "a_post_per_alpha", "0", "1.0"), (r, 2, "a_post_per_alpha", "1", "0.1"), (r, 2, "a_post_per_alpha", "1", "0.3"), (r, 4, "a_post_per_alpha", "0", "0.4"),
    }
    assert N.subtype(t, w, "thermostat").where("rec_id = 1").count() == 2
    assert N.subtype(t, w, "top_coactivations").where("rest is not null").count() == 1


def test_each_variant_keeps_its_values(spark):
    panel = {"thermostat": [{"zone": "z", "D_ckm": "0.4623", "note": [1]}, {"zone": 5, "D_ckm": 0.5, "alpha_trajectory": "no"}, {"D_ckm": 1, "A0": None, "alpha_trajectory": [{"t": 1.5, "landscape": {"A_antes": 1, "more": 2}}, {"t": 2, "landscape": {"A_antes": 1}}]}]}
    t, w = spark.createDataFrame([(1, "s", json.dumps(panel), "c", 1)], TR), spark.createDataFrame([], SW)
    got = {r["item"]: r for r in N.subtype(t, w, "thermostat").collect()}
    assert [(r.subtype, r.D_ckm, r.zone, r.rest and json.loads(r.rest)) for _, r in sorted(got.items())] == [
        ("D_ckm:s", None, "z", {"D_ckm": "0.4623", "note": [1]}), ("zone:n", 0.5, None, {"zone": 5, "alpha_trajectory": "no"}), ("", 1.0, None, None),
    ]
    text = N.typed(t, w, "thermostat", "D_ckm:s")
    assert dict(text.dtypes)["D_ckm"] == "string" and [(r["item"], r.zone, r.D_ckm) for r in text.collect()] == [("0", "z", "0.4623")]
    assert [r.zone for r in N.typed(t, w, "thermostat", "zone:n").collect()] == [5.0]
    way = {r["item"]: r for r in N.subtype(t, w, "alpha_trajectory").collect()}
    assert (way["0"].subtype, way["0"].t, json.loads(way["0"].rest)) == ("landscape:o,t:n", None, {"landscape": {"A_antes": 1, "more": 2}, "t": 1.5})
    tops = json.dumps({"G_state": {"top_coactivations": [{"a": "x", "b": "y", "weight": [1]}]}})
    top = N.subtype(spark.createDataFrame([(1, "s", tops, "c", 1)], TR), w, "top_coactivations").collect()
    assert [(r.a, r.b, r.weight, r.rest) for r in top] == [("x", "y", None, '{"weight":[1]}')]
    assert way["1"].t == 2 and way["1"].landscape.A_antes == 1 and way["1"].rest is None and way["1"].parent_item == "2"


def test_deep_members_are_passed_over(spark):
    deep = '{"other": ' + "[" * 900 + "]" * 900 + ', "thermostat": {"zone": "z"}}'
    assert N.found(spark.createDataFrame([(1, "s", deep, "c", 1)], TR), spark.createDataFrame([], SW)).count() == 1


def test_any_depth(spark):
    for n in (400, 5_000, 60_000):
        deep = '{"x": [' * n + "1" + "]}" * n
        doc = f'{{"thermostat": {{"zone": "z", "other": {deep}}}}}'
        rows = N.rows_of(spark.createDataFrame([(1, "s", doc, "c", 1)], TR), spark.createDataFrame([], SW), ("thermostat",)).collect()
        assert len(rows) == 1 and rows[0].shape == "other:o,zone:s" and rows[0].rest == '{"other":' + deep.replace(" ", "") + "}"
    a = N.ShapeAutomaton()
    tree, shallow = N.deep_parsed('[{"a": [1, {"b": null}], "c": "\\u00e9\\""}, -1.5e3, true]'), [{"a": [1, {"b": None}], "c": 'é"'}, -1500.0, True]
    assert tree == shallow and a.deep_tree(tree) == a.tree(shallow)
    for broken in ("[", "[1,]", '{"a" 1}', '{"a": 1,}', "[1] 2", "{1: 2}", "]", '{"a": }', "[}", "nul", ""):
        with pytest.raises(ValueError):
            N.deep_parsed(broken)


def test_last_delivery_counts(spark):
    one, two = ({"thermostat": [{"zone": z} for z in zs]} for zs in ("abc", "de"))
    t = spark.createDataFrame([(1, "2024-01-01", json.dumps(one)), (1, "2024-01-02", json.dumps(two)), (2, "2024-01-02", None), (2, "2024-01-01", json.dumps(one)), (None, None, json.dumps(one)), (None, None, json.dumps(two))], "rec_id bigint, received_at string, panel string")
    rows = N.subtype(t, spark.createDataFrame([], SW), "thermostat").collect()
    assert sorted((r.rec_id or 0, r["item"], r.zone) for r in rows) == [(0, "0", "a"), (0, "0", "d"), (0, "1", "b"), (0, "1", "e"), (0, "2", "c"), (1, "0", "d"), (1, "1", "e")]


def test_parents(spark):
    panel = {"sampling_mode": "u", "D_ckm": 0.5, "thermostat": [{}], "G_state": {"mode": "m", "n_texts": 3, "top_coactivations": [{"a": "x"}]}, "more": [1]}
    t = spark.createDataFrame([(1, "s", json.dumps(panel), "c", 1)], TR)
    w = spark.createDataFrame([(7, json.dumps([{"A0": 3, "A_post_per_alpha": {"0.5": 1}}]), "c")], SW)
    p, g, s = (N.subtype(t, w, c).first() for c in ("panel", "g_state", "sweep"))
    assert (p.rec_id, p.sampling_mode, p.D_ckm, p.rest) == (1, "u", 0.5, '{"more":[1]}') and (g["mode"], g.n_texts, g["item"]) == ("m", 3, "")
    assert (s.rec_id, s["item"], s.A0, s.rest) == (7, "0", 3, None) and N.subtype(t, w, "a_post_per_alpha").first().parent_item == "0"


def test_empty(spark):
    assert N.found(spark.createDataFrame([], TR), spark.createDataFrame([], SW)).count() == 0


def test_states_name_shapes():
    a, b = N.ShapeAutomaton(), N.ShapeAutomaton()
    b.state({"other": [1, "x"]})
    assert a.state({"x": 1, "y": [1, 2.5]}) == b.state({"y": [9], "x": 2})
    assert a.state({"x": 1}) != a.state({"x": "1"}) and a.state([1, None]) != a.state([1])
