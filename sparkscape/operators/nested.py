"""Deeply nested records as related flat tables.

A bottom-up tree automaton gives every JSON node a state: scalars have one state
per kind, an array the set of its elements' states, an object the map of its
members' states. Equal shapes get equal states on every executor, as a state is
named by a digest of its transition. The state of a panel's node decides which of
its members hold children and of which table (EDGES); the state of a child, its
structural variant, decides the subtype: the members whose kind isn't the declared
one, such as "D_ckm:s". ``typed`` is the table of one subtype with that subtype's own
types, ``subtype`` has all subtypes of a table under the declared types. The common
keys (src, rec_id, child, places of parent and row) of the child tables are ``found``;
``panel``, ``g_state`` and ``sweep`` are the tables of their parents.

Of a record delivered more than once the last delivery counts (by received_at or written_at
where the table has it; of equal times the one of the larger digest). Rows without an id are
records of their own. Nesting may be of any depth.
"""

from __future__ import annotations

import hashlib
import json
import re as regex
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FIELDS = ("child", "parent_item", "item", "variant", "shape", "payload", "subtype", "rest")
KEYS = ["src", "rec_id", "child", "parent_item", "item"]
CHILDREN = ("thermostat", "alpha_trajectory", "top_coactivations", "a_post_per_alpha")
TYPED = {
    "panel": "sampling_mode string, D_ckm double, c_S double, fabrication_index double, n_rejected_pairs bigint",
    "g_state": "mode string, n_texts bigint, D_G double",
    "sweep": "W_label string, A0 bigint, A_pre bigint, D_ckm double, Perdida_STOP bigint, alpha_star double, t_stop bigint",
    "thermostat": "zone string, D_ckm double, A0 double, A_current double, frac_rec double, stop_applied boolean",
    "alpha_trajectory": "t bigint, alpha double, D_ckm double, landscape struct<A_antes:double,A_despues:double>",
    "top_coactivations": "a string, b string, weight double",
    "a_post_per_alpha": "alpha double, A_post double",
}
ANY = "osnbaz"
# table: (member, kinds of the member, kinds of the elements taken, their table)
EDGES = {
    "panel": (("thermostat", "oa", "o", "thermostat"), ("G_state", "o", "o", "g_state")),
    "thermostat": (("alpha_trajectory", "a", ANY.replace("z", ""), "alpha_trajectory"),),
    "g_state": (("top_coactivations", "a", ANY, "top_coactivations"),),
    "sweep": (("A_post_per_alpha", "", "", "a_post_per_alpha"),),
}
KIND = {"double": "n", "bigint": "n", "string": "s", "boolean": "b"}
COLUMN = {"n": "double", "s": "string", "b": "boolean", "a": "string", "o": "string"}
STRUCT = {"A_antes", "A_despues"}  # members of alpha_trajectory.landscape


def declared(child: str) -> dict[str, str]:
    """Member: type."""
    return dict(m.split(" ", 1) for m in regex.split(r",\s*(?![^<]*>)", TYPED[child]))


class ShapeAutomaton:
    """Deterministic bottom-up automaton over JSON trees, its transitions found as shapes come."""

    LEAF = {type(None): "z", bool: "b", int: "n", float: "n", str: "s"}
    KEPT = 50_000  # transitions and routes memoized; beyond that they are computed anew, with the same names
    DEEP = 100

    def __init__(self):
        self.names: dict[str, str] = {}
        self.routes: dict[tuple, object] = {}

    def name(self, transition: str) -> str:
        got = self.names.get(transition)
        if got is None:
            got = hashlib.md5(transition.encode("utf-8", "surrogatepass")).hexdigest()[:12]
            if len(self.names) < self.KEPT:
                self.names[transition] = got
        return got

    def tree(self, node, depth: int = 0) -> tuple[str, list | dict | None, object]:
        """(state, the same of elements or members, node)."""
        leaf = self.LEAF.get(type(node))
        if leaf:
            return leaf, None, node
        if depth > self.DEEP:
            return self.deep_tree(node)
        if type(node) is list:
            return self.closed(node, [self.tree(x, depth + 1) for x in node])
        return self.closed(node, {k: self.tree(v, depth + 1) for k, v in node.items()})

    def closed(self, node, kids) -> tuple[str, list | dict, object]:
        if type(node) is list:
            return "a" + self.name("|".join(sorted({k[0] for k in kids}))), kids, node
        return "o" + self.name(shape(kids, whole=True)), kids, node

    def deep_tree(self, node) -> tuple[str, list | dict | None, object]:
        """tree() without recursion: nodes are closed once all below them are."""
        done: list = []
        open_ = [(node, iter(node.items() if type(node) is dict else enumerate(node)), {})]
        while open_:
            at, rest, kids = open_[-1]
            for k, v in rest:
                leaf = self.LEAF.get(type(v))
                if not leaf:
                    kids[k] = None  # keeps the members' order
                    open_.append((v, iter(v.items() if type(v) is dict else enumerate(v)), {}))
                    break
                kids[k] = (leaf, None, v)
            else:
                open_.pop()
                done.append(self.closed(at, kids if type(at) is dict else list(kids.values())))
                if open_:
                    above = open_[-1][2]
                    above[next(reversed(above))] = done.pop()
        return done[0]

    def state(self, node) -> str:
        return self.tree(node)[0]

    def known(self, key: tuple, found):
        """found(), kept by key while there is room."""
        got = self.routes.get(key)
        if got is None:
            got = found()
            if len(self.routes) < self.KEPT:
                self.routes[key] = got
        return got

    def rows(self, role: str, tree, parent: str = "") -> Iterator[tuple]:
        """(child, parent_item, item, tree) of the child rows below a node, as its state routes them."""
        state, kids, _ = tree
        if state[0] != "o":
            return
        for member, taken, to in self.known((role, state), lambda: [(m, t, to) for m, forms, t, to in EDGES.get(role, ()) if m in kids and kids[m][0][0] in forms]):
            sub = kids[member]
            for place, e in enumerate(sub[1] if sub[0][0] == "a" else [sub]):
                if e[0][0] in taken:
                    own = "" if to == "g_state" else str(place)  # there is one
                    yield to, parent, own, e
                    yield from self.rows(to, e, own)

    def subtype(self, child: str, tree) -> tuple[str, str | None]:
        """(subtype, rest): the members of another kind than declared; JSON of these and of members not declared."""
        state, kids, node = tree
        if state[0] != "o":
            return "no object", dumped(node)

        def found():
            off, more = {}, []
            types = self.known((child,), lambda: declared(child))
            for k, (st, below, _) in kids.items():
                if k not in types:
                    if st != "z" and not any(k == m and (not forms or st[0] in forms) for m, forms, _, _ in EDGES.get(child, ())):
                        more.append(k)
                elif types[k].startswith("struct"):
                    if st != "z" and not (st[0] == "o" and set(below) <= STRUCT and all(x[0] in "nz" for x in below.values())):
                        off[k] = st[0]
                elif st != "z" and st != KIND[types[k]]:
                    off[k] = st[0]
            return off, more, [k for k, t in types.items() if t == "bigint" and k in kids and kids[k][0] == "n"]

        off, more, whole = self.known((child, state, "subtype"), found)
        broken = {k: "n" for k in whole if type(node[k]) is not int or not -(2**63) <= node[k] < 2**63}
        off = off | broken if broken else off
        rest = {k: node[k] for k in (*sorted(off), *sorted(more))}
        return ",".join(f"{k}:{v}" for k, v in sorted(off.items())), dumped(rest) if rest else None


def shape(kids: dict, whole: bool = False) -> str:
    """The members with their kinds, or with their whole states."""
    return ",".join(f"{k}:{v[0] if whole else v[0][0]}" for k, v in sorted(kids.items(), key=lambda m: m[0]))


TOKEN = regex.compile(r'[ \t\n\r]*(?:([\[{\]},:])|("(?:[^"\\]|\\.)*")|(-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?|true|false|null|-?Infinity|NaN))')


def deep_parsed(text: str):
    """JSON nested deeper than the json module goes; ValueError where it is broken."""
    at, stack, value, want = 0, [], None, "value"
    blank = regex.compile(r"[ \t\n\r]*")
    while True:
        m = TOKEN.match(text, at)
        if not m:
            raise ValueError("no JSON")
        at, sign = m.end(), m.group(1)
        if want in ("value", "first", "key", "first key") and (sign in ("[", "{") or not sign):
            if want in ("key", "first key"):
                if not m.group(2) or not (colon := regex.compile(r"[ \t\n\r]*:").match(text, at)):
                    raise ValueError("no member")
                stack[-1][1], at, want = json.loads(m.group(2)), colon.end(), "value"
                continue
            if sign:
                stack.append([[] if sign == "[" else {}, None])
                want = "first" if sign == "[" else "first key"
                continue
            value = json.loads(m.group(2) or m.group(3))
        elif sign in ("]", "}") and stack and (type(stack[-1][0]) is list) == (sign == "]") and want in ("comma", "first" if sign == "]" else "first key"):
            value = stack.pop()[0]
        elif sign == "," and want == "comma":
            want = "value" if type(stack[-1][0]) is list else "key"
            continue
        else:
            raise ValueError("no JSON")
        if not stack:
            if blank.match(text, at).end() < len(text):
                raise ValueError("more than one value")
            return value
        above, key = stack[-1]
        above.append(value) if type(above) is list else above.__setitem__(key, value)
        want = "comma"


def parsed(text):
    """The JSON value of a text; None for null, empty and broken ones."""
    try:
        return json.loads(text) if text else None
    except ValueError:
        return None
    except RecursionError:
        try:
            return deep_parsed(text)
        except ValueError:
            return None


def dumped(node) -> str:
    """JSON without blanks, of any depth."""
    try:
        return json.dumps(node, ensure_ascii=False, separators=(",", ":"))
    except RecursionError:
        out: list[str] = []
        todo: list = [node]
        while todo:
            x = todo.pop()
            if type(x) is tuple:
                out.append(x[0])
            elif type(x) is list:
                todo.append(("]",))
                for k in range(len(x) - 1, -1, -1):
                    todo += [x[k], (",",)] if k else [x[k]]
                out.append("[")
            elif type(x) is dict:
                todo.append(("}",))
                for k, (name, v) in reversed(list(enumerate(x.items()))):
                    todo += [v, (("," if k else "") + json.dumps(name, ensure_ascii=False) + ":",)]
                out.append("{")
            else:
                out.append(json.dumps(x, ensure_ascii=False))
        return "".join(out)


def items(node) -> list[tuple[int, object]]:
    """An array's places and elements; an object counts as an array of one."""
    if type(node) is list:
        return list(enumerate(node))
    return [(0, node)] if type(node) is dict else []


def one_decimal(alpha) -> str | None:
    try:
        x = float(alpha)
    except (TypeError, ValueError):
        return None
    return f"{x:.1f}" if x == x and abs(x) != float("inf") else None


def alphas(node) -> Iterator[tuple[str, object]]:
    """(alpha with one decimal, value) of the values that aren't null, from any of the forms.

    Forms: an object by alpha, an array of objects with alpha, an array of [alpha, value]
    pairs, JSON text of one of these. An alpha that is no number is left out.
    """
    if type(node) is str:
        node = parsed(node)
    if type(node) is dict:
        if "alpha" in node and one_decimal(node["alpha"]) is not None:
            node = [node]
        else:
            found = node.items()
    if type(node) is list:
        found = []
        for e in node:
            if type(e) is dict:
                rest = [v for k, v in e.items() if k != "alpha" and v is not None]
                found.append((e.get("alpha"), e["A_post"] if "A_post" in e else rest[0] if rest else None))
            elif type(e) is list and len(e) == 2:
                found.append(tuple(e))
    elif type(node) is not dict:
        return
    for a, v in found:
        key = one_decimal(a)
        if key is not None and v is not None:
            yield key, v


def panel_children(automaton: ShapeAutomaton, panel) -> Iterator[tuple]:
    """(table, parent_item, item, tree) of a monitor panel and its children."""
    tree = automaton.tree(panel)
    if tree[0][0] == "o":
        yield "panel", "", "", tree
    yield from automaton.rows("panel", tree)


def sweep_children(automaton: ShapeAutomaton, node) -> Iterator[tuple]:
    """(table, parent_item, item, tree) of a sweep record or an array of them; child rows have one form, whatever the record's."""
    for place, rec in items(node):
        if type(rec) is dict:
            yield "sweep", "", str(place), automaton.tree(rec)
            for a, v in alphas(rec.get("A_post_per_alpha")):
                yield "a_post_per_alpha", str(place), a, automaton.tree({"alpha": float(a), "A_post": v})


def _rows(df: DataFrame, src: str, key: str, text: str, order: str, walk, tables: tuple, fields: tuple) -> DataFrame:
    """src, rec_id and the wanted fields of the rows of some tables, of each record's last delivery.

    A task sends one row a record, so that deliveries meet as whole records."""
    struct = ", ".join(f"{f}: string" for f in fields)

    def run(batches):
        automaton = ShapeAutomaton()
        for batch in batches:
            out = []
            for doc in batch.column(3).to_pylist():
                rows = []
                for child, parent, item, tree in walk(automaton, parsed(doc)):
                    if child in tables:
                        state, kids, node = tree
                        subtype, rest = automaton.subtype(child, tree)
                        row = {"child": child, "parent_item": parent, "item": item, "variant": state, "shape": shape(kids) if state[0] == "o" else "", "subtype": subtype, "rest": rest}
                        if "payload" in fields:
                            row["payload"] = dumped(node)
                        rows.append({f: row[f] for f in fields})
                out.append(rows)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(out, pa.list_(pa.struct([(f, pa.string()) for f in fields])))], names=["rec", "own", "arrived", "rows"])

    arrived = F.col(order).cast("timestamp") if order in df.columns else F.lit(None).cast("timestamp")
    digest = F.xxhash64(text)
    took = df.select(F.col(key).cast("bigint").alias("rec"), F.when(F.col(key).isNull(), digest).alias("own"), F.struct(arrived.alias("at"), digest.alias("h")).alias("arrived"), F.col(text).alias("doc"))
    last = took.mapInArrow(run, f"rec bigint, own bigint, arrived struct<at: timestamp, h: bigint>, rows array<struct<{struct}>>").groupBy("rec", "own").agg(F.max_by("rows", "arrived").alias("rows"))
    return last.select(F.lit(src).alias("src"), F.col("rec").alias("rec_id"), F.explode("rows").alias("r")).select("src", "rec_id", "r.*")


def rows_of(trajectory: DataFrame, sweep: DataFrame, tables: tuple = tuple(TYPED), fields: tuple = FIELDS) -> DataFrame:
    """Rows of the wanted tables with keys, structural variant, subtype and payload (JSON), from the sources that hold them.

    Null, broken and other JSON gives no rows."""
    parts = []
    if set(tables) - {"sweep", "a_post_per_alpha"}:
        parts.append(_rows(trajectory, "monitor_trajectory", "rec_id", "panel", "received_at", panel_children, tables, fields))
    if set(tables) & {"sweep", "a_post_per_alpha"}:
        parts.append(_rows(sweep, "reg_sweep_stop_perdida_v1", "sweep_id", "record_json", "written_at", sweep_children, tables, fields))
    return parts[0].unionByName(parts[1]) if len(parts) > 1 else parts[0]


def found(trajectory: DataFrame, sweep: DataFrame) -> DataFrame:
    """src, rec_id, child, parent_item, item: the keys of the child tables' rows, each once."""
    return rows_of(trajectory, sweep, CHILDREN, ("child", "parent_item", "item")).select(*KEYS).distinct()


def subtype(trajectory: DataFrame, sweep: DataFrame, child: str) -> DataFrame:
    """The flat table of one child with all its subtypes under the declared types, with keys and variant.

    Members of another type than declared are null and stand, with members not declared, as
    JSON in ``rest``; a child element that is no object has nulls in all typed columns and
    its JSON in ``rest``. Two rows of a record with the same keys (an alpha written twice)
    both stay where their content differs.
    """
    v = rows_of(trajectory, sweep, (child,)).distinct().withColumn("t_", F.from_json("payload", TYPED[child]))
    columns = [F.when(~F.col("subtype").rlike(f"(^|,){m}:"), F.col(f"t_.{m}")).alias(m) for m in declared(child)]
    return v.select("src", "rec_id", "parent_item", "item", "variant", "shape", "subtype", *columns, "rest")


def typed(trajectory: DataFrame, sweep: DataFrame, child: str, name: str) -> DataFrame:
    """The typed table of one subtype, such as thermostat's "D_ckm:s", where D_ckm is a string; "" is as declared."""
    types = declared(child) | {k: COLUMN[v] for k, v in (m.rsplit(":", 1) for m in name.split(",") if m)}
    rows = rows_of(trajectory, sweep, (child,)).distinct().where(F.col("subtype") == name)
    v = rows.withColumn("t_", F.from_json("payload", ", ".join(f"{m} {t}" for m, t in types.items())))
    return v.select("src", "rec_id", "parent_item", "item", "variant", "t_.*", "rest")


MEASURE = {"thermostat": "D_ckm", "alpha_trajectory": "alpha", "top_coactivations": "weight", "a_post_per_alpha": "A_post"}


def values(trajectory: DataFrame, sweep: DataFrame) -> DataFrame:
    """Keys and the measured value of every child row (null where it isn't a number), all children in one table."""
    rows = rows_of(trajectory, sweep, CHILDREN, ("child", "parent_item", "item", "payload")).distinct()
    members = ", ".join(f"{m} double" for m in MEASURE.values())
    v = rows.withColumn("v_", F.from_json("payload", members))
    value = F.coalesce(*(F.when(F.col("child") == c, F.col(f"v_.{m}")) for c, m in MEASURE.items()))
    return v.select(*KEYS, value.alias("value"))


def variants(trajectory: DataFrame, sweep: DataFrame) -> DataFrame:
    """Catalogue of structural variants: child, variant, shape, number of rows and records."""
    rows = rows_of(trajectory, sweep, CHILDREN, ("child", "parent_item", "item", "variant", "shape")).distinct()
    return rows.groupBy("child", "variant", "shape").agg(F.count("*").alias("n_rows"), F.count_distinct("src", "rec_id").alias("n_records"))


def shapes(trajectory: DataFrame, sweep: DataFrame) -> DataFrame:
    """Catalogue of all tables by shape (members and kinds) and subtype: child, shape, subtype, n_rows."""
    rows = rows_of(trajectory, sweep, fields=("child", "parent_item", "item", "shape", "subtype")).distinct()
    return rows.groupBy("child", "shape", "subtype").agg(F.count("*").alias("n_rows"))
