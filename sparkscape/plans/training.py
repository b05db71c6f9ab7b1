"""Queries of the general training-data problems (1, 2, 5) and their SQL."""

from __future__ import annotations

from sparkscape.operators import dirty_rows, nested, schema_drift
from sparkscape.session import table


def _dump(spark, d):
    return table(spark, d, "dump_line"), table(spark, d, "dump_column")


def _nested(spark, d):
    return table(spark, d, "monitor_trajectory"), table(spark, d, "reg_sweep_stop_perdida_v1")


QUERIES = {
    "p1_found": lambda s, d: dirty_rows.malformed(*_dump(s, d)),
    "p1_valid_post": lambda s, d: dirty_rows.typed(*_dump(s, d), "post"),
    "p1_valid_qr_entry": lambda s, d: dirty_rows.typed(*_dump(s, d), "mturk_2010_qr_entry"),
    "p1_reasons": lambda s, d: dirty_rows.load_records(*_dump(s, d), keep=False).groupBy("table_name", "fmt", "kind", "reason").count().withColumnRenamed("count", "n"),
    "p2_found": lambda s, d: schema_drift.changes(table(s, d, "trajectory_line")),
    "p2_log": lambda s, d: schema_drift.ordered_log(table(s, d, "trajectory_line")),
    "p2_schema": lambda s, d: schema_drift.typed_schema(table(s, d, "trajectory_line")),
    "p2_unified": lambda s, d: schema_drift.read_unified(table(s, d, "trajectory_line")),
    "p5_found": lambda s, d: nested.found(*_nested(s, d)),
    "p5_panel": lambda s, d: nested.subtype(*_nested(s, d), "panel").drop("variant"),
    "p5_g_state": lambda s, d: nested.subtype(*_nested(s, d), "g_state").drop("variant"),
    "p5_sweep": lambda s, d: nested.subtype(*_nested(s, d), "sweep").drop("variant"),
    "p5_thermostat": lambda s, d: nested.subtype(*_nested(s, d), "thermostat").drop("variant"),
    "p5_thermostat_text": lambda s, d: nested.typed(*_nested(s, d), "thermostat", "D_ckm:s").drop("variant"),
    "p5_alpha_trajectory": lambda s, d: nested.subtype(*_nested(s, d), "alpha_trajectory").select("*", "landscape.*").drop("variant", "landscape"),
    "p5_top_coactivations": lambda s, d: nested.subtype(*_nested(s, d), "top_coactivations").drop("variant"),
    "p5_a_post_per_alpha": lambda s, d: nested.subtype(*_nested(s, d), "a_post_per_alpha").drop("variant"),
    "p5_values": lambda s, d: nested.values(*_nested(s, d)),
    "p5_shapes": lambda s, d: nested.shapes(*_nested(s, d)),
    "p5_variants": lambda s, d: nested.variants(*_nested(s, d)),
}

# One pattern per rule, independent of the engine's scanner. F is a field, closed or unquoted.
_SQL_F = r"""(?:[ \t\r\n]*''(?:[^''\\]|\\(?:.|\n)|'''')*''[ \t\r\n]*|[^'',)]*)"""
_CSV_F = r"""(?:[ \t\r\n]*"(?:[^"]|"")*"[ \t\r\n]*|[^",]*)"""
_P1_BASE = rf"""
l as (select *, trim(line, e' \t\r\n') as s from dump_line),
r as (select * from l where s <> '' and not (fmt = 'sql' and (starts_with(s, '--') or starts_with(s, 'INSERT INTO')))
  and not (fmt = 'csv' and (starts_with(s, '#') or s in ('discussion_id,post_id,author_id,posted_at,parent_post_id,title', 'page,tab,discussion_id,post_id,quote_index,presented')))),
k as (select *,
  case fmt when 'sql' then regexp_matches(s, '\A\(?{_SQL_F}(?:,{_SQL_F})*(?:\z|\))') else regexp_matches(s, '\A{_CSV_F}(?:,{_CSV_F})*\z') end as quoted,
  case fmt when 'sql' then regexp_matches(s, '\A\({_SQL_F}(?:,{_SQL_F}){{5}}\)[,; \t\r\n]*\z') else regexp_matches(s, '\A{_CSV_F}(?:,{_CSV_F}){{5}}\z') end as counted
  from r),
g as (select *, case fmt when 'sql' then regexp_extract(s, '\A\(({_SQL_F}),({_SQL_F}),({_SQL_F}),({_SQL_F}),({_SQL_F}),({_SQL_F})\)[,; \t\r\n]*\z', ['1','2','3','4','5','6'])
  else regexp_extract(s, '\A({_CSV_F}),({_CSV_F}),({_CSV_F}),({_CSV_F}),({_CSV_F}),({_CSV_F})\z', ['1','2','3','4','5','6']) end as f
  from k),
c as (select line_id, table_name, fmt, quoted, counted, unnest(['1','2','3','4','5','6']) as i, unnest([f['1'], f['2'], f['3'], f['4'], f['5'], f['6']]) as v from g),
t as (select *, trim(v, e' \t\r\n') as w from c),
u as (select *, case when (fmt = 'sql' and upper(w) = 'NULL') or (fmt = 'csv' and w = '') then null
   when fmt = 'sql' and starts_with(w, '''') then w[2:-2] when fmt = 'csv' and starts_with(w, '"') then w[2:-2] else w end as x from t),
b as (select line_id, fmt, table_name, any_value(quoted) as quoted, any_value(counted) as counted,
  bool_and(coalesce(case when x is null then q.is_nullable = 1
    when q.data_type = 'int' then regexp_full_match(x, '[0-9]+') and try_cast(x as hugeint) between q.min_value and q.max_value
    when q.data_type = 'timestamp' then regexp_full_match(x, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}} [0-9]{{2}}:[0-9]{{2}}:[0-9]{{2}}') and try_cast(x as timestamp) is not null
    else true end, false)) as fits
  from u join dump_column q using (table_name) where q.ordinal = i::int group by all)
"""



def _p1_valid(name: str, columns: list[tuple[str, str]]) -> str:
    cells = ", ".join(f"max(y) filter (i = '{k + 1}')::{t} as {c}" for k, (c, t) in enumerate(columns))
    text = r"""case when fmt = 'sql' and starts_with(w, '''') then regexp_replace(x, '(?s)\\(.)|''('')', '\1\2', 'g') when fmt = 'csv' and starts_with(w, '"') then replace(x, '""', '"') else x end"""
    return f"with {_P1_BASE}, ok as (select line_id from b where quoted and counted and fits), z as (select u.line_id, u.i, {text} as y from u join ok using (line_id) where u.table_name = '{name}') select line_id, {cells} from z group by 1"


_POST = [("discussion_id", "bigint"), ("post_id", "bigint"), ("author_id", "bigint"), ("posted_at", "timestamp"), ("parent_post_id", "bigint"), ("title", "varchar")]
_QR = [("page", "bigint"), ("tab", "bigint"), ("discussion_id", "bigint"), ("post_id", "bigint"), ("quote_index", "bigint"), ("presented", "varchar")]

_P5 = """
with p as (select distinct rec_id, panel::json as j from monitor_trajectory where panel is not null),
h as (select rec_id, json_extract(j, '$.thermostat') as th, json_extract(j, '$.G_state.top_coactivations') as tops from p),
t as (select rec_id, 0::bigint as item, th as e from h where json_type(th) = 'OBJECT'
  union all select rec_id, i, json_extract(th, '$[' || i || ']') from (select rec_id, th, unnest(range(json_array_length(th)::bigint)) as i from h where json_type(th) = 'ARRAY')),
o as (select * from t where json_type(e) = 'OBJECT'),
w as (select rec_id, item, json_extract(e, '$.alpha_trajectory') as a from o),
v as (select rec_id, item, i, json_extract(a, '$[' || i || ']') as e from (select rec_id, item, a, unnest(range(json_array_length(a)::bigint)) as i from w where json_type(a) = 'ARRAY')),
s as (select sweep_id, record_json::json as j from reg_sweep_stop_perdida_v1 where record_json is not null),
r as (select sweep_id, 0::bigint as place, j as e from s where json_type(j) = 'OBJECT'
  union all select sweep_id, i, json_extract(j, '$[' || i || ']') from (select sweep_id, j, unnest(range(json_array_length(j)::bigint)) as i from s where json_type(j) = 'ARRAY')),
m as (select sweep_id, place, json_extract(e, '$.A_post_per_alpha') as a from r),
k as (select sweep_id, place, key as alpha, json_extract(a, '$."' || key || '"') as x from (select sweep_id, place, a, unnest(json_keys(a)) as key from m where json_type(a) = 'OBJECT')
  union all select sweep_id, place, json_extract_string(a, '$[' || i || '].alpha'), json_extract(a, '$[' || i || '].A_post') from (select sweep_id, place, a, unnest(range(json_array_length(a)::bigint)) as i from m where json_type(a) = 'ARRAY'))
"""

# The rows of each table: (keys and JSON e, source).
_P5_ROWS = {
    "panel": ("select rec_id, '' as parent_item, '' as item, j as e from p where json_type(j) = 'OBJECT'", "monitor_trajectory"),
    "g_state": ("select rec_id, '' as parent_item, '' as item, json_extract(j, '$.G_state') as e from p where json_type(j, '$.G_state') = 'OBJECT'", "monitor_trajectory"),
    "thermostat": ("select rec_id, '' as parent_item, item::varchar as item, e from o", "monitor_trajectory"),
    "alpha_trajectory": ("select rec_id, item::varchar as parent_item, i::varchar as item, e from v where json_type(e) <> 'NULL'", "monitor_trajectory"),
    "top_coactivations": ("select rec_id, '' as parent_item, i::varchar as item, json_extract(tops, '$[' || i || ']') as e from (select rec_id, tops, unnest(range(json_array_length(tops)::bigint)) as i from h where json_type(tops) = 'ARRAY')", "monitor_trajectory"),
    "sweep": ("select sweep_id as rec_id, '' as parent_item, place::varchar as item, e from r where json_type(e) = 'OBJECT'", "reg_sweep_stop_perdida_v1"),
    "a_post_per_alpha": ("select distinct sweep_id as rec_id, place::varchar as parent_item, printf('%.1f', alpha::double) as item, json_object('alpha', printf('%.1f', alpha::double)::double, 'A_post', x) as e from k where json_type(x) <> 'NULL'", "reg_sweep_stop_perdida_v1"),
}
_P5_EDGES = {"panel": "(c = 'thermostat' and kd in ('o', 'a') or c = 'G_state' and kd = 'o')", "g_state": "(c = 'top_coactivations' and kd = 'a')", "thermostat": "(c = 'alpha_trajectory' and kd = 'a')", "sweep": "c = 'A_post_per_alpha'"}
_P5_KIND = {"string": "s", "double": "n", "bigint": "n", "boolean": "b"}
_P5_CELL = {"string": "{} ->> '$'", "double": "({})::double", "bigint": "({})::bigint", "boolean": "({})::boolean"}


def _p5_members(child: str) -> str:
    """CTEs of one table: e_ (rows), m_ (members with kind, whether off or more), g_ (shape, subtype, rest)."""
    kinds = {m: t for m, t in nested.declared(child).items() if not t.startswith("struct")}
    off = " or ".join(f"c = '{m}' and (kd not in ('z', '{_P5_KIND[t]}')" + (" or kd = 'n' and json_type(x) = 'DOUBLE')" if t == "bigint" else ")") for m, t in kinds.items())
    if child == "alpha_trajectory":
        off += " or c = 'landscape' and kd <> 'z' and (kd <> 'o' or len(list_filter(json_keys(x), lambda y: y not in ('A_antes', 'A_despues'))) > 0)"
    known = ", ".join(f"'{m}'" for m in nested.declared(child))
    more = f"c not in ({known}) and kd <> 'z' and not {_P5_EDGES.get(child, 'false')}"
    return f"""e_{child} as ({_P5_ROWS[child][0]}),
k_{child} as (select *, unnest(range(len(json_keys(e))::bigint)) as nr from e_{child} where json_type(e) = 'OBJECT'),
n_{child} as (select rec_id, parent_item, item, nr, json_keys(e)[nr + 1] as c, json_extract(e, '$."' || json_keys(e)[nr + 1] || '"') as x from k_{child}),
q_{child} as (select *, case json_type(x) when 'NULL' then 'z' when 'BOOLEAN' then 'b' when 'VARCHAR' then 's' when 'ARRAY' then 'a' when 'OBJECT' then 'o' else 'n' end as kd from n_{child}),
m_{child} as (select *, ({off}) as is_off, ({more}) as is_more from q_{child}),
g_{child} as (select rec_id, parent_item, item, string_agg(c || ':' || kd, ',' order by c) as shape, coalesce(string_agg(c || ':' || kd, ',' order by c) filter (is_off), '') as subtype,
  '{{' || string_agg('"' || c || '":' || x::varchar, ',' order by is_more, c) filter (is_off or is_more) || '}}' as rest from m_{child} group by all),
s_{child} as (select e.*, case when json_type(e) = 'OBJECT' then coalesce(shape, '') else '' end as shape, case when json_type(e) = 'OBJECT' then coalesce(subtype, '') else 'no object' end as subtype,
  case when json_type(e) = 'OBJECT' then rest else e::varchar end as rest from e_{child} e left join g_{child} using (rec_id, parent_item, item))"""


def _p5_table(child: str, only: str = "", text: tuple = ()) -> str:
    kinds = nested.declared(child)
    cells = []
    for m, t in kinds.items():
        if t.startswith("struct"):
            cells += [f"json_extract(e, '$.{m}.{f}')::double as {f}" for f in ("A_antes", "A_despues")]
            continue
        t = "string" if m in text else t
        kind = _P5_KIND[t]
        x = f"json_extract(e, '$.{m}')"
        right = {"s": f"json_type({x}) = 'VARCHAR'", "b": f"json_type({x}) = 'BOOLEAN'", "n": f"json_type({x}) in ('UBIGINT', 'BIGINT'" + (")" if t == "bigint" else ", 'DOUBLE')")}[kind]
        cells.append(f"case when {right} then {_P5_CELL[t].format(x)} end as {m}")
    shown = "" if only else "shape, subtype, "
    return f"{_P5}, {_p5_members(child)} select '{_P5_ROWS[child][1]}' as src, rec_id, parent_item, item, {shown}{', '.join(cells)}, rest from s_{child}" + (f" where subtype = '{only}'" if only else "")


_P2 = """
with x as (select distinct file_id, series, file_seq, line_json::json as j from trajectory_line),
w as (select file_id, x.j ->> '$.t' as t, replace(n.fullkey[3:], '"', '') as path, n.type as ty, n.value as v from x, json_tree(x.j) n where n.fullkey <> '$' and not contains(n.fullkey, '[')),
c as (select file_id, t, path, case when ty in ('UBIGINT', 'BIGINT', 'HUGEINT', 'UHUGEINT', 'DOUBLE') then 'number' when ty = 'VARCHAR' then 'string' else lower(ty) end as kind, case when ty in ('UBIGINT', 'BIGINT', 'DOUBLE') then (v::double)::varchar else v::varchar end as v from w),
f as (select file_id, path, coalesce(list_sort(list(distinct kind) filter (kind <> 'null')), []) as kinds from c group by all),
fs as (select distinct file_id, series, file_seq from x),
pr as (select n.file_id, o.file_id as old_id from fs n join fs o on n.series = o.series and n.file_seq = o.file_seq + 1),
nw as (select pr.*, path, kinds from pr join f using (file_id)),
ol as (select pr.*, path, kinds from pr join f on f.file_id = pr.old_id),
ad as (select *, regexp_replace(path, '[.]?[^.]*$', '') as parent from nw anti join ol using (file_id, path)),
rm as (select *, regexp_replace(path, '[.]?[^.]*$', '') as parent from ol anti join nw using (file_id, path)),
ct as (select distinct pr.file_id, a.t from pr join c a on a.file_id = pr.file_id join c b on b.file_id = pr.old_id and b.t = a.t),
sa as (select ad.file_id, ad.parent, ad.path, list_sort(list(distinct c.t || ' ' || kind || ' ' || v)) as sig from ad join c on c.file_id = ad.file_id and c.path = ad.path and kind <> 'null' join ct on ct.file_id = ad.file_id and ct.t = c.t group by all),
sr as (select rm.file_id, rm.parent, rm.path, list_sort(list(distinct c.t || ' ' || kind || ' ' || v)) as sig from rm join c on c.file_id = rm.old_id and c.path = rm.path and kind <> 'null' join ct on ct.file_id = rm.file_id and ct.t = c.t group by all),
rn as (select sa.file_id, sa.path as field, sr.path as old_field from sa join sr using (file_id, parent, sig))
"""

_P2_CHANGES = """select file_id, 'added' as change, path as field, '' as old_field from ad where not exists (select 1 from rn where rn.file_id = ad.file_id and rn.field = ad.path)
union all select file_id, 'removed', path, '' from rm where not exists (select 1 from rn where rn.file_id = rm.file_id and rn.old_field = rm.path)
union all select nw.file_id, 'type', path, '' from nw join ol using (file_id, path) where len(nw.kinds) > 0 and len(ol.kinds) > 0 and nw.kinds <> ol.kinds
union all select file_id, 'renamed', field, old_field from rn"""

# The unified table of the tables at scale 0.01: column, type, paths under one name. SQL can't find its own columns.
_P2_COLUMNS = [
    ("agent_id", "string", "agentId agent_id device device_id"), ("message_id", "string", "message_id"), ("panel__D_G", "string", "panel.D_G"), ("panel__D_ckm", "string", "panel.D_ckm"),
    ("panel__Delta_r_sum", "string", "panel.Delta_r_sum panel.delta_sum"), ("panel__G_state__D_G", "string", "panel.G_state.D_G"), ("panel__G_state__D_G__ref", "string", "panel.G_state.D_G.ref"),
    ("panel__G_state__D_G__value", "double", "panel.G_state.D_G.value"), ("panel__G_state__G_sparsity", "double", "panel.G_state.G_sparsity"), ("panel__G_state__active_behavior", "string", "panel.G_state.active_behavior"),
    ("panel__G_state__mode", "string", "panel.G_state.mode"), ("panel__G_state__n_texts", "bigint", "panel.G_state.n_textos panel.G_state.n_texts"), ("panel__G_state__termap_version", "string", "panel.G_state.termap_version"),
    ("panel__N_eff", "double", "panel.N_eff panel.n_eff"), ("panel__N_eff0", "double", "panel.N_eff0"), ("panel__activos_prompt", "string", "panel.activos_prompt"), ("panel__c_S", "double", "panel.cS panel.c_S"),
    ("panel__cola_orbita", "bigint", "panel.cola_orbita"), ("panel__fabrication_index", "double", "panel.fab_index panel.fabrication_index"), ("panel__n_rejected_pairs", "string", "panel.n_expulsados panel.n_rejected_pairs"),
    ("panel__sampling_mode", "string", "panel.sampling_mode"), ("panel__sampling_mode__n_warmup", "bigint", "panel.sampling_mode.n_warmup"), ("panel__sampling_mode__name", "string", "panel.sampling_mode.name"),
    ("panel__thermostat", "string", "panel.thermostat"), ("reloj", "string", "reloj"), ("t", "bigint", "t"), ("text", "string", "text"),
]


def _p2_cell(path: str, kind: str) -> str:
    x = f"json_extract(j, '$.{path}')"
    if kind == "string":
        return f"case json_type({x}) when 'VARCHAR' then {x} ->> '$' when 'NULL' then null when 'OBJECT' then null else {x}::varchar end"
    return f"case when json_type({x}) in ('UBIGINT', 'BIGINT'{', ' + repr('DOUBLE') if kind == 'double' else ''}) then ({x})::{kind} end"


SQL = {
    "p2_unified": "with l as (select file_id, line_no, line_json, case when json_valid(line_json) and json_type(line_json) = 'OBJECT' then line_json::json end as j from trajectory_line) select file_id, line_no, case when j is null then line_json end as corrupt_line, "
    + ", ".join(f"coalesce({', '.join(_p2_cell(p, k) for p in ps.split())}) as {n}" for n, k, ps in _P2_COLUMNS)
    + " from l",
    "p2_log": f"{_P2}, ch as ({_P2_CHANGES}) select series, file_seq::bigint as file_seq, row_number() over (partition by file_id order by case change when 'renamed' then 0 when 'removed' then 1 when 'added' then 2 else 3 end, field, old_field)::int - 1 as position, file_id, change, field, old_field from ch join fs using (file_id)",
    "p2_schema": f"""{_P2}, ks as (select path, list(distinct case when ty in ('UBIGINT', 'BIGINT') then 'integer' when ty = 'DOUBLE' then 'double' else lower(ty) end) filter (ty not in ('NULL', 'OBJECT')) as k, count(distinct file_id) as n_files from w group by path)
select path, case when k is null then 'null' when k = ['integer'] then 'bigint' when len(list_filter(k, lambda y: y not in ('integer', 'double'))) = 0 then 'double' when k = ['boolean'] then 'boolean' when k = ['array'] then 'array' else 'string' end as type, n_files from ks""",
    **{f"p5_{c}": _p5_table(c) for c in _P5_ROWS},
    "p5_thermostat_text": _p5_table("thermostat", "D_ckm:s", ("D_ckm",)),
    "p5_shapes": _P5 + "".join(f", {_p5_members(c)}" for c in _P5_ROWS) + " union all ".join(f" select '{c}' as child, shape, subtype, count(*) as n_rows from s_{c} group by shape, subtype" for c in _P5_ROWS),
    "p2_found": f"{_P2} {_P2_CHANGES}",
    "p5_values": _P5
    + """, q as (select 'monitor_trajectory' as src, rec_id, 'thermostat' as child, '' as parent_item, item::varchar as item, json_extract(e, '$.D_ckm') as v from o
union select 'monitor_trajectory', rec_id, 'alpha_trajectory', item::varchar, i::varchar, json_extract(e, '$.alpha') from v where json_type(e) <> 'NULL'
union select 'monitor_trajectory', rec_id, 'top_coactivations', '', i::varchar, json_extract(tops, '$[' || i || '].weight') from (select rec_id, tops, unnest(range(json_array_length(tops)::bigint)) as i from h where json_type(tops) = 'ARRAY')
union select 'reg_sweep_stop_perdida_v1', sweep_id, 'a_post_per_alpha', place::varchar, printf('%.1f', alpha::double), x from k where json_type(x) <> 'NULL')
select src, rec_id, child, parent_item, item, case when json_type(v) in ('UBIGINT', 'BIGINT', 'DOUBLE') then v::double end as value from q""",
    "p1_found": f"with {_P1_BASE} select line_id, case when not quoted then 'quoting' when not counted then 'column_count' else 'invalid_value' end as reason from b where not quoted or not counted or not fits",
    "p1_reasons": f"with {_P1_BASE}, g2 as (select line_id, case when not quoted then 'quoting' when not counted then 'column_count' when not fits then 'invalid_value' end as reason from b) select table_name, fmt, case when g2.line_id is null then 'other' when reason is null then 'valid' else 'malformed' end as kind, reason, count(*) as n from dump_line left join g2 using (line_id) group by all",
    "p1_valid_post": _p1_valid("post", _POST),
    "p1_valid_qr_entry": _p1_valid("mturk_2010_qr_entry", _QR),
    "p5_found": _P5
    + """select 'monitor_trajectory' as src, rec_id, 'thermostat' as child, '' as parent_item, item::varchar as item from o
union select 'monitor_trajectory', rec_id, 'alpha_trajectory', item::varchar, i::varchar from v where json_type(e) <> 'NULL'
union select 'monitor_trajectory', rec_id, 'top_coactivations', '', i::varchar from (select rec_id, unnest(range(json_array_length(tops)::bigint)) as i from h where json_type(tops) = 'ARRAY')
union select 'reg_sweep_stop_perdida_v1', sweep_id, 'a_post_per_alpha', place::varchar, printf('%.1f', alpha::double) from k where json_type(x) <> 'NULL'""",
}
