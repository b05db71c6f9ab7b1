"""Queries over landscapes of any size: the documents' W of 146 nodes."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkscape.operators import corpus as C
from sparkscape.operators import landscape as L
from sparkscape.operators import wide as W
from sparkscape.plans.corpus import base, units
from sparkscape.session import cut

N, RUNS, SEED = 146, 1000, 0


def weights(s, d, n=N):
    nodes, e = C.signed_w(units(s, d), n)
    return W.matrix(e, nodes.count())


def relaxed(s, d, mode="uniform", runs=RUNS):
    w = weights(s, d)
    return W.relaxed(W.sampled(s, w, runs, mode, SEED), w)


def measures(s, d):
    """Effective number of each sampling mode, with the share of mirrored orbits; W is built once."""
    w, out = weights(s, d), None
    for mode in W.MODES:
        r = cut(W.relaxed(W.sampled(s, w, RUNS, mode, SEED), w))
        kinds = r.agg(F.round(F.avg((F.col("kind") == "mirrored").cast("int")), 6).alias("mirrored"), F.max("tail").alias("longest_tail"))
        one = L.n_eff(r).crossJoin(kinds).select(F.lit(mode).alias("mode"), "n_runs", "n_orbits", "n_eff", "mirrored", "longest_tail")  # one row each
        out = one if out is None else out.unionByName(one)
    return out


def margins(s, d):
    """Margin of the landscape at N = 10: N0 is that of W with all signs positive, the floor that of the collapsed W."""
    u = units(s, d)
    nodes = cut(C.nodes(u, 10))
    present = C.presence(u, nodes)
    signs = u.select("unit_id", C.T.opposes(F.col("text")).alias("negative"))
    p = cut(C.pairs(present, signs))
    w, plain = L.matrix(C.edges(p), 10), L.matrix(C.edges(p, force_positive=True), 10)
    n = lambda m, name: L.n_eff(L.relaxed(L.all_states(s, 10), m)).select(F.col("n_eff").alias(name))
    row = n(w, "n_eff").crossJoin(n(plain, "n0")).crossJoin(n(L.between(w, 4), "collapsed"))  # one row each
    return row.select("*", F.round(W.margin(F.col("n_eff"), F.col("n0"), F.col("collapsed")), 9).alias("margin"))


QUERIES = {
    "wide_basins": lambda s, d: L.basins(relaxed(s, d)).select("orbit", "period", "n", "mass"),
    "wide_kinds": lambda s, d: relaxed(s, d).groupBy("kind", "period").agg(F.count("*").alias("n_runs"), F.count_distinct("orbit").alias("n_orbits")),
    "wide_modes": measures,
    "wide_20k_runs": lambda s, d: L.n_eff(relaxed(s, d, runs=20_000)),
    "wide_distance": lambda s, d: (lambda w: W.basin_distance(W.sampled(s, w, 50, "uniform", SEED), w))(weights(s, d, 40)).groupBy("distance", "exact").agg(F.count("*").alias("n"), F.max("evaluated").alias("most_evaluated")),
    "weighted_sample": lambda s, d: (lambda w: W.chosen(s, RUNS, len(w), SEED, W.strengths(w)))(weights(s, d, 12)).select("run", "n_act", F.array_sort("active").alias("active")).select("run", "n_act", F.concat_ws(",", F.col("active").cast("array<string>")).alias("active")),
    "landscape_margin": margins,
    "dyadic_weights": lambda s, d: W.dyadic(C.signed_w(units(s, d), 40)[1]),
    "enumeration_20": lambda s, d: L.n_eff(L.relaxed(L.all_states(s, 20), L.matrix(C.signed_w(units(s, d), 20)[1], 20))),
}


STEPS = 16  # of the SQL: its runs are in their orbits by then


def _sampled_sql(n: int, runs: int, key: str) -> str:
    return f"""
rn as (select run, greatest(1, round_even((0.3::double + 0.4::double * (('0x' || md5('{SEED}:' || run || ':act')[1:8])::bigint / 4294967296.0::double)) * {n}, 0))::int as n_act from (select unnest(range({runs})) as run)),
rk2 as (select run, n_act, i, row_number() over (partition by run order by {key}, i) as k from rn, (select unnest(range({n})) as i))"""


def _relax_sql(n: int, runs: int) -> str:
    """CTE o (run, a, b): the two phases of each run's orbit as hexadecimal names, w as lists of rows, all runs stepped alike."""
    md5 = f"md5('{SEED}:' || run || ':' || i)"
    bit = lambda s: f"list_aggregate(list_transform(range({(n + 7) // 8}), lambda q: printf('%02x', list_sum(list_transform(range(8), lambda k: case when {s}[q * 8 + k + 1] > 0 then 1 << k else 0 end))::int)), 'string_agg', '')"
    steps = "".join(
        f""",
s{t + 1} as materialized (select run, s as p, list_transform(list_zip(h, s), lambda x: case when x[1] > 0 then 1.0::double when x[1] < 0 then -1.0::double else x[2] end) as s from (select run, s, list_transform(rows_, lambda r: list_dot_product(r, s)) as h from s{t}, wr))"""
        for t in range(STEPS + 1)
    )
    return f"""with {base(k=n)},
bw as (select i, j, raw from e union all select j, i, raw from e),
whole as (select a.node_id as i, b.node_id as j, coalesce(raw, 0)::double as raw from n a cross join n b left join bw on bw.i = a.node_id and bw.j = b.node_id),
wr as (select list(r order by i) as rows_ from (select i, list(raw order by j) as r from whole group by i)),{_sampled_sql(n, runs, md5)},
s0 as (select run, list(case when k <= n_act then 1.0::double else -1.0::double end order by i) as s from rk2 group by run){steps},
o as (select run, least({bit("p")}, {bit("s")}) as orbit, case when p = s then 1 else 2 end as period, case when p = s then 'fixed' when p = list_transform(s, lambda x: -x) then 'mirrored' else 'paired' end as kind from s{STEPS + 1})"""


def _margin_sql() -> str:
    from sparkscape.plans.landscape import _settled, _succ

    q = "with " + base(k=10) + """, bw as (select i, j, raw from e where raw <> 0 union all select j, i, raw from e where raw <> 0),
bp as (select i, j, n_pos + n_neg as raw from pc union all select j, i, n_pos + n_neg from pc),
bc as (select a.node_id as i, b.node_id as j, (select max(abs(raw)) from e) as raw from n a join n b on a.node_id <> b.node_id)"""
    q += _succ("su", "bw") + _settled("su") + _succ("sp", "bp").replace("sb as (", "sb2 as (", 1) + _settled("sp") + _succ("sq", "bc").replace("sb as (", "sb3 as (", 1) + _settled("sq")
    n = lambda t: f"(select round(sum(n)::double ** 2 / sum(n * n), 9) from (select count(*) as n from {t}o group by orbit))"
    return f"{q}, ve as (select {n('su')} as n_eff, {n('sp')} as n0, {n('sq')} as collapsed) select *, round(case when n0 > 1 and collapsed > 0 then 1 - ln(collapsed) / ln(n0) end, 9) as margin from ve"


_KEY = f"round(-ln((('0x' || md5('{SEED}:' || run || ':' || i)[1:8])::bigint / 4294967296.0::double * 4294967296.0::double + 0.5::double) / 4294967296.0::double) / (select f[i + 1] from fi), 15)"
SQL = {
    "wide_basins": _relax_sql(N, RUNS) + f" select orbit, period, count(*) as n, round(count(*) / {RUNS}, 9) as mass from o group by all",
    "wide_kinds": _relax_sql(N, RUNS) + " select kind, period, count(*) as n_runs, count(distinct orbit) as n_orbits from o group by all",
    "weighted_sample": f"with {base(k=12)}, bw as (select i, raw from e union all select j, raw from e), fs as (select node_id, coalesce(sum(abs(raw)), 0)::double as f from n left join bw on i = node_id group by all), fi as (select list(f order by node_id) as f from fs),{_sampled_sql(12, RUNS, _KEY)} select run, n_act, string_agg(i, ',' order by i) as active from rk2 where k <= n_act group by all",
    "landscape_margin": _margin_sql(),
    "dyadic_weights": f"with {base(k=40)} select count(*) as n, count(*) filter (w * 1048576 = floor(w * 1048576)) as n_dyadic from e",
}
