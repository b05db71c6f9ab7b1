"""Queries over the landscape of the documents' W (ten nodes, all states or keyed samples)."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from sparkscape.operators import corpus as C
from sparkscape.operators import landscape as L
from sparkscape.plans.corpus import base, units
from sparkscape.session import cut

N, RUNS, SEED = 10, 1000, 0


def weights(s, d):
    n, e = C.signed_w(units(s, d), N)
    return L.matrix(e, N)


def exact(s, d):
    return L.relaxed(L.all_states(s, N), weights(s, d))


def runs(s, d):
    return L.relaxed(L.sampled(s, RUNS, N, SEED), weights(s, d))


def successors(s, d):
    w = weights(s, d)

    def step(batches):
        for b in batches:
            x = b.column("state").to_numpy()
            yield pa.RecordBatch.from_arrays([b.column("state"), pa.array(L.step(x, w))], names=["state", "successor"])

    return L.all_states(s, N).select("state").mapInArrow(step, "state bigint, successor bigint")


def conjugates(s, d):
    e = cut(exact(s, d).select("state", "orbit"))
    mate = e.select(F.col("state").bitwiseXOR((1 << N) - 1).alias("state"), F.col("orbit").alias("mate"))
    return e.join(mate, "state").groupBy("orbit").agg(F.min("mate").alias("mate"), F.max("mate").alias("mate_max"), F.count("*").alias("n")).select("orbit", "mate", (F.col("mate") == F.col("mate_max")).alias("one_mate"), "n")


def antisymmetry(s, d):
    m = cut(successors(s, d))
    full = (1 << N) - 1
    o = m.select(F.col("state").bitwiseXOR(full).alias("state"), F.col("successor").bitwiseXOR(full).alias("other"))
    return m.join(o, "state").agg(F.count("*").alias("n"), F.count_if(F.col("successor") != F.col("other")).alias("mismatches"))


def d_ckm(s, d):
    """Distance of the signed W's landscape from that of W with all signs positive."""
    u = units(s, d)
    nodes = C.nodes(u, N)
    plain = C.edges(C.pairs(C.presence(u, nodes)))
    first = L.n_eff(L.relaxed(L.all_states(s, N), L.matrix(plain, N))).select(F.col("n_eff").alias("n0"))
    return L.n_eff(exact(s, d)).select("n_eff").crossJoin(first).select("n_eff", "n0", F.round(L.distance(F.col("n_eff"), F.col("n0")), 9).alias("d_ckm"), F.round((F.col("n0") - F.col("n_eff")) / F.col("n0"), 9).alias("d_linear"))


def coverage(s, d):
    first = runs(s, d).groupBy("orbit").agg(F.min("run").alias("first"))
    marks = s.createDataFrame([(m,) for m in (10, 100, 300, 1000)], "n_runs bigint")
    return marks.join(first, first["first"] < marks["n_runs"], "left").groupBy("n_runs").agg(F.count("orbit").alias("n_orbits"))


def simpson(s, d):
    c = F.col("n").cast("double")
    g = L.basins(runs(s, d))
    t = g.agg(F.sum(c).alias("m"), F.sum(c * c).alias("s2"), F.sum(c * (c - 1)).alias("u"), F.sum(F.pow(c, 3)).alias("s3"))
    theta = F.col("s2") / F.pow("m", 2)
    var = 4 / F.col("m") * (F.col("s3") / F.pow("m", 3) - theta * theta)
    half = 1.959964 * F.sqrt(F.greatest(var, F.lit(0.0)))
    return t.select(F.round(theta, 9).alias("theta"), F.round(F.col("u") / (F.col("m") * (F.col("m") - 1)), 9).alias("unbiased"), F.round(1 / (theta + half), 6).alias("n_low"), F.round(F.try_divide(F.lit(1.0), theta - half), 6).alias("n_high"))


def saturation(s, d):
    b = L.basins(runs(s, d))
    return b.agg(F.round(F.pow(F.sum("n"), 2) / F.sum(F.col("n") * F.col("n")) / F.sum("n"), 4).alias("saturation"), F.round(F.avg((F.col("n") < 1.5).cast("int")), 6).alias("single"))


def calibrate(s, d):
    w = weights(s, d)
    out = None
    for q in range(5):
        one = L.n_eff(L.relaxed(L.all_states(s, N), L.between(w, q))).select(F.lit(q / 4).alias("lam"), "n_eff")
        out = one if out is None else out.union(one)
    first = F.first("n_eff").over(Window.orderBy("lam").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))  # five rows
    return out.withColumn("d_ckm", F.round(L.distance(F.col("n_eff"), first), 9))


def on_field(s, d):
    """(w, rows run, state): W and every document's own state, from one pass over the texts."""
    u = units(s, d)
    _, e, present = C.field(u, N)
    state = present.groupBy("unit_id").agg(F.sum(F.expr("shiftleft(1L, node_id)")).alias("state"))
    rows = u.select("unit_id").join(state, "unit_id", "left").select(F.col("unit_id").alias("run"), F.coalesce("state", F.lit(0)).cast("bigint").alias("state"))
    return L.matrix(e, N), rows


def occupied(s, d):
    """Orbits the documents' own states fall into."""
    w, rows = on_field(s, d)
    return L.relaxed(rows, w)


def phases(s, d):
    """Declared active pairs of each document: accepted in all phases, expelled in all, torn between them."""
    w, rows = on_field(s, d)

    def phase(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(L.step(b.column("orbit").to_numpy(), w))], names=[*b.schema.names, "second"])

    p = L.relaxed(rows, w).select("run", "state", "orbit", "period").mapInArrow(phase, "run bigint, state bigint, orbit bigint, period int, second bigint")
    k = lambda c: F.bit_count(c).cast("bigint")
    pairs = lambda c: k(c) * (k(c) - 1) / 2
    both = F.col("state").bitwiseAND(F.col("orbit")).bitwiseAND(F.col("second"))
    accepted = pairs(both)
    in_first, in_second = pairs(F.col("state").bitwiseAND(F.col("orbit"))), pairs(F.col("state").bitwiseAND(F.col("second")))
    expelled = pairs(F.col("state")) - (in_first + in_second - accepted)
    out = p.select(F.col("run").alias("unit_id"), pairs(F.col("state")).cast("bigint").alias("n_declared"), accepted.cast("bigint").alias("accepted"), expelled.cast("bigint").alias("expelled"), "period")
    return out.withColumn("torn", F.col("n_declared") - F.col("accepted") - F.col("expelled")).withColumn("fabrication", F.round(F.when(F.col("n_declared") > 0, F.col("expelled") / F.col("n_declared")).otherwise(0.0), 6))


def beta_c(s, d):
    _, e = C.signed_w(units(s, d), N)
    pos = e.where("w > 0").agg(F.avg("w").alias("m"))
    allp = e.agg((F.sum("w") / (N * (N - 1) / 2)).alias("mu"))
    return pos.crossJoin(allp).select(F.round(1 / (0.5 * N * F.col("m")), 9).alias("beta_landscape"), F.round(F.when(F.col("mu") > 0, 1 / (0.5 * N * F.col("mu"))), 9).alias("beta_corpus"))


QUERIES = {
    "successor_map": successors,
    "orbits_exact": lambda s, d: exact(s, d).groupBy("orbit", "period").agg(F.count("*").alias("n_states"), F.max("tail").alias("longest_tail")),
    "neff_exact": lambda s, d: L.n_eff(exact(s, d)),
    "conjugate_orbits": conjugates,
    "antisymmetry": antisymmetry,
    "sample_s0": lambda s, d: L.sampled(s, RUNS, N, SEED),
    "basin_masses": lambda s, d: L.basins(runs(s, d)),
    "n_eff": lambda s, d: L.n_eff(runs(s, d)),
    "d_ckm": d_ckm,
    "mean_cs": lambda s, d: (lambda w: L.cohesion(L.relaxed(L.sampled(s, RUNS, N, SEED), w), w))(weights(s, d)).agg(F.count("*").alias("n"), F.round(F.avg("cs"), 9).alias("mean_cs")),
    "saturation": saturation,
    "coverage_curve": coverage,
    "period_stats": lambda s, d: exact(s, d).groupBy("period").agg(F.count("*").alias("n_states"), F.count_distinct("orbit").alias("n_orbits")),
    "simpson_ci": simpson,
    "basin_distance": lambda s, d: L.flips(L.sampled(s, 200, N, SEED), weights(s, d)).groupBy("distance").agg(F.count("*").alias("n")),
    "beta_c": beta_c,
    "calibrate_curve": calibrate,
    "occupied_orbits": lambda s, d: occupied(s, d).groupBy("orbit").agg(F.count("*").alias("n_units")),
    "pairs_by_orbit": phases,
    "boltzmann_masses": lambda s, d: (lambda w: L.basins(L.relaxed(L.boltzmann(s, w, RUNS, 0.01, 50), w)))(weights(s, d)),
    "terminal_states": lambda s, d: runs(s, d).agg(F.count_distinct("terminal").alias("n_terminal"), F.count_distinct("orbit").alias("n_orbits")),
    "async_relax": lambda s, d: L.asynchronous(L.sampled(s, RUNS, N, SEED), weights(s, d)).groupBy("terminal").agg(F.count("*").alias("n"), F.max("sweeps").alias("most_sweeps")),
    "collapse_floor": lambda s, d: s.range(3, 12).select(F.col("id").alias("n"), F.when(F.col("id") % 2 == 1, 2.0).alias("odd_floor"), F.round(1 / (F.pow(F.col("id") / 20, 2) + F.pow(1 - F.col("id") / 20, 2) / 2), 9).alias("involution_bound")),
}

_W = "with " + base(k=N) + ", bw as (select i, j, raw from e where raw <> 0 union all select j, i, raw from e where raw <> 0)"


def _succ(name, w):
    return f""",
sb as (select s, i, case when (s >> i) & 1 = 1 then 1 else -1 end as x from (select unnest(range({1 << N})) as s), (select unnest(range({N})) as i)),
{name}h as (select a.s, a.i, a.x, coalesce(sum(b.x * raw), 0) as h from sb a left join {w} k on k.i = a.i left join sb b on b.s = a.s and b.i = k.j group by all),
{name} as (select s, sum(case when h > 0 or (h = 0 and x = 1) then 1 << i else 0 end)::bigint as t from {name}h group by s)"""


def _settled(name):
    """States after 2**8 steps, with orbit and period."""
    q, prev = "", name
    for k in range(8):
        q += f",\n{name}{k} as (select a.s, b.t from {prev} a join {prev} b on b.s = a.t)"
        prev = f"{name}{k}"
    return q + f",\n{name}o as (select z.s, least(z.t, f.t) as orbit, case when z.t = f.t then 1 else 2 end as period from {prev} z join {name} f on f.s = z.t)"


_S = _W + _succ("su", "bw")
_O = _S + _settled("su")
_SAMPLE = f""",
rn as (select run, greatest(1, round_even((0.3::double + 0.4::double * (('0x' || md5('{SEED}:' || run || ':act')[1:8])::bigint / 4294967296.0::double)) * {N}, 0))::int as n_act from (select unnest(range({RUNS})) as run)),
rk2 as (select run, n_act, i, row_number() over (partition by run order by md5('{SEED}:' || run || ':' || i)) as k from rn, (select unnest(range({N})) as i)),
sm as (select run, n_act, sum(1 << i)::bigint as state from rk2 where k <= n_act group by all),
rr as (select run, state, orbit, period from sm join suo on suo.s = sm.state),
bs as (select orbit, period, count(*) as n from rr group by all)"""
_R = _O + _SAMPLE
# Steps of each state until one returns after two more.
_TAILS = _O.replace("with ", "with recursive ", 1) + ", tl(s, c, k) as (select s, s, 0 from su union all select tl.s, b.t, k + 1 from tl join su b on b.s = tl.c join su x on x.s = b.t where x.t <> tl.c), tm as (select s, max(k) as tail from tl group by s)"


def n_eff_sql(name: str) -> str:
    return f"(select round(sum(n)::double ** 2 / sum(n * n), 9) from (select count(*) as n from {name}o group by orbit))"


def _dense(name: str, raw: str, n: int = N) -> str:
    """All off-diagonal cells of W under an expression of raw (0 where there is no edge) and top, its largest absolute."""
    return f""",
{name} as (select i, j, ({raw})::bigint as raw from (select a.node_id as i, b.node_id as j, coalesce(bw.raw, 0) as raw, (select max(abs(raw)) from e) as top from n a join n b on a.node_id <> b.node_id left join bw on bw.i = a.node_id and bw.j = b.node_id))"""


def variants_sql(cells: list[tuple[str, str]]) -> str:
    """CTEs w<k>o of the landscape of each variant of W, given as expressions of raw and top."""
    q = _W
    for k, (_, raw) in enumerate(cells):
        q += _dense(f"d{k}_", raw) + _succ(f"w{k}_", f"d{k}_").replace("sb as (", f"sb{k}_ as (" if k else "sb as (", 1) + _settled(f"w{k}_")
    return q


def n_eff_rows(cells: list[tuple[str, str]], column: str, orbits: bool = False) -> str:
    more = lambda k: f"(select count(distinct orbit) from w{k}_o) as n_orbits, " if orbits else ""
    return variants_sql(cells) + " " + " union all ".join(f"select {label} as {column}, {more(k)}{n_eff_sql(f'w{k}_')} as n_eff" for k, (label, _) in enumerate(cells))


_LAM = [(f"{q / 4}::double", f"{4 - q} * raw + {q} * top") for q in range(5)]
_STATES = ", sd as (select u.unit_id, coalesce(sum(1 << node_id) filter (pr.unit_id is not null), 0)::bigint as state from u left join pr using (unit_id) group by 1)"
_PAIRS = lambda x: f"(bit_count({x})::bigint * (bit_count({x})::bigint - 1) // 2)"

SQL = {
    "terminal_states": _R + " select count(distinct su7.t) as n_terminal, count(distinct suo.orbit) as n_orbits from sm join suo on suo.s = sm.state join su7 on su7.s = sm.state",
    "orbits_exact": _TAILS + " select orbit, period, count(*) as n_states, max(tail) as longest_tail from suo join tm using (s) group by all",
    "calibrate_curve": f"with z as ({n_eff_rows(_LAM, 'lam')}) select lam, n_eff, round(case when first_value(n_eff) over (order by lam) > 1 and n_eff > 0 then 1 - ln(n_eff) / ln(first_value(n_eff) over (order by lam)) end, 9) as d_ckm from z",
    "pairs_by_orbit": _O + _STATES + f", q as (select unit_id, state, a.orbit, period, b.t as second from sd join suo a on a.s = state join su b on b.s = a.orbit), z as (select unit_id, {_PAIRS('state')} as n_declared, {_PAIRS('state & orbit & second')} as accepted, {_PAIRS('state')} - ({_PAIRS('state & orbit')} + {_PAIRS('state & second')} - {_PAIRS('state & orbit & second')}) as expelled, period from q) select *, n_declared - accepted - expelled as torn, round(case when n_declared > 0 then expelled / n_declared else 0 end, 6) as fabrication from z",
    "successor_map": _S + " select s as state, t as successor from su",
    "neff_exact": _O + ", g as (select orbit, count(*) as n from suo group by 1) select sum(n)::bigint as n_runs, count(*) as n_orbits, round(sum(n)::double ** 2 / sum(n * n), 9) as n_eff from g",
    "conjugate_orbits": _O + f" select a.orbit, min(b.orbit) as mate, min(b.orbit) = max(b.orbit) as one_mate, count(*) as n from suo a join suo b on b.s = xor(a.s, {(1 << N) - 1}) group by 1",
    "antisymmetry": _S + f" select count(*) as n, count(*) filter (a.t <> xor(b.t, {(1 << N) - 1})) as mismatches from su a join su b on b.s = xor(a.s, {(1 << N) - 1})",
    "sample_s0": _R + " select run, n_act, state from sm",
    "basin_masses": _R + f" select orbit, period, n, round(n / {RUNS}, 9) as mass from bs",
    "n_eff": _R + " select sum(n)::bigint as n_runs, count(*) as n_orbits, round(sum(n)::double ** 2 / sum(n * n), 9) as n_eff from bs",
    "saturation": _R + " select round(sum(n)::double ** 2 / sum(n * n) / sum(n), 4) as saturation, round(avg((n < 1.5)::int), 6) as single from bs",
    "coverage_curve": _R + ", f1 as (select orbit, min(run) as first from rr group by 1) select m as n_runs, count(orbit) as n_orbits from (select unnest([10, 100, 300, 1000])::bigint as m) left join f1 on first < m group by 1",
    "period_stats": _O + " select period, count(*) as n_states, count(distinct orbit) as n_orbits from suo group by 1",
    "simpson_ci": _R + ", q as (select sum(n)::double as m, sum(n * n)::double as s2, sum(n * (n - 1))::double as u, sum(n::double ** 3) as s3 from bs), z as (select *, s2 / m ** 2 as th, 1.959964 * sqrt(greatest(4 / m * (s3 / m ** 3 - (s2 / m ** 2) ** 2), 0)) as half from q) select round(th, 9) as theta, round(u / (m * (m - 1)), 9) as unbiased, round(1 / (th + half), 6) as n_low, round(1 / nullif(th - half, 0), 6) as n_high from z",
    "basin_distance": _R + f", mk as (select 1 << i as m, 1 as k from (select unnest(range({N})) as i) union all select (1 << i) | (1 << j), 2 from (select unnest(range({N})) as i), (select unnest(range({N})) as j) where i < j), ds as (select run, min(case when b.orbit <> a.orbit then k end) as distance from rr a, mk join suo b on b.s = xor(a.state, m) where run < 200 group by 1) select distance, count(*) as n from ds group by 1",
    "beta_c": _W + f" select round(1 / (0.5 * {N} * avg(w) filter (w > 0)), 9) as beta_landscape, round(case when sum(w) > 0 then 1 / (0.5 * {N} * (sum(w) / {N * (N - 1) // 2})) end, 9) as beta_corpus from e",
    "occupied_orbits": _O + ", sd as (select u.unit_id, coalesce(sum(1 << node_id) filter (pr.unit_id is not null), 0)::bigint as state from u left join pr using (unit_id) group by 1) select orbit, count(*) as n_units from sd join suo on suo.s = sd.state group by 1",
    "mean_cs": _R + f", zz as (select run, t as o from sm join su7 on su7.s = sm.state), mx as (select max(abs(raw)) as top from e), c1 as (select run, sum(raw / top * xa.x * xb.x) / {N * (N - 1) // 2} as cs from zz, mx, e join sb xa on true join sb xb on true where xa.s = o and xa.i = e.i and xb.s = o and xb.i = e.j group by 1) select count(*) as n, round(avg(cs), 9) as mean_cs from c1",
    "collapse_floor": "select n, case when n % 2 = 1 then 2.0 end as odd_floor, round(1 / ((n / 20) ** 2 + (1 - n / 20) ** 2 / 2), 9) as involution_bound from (select unnest(range(3, 12))::bigint as n)",
    "d_ckm": _O + ", bp as (select i, j, n_pos + n_neg as raw from pc union all select j, i, n_pos + n_neg from pc)" + _succ("sp", "bp").replace("sb as (", "sb2 as (", 1) + _settled("sp")
    + ", a as (select (select round(sum(n)::double ** 2 / sum(n * n), 9) from (select count(*) as n from suo group by orbit)) as n_eff, (select round(sum(n)::double ** 2 / sum(n * n), 9) from (select count(*) as n from spo group by orbit)) as n0) select n_eff, n0, round(case when n0 > 1 and n_eff > 0 then 1 - ln(n_eff) / ln(n0) end, 9) as d_ckm, round((n0 - n_eff) / n0, 9) as d_linear from a",
}
