"""Queries of graph, topology and statistics over the documents' W, and W of other units."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from sparkscape.operators import analytics as A
from sparkscape.operators import corpus as C
from sparkscape.operators import gatekeeper as G
from sparkscape.operators import landscape as L
from sparkscape.operators import votes as V
from sparkscape.plans import landscape as PL
from sparkscape.plans import wide as WIDE
from sparkscape.plans.corpus import base, units
from sparkscape.plans.relations import _Q, _core_sql, quote_edges
from sparkscape.session import cut, table

N = PL.N
THETA = 0.2


def edges(s, d):
    return C.signed_w(units(s, d), N)[1]


def attractors(s, d):
    """orbit, n: each exact orbit once."""
    return PL.exact(s, d).groupBy("orbit").agg(F.count("*").alias("n"))


def bit(i, c="orbit"):
    return F.shiftright(F.col(c), i).bitwiseAND(1) if isinstance(i, int) else F.expr(f"shiftright({c}, {i}) & 1")


def correlation(s, d):
    """Pearson correlation of two nodes' presence over the attractors; null where a node is constant."""
    a = attractors(s, d).select("orbit")
    nodes = F.array(*(F.lit(i) for i in range(N)))
    p = a.select("orbit", F.explode(nodes).alias("i")).select("orbit", "i", F.explode(nodes).alias("j")).where("i < j")
    g = p.groupBy("i", "j").agg(F.count("*").alias("m"), F.sum(bit("i")).alias("ni"), F.sum(bit("j")).alias("nj"), F.sum(bit("i") * bit("j")).alias("nij"))
    den = F.sqrt(F.col("ni").cast("double") * F.col("nj") * (F.col("m") - F.col("ni")) * (F.col("m") - F.col("nj")))
    return g.select("i", "j", F.round(F.try_divide(F.col("m") * F.col("nij") - F.col("ni") * F.col("nj"), den), 9).alias("corr"))


def sizes(s, d):
    k = F.bit_count("orbit")
    return attractors(s, d).agg(F.count("*").alias("n"), F.round(F.avg(k), 6).alias("mean"), F.round(F.stddev_pop(k), 6).alias("std"), F.min(k).alias("least"), F.max(k).alias("most"), F.count_if(k >= 0.85 * N).alias("saturated"), F.round(F.sum(k * F.col("n")) / F.sum("n"), 6).alias("weighted_mean"))


def core_nodes(s, d):
    p = attractors(s, d).select(F.explode(F.array(*(F.struct(F.lit(i).alias("node_id"), bit(i).alias("x")) for i in range(N)))).alias("c")).groupBy("c.node_id").agg(F.round(F.avg("c.x"), 6).alias("presence"))
    return p.withColumn("core", F.col("presence") >= 0.8)


def frontier(s, d):
    """Mean w inside and between the thirds of the nodes by strength (0: the strongest), and the coercivity of each pair."""
    n, e = C.signed_w(units(s, d), N)
    third = (F.floor((F.row_number().over(Window.orderBy(F.desc("strength"), "node_id")) - 1) * 3 / N)).cast("int")  # N rows
    c = cut(C.row_strength(n, e).select("node_id", third.alias("c")))
    a, b = (c.select(F.col("node_id").alias(x), F.col("c").alias(f"c{x}")) for x in "ij")
    pairs = a.join(b, F.col("i") < F.col("j")).join(e.select("i", "j", "w"), ["i", "j"], "left").withColumn("w", F.coalesce("w", F.lit(0.0)))  # N * N / 2 rows
    g = pairs.select(F.least("ci", "cj").alias("a"), F.greatest("ci", "cj").alias("b"), "w").groupBy("a", "b").agg(F.avg("w").alias("m"))
    inside = g.where("a = b").select("a", F.col("m").alias("intra"))
    c = g.where("a < b").join(inside, "a").join(inside.select(F.col("a").alias("b"), F.col("intra").alias("intra_b")), "b")
    low = F.least("intra", "intra_b")
    kind = F.when(F.abs("m") <= 1e-12, "inf").when(F.col("m") < 0, "opposition").otherwise("ratio")
    return c.select("a", "b", F.round("m", 9).alias("inter"), F.round(low, 9).alias("least_intra"), kind.alias("kind"), F.round(F.when(kind == "ratio", low / F.col("m")), 6).alias("coercivity"))


def density(s, d, samples=20):
    """Mean cohesion of keyed samples at each density; the best density is the largest mean."""
    w = PL.weights(s, d)
    grid = s.range(1, N).select(F.col("id").alias("k")).crossJoin(s.range(samples).select(F.col("id").alias("r")))  # a grid of given size
    ranked = F.array_sort(F.transform(F.sequence(F.lit(0), F.lit(N - 1)), lambda i: F.struct(F.md5(F.concat_ws(":", "k", "r", i)).alias("h"), i.alias("i"))))
    state = F.aggregate(F.slice(ranked, 1, F.col("k").cast("int")), F.lit(0).cast("bigint"), lambda a, x: a + F.pow(F.lit(2.0), x["i"]).cast("bigint"))
    c = L.cohesion(grid.select((F.col("k") * 1000 + F.col("r")).alias("run"), state.alias("terminal")), w)
    return c.groupBy(F.floor(F.col("run") / 1000).alias("k")).agg(F.round(F.avg("cs"), 9).alias("mean_cs"))


def direction(s, d):
    """Share of each document's active nodes' dependencies (the node before) that are active; 1 without any."""
    return directions(PL.occupied(s, d))


def directions(occupied):
    p = occupied.select(F.col("run").alias("unit_id"), "state")
    needs = F.col("state").bitwiseAND((1 << N) - 2)
    met = F.bit_count(needs.bitwiseAND(F.shiftleft("state", 1)))
    n = F.bit_count(needs)
    return p.select("unit_id", F.round(F.when(n > 0, met / n).otherwise(1.0), 6).alias("direction"), n.alias("n_dependencies"))


def gate(s, d):
    """Largest |w| of a node to the nodes of the first half; admitted at the threshold."""
    e = C.both_ways(edges(s, d)).where(F.col("j") < N // 2).groupBy(F.col("i").alias("node_id")).agg(F.max(F.abs("w")).alias("strongest"))
    return e.select("node_id", F.round("strongest", 9).alias("strongest"), (F.col("strongest") >= THETA).alias("admitted"))


def gatekeeper(s, d):
    """Four criteria on each document's state: cohesion, direction, density, not alone; with the reason."""
    w, rows = PL.on_field(s, d)
    o = cut(L.relaxed(rows, w))
    cs = L.cohesion(o.select("run", "state"), w, "state")
    x = o.join(cs, "run").join(directions(o).withColumnRenamed("unit_id", "run"), "run").withColumn("rho", F.bit_count("state") / N)
    ok = {"cohesion": F.col("cs") >= 0, "direction": F.col("direction") >= 0.5, "density": F.col("rho") <= 0.95, "alone": F.col("rho") > 1 / N}
    admitted = None
    for c in ok.values():
        admitted = c if admitted is None else admitted & c
    score = 0.4 * (F.col("cs") + 1) / 2 + 0.3 * F.col("direction") + 0.3 * F.col("rho")
    label = F.when(score >= 0.6, "strong").when(score >= 0.4, "fair").when(score >= 0.2, "weak").otherwise("none")
    return x.select(F.col("run").alias("unit_id"), admitted.alias("admitted"), F.concat_ws(",", *(F.when(~c, n) for n, c in ok.items())).alias("failed"), F.round(score, 6).alias("score"), label.alias("label"))


def hebbian(s, d, rate=0.1):
    """W after one Hebbian step on every document's state: w + rate / N * mean s_i s_j."""
    w, rows = PL.on_field(s, d)
    o = rows.select("state")
    nodes = [(i, j) for i in range(N) for j in range(i + 1, N)]
    sign = lambda i: 2 * bit(i, "state") - 1
    m = o.agg(*(F.avg(sign(i) * sign(j)).alias(f"m{i}_{j}") for i, j in nodes))
    long = m.select(F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.col(f"m{i}_{j}").alias("m")) for i, j in nodes))).alias("c")).select("c.*")
    top = np.abs(w).max() or 1
    own = s.createDataFrame([(i, j, float(w[i, j] / top)) for i, j in nodes], "i int, j int, w double")  # N * N / 2 rows
    return long.join(F.broadcast(own), ["i", "j"]).select("i", "j", F.round(F.col("w") + rate / N * F.col("m"), 9).alias("w"))


def brand_w(s, d):
    """Brands in the same order; urgent orders count against."""
    o = table(s, d, "orders").select(F.col("o_orderkey").alias("unit_id"), (F.col("o_orderpriority") == "1-URGENT").alias("negative"))
    li = table(s, d, "lineitem").select("l_orderkey", "l_partkey").join(table(s, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand"), "l_partkey")
    present = li.select(F.col("l_orderkey").alias("unit_id"), F.col("p_brand").alias("node_id")).distinct()
    e = C.edges(C.pairs(present, o))
    return e.select("i", "j", "raw", F.round("w", 9).alias("w"))


def event_phi(s, d):
    """Event types of the same user and hour: phi of their presence."""
    e = table(s, d, "events").where("user_id is not null and ts is not null").select(F.concat_ws("|", "user_id", F.date_trunc("hour", "ts").cast("string")).alias("unit_id"), F.col("event_type").alias("node_id")).distinct()
    e = cut(e)
    return C.association(e, e.select("unit_id").distinct().count())


def amplified(s, d):
    """n_eff of W with its negative weights amplified."""
    w, out = PL.weights(s, d), None
    for amp in (1, 2, 4):
        x = np.where(w < 0, w * amp, w)
        one = L.n_eff(L.relaxed(L.all_states(s, N), x)).select(F.lit(amp).alias("amp"), "n_orbits", "n_eff")
        out = one if out is None else out.union(one)
    return out


def sensitivity(s, d):
    """n_eff with 8, 9, 10 nodes."""
    out = None
    for k in (8, 9, 10):
        _, e = C.signed_w(units(s, d), k)
        one = L.n_eff(L.relaxed(L.all_states(s, k), L.matrix(e, k))).select(F.lit(k).alias("top_k"), "n_orbits", "n_eff")
        out = one if out is None else out.union(one)
    return out


def grid(s, d, cells, work, schema):
    w = PL.weights(s, d)
    return A.over_grid(s, cells, lambda c: work(w, c), schema)


def sweep(w, c):
    seed, runs = c // 4, (100, 300, 1000, 3000)[c % 4]
    g = np.random.default_rng(seed)
    k = np.maximum(1, np.rint(g.uniform(0.3, 0.7, runs) * len(w)).astype(int))
    states = (np.argsort(np.argsort(g.random((runs, len(w))), axis=1), axis=1) < k[:, None]) @ (1 << np.arange(len(w)))
    _, n = np.unique(L.relax(states.astype(np.int64), w)[0], return_counts=True)
    return [(seed, runs, len(n), round(float(n.sum() ** 2 / (n.astype(float) ** 2).sum()), 6))]


def planted(s, d, steps=30, texts=10, eps=0.1):
    """Three planted groups of six terms: does w's sign tell same group from other? One row a step."""
    u = s.range(steps * texts * 18).select((F.col("id") / 18).cast("int").alias("u"), (F.col("id") % 18).cast("int").alias("term"))
    u = u.where(((F.floor(F.col("term") / 6) == F.col("u") % 3) & (L.unit(F.lit("in"), "u", "term") > 0.3)) | (L.unit(F.lit("eps"), "u", "term") < eps))
    n = steps * texts
    p = C.association(u.select(F.col("u").alias("unit_id"), F.col("term").alias("node_id")), n)
    same = F.floor(F.col("i") / 6) == F.floor(F.col("j") / 6)
    return p.agg(F.count("*").alias("n_pairs"), F.count_if(F.col("phi").isNull()).alias("undefined"), F.count_if(F.col("phi") == 0).alias("zero"), F.round(F.avg(((F.col("phi") > 0) == same).cast("int")), 6).alias("recovered"))


def complexes(w, c):
    b = A.betti(w, (0.0, 0.1, 0.2, 0.4, 0.8)[c])
    o = A.orientable(w, (0.0, 0.1, 0.2, 0.4, 0.8)[c])
    return [((0.0, 0.1, 0.2, 0.4, 0.8)[c], *b.values(), o)]


def adj(w):
    return np.abs(A.scaled(w)) >= THETA


def thermal_row(w, c):
    side, _ = A.fiedler(w)
    x = A.thermal(w, (0.1, 0.2, 0.5, 1.0, 2.0)[c], c)
    s = np.array(side)
    iu = np.triu_indices(len(w), 1)
    same = s[iu[0]] == s[iu[1]]
    v = x[iu]
    return [((0.1, 0.2, 0.5, 1.0, 2.0)[c], float(v[same].mean()) if same.any() else None, float(v[~same].mean()) if (~same).any() else None)]


TAILS = "exponent double, n int, tau double, rate double, r double, z double, p double, decades double, asymmetry double, p_asymmetry double"


def tails(w, c):
    return tails_of(w, 3)


def tails_of(w, k):
    lost = [x[1] for x in A.cascades(adj(w), k)]
    p = A.power_or_exponential(lost, len(w))
    r = A.asymmetry(adj(w), k, 100, 42)
    return [(A.tail_exponent(lost), p["n"], p["tau"], p["rate"], p["r"], p["z"], p["p"], p["decades"], r["asymmetry"], r["p"])]


def poles(s, d):
    """Two poles of the directed author groups: stance pairs by votes below 0."""
    w = PL.weights(s, d).astype(float)
    scaled = A.scaled(w)
    # What a node has over another in strength counts as directed.
    strength = np.abs(scaled).sum(axis=1)
    delta = np.maximum(strength[:, None] - strength[None, :], 0) * (scaled != 0)
    return A.over_grid(s, 4, lambda c: [(c, *r) for r in A.two_poles(scaled, delta, 500, 400, c)], "seed int, field string, class string, share double")


def layered(s, d):
    """(w, needs, rows run, state): W, dependencies and the documents' states. A node needs another that is in at least half of its documents and in more documents than it."""
    u = units(s, d)
    _, e, present = C.field(u, N)
    present = cut(present)
    each = present.groupBy("node_id").agg(F.count("*").alias("n"))
    p = C.pairs(present).select("i", "j", (F.col("n_pos") + F.col("n_neg")).alias("m"))
    both = p.union(p.select("j", "i", "m")).join(F.broadcast(each.select(F.col("node_id").alias("i"), F.col("n").alias("ni"))), "i").join(F.broadcast(each.select(F.col("node_id").alias("j"), F.col("n").alias("nj"))), "j")
    needs = [0] * N
    for r in both.where("2 * m >= ni and nj > ni").select("i", "j").collect():  # at most N * N rows
        needs[r.i] |= 1 << r.j
    state = present.groupBy("unit_id").agg(F.sum(F.expr("shiftleft(1L, node_id)")).alias("state"))
    rows = u.select("unit_id").join(state, "unit_id", "left").select(F.col("unit_id").alias("run"), F.coalesce("state", F.lit(0)).cast("bigint").alias("state"))
    return A.scaled(L.matrix(e, N)), needs, rows


def state_scores(s, d):
    w, needs, rows = layered(s, d)
    return G.scored(rows, w, needs).withColumnRenamed("run", "unit_id")


def node_gate(s, d):
    """Criteria for every node that is down, for each distinct state of a document."""
    w, needs, rows = layered(s, d)
    return G.candidates(rows.select("state").distinct().select(F.col("state").alias("run"), "state"), w, needs).withColumnRenamed("run", "state")


QUERIES = {
    "state_scores": state_scores,
    "node_gatekeeper": node_gate,
    "topological_profile": lambda s, d: grid(s, d, 5, lambda w, c: [((0.05, 0.1, 0.2, 0.4, 0.8)[c], *(lambda x: (x["n"], *(x[k] for k in ("h0", "h1", "h2")), x["orientable"]))(A.invariants(w, (0.05, 0.1, 0.2, 0.4, 0.8)[c])))], "theta double, n int, h0 int, h1 int, h2 int, orientable boolean"),
    "perspectives": lambda s, d: grid(s, d, 1, lambda w, c: [(k, *A.compared(w, list(range(0, len(w) // 2)), list(range(len(w) // 2 - k, len(w))), THETA).values()) for k in range(4)], "shared int, verdict string, delta_h0 int, delta_h1 int, delta_h2 int"),
    "same_strength_null": lambda s, d: grid(s, d, 20, lambda w, c: [(c, round(float(np.abs(A.same_strength(w, c).sum(axis=1) - np.abs(w).sum(axis=1)).max()), 6), *A.fiedler(A.same_strength(w, c))[1:])], "seed int, strength_off double, ncut double"),
    "two_poles": poles,
    "copresence_corr": correlation,
    "perfect_oppositions": lambda s, d: correlation(s, d).where("corr <= -0.9"),
    "attractor_stats": sizes,
    "core_nodes": core_nodes,
    "cluster_frontier": frontier,
    "density_curve": density,
    "threshold_edges": lambda s, d: edges(s, d).where(F.abs("w") >= THETA).select("i", "j", F.round("w", 9).alias("w")),
    "direction_score": direction,
    "gatekeeper_c1": gate,
    "gatekeeper_r15": gatekeeper,
    "hebbian_update": hebbian,
    "tension": lambda s, d: edges(s, d).agg(F.round(F.try_divide(F.sum(F.when(F.col("w") < 0, -F.col("w")).otherwise(0.0)), F.sum(F.abs("w"))), 9).alias("tension")),
    "order_brand_w": brand_w,
    "event_phi": event_phi,
    "amplified_negative": amplified,
    "topk_sensitivity": sensitivity,
    "planted_field": planted,
    "ward_clusters": lambda s, d: grid(s, d, 1, lambda w, c: [(i, g) for i, g in enumerate(A.ward(w, 4))], "node_id int, cluster int"),
    "spectral_cut": lambda s, d: grid(s, d, 1, lambda w, c: [(i, x, A.fiedler(w)[1]) for i, x in enumerate(A.fiedler(w)[0])], "node_id int, side int, ncut double"),
    "spectral_kmeans": lambda s, d: grid(s, d, 6, lambda w, c: [(c + 2, i, g) for i, g in enumerate(A.spectral_kmeans(w, c + 2))], "k int, node_id int, cluster int"),
    "betti": lambda s, d: grid(s, d, 5, complexes, "theta double, n_edges int, n_triangles int, h0 int, h1 int, h2 int, chi int, orientable boolean"),
    "kcore_rounds": lambda s, d: grid(s, d, 5, lambda w, c: [(c + 1, int(A.k_core(adj(w), c + 1)[0].sum()), A.k_core(adj(w), c + 1)[1])], "k int, n_core int, rounds int"),
    "cascades": lambda s, d: grid(s, d, 1, lambda w, c: A.cascades(adj(w), 3), "node_id int, lost int, rounds int"),
    "cascade_tail": lambda s, d: grid(s, d, 1, tails, TAILS),
    "cascade_tail_wide": lambda s, d: (lambda w: A.over_grid(s, 3, lambda c: [(c + 2, *tails_of(w, c + 2)[0])], "k int, " + TAILS))(WIDE.weights(s, d, 60)),
    "hysteresis": lambda s, d: grid(s, d, 20, lambda w, c: [(c, A.hysteresis(w, c))], "seed int, area double"),
    "thermal_correlations": lambda s, d: grid(s, d, 5, thermal_row, "beta double, inside double, across double"),
    "belief_dynamics": lambda s, d: grid(s, d, 10, lambda w, c: [(c, i, *map(float, x)) for i, x in enumerate(A.beliefs(w, 2000, 0.05, 0.02, 0.05, c))], "seed int, node_id int, first double, second double, third double"),
    "parallel_sweep": lambda s, d: grid(s, d, 20, sweep, "seed int, n_runs int, n_orbits int, n_eff double"),
    "smallest_landscapes": lambda s, d: A.over_grid(s, 27, lambda c: A.smallest_landscapes(4, c * 27, c * 27 + 27), "code bigint, n_eff double"),
    "kcore_sizes": lambda s, d: V.core(quote_edges(s, d), 2).agg(F.count("*").alias("n")),
}


_E = "with " + base(k=N)
_O = PL._O
_AT = _O + ", att as (select orbit, count(*) as n from suo group by 1)"
_CO = _AT + f", g as (select i, j, count(*) as m, sum((orbit >> i) & 1) as ni, sum((orbit >> j) & 1) as nj, sum(((orbit >> i) & 1) * ((orbit >> j) & 1)) as nij from att, (select unnest(range({N})) as i), (select unnest(range({N})) as j) where i < j group by all), co as (select i, j, round((m * nij - ni * nj) / nullif(sqrt(ni::double * nj * (m - ni) * (m - nj)), 0), 9) as corr from g)"
_SD = _O + ", sd as (select u.unit_id, coalesce(sum(1 << node_id) filter (pr.unit_id is not null), 0)::bigint as state from u left join pr using (unit_id) group by 1)"
_DI = f", di as (select unit_id, state, bit_count(state & {(1 << N) - 2}) as nd, bit_count(state & {(1 << N) - 2} & (state << 1)) as met from sd)"

_LAYER = _SD + f""", fq as (select node_id, count(*) as n from pr group by 1), pb as (select i, j, n_pos + n_neg as m from pc union all select j, i, n_pos + n_neg from pc),
nd as (select pb.i, sum(1 << pb.j)::bigint as mask from pb join fq a on a.node_id = pb.i join fq b on b.node_id = pb.j where 2 * m >= a.n and b.n > a.n group by 1),
mx as (select max(abs(raw)) as top from e), ww as (select a.node_id as i, b.node_id as j, coalesce(raw, 0) / top as w from n a join n b on a.node_id < b.node_id cross join mx left join e on e.i = a.node_id and e.j = b.node_id),
sw as (select list(w order by w desc) as ws from ww), ss as (select distinct state, bit_count(state)::int as k from sd),
cs as (select state, sum(w * (2 * ((state >> i) & 1) - 1) * (2 * ((state >> j) & 1) - 1)) / {N * (N - 1) // 2} as c, sum(w * ((state >> i) & 1) * ((state >> j) & 1)) as inside from ss, ww group by 1),
dr as (select state, avg(case when mask is null then 1 else bit_count(state & mask) / bit_count(mask) end) as direction from ss join n on (state >> node_id) & 1 = 1 left join nd on nd.i = node_id group by 1),
qq as (select state, k, least(1, greatest(0, (c + 0.05) / 0.1)) as cs_norm, coalesce(direction, 0) as direction, inside / greatest(1, k * (k - 1) // 2) as ins, list_avg(ws[1:k * (k - 1) // 2]) as most from ss join cs using (state) left join dr using (state), sw),
zz as (select state, cs_norm, direction, case when k >= 2 and abs(most) >= 1e-10 then least(1, greatest(-1, ins / most)) else 0 end as density from qq),
yy as (select *, 0.2 * cs_norm + 0.5 * direction + 0.3 * density as score from zz)"""
SQL = {
    "state_scores": _LAYER + " select unit_id, round(cs_norm, 6) as cs_norm, round(direction, 6) as direction, round(density, 6) as density, round(score, 6) as score, case when round(score, 6) >= 0.63 then 'COHESIVE' when round(score, 6) >= 0.5 then 'SPURIOUS_HIGH' when round(score, 6) >= 0.3 then 'SPURIOUS_MEDIUM' else 'SPURIOUS_LOW' end as label from sd join yy using (state)",
    "kcore_sizes": _Q + _core_sql(2) + " select count(*) as n from core",
    "amplified_negative": PL.n_eff_rows([(str(a), f"case when raw < 0 then raw * {a} else raw end") for a in (1, 2, 4)], "amp", orbits=True),
    "hebbian_update": _SD + f", ij as (select i, j from (select unnest(range({N}))::int as i), (select unnest(range({N}))::int as j) where i < j), m as (select i, j, avg((2 * ((state >> i) & 1) - 1) * (2 * ((state >> j) & 1) - 1)) as m from sd, ij group by all) select i, j, round(coalesce(w, 0) + 0.1::double / {N} * m, 9) as w from m left join e using (i, j)",
    "gatekeeper_r15": _SD + _DI + f""", mx as (select max(abs(raw)) as top from e), ij as (select a.node_id as i, b.node_id as j, coalesce(raw, 0) as raw from n a join n b on a.node_id < b.node_id left join e on e.i = a.node_id and e.j = b.node_id),
ss as (select distinct state from sd), co as (select state, sum(raw / top * (2 * ((state >> i) & 1) - 1) * (2 * ((state >> j) & 1) - 1)) / {N * (N - 1) // 2} as cs from ss, ij, mx group by state),
gx as (select unit_id, cs, round(case when nd > 0 then met / nd else 1 end, 6) as direction, bit_count(di.state) / {N} as rho from di join co using (state)),
gy as (select unit_id, cs >= 0 as a, direction >= 0.5 as b, rho <= 0.95 as c, rho > {1 / N} as d, 0.4::double * (cs + 1) / 2 + 0.3::double * direction + 0.3::double * rho as score from gx)
select unit_id, a and b and c and d as admitted, concat_ws(',', case when not a then 'cohesion' end, case when not b then 'direction' end, case when not c then 'density' end, case when not d then 'alone' end) as failed, round(score, 6) as score,
  case when score >= 0.6 then 'strong' when score >= 0.4 then 'fair' when score >= 0.2 then 'weak' else 'none' end as label from gy""",
    "topk_sensitivity": " union all ".join(f"select * from (with {base(k=k)}, bw as (select i, j, raw from e where raw <> 0 union all select j, i, raw from e where raw <> 0)" + PL._succ("su", "bw").replace(f"range({1 << N})", f"range({1 << k})").replace(f"range({N})", f"range({k})") + PL._settled("su") + f" select {k} as top_k, count(*) as n_orbits, round(sum(n)::double ** 2 / sum(n * n), 9) as n_eff from (select count(*) as n from suo group by orbit))" for k in (8, 9, 10)),
    "copresence_corr": _CO + " select * from co",
    "perfect_oppositions": _CO + " select * from co where corr <= -0.9",
    "attractor_stats": _AT + f" select count(*) as n, round(avg(bit_count(orbit)), 6) as mean, round(stddev_pop(bit_count(orbit)), 6) as std, min(bit_count(orbit)) as least, max(bit_count(orbit)) as most, count(*) filter (bit_count(orbit) >= 0.85 * {N}) as saturated, round(sum(bit_count(orbit) * n) / sum(n), 6) as weighted_mean from att",
    "core_nodes": _AT + f" select i as node_id, round(avg((orbit >> i) & 1), 6) as presence, round(avg((orbit >> i) & 1), 6) >= 0.8 as core from att, (select unnest(range({N}))::int as i) group by 1",
    "cluster_frontier": _E + f", bw2 as (select i, abs(w) as w from e where raw <> 0 union all select j, abs(w) from e where raw <> 0), st2 as (select node_id, round(coalesce(sum(w), 0), 9) as strength from n left join bw2 on i = node_id group by 1), c3 as (select node_id, ((row_number() over (order by strength desc, node_id) - 1) * 3 // {N})::int as c from st2), q as (select x.node_id as i, y.node_id as j, x.c as ci, y.c as cj, coalesce(w, 0) as w from c3 x join c3 y on x.node_id < y.node_id left join e on e.i = x.node_id and e.j = y.node_id), g as (select least(ci, cj) as a, greatest(ci, cj) as b, avg(w) as m from q group by all), z as (select g.a, g.b, g.m, least(x.m, y.m) as low from g join g x on x.a = g.a and x.b = g.a join g y on y.a = g.b and y.b = g.b where g.a < g.b) select a, b, round(m, 9) as inter, round(low, 9) as least_intra, case when abs(m) <= 1e-12 then 'inf' when m < 0 then 'opposition' else 'ratio' end as kind, round(case when m > 1e-12 then low / m end, 6) as coercivity from z",
    "density_curve": PL._S + f", kk as (select k, r, i, row_number() over (partition by k, r order by md5(k || ':' || r || ':' || i)) as p from (select unnest(range(1, {N})) as k), (select unnest(range(20)) as r), (select unnest(range({N})) as i)), st as (select k, r, sum(1 << i)::bigint as state from kk where p <= k group by all), mx as (select max(abs(raw)) as top from e), c1 as (select k, r, sum(raw / top * xa.x * xb.x) / {N * (N - 1) // 2} as cs from st, mx, e join sb xa on true join sb xb on true where xa.s = state and xa.i = e.i and xb.s = state and xb.i = e.j group by all) select k, round(avg(cs), 9) as mean_cs from c1 group by 1",
    "threshold_edges": _E + f" select i, j, round(w, 9) as w from e where abs(w) >= {THETA}",
    "direction_score": _SD + _DI + " select unit_id, round(case when nd > 0 then met / nd else 1 end, 6) as direction, nd as n_dependencies from di",
    "gatekeeper_c1": _E + f", b as (select i, j, w from e union all select j, i, w from e), m as (select i as node_id, max(abs(w)) as x from b where j < {N // 2} group by 1) select node_id, round(x, 9) as strongest, x >= {THETA} as admitted from m",
    "tension": _E + " select round(sum(case when w < 0 then -w else 0 end) / nullif(sum(abs(w)), 0), 9) as tension from e",
    "order_brand_w": "with p as (select distinct l_orderkey as k, p_brand as b from lineitem join part on l_partkey = p_partkey), q as (select x.b as i, y.b as j, sum(case when o_orderpriority = '1-URGENT' then -1 else 1 end)::bigint as raw from p x join p y on x.k = y.k and x.b < y.b left join orders on o_orderkey = x.k group by all) select i, j, raw, round(raw / max(abs(raw)) over (), 9) as w from q",
    "event_phi": "with p as (select distinct user_id || '|' || date_trunc('hour', ts) as u, event_type as t from events where user_id is not null and ts is not null), n as (select count(distinct u)::double as n from p), c as (select t, count(*)::double as m from p group by 1), q as (select x.t as i, y.t as j, count(*) as n_ij from p x join p y on x.u = y.u and x.t < y.t group by all) select i, j, n_ij, round((n * n_ij - a.m * b.m) / sqrt(a.m * b.m * (n - a.m) * (n - b.m)), 9) as phi, round(ln(n_ij * n / (a.m * b.m)), 9) as pmi from q join c a on a.t = i join c b on b.t = j, n",
}
