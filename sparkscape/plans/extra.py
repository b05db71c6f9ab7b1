"""Further queries: provenance, rebuild policy, null models by marker, dispute matrices, capabilities."""

from __future__ import annotations

from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from sparkscape.functions import text as T
from sparkscape.operators import analytics as A
from sparkscape.operators import corpus as C
from sparkscape.operators import landscape as L
from sparkscape.operators import monitor as M
from sparkscape.operators import nulls as U
from sparkscape.plans import landscape as PL
from sparkscape.plans.analytics import grid
from sparkscape.plans.corpus import base, lines, units
from sparkscape.plans.monitor import _R, _W, recs
from sparkscape.session import cut, table

N = PL.N


def count_w(s, d):
    """Co-occurrence over paragraphs instead of whole documents, divided by their number."""
    nodes = cut(C.nodes(units(s, d), N))
    p = lines(s, d).where(T.not_blank(F.col("line"))).select(F.xxhash64("unit_id", "pos").alias("unit_id"), F.col("line").alias("text"))
    n = p.agg(F.count("*").alias("m"))
    e = C.pairs(C.presence(p, nodes)).crossJoin(n)  # one row
    return e.select("i", "j", F.col("n_pos").alias("n"), F.round(F.col("n_pos") / F.col("m"), 9).alias("w"))


def first_traces(s, d):
    """First record of each (series, sampling mode): distinct calibrations of a trajectory."""
    w = Window.partitionBy("series", "sampling_mode").orderBy("t", "rec_id")
    return recs(s, d).where("sampling_mode is not null").withColumn("k", F.row_number().over(w)).where("k = 1").select("series", "sampling_mode", "rec_id", "t")


def provenance(s, d):
    """Threshold of each record: MEASURED from the last earlier record of its series with a distance in the
    same sampling mode, else DECLARED with its cause."""
    w = Window.partitionBy("series").orderBy("t", "rec_id").rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(F.col("D_ckm").isNotNull(), F.struct("sampling_mode", "D_ckm")), ignorenulls=True).over(w)
    r = recs(s, d).withColumn("last", last)
    same = F.col("last.sampling_mode").eqNullSafe(F.col("sampling_mode"))
    ok = F.col("last").isNotNull() & same
    return r.select("rec_id", F.when(ok, F.col("last.D_ckm")).otherwise(M.D_THRESHOLD).alias("threshold"), F.when(ok, "MEASURED").otherwise("DECLARED").alias("origin"), F.when(F.col("last").isNull(), "no calibration").when(~same, "other mode").alias("cause"))


def signatures(s, d):
    """Whether each record's mode was ever a state of its series before it, and whether it is the current one."""
    r = recs(s, d)
    history = r.where("sampling_mode is not null").groupBy("series", "sampling_mode").agg(F.min(F.struct("t", "rec_id")).alias("since"))
    current = F.lag("sampling_mode").over(M.in_order())
    j = r.withColumn("current", current).join(history, ["series", "sampling_mode"], "left")
    known = F.coalesce(F.col("since") < F.struct("t", "rec_id"), F.lit(False))
    return j.select("rec_id", known.alias("known"), F.col("sampling_mode").eqNullSafe(F.col("current")).alias("is_current"))


def rebuilds(s, d, first=30, every=10, devices=2):
    """Cause at each record: structural (mode changed), volume (each ``every`` texts after the first ``first``), or none.

    The first W needs ``first`` texts of at least ``devices`` devices.
    """
    r = recs(s, d).withColumn("has", T.not_blank(F.coalesce("text", F.lit(""))).cast("int"))
    n = F.sum("has").over(M.in_order())
    fresh = F.col("device_id").isNotNull() & (F.row_number().over(Window.partitionBy("series", "device_id").orderBy("t", "rec_id")) == 1)
    r = r.withColumn("fresh", fresh.cast("int")).withColumn("n", n).withColumn("seen", F.sum("fresh").over(M.in_order())).withColumn("was", F.lag("sampling_mode").over(M.in_order()))
    ready = (F.col("n") >= first) & (F.col("seen") >= devices)
    cause = F.when(~ready, "not ready").when(F.col("sampling_mode").isNotNull() & F.col("was").isNotNull() & (F.col("sampling_mode") != F.col("was")), "structural").when((F.col("n") % every == 0) & (F.col("has") == 1), "volume").otherwise("none")
    return r.select("rec_id", F.col("n").alias("n_texts"), cause.alias("cause"))


def snapshot(s, d):
    """Quadrant of each record by fabrication and cohesion, and where it changes within the series."""
    fi, c = F.col("fabrication_index"), F.col("c_S")
    q = F.when(fi.isNull() | c.isNull(), "UNKNOWN").when(fi >= 0.5, F.when(c >= 0, "binding").otherwise("breaking")).otherwise(F.when(c >= 0, "cohesive").otherwise("open"))
    r = recs(s, d).withColumn("quadrant", q)
    return r.select("rec_id", "quadrant", (~F.col("quadrant").eqNullSafe(F.lag("quadrant").over(M.in_order()))).alias("inflection"), F.round(fi - F.lag("fabrication_index").over(M.in_order()), 6).alias("trend"))


def efficiency(s, d, gamma=0.1):
    """Minus gamma times the mean gain per alpha of the last five records (two at least), clipped alpha beside it."""
    a = M.alpha(F.greatest(F.col("D_ckm"), F.lit(0.0)))
    gain = (F.col("fabrication_index") - F.lag("fabrication_index").over(M.in_order())) / a
    r = recs(s, d).withColumn("gain", gain)
    w = M.in_order(4)
    comp = F.when(F.count("gain").over(w) >= 2, -gamma * F.avg("gain").over(w)).otherwise(0.0)
    return r.select("rec_id", F.round(comp, 6).alias("component"), F.round(F.least(F.lit(M.ALPHA_MAX), F.greatest(F.lit(M.ALPHA_MIN), a + comp)), 6).alias("alpha"))


def share(k):
    """Probability that a sample has k active nodes: the part of [0.3, 0.7] N that rounds to k."""
    lo, hi = 0.3 * N, 0.7 * N
    return max(0.0, min(hi, k + 0.5) - max(lo, k - 0.5)) / (hi - lo)


def weighted(s, d):
    """Exact basin masses and effective number under the sampling measure P(k) / C(N, k)."""
    e = PL.exact(s, d)
    w = F.element_at(F.array(*(F.lit(share(k) / comb(N, k)) for k in range(N + 1))), (F.bit_count("state") + 1).cast("int"))
    b = e.groupBy("orbit").agg(F.sum(w).alias("mass"))
    return b.agg(F.round(F.sum("mass"), 9).alias("total"), F.round(F.pow(F.sum("mass"), 2) / F.sum(F.col("mass") * F.col("mass")), 9).alias("n_eff"))


def marker_null(s, d, runs=10):
    """Sum of raw weights when as many documents as carry a marker are marked at random, run by run."""
    u = units(s, d)
    nodes = cut(C.nodes(u, N))
    a = C.active_nodes(C.presence(u, nodes)).select("unit_id", (F.size("active") * (F.size("active") - 1) / 2).cast("bigint").alias("pairs"))
    flag = u.select("unit_id", T.opposes(F.col("text")).alias("neg"))
    k = flag.agg(F.count_if("neg").alias("k"))
    p = cut(flag.join(a, "unit_id", "left").select("unit_id", "neg", F.coalesce("pairs", F.lit(0)).alias("pairs")))
    seen = p.agg(F.sum(F.when(F.col("neg"), -F.col("pairs")).otherwise(F.col("pairs"))).alias("observed"))
    r = p.join(F.broadcast(s.range(runs).select(F.col("id").alias("run"))))  # runs: a given, small number
    x = U.ranked(r.withColumn("d_", U.key("m", "unit_id")), ["run"], ["d_", "unit_id"], "rank").crossJoin(k).groupBy("run").agg(F.sum(F.when(F.col("rank") <= F.col("k"), -F.col("pairs")).otherwise(F.col("pairs"))).alias("total"))
    return x.crossJoin(seen)


def marker_test(s, d, runs=20):
    """Effective number of W when as many documents are marked at random as carry a marker: observed drop from the all-positive W, and its percentile.

    Nodes and presence stay; a run's W takes the marked units' pairs away twice. W has at most N * N / 2 edges a run."""
    u = units(s, d)
    nodes = cut(C.nodes(u, N))
    a = C.active_nodes(C.presence(u, nodes))
    p = cut(a.select("unit_id", F.posexplode("active").alias("at", "i"), "active").select("unit_id", "i", F.explode(F.expr("slice(active, at + 2, size(active))")).alias("j")))
    flag = cut(u.select("unit_id", T.opposes(F.col("text")).alias("neg")))
    k = flag.agg(F.count_if("neg").alias("k_"))
    drawn = U.ranked(flag.select("unit_id").join(F.broadcast(s.range(runs).select(F.col("id").alias("run")))).withColumn("d_", U.key("m", "unit_id")), ["run"], ["d_", "unit_id"], "rank")
    marked = drawn.crossJoin(k).where("rank <= k_").select("run", "unit_id").union(flag.where("neg").select(F.lit(-1).cast("bigint"), "unit_id"))  # k: one row; run -1 is the observed
    every = cut(p.groupBy("i", "j").agg(F.count("*").alias("n")))
    neg = p.join(marked, "unit_id").groupBy("run", "i", "j").agg(F.count("*").alias("m"))
    all_runs = s.range(-2, runs).select(F.col("id").alias("run"))  # run -2 is all positive
    raw = every.join(F.broadcast(all_runs)).join(neg, ["run", "i", "j"], "left").select("run", "i", "j", (F.col("n") - 2 * F.coalesce("m", F.lit(0))).alias("raw"))
    w = raw.groupBy("run").agg(F.collect_list(F.struct("i", "j", "raw")).alias("edges"))

    def measure(batches):
        for b in batches:
            out = []
            for edges in b.column("edges").to_pylist():
                m = np.zeros((N, N), dtype=np.int64)
                for e in edges:
                    m[e["i"], e["j"]] = m[e["j"], e["i"]] = e["raw"]
                n = np.unique(L.relax(np.arange(1 << N), m)[0], return_counts=True)[1].astype(float)
                out.append(round(float(n.sum() ** 2 / (n**2).sum()), 9))
            yield pa.RecordBatch.from_arrays([b.column("run"), pa.array(out, pa.float64())], names=["run", "n_eff"])

    r = cut(w.mapInArrow(measure, "run bigint, n_eff double"))
    one = r.agg(F.max(F.when(F.col("run") == -1, F.col("n_eff"))).alias("n_eff"), F.max(F.when(F.col("run") == -2, F.col("n_eff"))).alias("n_eff_positive"))
    x = r.where("run >= 0").withColumnRenamed("n_eff", "e").join(F.broadcast(one))  # one row
    drop = lambda c: F.col("n_eff_positive") - c
    return x.groupBy("n_eff", "n_eff_positive").agg(F.count("*").alias("runs"), F.round(drop(F.avg("e")), 6).alias("null_mean_drop"), F.round(F.stddev_samp("e"), 6).alias("null_sd"), F.round(F.avg((drop(F.col("e")) <= drop(F.col("n_eff"))).cast("int")), 6).alias("percentile")).withColumn("drop", F.round(drop(F.col("n_eff")), 6))


def disputes(s, d):
    """Dispute and support between groups of pages and tabs, by the vote's side, each scaled by its largest."""
    v = table(s, d, "vote").where("disagree_agree is not null and page is not null")
    g = v.groupBy((F.col("page") % 20).alias("a"), F.col("tab").alias("b")).agg(F.count_if(F.col("disagree_agree") < 0).alias("dispute"), F.count_if(F.col("disagree_agree") > 0).alias("support"))
    every = Window.partitionBy()
    return g.select("a", "b", F.round(F.col("dispute") / F.max("dispute").over(every), 9).alias("dispute"), F.round(F.col("support") / F.max("support").over(every), 9).alias("support"))


def elicited(s, d):
    """Pairs of nodes with tension, asymmetry of degree and a third node; score of the three that hold."""
    n, e = C.signed_w(units(s, d), N)
    st = C.row_strength(n, e).select("node_id", "degree")
    x = e.join(F.broadcast(st.select(F.col("node_id").alias("i"), F.col("degree").alias("di"))), "i").join(F.broadcast(st.select(F.col("node_id").alias("j"), F.col("degree").alias("dj"))), "j")
    b = cut(C.both_ways(e).where("raw <> 0").select("i", F.col("j").alias("k")))
    third = b.join(b.select(F.col("i").alias("j"), "k"), "k").where("i < j").select("i", "j").distinct().withColumn("third", F.lit(True))
    y = x.join(third, ["i", "j"], "left").select("i", "j", (F.col("raw") < 0).alias("tension"), (F.abs(F.col("di") - F.col("dj")) >= 2).alias("asymmetry"), F.coalesce("third", F.lit(False)).alias("third"))
    return y.withColumn("score", F.col("tension").cast("int") + F.col("asymmetry").cast("int") + F.col("third").cast("int"))


def capabilities(s, d, theta=0.2):
    """Each node as a capability that depends on the nodes it is strongly tied to: what is unmet per document."""
    n, e = C.signed_w(units(s, d), N)
    needs = C.both_ways(e).where((F.col("w") >= theta)).select(F.col("i").alias("node_id"), F.col("j").alias("need"))
    present = cut(C.presence(units(s, d), n))
    wanted = present.join(F.broadcast(needs), "node_id")  # at most top_k ** 2 rows
    met = present.select("unit_id", F.col("node_id").alias("need"), F.lit(1).alias("met"))
    j = wanted.join(met, ["unit_id", "need"], "left")
    return j.groupBy("unit_id").agg(F.count("*").alias("n_needed"), F.sum(F.coalesce("met", F.lit(0))).alias("n_met")).withColumn("admitted", F.col("n_met") * 2 >= F.col("n_needed"))


def scrubbed(s, d):
    """Nodes that enter or leave when two tokens are scrubbed from the texts."""
    u = units(s, d)
    gone = ("midió", "lost")
    a = C.nodes(u, N).select("term", F.lit(1).alias("a"))
    b = C.nodes(u, N, stop=T.STOP_WORDS + gone).select("term", F.lit(1).alias("b"))
    return a.join(b, "term", "full").where("a is null or b is null").select("term", F.when(F.col("a").isNull(), "enters").otherwise("leaves").alias("change"))


def scales(s, d):
    """n_eff of W, of W against its transposed sum, of clipped and of doubled weights: the landscape ignores scale."""
    w, out = PL.weights(s, d), None
    for name, x in (("raw", w), ("doubled", 2 * w), ("sum", w + w.T), ("clipped", np.clip(w, -1, 1))):
        one = L.n_eff(L.relaxed(L.all_states(s, N), x)).select(F.lit(name).alias("variant"), "n_eff")
        out = one if out is None else out.union(one)
    return out


def swap_row(w, seed):
    x = A.swapped(w, 200, seed)
    _, n = np.unique(L.relax(np.arange(1 << len(w)), x)[0], return_counts=True)
    return int((np.triu(x, 1) != 0).sum()), len(n), round(float(n.sum() ** 2 / (n.astype(float) ** 2).sum()), 9)


def prefixes_of(s, d, sizes):
    """W of each prefix of the corpus: edges, their sum and the nodes, oldest first; nodes at a tie keep their place.
    Terms and signs are taken once, for all prefixes."""
    out, before = None, None
    every = units(s, d).where(F.col("unit_id") <= sizes[-1])
    terms = cut(C.term_counts(every))
    flags = cut(every.select("unit_id", T.opposes(F.col("text")).alias("negative")))
    for size in sizes:
        u, counts, flag = (x.where(F.col("unit_id") <= size) for x in (every, terms, flags))
        n = cut(C.nodes_of(C.scores_of(counts, u, N), N, before))
        e = C.edges(C.pairs(counts.join(F.broadcast(n.select("term", "node_id")), "term").select("unit_id", "node_id"), flag))
        row = e.agg(F.lit(size).cast("bigint").alias("size"), F.count("*").alias("n_edges"), F.sum("raw").alias("total"))
        before = [r[0] for r in n.select("term").collect()]  # at most top_k terms
        out = row if out is None else out.union(row)
    return out


def corpus_versions(s, d):
    """prefixes_of thirds of the ids there are; the last is the whole corpus."""
    lo, hi = units(s, d).agg(F.coalesce(F.min("unit_id"), F.lit(0)), F.coalesce(F.max("unit_id"), F.lit(0))).first()
    return prefixes_of(s, d, [lo + (hi - lo) * k // THIRDS for k in range(1, THIRDS + 1)])


THIRDS = 3

QUERIES = {
    "w_prefixes_whole": corpus_versions,
    "degree_swaps": lambda s, d: grid(s, d, 20, lambda w, c: [(c, *swap_row(w, c))], "seed int, n_edges int, n_orbits int, n_eff double"),
    "frontier_screening": lambda s, d: grid(s, d, 7, lambda w, c: [(c + 2, *A.screen(w, c + 2, 300, 1).values())], "k int, porosity double, p double, verdict string"),
    "first_melting": lambda s, d: grid(s, d, 1, lambda w, c: A.first_melting(w, [0.05, 0.1, 0.2, 0.5, 1.0, 2.0], 3), "i int, j int, beta double"),
    "collapse_distribution": lambda s, d: A.over_grid(s, 6, lambda c: [(c + 5, v, p) for v, p in A.collapse_distribution(c + 5, 20)], "n int, n_eff double, p double"),
    "count_w": count_w,
    "first_traces": first_traces,
    "threshold_provenance": provenance,
    "firma_verify": signatures,
    "rebuild_hierarchy": rebuilds,
    "fabrication_snapshot": snapshot,
    "landscape_component": efficiency,
    "neff_weighted": weighted,
    "sample_symmetry": lambda s, d: L.sampled(s, 2000, N, 1).groupBy("n_act").agg(F.count("*").alias("n")),
    "null_marker_shuffle": marker_null,
    "null_marker_test": marker_test,
    "dispute_support": disputes,
    "pair_elicitation": elicited,
    "capability_deps": capabilities,
    "scrub_control": scrubbed,
    "scale_family": scales,
}

_E = "with " + base(k=N)
_SCRUBBED = base(k=N).replace("term not in (", "term not in ('midió', 'lost', ")


def _weights_sql():
    return "[" + ", ".join(repr(share(k) / comb(N, k)) + "::double" for k in range(N + 1)) + "]"


SQL = {
    "scale_family": PL.n_eff_rows([("'raw'", "raw"), ("'doubled'", "2 * raw"), ("'sum'", "raw + raw"), ("'clipped'", "greatest(-1, least(1, raw))")], "variant"),
    "w_prefixes_whole": " union all ".join(f"select * from (with {base(f'doc_id <= (select min(doc_id) + ((max(doc_id) - min(doc_id)) * {k}) // {THIRDS} from documents)', N)} select (select (min(doc_id) + ((max(doc_id) - min(doc_id)) * {k}) // {THIRDS})::bigint from documents) as size, count(*) as n_edges, sum(raw)::bigint as total from e)" for k in range(1, THIRDS + 1)),
    "count_w": _E + r", pl as (select unit_id, pos, line from (select unit_id, unnest(string_split(text, e'\n')) as line, unnest(range(len(string_split(text, e'\n')))) as pos from u) where regexp_matches(line, '[^ \t\r\n]')), px as (select distinct unit_id, pos, node_id from (select unit_id, pos, unnest(regexp_extract_all(lower(nfc_normalize(line)), '[\p{L}\p{Nl}\p{No}_]{3,}')) as term from pl) join n using (term)), m as (select count(*) as m from pl) select a.node_id as i, b.node_id as j, count(*) as n, round(count(*) / any_value(m), 9) as w from px a join px b on a.unit_id = b.unit_id and a.pos = b.pos and a.node_id < b.node_id, m group by 1, 2",
    "first_traces": _R + "select series, sampling_mode, rec_id, t from rc where sampling_mode is not null qualify row_number() over (partition by series, sampling_mode order by t, rec_id) = 1",
    "threshold_provenance": _R + """, q as (select *, last_value(case when "D_ckm" is not null then {'m': sampling_mode, 'd': "D_ckm"} end ignore nulls) over (partition by series order by t, rec_id rows between unbounded preceding and 1 preceding) as l from rc)
select rec_id, case when l is not null and l.m is not distinct from sampling_mode then l.d else 0.4 end as threshold, case when l is not null and l.m is not distinct from sampling_mode then 'MEASURED' else 'DECLARED' end as origin, case when l is null then 'no calibration' when l.m is distinct from sampling_mode then 'other mode' end as cause from q""",
    "firma_verify": _R + ", q as (select *, lag(sampling_mode) over w as cur, sum(1) over (partition by series, sampling_mode order by t, rec_id) as k from rc" + _W + ") select rec_id, sampling_mode is not null and k > 1 as known, sampling_mode is not distinct from cur as is_current from q",
    "rebuild_hierarchy": _R + r""", h as (select *, coalesce(regexp_matches(text, '[^ \t\r\n]'), false)::int as has from rc), q as (select *, sum(has) over w as n, lag(sampling_mode) over w as was, len(list_distinct(list(device_id) over w)) as seen from h""" + _W + """) select rec_id, n::bigint as n_texts, case when not (n >= 30 and seen >= 2) then 'not ready' when sampling_mode <> was then 'structural' when n % 10 = 0 and has = 1 then 'volume' else 'none' end as cause from q""",
    "fabrication_snapshot": _R + """, q as (select *, case when fabrication_index is null or "c_S" is null then 'UNKNOWN' when fabrication_index >= 0.5 then case when "c_S" >= 0 then 'binding' else 'breaking' end when "c_S" >= 0 then 'cohesive' else 'open' end as quadrant from rc) select rec_id, quadrant, quadrant is distinct from lag(quadrant) over w as inflection, round(fabrication_index - lag(fabrication_index) over w, 6) as trend from q""" + _W,
    "landscape_component": _R + """, a as (select *, case when greatest("D_ckm", 0) is not null then 0.3::double - 0.25::double * least(1, greatest(0, (greatest("D_ckm", 0) - 0.4::double) / 0.6::double)) end as al from rc), g as (select *, (fabrication_index - lag(fabrication_index) over w) / al as gain from a""" + _W + """), c as (select *, case when count(gain) over f >= 2 then -0.1::double * avg(gain) over f else 0 end as comp from g window f as (partition by series order by t, rec_id rows between 4 preceding and current row)) select rec_id, round(comp, 6) as component, round(least(0.3::double, greatest(0.05::double, al + comp)), 6) as alpha from c""",
    "neff_weighted": PL._O + f", b as (select orbit, sum({_weights_sql()}[bit_count(s) + 1]) as mass from suo group by 1) select round(sum(mass), 9) as total, round(sum(mass) ** 2 / sum(mass * mass), 9) as n_eff from b",
    "sample_symmetry": f"with r as (select greatest(1, round_even((0.3::double + 0.4::double * (('0x' || md5('1:' || run || ':act')[1:8])::bigint / 4294967296.0::double)) * {N}, 0))::int as n_act from (select unnest(range(2000)) as run)) select n_act, count(*) as n from r group by 1",
    "null_marker_shuffle": _E + ", ac as (select unit_id, count(*) as k from pr group by 1), pm as (select u.unit_id, negative as neg, coalesce(k * (k - 1) // 2, 0) as pairs from u join sg using (unit_id) left join ac using (unit_id)), kk as (select count(*) filter (neg) as k, sum(case when neg then -pairs else pairs end)::bigint as observed from pm), xm as (select run, pairs, row_number() over (partition by run order by md5('m:' || run || ':' || unit_id), unit_id) as rank from pm, (select unnest(range(10)) as run)) select run, sum(case when rank <= k then -pairs else pairs end)::bigint as total, any_value(observed) as observed from xm, kk group by 1",
    "dispute_support": "with g as (select page % 20 as a, tab as b, count(*) filter (disagree_agree < 0) as d, count(*) filter (disagree_agree > 0) as p from vote where disagree_agree is not null and page is not null group by all) select a, b, round(d / max(d) over (), 9) as dispute, round(p / max(p) over (), 9) as support from g",
    "pair_elicitation": _E + ", bw as (select i, j from e where raw <> 0 union all select j, i from e where raw <> 0), dg as (select node_id, count(j) as dg from n left join bw on i = node_id group by 1), th as (select distinct a.i, b.i as j from bw a join bw b on a.j = b.j where a.i < b.i), y as (select e.i, e.j, raw < 0 as tension, abs(x.dg - z.dg) >= 2 as asymmetry, th.i is not null as third from e join dg x on x.node_id = e.i join dg z on z.node_id = e.j left join th on th.i = e.i and th.j = e.j) select *, tension::int + asymmetry::int + third::int as score from y",
    "capability_deps": _E + ", nd as (select i as node_id, j as need from e where w >= 0.2 union all select j, i from e where w >= 0.2), wt as (select pr.unit_id, need from pr join nd using (node_id)) select wt.unit_id, count(*) as n_needed, count(m.node_id) as n_met, count(m.node_id) * 2 >= count(*) as admitted from wt left join pr m on m.unit_id = wt.unit_id and m.node_id = need group by 1",
    "scrub_control": f"with a as (with {base(k=N)} select term from n), b as (with {_SCRUBBED} select term from n) select coalesce(a.term, b.term) as term, case when a.term is null then 'enters' else 'leaves' end as change from a full join b on a.term = b.term where a.term is null or b.term is null",
}
