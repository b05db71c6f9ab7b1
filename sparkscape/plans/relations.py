"""Queries over the forum tables: vote chain, pairs, graph and null models."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkscape.operators import nulls as U
from sparkscape.operators import votes as V
from sparkscape.session import cut, table
from sparkscape.sources import files as D

TOPIC = 9


def chain(s, d):
    return V.resolved(s, d, TOPIC)


def pairs(s, d):
    return V.pair_votes(chain(s, d))


def edges(s, d):
    return V.symmetric(pairs(s, d))


def author_pairs(s, d):
    """Ordered author pairs by the votes of all discussions."""
    return V.pair_votes(V.resolved(s, d, None))


def author_edges(s, d):
    """Signed author graph: the sign is that of the votes on a pair's quotes, in both directions together."""
    return V.symmetric(author_pairs(s, d))


def quotes(s, d):
    """Author graph of quotes: a quotes b, over all discussions."""
    p = table(s, d, "post").groupBy("discussion_id", "post_id").agg(F.min("author_id").alias("author"))
    q = table(s, d, "post_quote").select("discussion_id", "post_id", "quote_index", "src_discussion_id", "src_post_id").distinct()
    q = q.join(p, ["discussion_id", "post_id"]).join(p.select(F.col("discussion_id").alias("src_discussion_id"), F.col("post_id").alias("src_post_id"), F.col("author").alias("quoted")), ["src_discussion_id", "src_post_id"])
    return q.where("author is not null and quoted is not null and author <> quoted").select("author", "quoted")


def quote_edges(s, d):
    q = quotes(s, d).groupBy(F.least("author", "quoted").alias("a"), F.greatest("author", "quoted").alias("b")).agg(F.count("*").alias("n"))
    return q.select("a", "b", "n", F.lit(1).alias("sign"))


def quote_degrees(s, d):
    q = quotes(s, d)
    out = q.groupBy(F.col("author").alias("v")).agg(F.count("*").alias("n_out"))
    inn = q.groupBy(F.col("quoted").alias("v")).agg(F.count("*").alias("n_in"))
    b = out.join(inn, "v", "full").select("v", F.coalesce("n_in", F.lit(0)).alias("n_in"), F.coalesce("n_out", F.lit(0)).alias("n_out")).withColumn("ratio", F.round(F.col("n_in") / (F.col("n_out") + 0.5), 6))
    kind = F.when(F.col("ratio") > 10, "quoted").when(F.col("ratio") > 3, "mostly quoted").otherwise("both")
    return b.where("n_in >= 10").orderBy(F.desc("ratio"), "v").limit(30).withColumn("kind", kind)


def bins(s, d):
    b = F.when(F.col("n") == 1, "1").when(F.col("n") == 2, "2").when(F.col("n") <= 5, "3-5").when(F.col("n") <= 10, "6-10").when(F.col("n") <= 50, "11-50").otherwise(">50")
    return pairs(s, d).where("self_pair = 0").groupBy(b.alias("bin")).agg(F.count("*").alias("n_pairs"), F.sum("n").alias("n_votes"))


def asymmetry(s, d):
    g = pairs(s, d).where("self_pair = 0").groupBy("quoted_stance", "responding_stance")
    return g.agg(F.count("*").alias("n_pairs"), F.sum("n").alias("n_votes"), F.round(F.sum("total") / F.sum("n"), 3).alias("mean_vote"), F.round(100 * F.sum("n_negative") / F.sum("n"), 2).alias("pct_disagree"), F.round(100 * F.sum("n_positive") / F.sum("n"), 2).alias("pct_agree"))


def frustration(s, d):
    """Triangles of the signed author graph: with a zero sign, frustrated, and the share of these among the others and among all triples of authors."""
    e = cut(author_edges(s, d))
    t = V.triangles(e).agg(F.count("*").alias("n"), F.count_if(F.col("product") == 0).alias("with_zero"), F.count_if(F.col("product") < 0).alias("frustrated"))
    v = e.select(F.explode(F.array("a", "b")).alias("v")).agg(F.count_distinct("v").cast("double").alias("v"))
    x = t.crossJoin(v)  # one row each
    triples = F.col("v") * (F.col("v") - 1) * (F.col("v") - 2) / 6
    return x.select("n", "with_zero", "frustrated", F.round(F.try_divide(F.col("frustrated").cast("double"), F.col("n") - F.col("with_zero")), 9).alias("index"), F.round(F.try_divide(F.col("frustrated").cast("double"), triples), 15).alias("index_all"))


def variants(s, d):
    e = edges(s, d)
    return e.select("a", "b", F.expr("inline(array(named_struct('variant', 'obs', 'w', mean), named_struct('variant', 'sign', 'w', cast(sign as double)), named_struct('variant', 'presence', 'w', 1.0d)))"))


def sign_null(s, d, runs=10):
    """Total weight of negative edges in each shuffled run: the sign travels, the pair's n stays."""
    e = cut(author_edges(s, d))
    n = V.shuffled_signs(e, runs).join(e.select("a", "b", "n"), ["a", "b"])
    return n.groupBy("run").agg(F.sum(F.when(F.col("sign") < 0, F.col("n")).otherwise(0)).alias("negative"), F.sum("n").alias("total"))


def sign_null_test(s, d, runs=100):
    """Frustrated triangles against those of graphs with permuted edge signs."""
    e = cut(author_edges(s, d).select("a", "b", "sign"))
    tri = cut(V.triangles(e))
    return U.judged(V.frustration(tri, V.shuffled_signs(e, runs)), "frustrated", tri.agg(F.count_if(F.col("product") < 0).alias("observed")))


def vote_null_test(s, d, runs=100):
    """Frustrated triangles against those of graphs whose votes are permuted over all votes, graph and votes per pair staying."""
    v = cut(V.resolved(s, d, None).where("reason is null and quoted <> responding").select(F.least("quoted", "responding").alias("a"), F.greatest("quoted", "responding").alias("b"), "vote_id", "vote"))
    own = v.groupBy("a", "b").agg(F.signum(F.sum("vote")).cast("int").alias("sign"))
    tri = cut(V.triangles(own))
    signs = U.shuffled(v, ["a", "b", "vote_id"], "vote", runs, 11).groupBy("run", "a", "b").agg(F.signum(F.sum("vote")).cast("int").alias("sign"))
    return U.judged(V.frustration(tri, signs), "frustrated", tri.agg(F.count_if(F.col("product") < 0).alias("observed")))


def vote_null(s, d, runs=10):
    """Votes permuted over all resolved votes, pair sizes kept: pairs with a negative sum in each run."""
    v = chain(s, d).where("reason is null and quoted <> responding").select("vote_id", F.concat_ws("-", "quoted", "responding").alias("a"), F.col("vote_id").alias("b"), F.col("vote").alias("sign"))
    p = V.shuffled_signs(v, runs).groupBy("run", "a").agg(F.sum("sign").alias("total"))
    return p.groupBy("run").agg(F.count("*").alias("n_pairs"), F.count_if(F.col("total") < 0).alias("n_negative"))


def diff(s, d):
    """Cell by cell: pairs by all votes against pairs by votes that aren't marked unsure."""
    c = chain(s, d)
    a = V.symmetric(V.pair_votes(c)).select("a", "b", F.col("total").alias("left_total"))
    b = V.symmetric(V.pair_votes(c.where("unsure = 0"))).select("a", "b", F.col("total").alias("right_total"))
    m = a.join(b, ["a", "b"], "full").where(~F.col("left_total").eqNullSafe(F.col("right_total")))
    return m.withColumn("kind", F.when(F.col("right_total").isNull(), "missing").otherwise("changed"))


def best_match(s, d):
    """For each stance pair the stance pair of nearest mean vote."""
    a = asymmetry(s, d).select(F.concat_ws("-", "quoted_stance", "responding_stance").alias("g"), "mean_vote")
    b = a.select(F.col("g").alias("other"), F.col("mean_vote").alias("m2"))
    both = a.join(F.broadcast(b), F.col("g") != F.col("other"))  # at most four groups
    return both.groupBy("g").agg(F.min_by("other", F.struct(F.abs(F.col("mean_vote") - F.col("m2")).alias("gap"), "other")).alias("nearest"))


def dump_rows(s, d):
    """Rows of each dump table by counting row ends in INSERT-style lines, without parsing them."""
    l = table(s, d, "dump_line").where("fmt = 'sql'").where(F.col("line").startswith("("))
    return l.groupBy("table_name").agg(F.sum((F.length("line") - F.length(F.replace("line", F.lit("),("), F.lit("")))) / 3 + 1).cast("bigint").alias("n"))


def dump_scan(s, d, topic=None):
    """Projected scan of post records, ids only: the wanted columns are cut from the line, the others not parsed; ids beyond the declared largest are left out.

    With a topic, only posts of its discussions: the filter is in the scan."""
    l = table(s, d, "dump_line").where("table_name = 'post' and fmt = 'sql'")
    ids = {c: D.sql_column(F.col("line"), k, 3) for k, c in enumerate(("discussion_id", "post_id", "author_id"))}
    x = l.select("line_id", *(F.when(v.rlike("^[0-9]+$"), v.try_cast("decimal(38,0)")).alias(c) for c, v in ids.items()))
    x = x.where(" and ".join(f"{c} between 0 and 2147483647" for c in ids)).select("line_id", *(F.col(c).cast("bigint").alias(c) for c in ids))
    return x if topic is None else x.join(V.topic_discussions(s, d, topic), "discussion_id", "left_semi").select("line_id", *ids)


TABLES = "discussion_topic post post_quote mturk_author_stance mturk_2010_qr_entry vote".split()


def explored(s, d):
    """The forum tables that are there: rows and the first eight columns; a table that isn't has no row."""
    out = None
    for t in TABLES:
        if not D.exists(s, f"{d}/{t}.parquet"):
            continue
        df = table(s, d, t)
        one = df.agg(F.count("*").alias("n_rows")).select(F.lit(t).alias("table_name"), "n_rows", F.lit(",".join(df.columns[:8])).alias("columns"))
        out = one if out is None else out.unionByName(one)
    return out if out is not None else s.createDataFrame([], "table_name string, n_rows bigint, columns string")


def top_pairs(s, d):
    """Directed author pairs with at least two votes, the hundred with the most."""
    p = pairs(s, d).where("self_pair = 0 and n >= 2").select("quoted", "responding", "quoted_stance", "responding_stance", "n", F.round(F.col("total") / F.col("n"), 3).alias("mean_vote"))
    return p.orderBy(F.desc("n"), "quoted", "responding").limit(100)


def author_top_pairs(s, d):
    """The same over all discussions, without stances."""
    p = author_pairs(s, d).where("self_pair = 0 and n >= 2").select("quoted", "responding", "n", F.round(F.col("total") / F.col("n"), 3).alias("mean_vote"))
    return p.orderBy(F.desc("n"), "quoted", "responding").limit(100)


QUERIES = {
    "schema_explorer": explored,
    "top_author_pairs": author_top_pairs,
    "dump_scan_topic": lambda s, d: dump_scan(s, d, TOPIC),
    "dump_rowcount": dump_rows,
    "dump_scan": dump_scan,
    "vote_chain": lambda s, d: chain(s, d).where("reason is null").drop("reason"),
    "vote_drops": lambda s, d: chain(s, d).groupBy(F.coalesce("reason", F.lit("resolved")).alias("reason")).agg(F.count("*").alias("n")),
    "stance_majority": lambda s, d: V.stances(s, d, TOPIC),
    "pair_votes": pairs,
    "symmetrized_edges": edges,
    "both_directions": lambda s, d: edges(s, d).agg(F.count_if(F.col("directions") == 2).alias("both"), F.count_if(F.col("directions") == 1).alias("one"), F.count_if("sign_differs").alias("sign_differs")),
    "pair_bins": bins,
    "stance_crosstab": lambda s, d: pairs(s, d).where("self_pair = 0").groupBy(F.concat(F.lit("T"), "quoted_stance", F.lit("_quoted_by_T"), "responding_stance").alias("g")).agg(F.count("*").alias("n_pairs"), F.sum("n").alias("n_votes"), F.count_if(F.col("total") < 0).alias("n_negative_pairs")),
    "group_asymmetry": asymmetry,
    "w_variants": variants,
    "quote_degrees": quote_degrees,
    "author_edges": lambda s, d: author_edges(s, d).select("a", "b", "n", "total", "sign"),
    "triangles": lambda s, d: V.triangles(author_edges(s, d)),
    "frustration": frustration,
    "euler_chi": lambda s, d: V.triangles(quote_edges(s, d)).agg(F.count("*").alias("t")).crossJoin(quote_edges(s, d).agg(F.count("*").alias("e"))).crossJoin(quote_edges(s, d).select(F.col("a").alias("v")).union(quote_edges(s, d).select("b")).agg(F.count_distinct("v").alias("v"))).select("v", "e", "t", (F.col("v") - F.col("e") + F.col("t")).alias("chi")),
    "components": lambda s, d: V.components(quote_edges(s, d)).groupBy("component").agg(F.count("*").alias("n")),
    "kcore_core": lambda s, d: V.core(quote_edges(s, d), 4),
    "null_sign_shuffle": sign_null,
    "null_vote_shuffle": vote_null,
    "null_sign_test": sign_null_test,
    "null_vote_test": vote_null_test,
    "artifact_diff": diff,
    "best_match_pairs": best_match,
    "stance_lookup": lambda s, d: table(s, d, "post").select("author_id").where("author_id is not null").distinct().join(V.stances(s, d, TOPIC), "author_id", "left").select("author_id", F.coalesce(F.col("stance").cast("string"), F.lit("not_found")).alias("stance")),
    "topic_filter": lambda s, d: table(s, d, "post").join(V.topic_discussions(s, d, TOPIC), "discussion_id", "left_semi").groupBy("discussion_id").agg(F.count("*").alias("n_posts"), F.count_distinct("post_id").alias("n_ids")),
    "latest_messages": lambda s, d: table(s, d, "post").where("author_id is not null").groupBy("author_id").agg(F.max("posted_at").alias("last_post"), F.count("*").alias("n")),
}

_CHAIN = f"""
td as (select distinct discussion_id from discussion_topic where topic_id = {TOPIC}),
sv as (select author_id, max({{'a': votes_1, 'b': votes_2}}) as v from mturk_author_stance where topic_id = {TOPIC} and votes_1 <> votes_2 group by 1),
st as (select author_id, case when v.a > v.b then 0 else 1 end as stance from sv),
en as (select page, tab, min({{'a': discussion_id, 'b': post_id, 'c': quote_index}}) as e from mturk_2010_qr_entry group by all),
po as (select discussion_id, post_id, min(author_id) as author_id from post semi join td using (discussion_id) group by all),
qu as (select discussion_id, post_id, quote_index, min({{'a': src_discussion_id, 'b': src_post_id}}) as q from post_quote semi join td using (discussion_id) group by all),
ch as (select vote_id, y.author_id as quoted, r.author_id as responding, sq.stance as quoted_stance, sr.stance as responding_stance, disagree_agree as vote, coalesce(unsure, 0) as unsure,
  case when e is null then 'no_qr' when r.author_id is null then 'no_post' when q is null then 'no_quote' when y.author_id is null then 'no_post' when sr.stance is null or sq.stance is null then 'no_stance' end as reason
  from (select * from vote where disagree_agree is not null) v left join en using (page, tab)
  left join po r on r.discussion_id = e.a and r.post_id = e.b left join qu on qu.discussion_id = e.a and qu.post_id = e.b and qu.quote_index = e.c
  left join po y on y.discussion_id = q.a and y.post_id = q.b left join st sr on sr.author_id = r.author_id left join st sq on sq.author_id = y.author_id),
pv as (select quoted, responding, quoted_stance, responding_stance, count(*) as n, sum(vote)::bigint as total, round(avg(vote), 6) as mean, count(*) filter (vote < 0) as n_negative, count(*) filter (vote = 0) as n_zero,
  count(*) filter (vote > 0) as n_positive, sum(unsure)::bigint as n_unsure, (quoted = responding)::int as self_pair from ch where reason is null group by quoted, responding, quoted_stance, responding_stance),
sy as (select least(quoted, responding) as a, greatest(quoted, responding) as b, sum(n)::bigint as n, sum(total)::bigint as total, round(sum(total) / sum(n), 6) as mean, sign(sum(total))::int as sign, count(*) as directions, count(*) = 2 and max(sign(total)) <> min(sign(total)) as sign_differs from pv where self_pair = 0 group by 1, 2)
"""
_C = "with " + _CHAIN
_AS = "select quoted_stance, responding_stance, count(*) as n_pairs, sum(n)::bigint as n_votes, round(sum(total) / sum(n), 3) as mean_vote, round(100 * sum(n_negative) / sum(n), 2) as pct_disagree, round(100 * sum(n_positive) / sum(n), 2) as pct_agree from pv where self_pair = 0 group by all"
_Q = """with pp as (select discussion_id, post_id, min(author_id) as author from post group by all),
qq as (select distinct discussion_id, post_id, quote_index, src_discussion_id, src_post_id from post_quote),
qa as (select x.author, y.author as quoted from qq join pp x using (discussion_id, post_id) join pp y on y.discussion_id = src_discussion_id and y.post_id = src_post_id where x.author <> y.author),
qe as (select least(author, quoted) as a, greatest(author, quoted) as b, count(*) as n, 1 as sign from qa group by 1, 2),
tr as (select x.a, x.b, y.b as c, x.sign * y.sign * z.sign as product from qe x join qe y on x.b = y.a join qe z on z.a = x.a and z.b = y.b)
"""

# The author graph by the votes of all discussions, its triangles, and runs of permuted signs or votes.
_A = """with en as (select page, tab, min({'a': discussion_id, 'b': post_id, 'c': quote_index}) as e from mturk_2010_qr_entry group by all),
po as (select discussion_id, post_id, min(author_id) as author_id from post group by all),
qu as (select discussion_id, post_id, quote_index, min({'a': src_discussion_id, 'b': src_post_id}) as q from post_quote group by all),
cv as (select vote_id, y.author_id as quoted, r.author_id as responding, disagree_agree as vote from vote join en using (page, tab) join po r on r.discussion_id = e.a and r.post_id = e.b
  join qu on qu.discussion_id = e.a and qu.post_id = e.b and qu.quote_index = e.c join po y on y.discussion_id = q.a and y.post_id = q.b where disagree_agree is not null and r.author_id is not null and y.author_id is not null),
av as (select least(quoted, responding) as a, greatest(quoted, responding) as b, vote_id, vote from cv where quoted <> responding),
ae as (select a, b, count(*) as n, sum(vote)::bigint as total, sign(sum(vote))::int as sign from av group by all),
tg as (select x.a, x.b, y.b as c, x.sign * y.sign * z.sign as product from ae x join ae y on x.b = y.a join ae z on z.a = x.a and z.b = y.b),
ru as (select unnest(range({runs})) as run)"""
_JUDGE = """, fr as (select run, count(product) filter (product < 0) as f from ru left join (select x.run, x.sign * y.sign * z.sign as product from tg join sr x on x.a = tg.a and x.b = tg.b join sr y on y.run = x.run and y.a = tg.a and y.b = tg.c join sr z on z.run = x.run and z.a = tg.b and z.b = tg.c) using (run) group by run),
ob as (select count(*) filter (product < 0) as observed from tg), jd as (select any_value(observed) as observed, count(*) as runs, round(avg(f), 6) as null_mean, round(stddev_samp(f), 6) as null_sd, count(*) filter (f <= observed) as le, count(*) filter (f >= observed) as ge from fr, ob)
select observed, runs, null_mean, null_sd, case when null_sd > 0 then round((observed - null_mean) / null_sd, 3) end as z, round((1 + le) / (1 + runs), 6) as p_le, round((1 + ge) / (1 + runs), 6) as p_ge from jd"""


def _authors(runs: int = 1) -> str:
    return _A.replace("{runs}", str(runs))


def _core_sql(k: int, rounds: int = 12) -> str:
    """CTE q<rounds>: the edges left when vertices of fewer than k neighbours have gone so often."""
    q = ", q0 as (select a, b from qe)"
    for r in range(rounds):
        q += f", v{r} as (select v from (select a as v from q{r} union all select b from q{r}) group by v having count(*) >= {k}), q{r + 1} as (select a, b from q{r} semi join v{r} x on x.v = a semi join v{r} y on y.v = b)"
    return q + f", core as (select a as v from q{rounds} union select b from q{rounds})"


_DUMP = r"""with x as (select line_id, regexp_extract(trim(line, e' \t\r\n'), '^\(\s*(\d+)\s*,\s*(\d+)\s*,\s*(\d+)\s*,', ['a', 'b', 'c']) as g from dump_line where table_name = 'post' and fmt = 'sql'),
y as (select line_id, g.a::bigint as discussion_id, g.b::bigint as post_id, g.c::bigint as author_id from x where g.a <> '' and try_cast(g.a as hugeint) <= 2147483647 and try_cast(g.b as hugeint) <= 2147483647 and try_cast(g.c as hugeint) <= 2147483647)"""
SQL = {
    "kcore_core": _Q + _core_sql(4) + " select v from core",
    "author_edges": _authors() + " select a, b, n, total, sign from ae",
    "null_sign_test": _authors(100) + ", p as (select run, a, b, row_number() over (partition by run order by a, b) as k from ae, ru), g as (select run, sign, row_number() over (partition by run order by md5('7:' || run || ':' || a || ':' || b)) as k from ae, ru), sr as (select run, a, b, sign from p join g using (run, k))" + _JUDGE,
    "null_vote_test": _authors(100) + ", p as (select run, a, b, row_number() over (partition by run order by a, b, vote_id) as k from av, ru), g as (select run, vote, row_number() over (partition by run order by md5('11:' || run || ':' || a || ':' || b || ':' || vote_id)) as k from av, ru), sr as (select run, a, b, sign(sum(vote))::int as sign from p join g using (run, k) group by all)" + _JUDGE,
    "dump_rowcount": "select table_name, sum((length(line) - length(replace(line, '),(', ''))) / 3 + 1)::bigint as n from dump_line where fmt = 'sql' and starts_with(line, '(') group by 1",
    "dump_scan": _DUMP + " select line_id, discussion_id, post_id, author_id from y",
    "dump_scan_topic": _DUMP + f" select line_id, discussion_id, post_id, author_id from y semi join (select discussion_id from discussion_topic where topic_id = {TOPIC}) using (discussion_id)",
    "schema_explorer": " union all ".join(f"select '{t}' as table_name, (select count(*) from {t}) as n_rows, (select string_agg(column_name, ',' order by column_index) from (select column_name, column_index from duckdb_columns() where table_name = '{t}' order by column_index limit 8)) as columns" for t in TABLES),
    "top_author_pairs": _authors() + ", z as (select quoted, responding, count(*) as n, sum(vote) as total from cv where quoted <> responding group by all) select quoted, responding, n, round(total / n, 3) as mean_vote from z where n >= 2 order by n desc, quoted, responding limit 100",
    "vote_chain": _C + "select vote_id, quoted, responding, quoted_stance, responding_stance, vote, unsure from ch where reason is null",
    "vote_drops": _C + "select coalesce(reason, 'resolved') as reason, count(*) as n from ch group by 1",
    "stance_majority": _C + "select author_id, stance from st",
    "pair_votes": _C + "select * from pv",
    "symmetrized_edges": _C + "select * from sy",
    "both_directions": _C + "select count(*) filter (directions = 2) as both, count(*) filter (directions = 1) as one, count(*) filter (sign_differs) as sign_differs from sy",
    "pair_bins": _C + "select case when n = 1 then '1' when n = 2 then '2' when n <= 5 then '3-5' when n <= 10 then '6-10' when n <= 50 then '11-50' else '>50' end as bin, count(*) as n_pairs, sum(n)::bigint as n_votes from pv where self_pair = 0 group by 1",
    "stance_crosstab": _C + "select 'T' || quoted_stance || '_quoted_by_T' || responding_stance as g, count(*) as n_pairs, sum(n)::bigint as n_votes, count(*) filter (total < 0) as n_negative_pairs from pv where self_pair = 0 group by 1",
    "group_asymmetry": _C + _AS,
    "w_variants": _C + "select a, b, 'obs' as variant, mean as w from sy union all select a, b, 'sign', sign from sy union all select a, b, 'presence', 1 from sy",
    "quote_degrees": _Q + ", o as (select author as v, count(*) as n_out from qa group by 1), i as (select quoted as v, count(*) as n_in from qa group by 1), b as (select v, coalesce(n_in, 0) as n_in, coalesce(n_out, 0) as n_out, round(coalesce(n_in, 0) / (coalesce(n_out, 0) + 0.5), 6) as ratio from o full join i using (v)) select v, n_in, n_out, ratio, case when ratio > 10 then 'quoted' when ratio > 3 then 'mostly quoted' else 'both' end as kind from b where n_in >= 10 order by ratio desc, v limit 30",
    "triangles": _authors() + " select * from tg",
    "frustration": _authors() + ' , v as (select count(distinct v)::double as v from (select a as v from ae union select b from ae)), q as (select count(*) as n, count(*) filter (product = 0) as with_zero, count(*) filter (product < 0) as frustrated from tg) select n, with_zero, frustrated, round(frustrated / nullif(n - with_zero, 0), 9) as "index", round(frustrated / nullif(v * (v - 1) * (v - 2) / 6, 0), 15) as index_all from q, v',
    "euler_chi": _Q + ", c as (select (select count(*) from (select a from qe union select b from qe)) as v, (select count(*) from qe) as e, (select count(*) from tr) as t) select v, e, t, v - e + t as chi from c",
    "components": _Q.replace("with ", "with recursive ", 1) + ", ed as (select a as u, b as v from qe union select b, a from qe), rc(v, c) as (select u, u from ed union select ed.v, rc.c from rc join ed on ed.u = rc.v where rc.c < ed.v), m as (select v, min(c) as component from rc group by 1) select component, count(*) as n from m group by 1",
    "null_sign_shuffle": _authors(10) + ", p as (select run, a, b, n, row_number() over (partition by run order by a, b) as k from ae, ru), g as (select run, sign, row_number() over (partition by run order by md5('7:' || run || ':' || a || ':' || b)) as k from ae, ru) select run, sum(case when sign < 0 then n else 0 end)::bigint as negative, sum(n)::bigint as total from p join g using (run, k) group by 1",
    "null_vote_shuffle": _C + ", vv as (select vote_id, quoted || '-' || responding as a, vote from ch where reason is null and quoted <> responding), ru as (select unnest(range(10)) as run), p as (select run, a, row_number() over (partition by run order by a, vote_id) as k from vv, ru), g as (select run, vote, row_number() over (partition by run order by md5('7:' || run || ':' || a || ':' || vote_id)) as k from vv, ru), t as (select run, a, sum(vote) as total from p join g using (run, k) group by all) select run, count(*) as n_pairs, count(*) filter (total < 0) as n_negative from t group by 1",
    "artifact_diff": _C + ", cu as (select * from ch where unsure = 0 and reason is null and quoted <> responding), rt as (select least(quoted, responding) as a, greatest(quoted, responding) as b, sum(vote)::bigint as total from cu group by 1, 2) select a, b, sy.total as left_total, rt.total as right_total, case when rt.total is null then 'missing' else 'changed' end as kind from sy full join rt using (a, b) where sy.total is distinct from rt.total",
    "best_match_pairs": _C + f", g0 as ({_AS}), g as (select quoted_stance || '-' || responding_stance as g, mean_vote from g0), r as (select x.g, y.g as nearest, row_number() over (partition by x.g order by abs(x.mean_vote - y.mean_vote), y.g) as k from g x join g y on x.g <> y.g) select g, nearest from r where k = 1",
    "stance_lookup": _C + ", a as (select distinct author_id from post where author_id is not null) select author_id, coalesce(stance::varchar, 'not_found') as stance from a left join st using (author_id)",
    "topic_filter": _C + "select discussion_id, count(*) as n_posts, count(distinct post_id) as n_ids from post semi join td using (discussion_id) group by 1",
    "latest_messages": "select author_id, max(posted_at) as last_post, count(*) as n from post where author_id is not null group by 1",
}
