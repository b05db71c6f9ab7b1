"""From votes on quotes to a signed graph of author pairs.

The vote table is the large side; every hop is an equi-join on a composite key whose right
side is made unique first, so a hop never multiplies votes. Hot pages or authors are left to
adaptive skew joins; aggregates combine before they shuffle. The reason of the first failed
hop is kept, so votes are counted whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkscape.operators.nulls import shuffled
from sparkscape.session import cut, table


def topic_discussions(s, d, topic: int) -> DataFrame:
    return table(s, d, "discussion_topic").where(F.col("topic_id") == topic).select("discussion_id").distinct()


def stances(s, d, topic: int) -> DataFrame:
    """author_id, stance: 0 if votes_1 > votes_2, else 1; ties and missing votes give none."""
    a = table(s, d, "mturk_author_stance").where(F.col("topic_id") == topic).where("votes_1 <> votes_2")
    return a.groupBy("author_id").agg(F.max(F.struct("votes_1", "votes_2")).alias("v")).select("author_id", F.when(F.col("v.votes_1") > F.col("v.votes_2"), 0).otherwise(1).alias("stance"))


def resolved(s, d, topic: int | None = 9) -> DataFrame:
    """vote_id, quoted, responding, their stances, vote, unsure, reason of every vote with an answer.

    Without a topic all discussions count, and authors need no stance.

    reason: no_qr, no_post, no_quote, no_stance, or null where the chain holds. Repeated rows
    of a lookup table count once (the smallest).
    """
    votes = table(s, d, "vote").where("disagree_agree is not null").select("vote_id", "page", "tab", "disagree_agree", F.coalesce("unsure", F.lit(0)).alias("unsure"))
    of_topic = (lambda t: t) if topic is None else (lambda t: t.join(topic_discussions(s, d, topic), "discussion_id", "left_semi"))
    entry = table(s, d, "mturk_2010_qr_entry").groupBy("page", "tab").agg(F.min(F.struct("discussion_id", "post_id", "quote_index")).alias("e"))
    entry = entry.select("page", "tab", "e.*", F.lit(True).alias("has_entry"))
    post = of_topic(table(s, d, "post")).groupBy("discussion_id", "post_id").agg(F.min("author_id").alias("author_id"))
    quote = of_topic(table(s, d, "post_quote")).groupBy("discussion_id", "post_id", "quote_index").agg(F.min(F.struct("src_discussion_id", "src_post_id")).alias("q"))
    stance = stances(s, d, topic) if topic is not None else s.createDataFrame([], "author_id bigint, stance int")
    v = votes.join(entry, ["page", "tab"], "left")
    v = v.join(post.withColumnRenamed("author_id", "responding"), ["discussion_id", "post_id"], "left")
    v = v.join(quote, ["discussion_id", "post_id", "quote_index"], "left")
    v = v.withColumn("sd", F.col("q.src_discussion_id")).withColumn("sp", F.col("q.src_post_id"))
    v = v.join(post.select(F.col("discussion_id").alias("sd"), F.col("post_id").alias("sp"), F.col("author_id").alias("quoted")), ["sd", "sp"], "left")
    v = v.join(stance.select(F.col("author_id").alias("responding"), F.col("stance").alias("responding_stance")), "responding", "left")
    v = v.join(stance.select(F.col("author_id").alias("quoted"), F.col("stance").alias("quoted_stance")), "quoted", "left")
    reason = (
        F.when(F.col("has_entry").isNull(), "no_qr").when(F.col("responding").isNull(), "no_post").when(F.col("q").isNull(), "no_quote")
        .when(F.col("quoted").isNull(), "no_post").when(F.lit(topic is not None) & (F.col("responding_stance").isNull() | F.col("quoted_stance").isNull()), "no_stance")
    )
    return v.select("vote_id", "quoted", "responding", "quoted_stance", "responding_stance", F.col("disagree_agree").alias("vote"), "unsure", reason.alias("reason"))


def pair_votes(chain: DataFrame) -> DataFrame:
    """One row per ordered author pair with its votes."""
    v = F.col("vote")
    return (
        chain.where("reason is null")
        .groupBy("quoted", "responding", "quoted_stance", "responding_stance")
        .agg(
            F.count("*").alias("n"), F.sum("vote").alias("total"), F.round(F.avg("vote"), 6).alias("mean"), F.count_if(v < 0).alias("n_negative"),
            F.count_if(v == 0).alias("n_zero"), F.count_if(v > 0).alias("n_positive"), F.sum("unsure").alias("n_unsure"),
        )
        .withColumn("self_pair", (F.col("quoted") == F.col("responding")).cast("int"))
    )


def symmetric(pairs: DataFrame) -> DataFrame:
    """a < b, n, total, mean, sign of both directions together; self pairs left out."""
    p = pairs.where("self_pair = 0").groupBy(F.least("quoted", "responding").alias("a"), F.greatest("quoted", "responding").alias("b"))
    p = p.agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.count("*").alias("directions"), F.max(F.signum("total")).alias("hi"), F.min(F.signum("total")).alias("lo"))
    return p.select("a", "b", "n", "total", F.round(F.col("total") / F.col("n"), 6).alias("mean"), F.signum("total").cast("int").alias("sign"), "directions", ((F.col("directions") == 2) & (F.col("hi") != F.col("lo"))).alias("sign_differs"))


def triangles(edges: DataFrame) -> DataFrame:
    """a < b < c with the product of the three signs.

    Each edge points from the endpoint of lower degree (then id), so a hub's links are
    divided among its partners and no vertex emits all pairs of its neighbours.
    """
    e = cut(edges.select("a", "b", "sign"))
    ends = e.select(F.col("a").alias("v")).union(e.select("b")).groupBy("v").agg(F.count("*").alias("deg"))
    d = e.join(ends.select(F.col("v").alias("a"), F.col("deg").alias("da")), "a").join(ends.select(F.col("v").alias("b"), F.col("deg").alias("db")), "b")
    up = (F.col("da") < F.col("db")) | ((F.col("da") == F.col("db")) & (F.col("a") < F.col("b")))
    o = cut(d.select(F.when(up, F.col("a")).otherwise(F.col("b")).alias("u"), F.when(up, F.col("b")).otherwise(F.col("a")).alias("v"), "sign"))
    wedge = o.alias("x").join(o.alias("y"), (F.col("x.u") == F.col("y.u")) & (F.col("x.v") < F.col("y.v"))).select(F.col("x.u").alias("u"), F.col("x.v").alias("a"), F.col("y.v").alias("b"), (F.col("x.sign") * F.col("y.sign")).alias("s2"))
    t = wedge.join(e, ["a", "b"])
    abc = F.array_sort(F.array("u", "a", "b"))
    return t.select(abc[0].alias("a"), abc[1].alias("b"), abc[2].alias("c"), (F.col("s2") * F.col("sign")).alias("product"))


def components(edges: DataFrame, most: int = 60) -> DataFrame:
    """v, component (its smallest vertex), by alternating large-star and small-star steps.

    Vertices hang on ever smaller neighbours; every step keeps connectivity and the number of
    rows, so no component is gathered in one place. Checkpointed each round, it stops when
    nothing moves and raises an error rather than stopping early.
    """
    e = cut(edges.select(F.col("a").alias("u"), F.col("b").alias("v")).where("u <> v").distinct())
    vertices = cut(e.select("u").union(e.select("v")).distinct())
    for _ in range(most):
        both = e.union(e.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small_low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(small_low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(small_low.select("u", F.col("m").alias("v"))).where("u <> v")
        nxt = cut(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
        if nxt.count() == e.count() and not nxt.exceptAll(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))).take(1):
            break
        e = nxt
    else:
        raise RuntimeError("components not settled")
    return vertices.withColumnRenamed("u", "v").join(e.groupBy(F.col("u").alias("v")).agg(F.min("v").alias("m")), "v", "left").select("v", F.coalesce("m", "v").alias("component"))


def shuffled_signs(edges: DataFrame, runs: int, seed: int = 7) -> DataFrame:
    """run, a, b, sign: the edges' signs permuted in each run, by the order of keyed digests."""
    return shuffled(edges.select("a", "b", "sign"), ["a", "b"], "sign", runs, seed)


def frustration(tri: DataFrame, signs: DataFrame) -> DataFrame:
    """run, frustrated, with_zero of a fixed list of triangles a < b < c under each run's signs (run, a, b, sign)."""
    e = signs.select("run", F.col("a").alias("x"), F.col("b").alias("y"), "sign")
    ab = tri.select("a", "b", "c").join(e.select("run", F.col("x").alias("a"), F.col("y").alias("b"), F.col("sign").alias("s1")), ["a", "b"])
    ac = ab.join(e.select("run", F.col("x").alias("a"), F.col("y").alias("c"), F.col("sign").alias("s2")), ["run", "a", "c"])
    p = ac.join(e.select("run", F.col("x").alias("b"), F.col("y").alias("c"), F.col("sign").alias("s3")), ["run", "b", "c"]).withColumn("p", F.col("s1") * F.col("s2") * F.col("s3"))
    found = p.groupBy("run").agg(F.count_if(F.col("p") < 0).alias("frustrated"), F.count_if(F.col("p") == 0).alias("with_zero"))
    every = signs.select("run").distinct()
    return every.join(found, "run", "left").na.fill(0)


def core(edges: DataFrame, k: int, most: int = 60) -> DataFrame:
    """v of the k-core: vertices of fewer than k neighbours go, all at once, until none goes."""
    e = cut(edges.select("a", "b"))
    for _ in range(most):
        deg = e.select(F.col("a").alias("v")).union(e.select("b")).groupBy("v").agg(F.count("*").alias("n"))
        weak = deg.where(F.col("n") < k).select("v")
        if not weak.take(1):
            return deg.select("v")
        e = cut(e.join(weak.withColumnRenamed("v", "a"), "a", "left_anti").join(weak.withColumnRenamed("v", "b"), "b", "left_anti").select("a", "b"))
    raise RuntimeError("core not settled")
