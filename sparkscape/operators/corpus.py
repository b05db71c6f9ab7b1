"""From texts to nodes, presence and the signed co-occurrence matrix W.

Units are rows (unit_id, text). Weights stay integer (``raw``); normalized weights are raw
over the largest absolute raw. Term counting and co-occurrence aggregate by term or pair of
selected nodes, with partial aggregation before every shuffle; the node list has at most
top_k rows, so joining it is a broadcast of proven size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkscape.functions import text as T
from sparkscape.session import cut

TIE = 1e-12
DIGITS = 9


def unit_terms(units: DataFrame, stop=T.STOP_WORDS, most: int = 1) -> DataFrame:
    """unit_id, term: every occurrence; blank and null texts give none."""
    return units.select("unit_id", F.explode(T.analyze(F.col("text"), stop, most)).alias("term"))


def term_counts(units: DataFrame, stop=T.STOP_WORDS, most: int = 1) -> DataFrame:
    """unit_id, term, n: occurrences of a term in a unit."""
    return unit_terms(units, stop, most).groupBy("unit_id", "term").agg(F.count("*").alias("n"))


def frequencies(units: DataFrame, stop=T.STOP_WORDS, most: int = 1, min_df: int = 2) -> DataFrame:
    """term, df (units), tf (occurrences) of the terms in at least min_df units."""
    return frequencies_of(term_counts(units, stop, most), min_df)


def frequencies_of(counts: DataFrame, min_df: int = 2) -> DataFrame:
    return counts.groupBy("term").agg(F.count("*").alias("df"), F.sum("n").alias("tf")).where(F.col("df") >= min_df)


def pool(units: DataFrame, top_k: int, stop=T.STOP_WORDS, most: int = 1, min_df: int = 2) -> DataFrame:
    """The 3 * top_k most frequent terms; ties by term."""
    return pool_of(term_counts(units, stop, most), top_k, min_df)


def pool_of(counts: DataFrame, top_k: int, min_df: int = 2) -> DataFrame:
    return frequencies_of(counts, min_df).orderBy(F.desc("tf"), "term").limit(3 * top_k)


def scores(units: DataFrame, top_k: int, stop=T.STOP_WORDS, most: int = 1, min_df: int = 2) -> DataFrame:
    """term, df, tf, score: mean TF-IDF of the pool's terms over all non-blank units.

    idf = ln((1 + n) / (1 + df)) + 1; rows are L2-normalized over pool terms only. Scores
    are rounded to 9 digits, so that their order doesn't depend on the order of summation.
    """
    return scores_of(term_counts(units, stop, most), units, top_k, min_df)


def scores_of(counts: DataFrame, units: DataFrame, top_k: int, min_df: int = 2) -> DataFrame:
    p = pool_of(counts, top_k, min_df)
    n = units.where(T.not_blank(F.col("text"))).agg(F.count("*").alias("n_units"))
    w = counts.join(F.broadcast(p), "term").crossJoin(F.broadcast(n))  # n: one row
    w = w.withColumn("x", F.col("n") * (F.log((1 + F.col("n_units")) / (1 + F.col("df"))) + 1))
    norm = F.sqrt(F.sum(F.col("x") * F.col("x")).over(Window.partitionBy("unit_id")))
    w = w.withColumn("x", F.col("x") / norm)
    return w.groupBy("term", "df", "tf").agg(F.round(F.sum("x") / F.max("n_units"), DIGITS).alias("score"))


def register(scored: DataFrame, top_k: int, previous: list[str] | None = None) -> DataFrame:
    """term, df, tf, score, rank, distance, was_member, selected of every pool term.

    Above the cut (the top_k-th score) a term is in. Ties at the cut enter if all fit;
    otherwise those that were members before stay, and without a previous selection none
    enters. A pool of at most top_k terms is taken whole. was_member is null without one.
    """
    one = Window.orderBy(F.desc("score"), "term")  # at most 3 * top_k rows
    r = scored.withColumn("rank", F.row_number().over(one))
    every = Window.partitionBy()
    r = r.withColumn("size", F.count("*").over(every)).withColumn("cut", F.max(F.when(F.col("rank") == F.least(F.lit(top_k), "size"), F.col("score"))).over(every))
    gap = F.col("score") - F.col("cut")
    tie = F.abs(gap) <= TIE
    r = r.withColumn("above", F.sum((gap > TIE).cast("int")).over(every)).withColumn("ties", F.sum(tie.cast("int")).over(every))
    was = F.lit(None).cast("boolean") if previous is None else F.col("term").isin(*previous) if previous else F.lit(False)
    enters = (F.col("size") <= top_k) | (gap > TIE) | (tie & ((F.col("ties") <= top_k - F.col("above")) | F.coalesce(was, F.lit(False))))
    return r.select("term", "df", "tf", "score", "rank", F.round(gap, DIGITS).alias("distance"), was.alias("was_member"), enters.alias("selected"))


def nodes(units: DataFrame, top_k: int = 20, stop=T.STOP_WORDS, most: int = 1, previous=None) -> DataFrame:
    """node_id (0-based, by score, then term), term, score."""
    return nodes_of(scores(units, top_k, stop, most), top_k, previous)


def nodes_of(scored: DataFrame, top_k: int, previous=None) -> DataFrame:
    chosen = register(scored, top_k, previous).where("selected")
    return chosen.select((F.row_number().over(Window.orderBy("rank")) - 1).alias("node_id"), "term", "score")


def presence(units: DataFrame, node_list: DataFrame, stop=T.STOP_WORDS, most: int = 1) -> DataFrame:
    """unit_id, node_id: which nodes occur in which unit."""
    return unit_terms(units, stop, most).join(F.broadcast(node_list.select("term", "node_id")), "term").select("unit_id", "node_id").distinct()


def active_nodes(present: DataFrame) -> DataFrame:
    """unit_id, active: the sorted nodes of each unit; at most top_k of them."""
    return present.groupBy("unit_id").agg(F.array_sort(F.collect_list("node_id")).alias("active"))


def pairs(present: DataFrame, sign: DataFrame | None = None) -> DataFrame:
    """i, j (i < j), n_pos, n_neg: units with both nodes, by the sign of the unit.

    Pairs come from the unit's own list of active nodes (at most top_k), not from a self-join.
    """
    a = active_nodes(present)
    a = a.withColumn("negative", F.lit(False)) if sign is None else a.join(sign, "unit_id", "left").withColumn("negative", F.coalesce("negative", F.lit(False)))
    both = a.select("negative", "active", F.posexplode("active").alias("at", "i")).select("negative", "i", F.explode(F.expr("slice(active, at + 2, size(active))")).alias("j"))
    return both.groupBy("i", "j").agg(F.count_if(~F.col("negative")).alias("n_pos"), F.count_if("negative").alias("n_neg"))


def edges(pair_counts: DataFrame, force_positive: bool = False) -> DataFrame:
    """i, j, raw, w: raw = sum of signs over units; w = raw / max |raw| (0 where all are 0)."""
    raw = (F.col("n_pos") + F.col("n_neg")) if force_positive else (F.col("n_pos") - F.col("n_neg"))
    e = pair_counts.select("i", "j", raw.alias("raw"))
    top = F.max(F.abs("raw")).over(Window.partitionBy())  # at most top_k ** 2 / 2 rows
    return e.select("i", "j", "raw", F.when(top > 0, F.col("raw") / top).otherwise(F.lit(0.0)).alias("w"))


def field(units: DataFrame, top_k: int = 20, sign: Column | None = None, stop=T.STOP_WORDS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, presence) of a corpus, its texts cut into terms once; a unit is negative if it declares opposition, or by ``sign``."""
    counts = cut(term_counts(units, stop))
    n = cut(nodes_of(scores_of(counts, units, top_k), top_k))
    flag = units.select("unit_id", (T.opposes(F.col("text")) if sign is None else sign).alias("negative"))
    present = counts.join(F.broadcast(n.select("term", "node_id")), "term").select("unit_id", "node_id")
    return n, cut(edges(pairs(present, flag))), present


def signed_w(units: DataFrame, top_k: int = 20, sign: Column | None = None, stop=T.STOP_WORDS) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a corpus."""
    return field(units, top_k, sign, stop)[:2]


def status(node_list: DataFrame, edge_list: DataFrame) -> DataFrame:
    """n_nodes, n_pairs, sparsity, neg_frac, mu_all, mu_nonzero of W's upper triangle."""
    n = node_list.agg(F.count("*").alias("n_nodes"))
    e = edge_list.agg(F.count_if(F.col("raw") != 0).alias("nonzero"), F.count_if(F.col("raw") < 0).alias("neg"), F.sum("w").alias("total"))
    slots = F.col("n_nodes") * (F.col("n_nodes") - 1) / 2
    return n.crossJoin(e).select(  # one row each
        "n_nodes", F.col("nonzero").alias("n_pairs"),
        F.round(1 - F.try_divide("nonzero", slots), 3).alias("sparsity"),
        F.round(F.try_divide("neg", "nonzero"), 6).alias("neg_frac"),
        F.round(F.try_divide("total", slots), DIGITS).alias("mu_all"),
        F.round(F.try_divide("total", "nonzero"), DIGITS).alias("mu_nonzero"),
    )


def both_ways(edge_list: DataFrame) -> DataFrame:
    return edge_list.select("i", "j", "raw", "w").union(edge_list.select(F.col("j").alias("i"), F.col("i").alias("j"), "raw", "w"))


def row_strength(node_list: DataFrame, edge_list: DataFrame) -> DataFrame:
    """node_id, term, strength (sum of |w|), degree; 0 for isolated nodes."""
    s = both_ways(edge_list.where("raw <> 0")).groupBy(F.col("i").alias("node_id")).agg(F.sum(F.abs("w")).alias("s"), F.count("*").alias("d"))
    return node_list.join(s, "node_id", "left").select("node_id", "term", F.round(F.coalesce("s", F.lit(0.0)), DIGITS).alias("strength"), F.coalesce("d", F.lit(0)).alias("degree"))


def association(present: DataFrame, n_units: int, laplace: float | None = None) -> DataFrame:
    """i, j, n_ij, phi, pmi of the node pairs that meet; phi null where a node is constant."""
    each = present.groupBy("node_id").agg(F.count("*").alias("n"))
    p = pairs(present).select("i", "j", F.col("n_pos").alias("n_ij"))
    p = p.join(F.broadcast(each.select(F.col("node_id").alias("i"), F.col("n").alias("n_i"))), "i").join(F.broadcast(each.select(F.col("node_id").alias("j"), F.col("n").alias("n_j"))), "j")
    n = F.lit(float(n_units))
    phi = F.try_divide(n * F.col("n_ij") - F.col("n_i") * F.col("n_j"), F.sqrt(F.col("n_i").cast("double") * F.col("n_j") * (n - F.col("n_i")) * (n - F.col("n_j"))))
    a = F.lit(float(laplace or 0))
    total = n + 4 * a
    pmi = F.log((F.col("n_ij") + a) * total / ((F.col("n_i") + 2 * a) * (F.col("n_j") + 2 * a)))
    return p.select("i", "j", "n_ij", F.round(phi, DIGITS).alias("phi"), F.round(pmi, DIGITS).alias("pmi"))


def evaluate(units: DataFrame, node_list: DataFrame, stop=T.STOP_WORDS) -> DataFrame:
    """unit_id, node_id, sigma: +1 if the node's term is among the unit's terms, else -1, for every unit and node.

    The node list is bounded by top_k, so each unit gives at most top_k rows.
    """
    listed = F.broadcast(node_list.agg(F.array_sort(F.collect_list(F.struct("node_id", "term"))).alias("all_nodes")))
    u = units.select("unit_id", F.array_distinct(T.analyze(F.col("text"), stop)).alias("terms")).crossJoin(listed)  # one row
    return u.select("unit_id", "terms", F.explode("all_nodes").alias("n")).select("unit_id", F.col("n.node_id").alias("node_id"), F.when(F.array_contains("terms", F.col("n.term")), 1).otherwise(-1).alias("sigma"))


def difference(old: DataFrame, new: DataFrame) -> DataFrame:
    """common_pairs, entered, left, norm of the change between two edge lists given by terms (a, b, w)."""
    d = old.select("a", "b", F.col("w").alias("w0")).join(new.select("a", "b", F.col("w").alias("w1")), ["a", "b"], "full")
    return d.agg(
        F.count_if(F.col("w0").isNotNull() & F.col("w1").isNotNull()).alias("common_pairs"),
        F.count_if(F.col("w0").isNull()).alias("entered"),
        F.count_if(F.col("w1").isNull()).alias("gone"),
        F.round(F.sqrt(F.sum(F.pow(F.coalesce("w1", F.lit(0.0)) - F.coalesce("w0", F.lit(0.0)), 2))), 6).alias("norm"),
    )
