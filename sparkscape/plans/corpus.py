"""Queries over the documents: text operators, node selection and W."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sparkscape.functions import text as T
from sparkscape.operators import blocks as B
from sparkscape.operators import corpus as C
from sparkscape.operators import nulls as U
from sparkscape.session import cut, table

K = 12


def units(s, d):
    return table(s, d, "documents").select(F.col("doc_id").alias("unit_id"), "text")


def lines(s, d):
    return units(s, d).select("unit_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))


def w(s, d):
    return C.signed_w(units(s, d), K)


MIDDLE = "(select min(loaded_at) + (max(loaded_at) - min(loaded_at)) / 2 from documents)"


def named(s, d, old):
    u = units(s, d)
    if old:  # the corpus as it was half-way through its loading
        t = table(s, d, "documents")
        lo, hi = t.agg(F.min("loaded_at"), F.max("loaded_at")).first()
        u = t.where(F.col("loaded_at") <= F.lit(lo + (hi - lo) / 2)).select(F.col("doc_id").alias("unit_id"), "text") if lo else u
    n, e = C.signed_w(u, K)
    a = n.select(F.col("node_id").alias("i"), F.col("term").alias("ta"))
    b = n.select(F.col("node_id").alias("j"), F.col("term").alias("tb"))
    return e.join(F.broadcast(a), "i").join(F.broadcast(b), "j").select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b"), "w")


def tokens_top(s, d):
    return C.frequencies(units(s, d), stop=(), min_df=1).orderBy(F.desc("tf"), "term").limit(50)


def stopword_effect(s, d):
    u = units(s, d).select(T.tokens(F.col("text")).alias("t"))
    return u.agg(F.sum(F.size("t")).alias("n_before"), F.sum(F.size(T.without(F.col("t")))).alias("n_after"))


def paginate(s, d, words=200):
    """Pages of consecutive words: a page closes with the line that brings it to ``words``."""
    own = lines(s, d).where(T.not_blank(F.col("line"))).select("unit_id", "pos", F.size(F.filter(F.split("line", r"\s+"), lambda x: x != "")).alias("n"))
    whole = own.groupBy("unit_id").agg(F.array_sort(F.collect_list(F.struct("pos", "n"))).alias("l"))  # lines of one document
    step = lambda acc, x: F.when(acc["run"] >= words, F.struct((acc["pages"] + 1).alias("pages"), x["n"].alias("run"))).otherwise(F.struct(acc["pages"].alias("pages"), (acc["run"] + x["n"]).alias("run")))
    return whole.select("unit_id", F.aggregate("l", F.struct(F.lit(1).alias("pages"), F.lit(0).alias("run")), step, lambda acc: acc["pages"]).alias("n_pages"))


def states(s, d):
    """Texts of each source by the month they were written in, as versions of the source."""
    return table(s, d, "documents").select(F.col("source").alias("series"), F.date_format("written_at", "yyyy-MM").alias("version"), "text")


def behaviour(s, d):
    u = units(s, d).select("unit_id", T.normalize(F.col("text")).alias("t"))
    hits = F.array_compact(F.array(*(F.when(T.whole_words(F.col("t"), p), F.lit(n)) for n, p in T.BEHAVIOUR.items())))
    return u.select("unit_id", F.explode(hits).alias("node"))


def behaviour_graph(s, d):
    a = behaviour(s, d).groupBy("unit_id").agg(F.array_sort(F.collect_list("node")).alias("active"))
    p = a.select("active", F.posexplode("active").alias("at", "a")).select("a", F.explode(F.expr("slice(active, at + 2, size(active))")).alias("b")).groupBy("a", "b").agg(F.count("*").alias("n"))
    return p.select("a", "b", "n", F.round(F.col("n") / F.max("n").over(Window.partitionBy()), 9).alias("g"))


def shuffled_words(s, d):
    """Null corpus: all words pooled, put in the order of a keyed digest, dealt out again by length."""
    u = units(s, d).where("unit_id is not null").select("unit_id", F.posexplode(F.filter(F.split("text", r"\s+"), lambda x: x != "")).alias("pos", "word"))
    u = cut(u)
    places = U.ranked(u.select("unit_id", "pos"), [], ["unit_id", "pos"])
    drawn = U.ranked(u.select("word", F.md5(F.concat_ws(":", F.lit("7"), "unit_id", "pos", "word")).alias("d")), [], ["d"])
    return places.join(drawn.select("word", "k"), "k").select("unit_id", "pos", "word")


def quantiles(s, d):
    n, _ = w(s, d)
    p = C.active_nodes(C.presence(units(s, d), n)).select("unit_id", F.size("active").alias("k"))
    u = units(s, d).select("unit_id", F.size(T.tokens(F.col("text"))).alias("words")).join(p, "unit_id", "left").withColumn("k", F.coalesce("k", F.lit(0)))
    q = lambda c: [F.round(F.percentile(c, x), 6).alias(f"{c}_p{int(x * 100)}") for x in (0.1, 0.5, 0.9)]
    return u.agg(*q("words"), *q("k"), F.round(F.avg((F.col("k") == 0).cast("int")), 6).alias("without"))


QUERIES = {
    "tokens_top": tokens_top,
    "doc_freq": lambda s, d: C.frequencies(units(s, d)),
    "ngram_top": lambda s, d: C.frequencies(units(s, d), most=2).where(F.col("term").contains(" ")).orderBy(F.desc("tf"), "term").limit(50),
    "stopword_effect": stopword_effect,
    "pool_terms": lambda s, d: C.pool(units(s, d), K),
    "tfidf_scores": lambda s, d: C.scores(units(s, d), K),
    "border_register": lambda s, d: C.register(C.scores(units(s, d), K), K, ["signal", "panel"]).select("term", "distance", "was_member", "selected"),
    "node_selection": lambda s, d: C.nodes(units(s, d), K),
    "presence": lambda s, d: C.presence(units(s, d), C.nodes(units(s, d), K)),
    "node_freq": lambda s, d: C.presence(units(s, d), C.nodes(units(s, d), K)).groupBy("node_id").agg(F.count("*").alias("n_units")),
    "cooc_pairs": lambda s, d: C.pairs(C.presence(units(s, d), C.nodes(units(s, d), K))).select("i", "j", F.col("n_pos").alias("n")),
    "w_edges": lambda s, d: w(s, d)[1].withColumn("w", F.round("w", 9)),
    "w_forced_positive": lambda s, d: C.edges(C.pairs(C.presence(units(s, d), C.nodes(units(s, d), K)), units(s, d).select("unit_id", T.opposes(F.col("text")).alias("negative"))), True).withColumn("w", F.round("w", 9)),
    "w_status": lambda s, d: C.status(*w(s, d)),
    "w_strength": lambda s, d: C.row_strength(*w(s, d)),
    "w_isolated": lambda s, d: C.row_strength(*w(s, d)).where("degree = 0").select("node_id", "term"),
    "w_strength_stats": lambda s, d: C.row_strength(*w(s, d)).agg(*(F.round(f, 6).alias(n) for n, f in (("mean", F.avg("strength")), ("std", F.stddev_pop("strength")), ("cv", F.stddev_pop("strength") / F.avg("strength")), ("skew", F.skewness("strength"))))),
    "w_difference": lambda s, d: C.difference(named(s, d, True), named(s, d, False)),
    "unit_quantiles": quantiles,
    "phi_pmi": lambda s, d: C.association(C.presence(units(s, d), C.nodes(units(s, d), K)), units(s, d).count()),
    "sigma_eval": lambda s, d: C.evaluate(units(s, d), C.nodes(units(s, d), K)),
    "opposition_flag": lambda s, d: units(s, d).select("unit_id", T.opposes(F.col("text")).alias("opposes")),
    "behaviour_nodes": behaviour,
    "behaviour_graph": behaviour_graph,
    "substring_map": lambda s, d: units(s, d).select("unit_id", F.explode(F.array_compact(F.array(*(F.when(F.lower("text").contains(t), F.lit(t)) for t in ("matri", "panel", "sign"))))).alias("term")),
    "prose_filter": lambda s, d: lines(s, d).select("unit_id", "pos", T.cleaned(F.col("line")).alias("line")).where(T.is_prose(F.col("line"))),
    "line_cleanup": lambda s, d: lines(s, d).select("unit_id", "pos", T.cleaned(F.col("line")).alias("line")),
    "text_lines": lambda s, d: lines(s, d).select("unit_id", "pos", F.regexp_replace("line", r"^[ \t\r]+|[ \t\r]+$", "").alias("line")).where("line <> ''"),
    "dedupe_lines": lambda s, d: lines(s, d).where(T.not_blank(F.col("line"))).groupBy(F.sha2(F.lower("line"), 256).alias("h")).agg(F.min(F.struct("unit_id", "pos")).alias("f"), F.count("*").alias("n")).select("h", F.col("f.unit_id").alias("unit_id"), F.col("f.pos").alias("pos"), "n"),
    "md_paragraphs": lambda s, d: units(s, d).select("unit_id", F.posexplode(F.split("text", "\n\n")).alias("pos", "block")).where(~F.col("block").rlike(r"^\s*(#|\||---)") & (F.length(F.trim("block")) >= 40)),
    "paginate": paginate,
    "token_scrub": lambda s, d: units(s, d).select("unit_id", F.trim(F.regexp_replace(F.regexp_replace("text", r"(^|[^\p{L}])(panel|matriz|signal|corpus)([^\p{L}]|$)", "$1$3"), r"\s+", " ")).alias("text")),
    "tag_strip": lambda s, d: units(s, d).select("unit_id", F.regexp_replace("text", r"<[^<>]*>", "").alias("text")),
    "set_hash": lambda s, d: units(s, d).select("unit_id", T.set_hash(F.array_distinct(T.tokens(F.col("text")))).alias("h")),
    "entity_decode": lambda s, d: T.entities_decoded(units(s, d).select("unit_id", F.regexp_replace("text", r"<[^<>]*>", "").alias("text")), "text"),
    "block_containment": lambda s, d: B.contained(states(s, d)),
    "block_turnover": lambda s, d: B.turnover(states(s, d)),
    "shuffled_words": shuffled_words,
}

STOP = ", ".join(f"'{x}'" for x in T.STOP_WORDS)
_TOK = r"regexp_extract_all(lower(nfc_normalize(text)), '[\p{L}\p{Nl}\p{No}_]{3,}')"
_MARK = "|".join(m.replace("'", "[''’]") for m in sorted(T.OPPOSITION_MARKERS, key=len, reverse=True))
_WHOLE = r"regexp_matches({t}, '(^|[^\p{{L}}\p{{N}}_])({p})([^\p{{L}}\p{{N}}_]|$)')"
_OPP = "coalesce(" + _WHOLE.format(t="lower(nfc_normalize(text))", p=_MARK) + ", false)"


def base(where="true", k=K):
    """CTEs up to the selected nodes (n) and the signed edges (e)."""
    return f"""
u as (select doc_id as unit_id, text from documents where {where}),
x0 as (select unit_id, unnest({_TOK}) as term from u),
x as (select * from x0 where term not in ({STOP})),
c as (select unit_id, term, count(*) as n from x group by all),
f as (select term, count(*) as df, sum(n)::bigint as tf from c group by term having count(*) >= 2),
p as (select * from f order by tf desc, term limit {3 * k}),
nu as (select count(*) as n_units from u where regexp_matches(text, '[^ \t\r\n]')),
v as (select unit_id, term, df, tf, n * (ln((1 + n_units) / (1 + df)) + 1) as x from c join p using (term), nu),
vn as (select *, x / sqrt(sum(x * x) over (partition by unit_id)) as y from v),
sc as (select term, df, tf, round(sum(y) / (select n_units from nu), 9) as score from vn group by all),
rk as (select *, row_number() over (order by score desc, term) as rank, count(*) over () as size from sc),
cut as (select score as cut from rk where rank = least({k}, size)),
rg as (select *, score - cut as gap, sum((score - cut > 1e-12)::int) over () as above, sum((abs(score - cut) <= 1e-12)::int) over () as ties from rk, cut),
n as (select (row_number() over (order by rank) - 1)::int as node_id, term, score from rg where size <= {k} or gap > 1e-12 or (abs(gap) <= 1e-12 and ties <= {k} - above)),
pr as (select distinct unit_id, node_id from x join n using (term)),
sg as (select unit_id, {_OPP} as negative from u),
pc as (select a.node_id as i, b.node_id as j, count(*) filter (not negative) as n_pos, count(*) filter (negative) as n_neg from pr a join pr b on a.unit_id = b.unit_id and a.node_id < b.node_id join sg on sg.unit_id = a.unit_id group by all),
r as (select i, j, n_pos - n_neg as raw from pc),
e as (select i, j, raw, case when max(abs(raw)) over () > 0 then raw / max(abs(raw)) over () else 0 end as w from r)"""


_B = "with " + base()
_STR = """, bw as (select i, j, w from e where raw <> 0 union all select j, i, w from e where raw <> 0),
st as (select node_id, term, round(coalesce(sum(abs(w)), 0), 9) as strength, count(w) as degree from n left join bw on node_id = i group by all)"""
_LINES = "with u as (select doc_id as unit_id, text from documents), l0 as (select unit_id, unnest(string_split(text, e'\\n')) as line, unnest(range(len(string_split(text, e'\\n')))) as pos from u), l as (select unit_id, pos::int as pos, line from l0)"
_BEH = "select doc_id as unit_id, node from (" + " union all ".join(f"select doc_id, '{n}' as node from documents where {_WHOLE.format(t='lower(nfc_normalize(text))', p='|'.join(x.replace(chr(39), '[' + chr(39) * 2 + '’]') for x in sorted(p, key=len, reverse=True)))}" for n, p in T.BEHAVIOUR.items()) + ")"

_BLOCKS = f"""with tx as (select source as series, strftime(written_at, '%Y-%m') as version, unnest(string_split_regex(text, '\\n[ \\t\\n\\x0B\\f\\r]*\\n')) as text from documents where source is not null and written_at is not null and text is not null),
tt as (select series, version, list_sort(list_distinct({_TOK})) as tokens from tx),
ms as (select distinct series, version, tokens, sha256(array_to_string(tokens, e'\\n')) as h from tt where len(tokens) >= 5),
sets as (select series, h, any_value(tokens) as tokens from ms group by all),
et as (select series, h, len(tokens) as m, unnest(tokens) as tok from sets),
ct as (select a.series, a.h, b.h as other from et a join et b on a.series = b.series and a.tok = b.tok and a.h <> b.h group by a.series, a.h, b.h, a.m having count(*) >= 0.8::double * a.m - 1e-9)"""

SQL = {
    "tokens_top": f"with u as (select doc_id as unit_id, text from documents), x as (select unit_id, unnest({_TOK}) as term from u) select term, count(distinct unit_id) as df, count(*) as tf from x group by term order by tf desc, term limit 50",
    "doc_freq": _B + " select * from f",
    "stopword_effect": f"with u as (select {_TOK} as t from documents) select sum(coalesce(len(t), 0))::bigint as n_before, sum(coalesce(len(list_filter(t, lambda w: w not in ({STOP}))), 0))::bigint as n_after from u",
    "ngram_top": f"with u as (select doc_id as unit_id, list_filter({_TOK}, lambda w: w not in ({STOP})) as t from documents), g as (select unit_id, unnest(list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1])) as term from u where len(t) >= 2) select term, count(distinct unit_id) as df, count(*) as tf from g group by term having count(distinct unit_id) >= 2 order by tf desc, term limit 50",
    "pool_terms": _B + " select * from p",
    "tfidf_scores": _B + " select * from sc",
    "border_register": _B + f" select term, round(gap, 9) as distance, term in ('signal', 'panel') as was_member, size <= {K} or gap > 1e-12 or (abs(gap) <= 1e-12 and (ties <= {K} - above or term in ('signal', 'panel'))) as selected from rg",
    "node_selection": _B + " select * from n",
    "presence": _B + " select * from pr",
    "node_freq": _B + " select node_id, count(*) as n_units from pr group by 1",
    "cooc_pairs": _B + " select i, j, n_pos + n_neg as n from pc",
    "w_edges": _B + " select i, j, raw, round(w, 9) as w from e",
    "w_forced_positive": _B + " select i, j, n_pos + n_neg as raw, round((n_pos + n_neg) / max(n_pos + n_neg) over (), 9) as w from pc",
    "w_status": _B + ", m as (select count(*) as n_nodes from n), q as (select count(*) filter (raw <> 0) as nz, count(*) filter (raw < 0) as neg, sum(w) as t from e) select n_nodes, nz as n_pairs, round(1 - nz / (n_nodes * (n_nodes - 1) / 2), 3) as sparsity, round(neg / nz, 6) as neg_frac, round(t / (n_nodes * (n_nodes - 1) / 2), 9) as mu_all, round(t / nz, 9) as mu_nonzero from m, q",
    "w_strength": _B + _STR + " select * from st",
    "w_isolated": _B + _STR + " select node_id, term from st where degree = 0",
    "w_strength_stats": _B + _STR + " select round(avg(strength), 6) as mean, round(stddev_pop(strength), 6) as std, round(stddev_pop(strength) / avg(strength), 6) as cv, round((select avg((strength - m) ** 3) / avg((strength - m) ** 2) ** 1.5 from (select strength, avg(strength) over () as m from st)), 6) as skew from st",
    "w_difference": "select count(*) filter (a.w is not null and b.w is not null) as common_pairs, count(*) filter (a.w is null) as entered, count(*) filter (b.w is null) as gone, round(sqrt(sum((coalesce(b.w, 0) - coalesce(a.w, 0)) ** 2)), 6) as norm from "
    + " full join ".join(f"(with {base(cond)} select least(na.term, nb.term) as ta, greatest(na.term, nb.term) as tb, w from e join n na on na.node_id = i join n nb on nb.node_id = j) {alias}" for cond, alias in ((f"loaded_at <= {MIDDLE}", "a"), ("true", "b")))
    + " on a.ta = b.ta and a.tb = b.tb",
    "unit_quantiles": _B + f", k as (select unit_id, count(*) as k from pr group by 1), q as (select coalesce(len({_TOK}), 0) as words, coalesce(k, 0) as k from u left join k using (unit_id)) select " + ", ".join(f"round(quantile_cont({c}, {x / 100}), 6) as {c}_p{x}" for c in ("words", "k") for x in (10, 50, 90)) + ", round(avg((k = 0)::int), 6) as without from q",
    "phi_pmi": _B + ", o as (select node_id, count(*)::double as m from pr group by 1), t as (select count(*)::double as nn from u) select i, j, n_pos + n_neg as n_ij, round((nn * (n_pos + n_neg) - a.m * b.m) / sqrt(a.m * b.m * (nn - a.m) * (nn - b.m)), 9) as phi, round(ln((n_pos + n_neg) * nn / (a.m * b.m)), 9) as pmi from pc join o a on a.node_id = i join o b on b.node_id = j, t",
    "sigma_eval": _B + " select unit_id, n.node_id, case when pr.unit_id is null then -1 else 1 end as sigma from u cross join n left join pr using (unit_id, node_id)",
    "opposition_flag": f"select doc_id as unit_id, {_OPP} as opposes from documents",
    "behaviour_nodes": _BEH,
    "behaviour_graph": f"with b as ({_BEH}), q as (select x.node as a, y.node as b, count(*) as n from b x join b y on x.unit_id = y.unit_id and x.node < y.node group by all) select a, b, n, round(n / max(n) over (), 9) as g from q",
    "substring_map": "select doc_id as unit_id, term from documents, (values ('matri'), ('panel'), ('sign')) t(term) where contains(lower(text), term)",
    "prose_filter": _LINES + r""", k as (select unit_id, pos, trim(regexp_replace(regexp_replace(line, '[*`#]', '', 'g'), '[\t\n\x0B\f\r ]+', ' ', 'g'), ' ') as line from l) select * from k where length(line) >= 40 and not contains(line, '|') and not (regexp_matches(line, '^\d+(\.\d+)*[.)]?\s+\S') and length(line) < 80) and not (regexp_matches(line, '^[-•*]\s') and length(line) < 60) and length(regexp_replace(line, '[^\p{L}]', '', 'g')) * 2 >= length(line)""",
    "line_cleanup": _LINES + r""" select unit_id, pos, trim(regexp_replace(regexp_replace(line, '[*`#]', '', 'g'), '[\t\n\x0B\f\r ]+', ' ', 'g'), ' ') as line from l""",
    "text_lines": _LINES + r""", t as (select unit_id, pos, regexp_replace(line, '^[ \t\r]+|[ \t\r]+$', '', 'g') as line from l) select * from t where line <> ''""",
    "dedupe_lines": _LINES + " select sha256(lower(line)) as h, min({'u': unit_id, 'a': pos}).u as unit_id, min({'u': unit_id, 'a': pos}).a as pos, count(*) as n from l where regexp_matches(line, '[^ \\t\\r\\n]') group by 1",
    "set_hash": f"select doc_id as unit_id, sha256(coalesce(array_to_string(list_sort(list_distinct({_TOK})), e'\\n'), '')) as h from documents",
    "tag_strip": "select doc_id as unit_id, regexp_replace(text, '<[^<>]*>', '', 'g') as text from documents",
    "md_paragraphs": r"with u as (select doc_id as unit_id, string_split(text, e'\n\n') as b from documents), q as (select unit_id, unnest(range(len(b)))::int as pos, unnest(b) as block from u) select * from q where not regexp_matches(block, '^\s*(#|\||---)') and length(trim(block)) >= 40",
    "token_scrub": r"select doc_id as unit_id, trim(regexp_replace(regexp_replace(text, '(^|[^\p{L}])(panel|matriz|signal|corpus)([^\p{L}]|$)', '\1\3', 'g'), '[\t\n\x0B\f\r ]+', ' ', 'g'), ' ') as text from documents",
    "paginate": _LINES + r""", k as (select unit_id, pos, len(list_filter(string_split_regex(line, '[\t\n\x0B\f\r ]+'), lambda w: w <> '')) as n from l where regexp_matches(line, '[^ \t\r\n]')),
g as (select unit_id, list(n order by pos) as ns from k group by 1) select unit_id, (list_reduce(list_prepend({'pages': 1, 'run': 0}, list_transform(ns, lambda n: {'pages': 0, 'run': n::int})), lambda a, x: {'pages': case when a.run >= 200 then a.pages + 1 else a.pages end, 'run': case when a.run >= 200 then x.run else a.run + x.run end})).pages as n_pages from g""",
    "block_containment": _BLOCKS + " select series, h, other from ct",
    "block_turnover": _BLOCKS + """, sv as (select series, h, version as v from ms union select ct.series, ct.h, o.version from ct join ms o on o.series = ct.series and o.h = ct.other),
vs as (select series, version, lead(version) over (partition by series order by version) as nx from (select distinct series, version from ms)),
fl as (select vs.series, vs.version, nx, s.h, bool_or(coalesce(m.version = vs.version, false)) as f, bool_or(coalesce(m.version = nx, false)) as t from vs join sets s using (series) left join ms m on m.series = s.series and m.h = s.h where nx is not null group by all),
sl as (select vs.series, vs.version, nx, sv.h, bool_or(v = vs.version) as sf, bool_or(v = nx) as st, bool_or(v > nx) as la, bool_or(v < vs.version) as ea from vs join sv using (series) where nx is not null group by all)
select fl.series, fl.version, fl.nx as next, count(*) filter (f) as n_from, count(*) filter (t) as n_to, count(*) filter (f and not st) as leaves, count(*) filter (f and not st and not la) as never_back, count(*) filter (t and not sf) as arrives, count(*) filter (t and not sf and ea) as returns
from fl join sl on sl.series = fl.series and sl.version = fl.version and sl.h = fl.h group by all""",
    "shuffled_words": "with u as (select doc_id as unit_id, list_filter(string_split_regex(text, '[ \\t\\n\\x0B\\f\\r]+'), lambda w: w <> '') as t from documents), q as (select unit_id, unnest(t) as word, unnest(range(len(t)))::int as pos from u), a as (select unit_id, pos, row_number() over (order by unit_id, pos) as k from q), b as (select word, row_number() over (order by md5('7:' || unit_id || ':' || pos || ':' || word)) as k from q) select unit_id, pos, word from a join b using (k)",
}
