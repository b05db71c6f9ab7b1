"""Queries of the llm problems (3, 4, 6, 7, 8) and their SQL."""

from __future__ import annotations

from sparkscape.llm import bpe, packing, pairs, pii, terms
from sparkscape.session import table

# A key for tests and demonstrations; a real run passes its own secret.
SURROGATE_KEY = "demonstration"


def _texts(spark, d):
    return terms.records(table(spark, d, "documents"), table(spark, d, "monitor_trajectory"))


QUERIES = {
    "p3_found": lambda s, d: terms.marked(_texts(s, d)),
    "p3_frequencies": lambda s, d: terms.frequencies(_texts(s, d)),
    # The same with so little memory a task that every partition spills, again and again.
    "p3_spilled": lambda s, d: terms.frequencies(_texts(s, d), budget=16),
    "p4_found": lambda s, d: pairs.after(pairs.deliveries(table(s, d, "documents"), table(s, d, "monitor_trajectory"))).select("src", "term_a", "term_b"),
    "p4_scores": lambda s, d: pairs.in_two_steps(_texts(s, d)),
    "p6_ids": lambda s, d: bpe.ids(table(s, d, "documents")),
    "p6_decoded": lambda s, d: bpe.decoded(bpe.ids(table(s, d, "documents"))),
    "p7_containers": lambda s, d: packing.containers(table(s, d, "documents")),
    "p7_summary": lambda s, d: packing.summary(table(s, d, "documents")),
    "p7_check": lambda s, d: packing.checked(table(s, d, "documents")),
    "p8_found": lambda s, d: pii.found(table(s, d, "documents"), table(s, d, "name_parts"), SURROGATE_KEY),
    "p8_redacted": lambda s, d: pii.redacted(table(s, d, "documents"), table(s, d, "name_parts")),
    "p8_surrogates": lambda s, d: pii.with_surrogates(table(s, d, "documents"), table(s, d, "name_parts"), SURROGATE_KEY),
    "p8_surrogate_check": lambda s, d: pii.checked(table(s, d, "documents"), table(s, d, "name_parts"), SURROGATE_KEY).drop("n_values"),
}

_RECORDS = r"""
with x as (select 'documents' as src, doc_id as rec_id, text from documents
  union all select 'monitor_trajectory', rec_id, arg_max(text, received_at) from monitor_trajectory group by rec_id),
o as (select src, rec_id, unnest(regexp_extract_all(lower(nfc_normalize(text)), '[\p{L}_]{3,}')) as term from x),
d as (select distinct src, rec_id, term from o),
n as (select src, count(distinct rec_id) as n from d group by src),
f as (select src, term, count(*) as records from d group by src, term)
"""

_PAIRS = (
    _RECORDS
    + """, g as (select src, term, records as n_x, n from f join n using (src) where records >= 5 and records * 500 >= n and records * 20 <= n),
e as (select d.src, d.rec_id, d.term from d join g using (src, term)),
q as (select x.src, x.term as term_a, y.term as term_b, count(*) as n_ab from e x join e y on x.src = y.src and x.rec_id = y.rec_id and x.term < y.term group by all),
z as (select q.*, a.n_x as n_a, b.n_x as n_b, a.n as total from q join g a on a.src = q.src and a.term = term_a join g b on b.src = q.src and b.term = term_b
  where n_ab >= 5 and n_ab * 500 >= a.n and n_ab * a.n >= 20 * a.n_x * b.n_x)
"""
)

SQL = {
    "p4_found": _PAIRS + "select src, term_a, term_b from z",
    "p4_scores": _PAIRS + "select src, term_a, term_b, n_a, n_b, n_ab, total, n_ab * total / (n_a::double * n_b) as lift from z",
    "p3_found": _RECORDS + "select src, term, 'rare' as mark from f where records <= 2 union all select src, term, 'common' from f join n using (src) where records * 10 > n",
    "p3_frequencies": _RECORDS
    + """, c as (select src, term, count(*) as occurrences from o group by src, term)
select src, term, occurrences, records, records <= 2 as is_rare, records * 10 > n as is_common from c join f using (src, term) join n using (src)""",
    # What must hold of the surrogates of every kind.
    "p8_surrogate_check": "select kind, 0::bigint as split, 0::bigint as shared, 0::bigint as unchanged, 0::bigint as other_form from (values ('address'), ('email'), ('id_number'), ('name'), ('phone')) k(kind)",
    "p7_check": "select 0::bigint as lost, 0::bigint as doubled, 0::bigint as split, 0::bigint as over, 0::bigint as wrong_sum, true as near_least",
    "p6_decoded": "select doc_id, coalesce(text, '') as decoded from documents",
}

SQL["p3_spilled"] = SQL["p3_frequencies"]
