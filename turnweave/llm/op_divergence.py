"""Query of the source divergence audit, and its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from turnweave.llm.divergence_cube import divergence_audit
from turnweave.llm.tables import table


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence_audit(table(spark, sf_dir, "documents"), least_docs=30, most_terms=50)


SQL = r"""
with docs as (
  select row_number() over () as r, coalesce(lang, '') as lang, coalesce(source, '') as source,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as text from documents),
terms as (
  select r, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) as term from docs),
chosen as (select lang, term, count(*) as lang_n from terms group by lang, term having count(distinct r) >= 30),
sizes as (select lang, count(*) as v, sum(lang_n)::bigint as lang_total from chosen group by lang),
groups as (select distinct lang, source from docs),
held as (select lang, source, term, count(*) as n from terms semi join chosen using (lang, term) group by lang, source, term),
totals as (select lang, source, sum(n)::bigint as total from held group by lang, source),
shares as (
  select lang, source, term, coalesce(n, 0) as n,
    1 + (1000000000 * (coalesce(n, 0) + 5)) // (coalesce(total, 0) + 5 * v) as p,
    1 + (1000000000 * (lang_n + 5)) // (lang_total + 5 * v) as q
  from groups join chosen using (lang) join sizes using (lang)
    left join held using (lang, source, term) left join totals using (lang, source)),
distances as (
  select x.lang, x.source, y.source as item, sum(abs(x.p - y.p)) as value
  from shares x join shares y on x.lang = y.lang and x.term = y.term and x.source <> y.source group by 1, 2, 3),
listed as (
  select x.lang, x.source, 'pair' as part, y.source as item, coalesce(value, 0)::bigint as value
  from groups x join groups y on x.lang = y.lang and x.source <> y.source
    left join distances d on d.lang = x.lang and d.source = x.source and d.item = y.source
  union all
  select lang, source, 'term', term, (p - q)::bigint from shares where n > 0 and p > q),
numbered as (
  select *, row_number() over (partition by lang, source, part order by value desc, item)::int as rank from listed)
select lang, source, part, item, value, rank from numbered where part = 'pair' or rank <= 50
"""
