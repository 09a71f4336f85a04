"""Query of the MinHash near-dedup operator, and its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from turnweave.llm.superminhash import near_duplicates
from turnweave.llm.tables import table


def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), words=4, percent=80)


SQL = r"""
with recursive worded as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') as w from documents),
shingled as (
  select distinct doc_id, unnest(case when len(w) = 0 then [] when len(w) < 4 then [array_to_string(w, ' ')]
    else list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) end) as s from worded),
sizes as (select doc_id, count(*) as n from shingled group by doc_id),
common as (
  select x.doc_id as a, y.doc_id as b, count(*) as c from shingled x join shingled y on x.s = y.s and x.doc_id <> y.doc_id
  group by 1, 2),
links as (
  select a, b from common join sizes p on p.doc_id = a join sizes q on q.doc_id = b where 100 * c >= 80 * (p.n + q.n - c)),
reached as (
  select doc_id as id, doc_id as other from documents
  union
  select r.id, l.b from reached r join links l on l.a = r.other)
select d.doc_id, coalesce(n, 0)::bigint as n_shingles, least_id as component_id, d.doc_id = least_id as kept
from documents d left join sizes using (doc_id)
join (select id, min(other) as least_id from reached group by id) on id = d.doc_id
"""
