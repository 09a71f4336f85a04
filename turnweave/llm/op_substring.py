"""Query of the word substring dedup operator, and its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from turnweave.llm.difference_cover import without_repeats
from turnweave.llm.tables import table


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = without_repeats(table(spark, sf_dir, "documents"), window=50)
    return left.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


SQL = r"""
with worded as (
  select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
windows as (
  select doc_id, unnest(range(1, len(w) - 48)) as s, w from worded where len(w) >= 50),
hashed as (select doc_id, s, md5(array_to_string(w[s:s + 49], ' ')) as h from windows),
later as (
  select doc_id, s from (select doc_id, s, min(doc_id) over (partition by h) as low from hashed) where low < doc_id),
covered as (select distinct doc_id, unnest(range(s, s + 50)) as i from later),
words as (select doc_id, unnest(w) as word, unnest(range(1, len(w) + 1)) as i from worded),
left_over as (
  select x.doc_id, count(*) as n, string_agg(word, ' ' order by x.i) as kept
  from words x anti join covered c on c.doc_id = x.doc_id and c.i = x.i group by x.doc_id)
select doc_id, len(w)::bigint as n_words, (len(w) - coalesce(n, 0))::bigint as n_removed,
  sha256(coalesce(kept, '')) as kept_sha256
from worded left join left_over using (doc_id)
"""
