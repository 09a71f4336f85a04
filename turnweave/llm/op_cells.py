"""Query of the embedding near-dedup operator, and its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from turnweave.llm.embedding_cells import embedding_groups
from turnweave.llm.tables import table


def op1_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_groups(table(spark, sf_dir, "embeddings"), least=0.93)


SQL = """
with recursive usable as (
  select vec_id, label, embedding::double[] as v from embeddings
  where label is not null and embedding is not null and len(embedding) > 0
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
    and len(list_filter(embedding, lambda x: x <> 0)) > 0),
links as (
  select x.vec_id as a, y.vec_id as b from usable x join usable y on x.label = y.label and x.vec_id <> y.vec_id
  where list_cosine_similarity(x.v, y.v) >= 0.93),
reached as (
  select vec_id as id, vec_id as other from embeddings
  union
  select r.id, l.b from reached r join links l on l.a = r.other),
least as (select id, min(other) as low from reached group by id),
counted as (select a, count(*) as n from links group by a)
select e.vec_id, coalesce(n, 0)::bigint as n_links, low as component_id, e.vec_id = low as kept
from embeddings e join least on least.id = e.vec_id left join counted on counted.a = e.vec_id
"""
