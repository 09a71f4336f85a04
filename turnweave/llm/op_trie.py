"""Query of the conversation prefix trie, and its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from turnweave.llm.tables import kept, table
from turnweave.llm.zfast_trie import ordered_turns, prefix_trie, with_shared_start


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    talks = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    rebuilt, conversations = with_shared_start(ordered_turns(talks))
    return prefix_trie(kept(rebuilt, "rebuilt"), conversations)


# DuckDB has no crc32; its table is made bit by bit and applied to the digits of the id.
SQL = r"""
with recursive bits as (
  select i::bigint as i, i::bigint as c, 0 as k from range(256) t(i)
  union all
  select i, case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, k + 1 from bits where k < 8),
crc_table as (select i, c from bits where k = 8),
checksum as (
  select conv_id, conv_id::varchar as s, 0 as pos, 4294967295::bigint as c
  from (select distinct conv_id from conversations where conv_id is not null)
  union all
  select conv_id, s, pos + 1, xor(x.c >> 8, t.c) from checksum x
    join crc_table t on t.i = xor(x.c, ascii(s[pos + 1])::bigint) & 255 where pos < length(s)),
talks as (
  select conv_id, conv_id - conv_id % 100 as base, xor(c, 4294967295) % 6 as h from checksum where pos = length(s)),
turns as (
  select conv_id, coalesce(role, '') as role, coalesce(text, '') as text,
    row_number() over (partition by conv_id order by turn nulls first) as nth from conversations where conv_id is not null),
mixed as (
  select t.conv_id, 0 as own, nth, role, text from talks t join turns b on b.conv_id = t.base and nth <= h
  union all
  select t.conv_id, 1, nth, role, text from talks t join turns o on o.conv_id = t.conv_id and nth > h),
placed as (
  select conv_id, row_number() over (partition by conv_id order by own, nth) as depth, length(text) as chars,
    md5(length(role) || ':' || role || text) as k from mixed),
prefixed as (
  select conv_id, depth, chars, string_agg(k, '') over (partition by conv_id order by depth) as path from placed
  union all
  select conv_id, 0, 0, '' from talks),
ended as (select conv_id, max(depth) as len from prefixed group by conv_id),
nodes as (
  select path, depth, any_value(chars) as chars, min(conv_id) as conv_id, count(*) as n_convs,
    sha256(coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (len = depth), '')) as ends_sha256
  from prefixed join ended using (conv_id) group by path, depth),
children as (
  select left(path, length(path) - 32) as path, count(*) as n_children from nodes where depth > 0 group by 1),
known as (
  select n.*, p.conv_id as parent_conv_id, coalesce(n_children, 0) as n_children
  from nodes n left join nodes p on n.depth > 0 and p.path = left(n.path, length(n.path) - 32)
    left join children c on c.path = n.path),
sums as (
  select v.path, count(*) filter (u.n_children = 0) as n_leaves, sum((u.n_convs - 1) * u.chars) as saved
  from known u join prefixed v on v.conv_id = u.conv_id and v.depth <= u.depth group by v.path)
select conv_id, depth::bigint as depth, parent_conv_id, n_convs, n_children, n_leaves, saved::bigint as saved_tokens, ends_sha256
from known join sums using (path)
"""
