"""Chat formatting as prefix trees.

Conversations that begin with the same turns share the tokens of those turns:
each tree's tokens are laid out once, depth first, and every turn carries its
position ids (as if its own conversation stood alone) and the intervals of the
layout that it may attend to.

A turn's identity is the running sum of hashes of (place, role, text), so equal
prefixes have equal keys, and sorting conversations by their keys sorts a tree
depth first. All sorts and running sums are spread over range partitions; a
start shared by very many conversations isn't one task's work.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagewright.plans.cut import cut

TOKEN = r"[\p{L}\p{N}]+|[^\s\p{L}\p{N}]"


def _number(of: str, start: int) -> str:
    return f"cast(conv(substr(sha2({of}, 256), {start}, 15), 16, 10) as decimal(38, 0))"


def chat_tree(conversations: DataFrame) -> DataFrame:
    """One row a shared turn of each tree.

    ``tree_id``; ``node``, its place in depth-first order from 1; ``depth``
    from 1; ``role``; ``n_conversations`` that pass through it; ``tokens``
    (role mark, the text's words and signs, end mark) and ``n_tokens``;
    ``start``, its first token's place in the tree's layout; ``position_ids``;
    ``attention``, the intervals [from, to) of the layout with its ancestors
    and itself, neighbouring ones joined; the last is causal.

    Turns are taken in the order of turn, role and text, nulls first; null
    role or text counts as empty; wholly repeated turns count once; rows
    without conv_id are left out. Conversations that are equal or a prefix of
    another share its nodes. An empty table gives no rows.
    """
    turns = conversations.where("conv_id is not null").selectExpr("conv_id", "turn", "coalesce(role, '') as role", "coalesce(text, '') as text").distinct()
    by_turn = W.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    turns = turns.withColumn("depth", F.row_number().over(by_turn))
    what = "concat(depth, char(0), role, char(0), text)"
    turns = turns.selectExpr("*", f"{_number(what, 1)} as _a", f"{_number(what, 16)} as _b", f"size(regexp_extract_all(text, '{TOKEN}', 0)) + 2 as n_tokens".replace("\\", "\\\\"))
    so_far = W.partitionBy("conv_id").orderBy("depth").rowsBetween(W.unboundedPreceding, 0)
    turns = turns.withColumn("key", F.concat_ws("-", F.sum("_a").over(so_far).cast("string"), F.sum("_b").over(so_far).cast("string")))
    turns = turns.withColumn("before", F.sum("n_tokens").over(so_far) - F.col("n_tokens"))

    # conversations in the order of their keys; the rank only orders, but it must not change when a task is repeated
    slim = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("depth", "key", "n_tokens", "before"))).alias("path"))
    slim = slim.selectExpr("conv_id", "path[0].key as tree_id", "path", "transform(path, x -> x.key) as keys")
    ranked = slim.repartitionByRange("tree_id", "keys").sortWithinPartitions("tree_id", "keys", "conv_id").select("conv_id", "tree_id", "path", F.monotonically_increasing_id().alias("rank"))
    ranked = cut(ranked)
    steps = ranked.select("tree_id", "conv_id", "rank", F.explode("path").alias("x")).select("tree_id", "conv_id", "rank", "x.*")

    nodes = steps.groupBy("tree_id", "key").agg(F.min("rank").alias("rank"), F.min_by("conv_id", "rank").alias("conv_id"), F.first("depth").alias("depth"), F.first("n_tokens").alias("n_tokens"), F.first("before").alias("before"), F.count("*").alias("n_conversations"))
    # running sums: within the range partition that a node's first conversation lies in, then over the partitions of a tree
    nodes = nodes.withColumn("chunk", F.shiftright("rank", 33))
    inside = W.partitionBy("tree_id", "chunk").orderBy("rank", "depth").rowsBetween(W.unboundedPreceding, 0)
    nodes = cut(nodes.withColumn("_tokens", F.sum("n_tokens").over(inside)).withColumn("_nodes", F.count("*").over(inside)))
    chunks = nodes.groupBy("tree_id", "chunk").agg(F.sum("n_tokens").alias("_t"), F.count("*").alias("_n"))
    earlier = W.partitionBy("tree_id").orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)
    chunks = chunks.select("tree_id", "chunk", F.coalesce(F.sum("_t").over(earlier), F.lit(0)).alias("_t0"), F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_n0"))
    placed = nodes.join(chunks, ["tree_id", "chunk"]).selectExpr("tree_id", "key", "rank as first_rank", "_nodes + _n0 as node", "_tokens + _t0 - n_tokens as start", "n_conversations")

    # a node's ancestors are the turns before it in its first conversation
    along = steps.join(placed, ["tree_id", "key"])
    path = W.partitionBy("rank").orderBy("depth")
    along = along.withColumn("_end", F.lag(F.col("start") + F.col("n_tokens")).over(path))
    breaks = F.col("_end").isNull() | (F.col("_end") != F.col("start"))
    upto = path.rowsBetween(W.unboundedPreceding, 0)
    along = along.withColumn("_from", F.collect_list(F.when(breaks, F.col("start"))).over(upto)).withColumn("_to", F.collect_list(F.when(breaks, F.col("_end"))).over(upto))
    along = along.where("rank = first_rank").withColumn("attention", F.arrays_zip(F.col("_from").alias("from"), F.concat("_to", F.array(F.col("start") + F.col("n_tokens"))).alias("to")))
    texts = turns.select("conv_id", "depth", "role", "text")
    return along.join(texts, ["conv_id", "depth"]).select(
        "tree_id", "node", "depth", "role", "n_conversations",
        F.concat(F.array(F.concat(F.lit("<|"), "role", F.lit("|>"))), F.regexp_extract_all("text", F.lit(TOKEN), 0), F.array(F.lit("<|end|>"))).alias("tokens"),
        "n_tokens", "start", F.sequence(F.col("before"), F.col("before") + F.col("n_tokens") - 1).alias("position_ids"), "attention",
    )


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations as prefix trees, lists written as text."""
    tree = chat_tree(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    return tree.selectExpr("tree_id", "node", "depth", "role", "n_conversations", "n_tokens", "start", "array_join(tokens, ' ') as tokens", "position_ids[0] as position_from", "element_at(position_ids, -1) as position_to", "array_join(transform(attention, x -> concat(x.`from`, '-', x.`to`)), ' ') as attention")


OP5_SQL = rf"""
with turns as (
  select *, row_number() over (partition by conv_id order by turn nulls first, role, text) as depth
  from (select distinct conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations where conv_id is not null)
), hashed as (select *, sha256(depth || chr(0) || role || chr(0) || text) as h, regexp_extract_all(text, '{TOKEN}') as words from turns)
, keyed as (
  select *, len(words) + 2 as n_tokens, sum(('0x' || substr(h, 1, 15))::bigint::hugeint) over w || '-' || sum(('0x' || substr(h, 16, 15))::bigint::hugeint) over w as "key",
         sum(len(words) + 2) over w - (len(words) + 2) as before
  from hashed window w as (partition by conv_id order by depth rows between unbounded preceding and current row)
), convs as (select conv_id, list("key" order by depth) as keys from keyed group by conv_id)
, ranked as (select conv_id, keys[1] as tree_id, row_number() over (partition by keys[1] order by keys, conv_id) as r from convs)
, steps as (select k.*, tree_id, r from keyed k join ranked using (conv_id))
, nodes as (select tree_id, "key", min(r) as first_r, any_value(depth) as depth, any_value(n_tokens) as n_tokens, count(*) as n_conversations from steps group by all)
, placed as (
  select *, row_number() over w as node, sum(n_tokens) over w - n_tokens as start from nodes window w as (partition by tree_id order by first_r, depth rows between unbounded preceding and current row)
), along as (
  select s.*, p.node, p.start, p.first_r, p.n_conversations, lag(p.start + s.n_tokens) over (partition by s.conv_id order by s.depth) as prev_end
  from steps s join placed p on s.tree_id = p.tree_id and s."key" = p."key"
), broken as (
  select *, list(start) filter (prev_end is null or prev_end <> start) over w as froms,
         list(prev_end) filter (prev_end is not null and prev_end <> start) over w as tos
  from along window w as (partition by conv_id order by depth rows between unbounded preceding and current row)
)
select tree_id, node, depth, role, n_conversations, n_tokens::int as n_tokens, start::bigint as start,
       array_to_string(list_concat(list_concat(['<|' || role || '|>'], words), ['<|end|>']), ' ') as tokens,
       before::bigint as position_from, (before + n_tokens - 1)::bigint as position_to,
       array_to_string(list_transform(range(1, len(froms) + 1), lambda i: froms[i]::bigint || '-' || coalesce(tos[i], start + n_tokens)::bigint), ' ') as attention
from broken where r = first_r
"""
