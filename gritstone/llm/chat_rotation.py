"""Operator 8: multi-party perspective rotation of dialogues, DataFrame functions only.

For every participant of a conversation the dialogue is rendered with that speaker as the assistant
and all others as named users. The mask lists the character ranges of the assistant's turns (content
and end mark), so training counts those only.

A conversation is rendered in pieces of at most PIECE turns, cut by position, whatever the turn numbers are. Positions come from a
range-partitioned, sorted table: a row's place in its partition, and what the conversation has in earlier partitions (a row for each
partition at most), so a long conversation is never in one task. Speakers meet a piece's key, and the piece its speakers, by the piece.
A turn's start is a running sum over its piece with all heads as users'; of a speaker's own turns, each earlier one moves it by the
difference of the two heads. So a rendering is made in one walk over at most PIECE turns.

Defined cases: a null text is empty; a null role is an unnamed user and no participant; null turns come
first, in block -1 (all others are block 0); a null conv_id is a conversation of its own; rows of one turn are ordered by role and text, and
repeated rows are all rendered; ``<|`` in a text becomes ``< |``, and ``%``, marks and white space in a name become ``%`` and
two hex digits, so content can't pose as a turn and different roles have different names; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import _common as C

PIECE = 256
ASSISTANT, USER, END = "<|assistant|>\n", "<|user|>\n", "<|end|>\n"
_ESCAPED = "%|<> \t\n\v\f\r"  # % first


def shown(role: Column) -> Column:
    return reduce(lambda c, x: F.replace(c, F.lit(x), F.lit(f"%{ord(x):02X}")), _ESCAPED, role)


def numbered(turns: DataFrame) -> DataFrame:
    """turns (conv_id, block, turn, role, text) with pos, a row's place in its conversation and block from 0."""
    order = ["conv_id", "block", "turn", "role", "text"]
    rows = turns.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("range", F.spark_partition_id())
    rows = C.save(rows, C.scratch(turns.sparkSession, "rotation-turns"))
    counts = rows.groupBy("conv_id", "block", "range").agg(F.count("*").alias("n"))
    earlier = F.sum("n").over(Window.partitionBy("conv_id", "block").orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    # a range goes on with one conversation of the range before at most, so there are fewer of these rows than ranges
    earlier = F.broadcast(counts.withColumn("before", earlier).filter("before > 0").select(F.col("conv_id").alias("c"), F.col("block").alias("b"), F.col("range").alias("r"), "before"))
    place = F.row_number().over(Window.partitionBy("range", "conv_id", "block").orderBy("turn", "role", "text"))
    rows = rows.withColumn("place", place).join(earlier, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("block") == F.col("b")) & (F.col("range") == F.col("r")), "left")
    return rows.select(*order, (F.col("place") - 1 + F.coalesce("before", F.lit(0))).alias("pos"))


def rotate(conversations: DataFrame, piece: int = PIECE) -> DataFrame:
    """conv_id, speaker, block, piece, n_turns, n_own_turns, text, mask (array of start and end)."""
    turns = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.when(F.col("turn").isNull(), -1).otherwise(0).cast("long").alias("block"),
        F.col("turn").cast("long").alias("turn"),
        F.col("role").cast("string").alias("role"),
        F.replace(F.coalesce(F.col("text").cast("string"), F.lit("")), F.lit("<|"), F.lit("< |")).alias("text"),
    )
    head = F.when(F.col("role").isNull(), F.lit(USER)).otherwise(F.concat(F.lit("<|user name="), shown(F.col("role")), F.lit("|>\n")))
    keys = ["conv_id", "block", "piece"]
    rows = numbered(turns).withColumn("piece", F.floor(F.col("pos") / piece).cast("long")).withColumn("head", head)
    size = F.char_length("head") + F.char_length("text") + len(END)
    rows = rows.withColumn("start", F.sum(size).over(Window.partitionBy(*keys).orderBy("pos")) - size)
    pieces = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("pos", "role", "head", "text", "start"))).alias("turns"))  # at most piece rows
    pieces = C.save(pieces, C.scratch(conversations.sparkSession, "rotation-pieces"))
    speakers = turns.filter("role is not null").select(F.col("conv_id").alias("conv"), F.col("role").alias("speaker")).distinct()
    wanted = pieces.select(*keys).join(speakers, F.col("conv_id").eqNullSafe(F.col("conv"))).select(*[F.col(k).alias(f"of_{k}") for k in keys], "speaker")
    rows = pieces.join(wanted, F.col("conv_id").eqNullSafe(F.col("of_conv_id")) & (F.col("block") == F.col("of_block")) & (F.col("piece") == F.col("of_piece")))
    mine = lambda x: F.coalesce(x["role"] == F.col("speaker"), F.lit(False))
    less = lambda x: F.char_length(x["head"]) - len(ASSISTANT)
    begin = lambda x, k: (x["start"] - k * less(x) + len(ASSISTANT)).cast("long")
    return rows.select(
        "conv_id",
        "speaker",
        "block",
        "piece",
        F.size("turns").cast("long").alias("n_turns"),
        F.array_join(F.transform("turns", lambda x: F.concat(F.when(mine(x), F.lit(ASSISTANT)).otherwise(x["head"]), x["text"], F.lit(END))), "").alias("text"),
        F.transform(F.filter("turns", mine), lambda x, k: F.struct(begin(x, k).alias("start"), (begin(x, k) + F.char_length(x["text"]) + len(END)).cast("long").alias("end"))).alias("mask"),
    ).withColumn("n_own_turns", F.size("mask").cast("long"))


def op8_chat_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rotate(C.table(spark, sf_dir, "conversations"))
    mask = F.array_join(F.transform("mask", lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ",")
    return rows.withColumn("mask", mask)


_NAME = reduce(lambda c, x: f"replace({c}, chr({ord(x)}), '%{ord(x):02X}')", _ESCAPED, "role")
ORACLE = f"""
with t as (
  select conv_id, turn, role, replace(coalesce(text, ''), '<|', '< |') as text, cast(case when turn is null then -1 else 0 end as bigint) as block from conversations),
n as (select *, row_number() over (partition by conv_id, block order by turn nulls first, role nulls first, text) as nth from t),
p as (select *, ((nth - 1) // {PIECE})::bigint as piece from n),
s as (select distinct conv_id, role as speaker from t where role is not null),
r as (
  select p.*, speaker, coalesce(role = speaker, false) as mine,
    case when role = speaker then '<|assistant|>' || chr(10) when role is null then '<|user|>' || chr(10) else '<|user name=' || {_NAME} || '|>' || chr(10) end as head,
    text || '<|end|>' || chr(10) as body
  from p join s on p.conv_id is not distinct from s.conv_id),
l as (select *, sum(length(head) + length(body)) over (partition by conv_id, speaker, block, piece order by nth) as stop from r)
select conv_id, speaker, block, piece, count(*) as n_turns, string_agg(head || body, '' order by nth) as text,
  coalesce(string_agg((stop - length(body))::bigint || ':' || stop::bigint, ',' order by nth) filter (mine), '') as mask, count(*) filter (mine) as n_own_turns
from l group by conv_id, speaker, block, piece
"""
