"""Multi-party chats rendered once from the side of every participant."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, table

def _harmless(column: str, empty: str) -> Column:
    return F.replace(F.coalesce(F.col(column).cast("string"), F.lit(empty)), F.lit("<|"), F.lit("< |"))


def perspectives(turns: DataFrame) -> DataFrame:
    """``turns(conv_id, turn, role, text)`` to one row per turn and participant of its conversation.

    Participants are the speakers of a conversation other than ``system``. From
    a participant's side its own turns are the assistant's, system turns stay,
    all others are a user's with the speaker as name. ``rendered`` is the
    turn's part of the dialogue, ``start`` and ``stop`` its code points in the
    whole, and ``train_start``, ``train_stop`` the part that the loss mask
    covers (the text and end mark of own turns; null for the others).

    No text or speaker can forge a turn: ``<|`` in them becomes ``< |``, and
    white space in a speaker's name becomes ``_``.

    Turns go in order of (turn, role, text), nulls first. A null role is the
    speaker "unknown", a null text is empty; a conversation of system turns
    only has no participant and no rows; repeated rows are repeated turns.
    Other columns are not read, and an empty table gives an empty result.
    Rows are dealt out by ranges of (conversation, participant, turn, role, start of the text); what of a
    view lies in one range is a block, and offsets come from the blocks' sums and the rows' own. So
    a very long conversation is spread over tasks, also where its turns have no number or one.
    """
    turns = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), F.regexp_replace(_harmless("role", "unknown"), r"[\x20\x09-\x0D]", "_").alias("role"), _harmless("text", "").alias("text"))
    people = turns.where("role <> 'system'").select(F.col("conv_id").alias("pc"), F.col("role").alias("perspective")).distinct()
    rows = turns.join(people, F.col("conv_id").eqNullSafe(F.col("pc"))).drop("pc")
    own = F.col("role") == F.col("perspective")
    head = F.when(own, F.lit("<|im_start|>assistant\n")).when(F.col("role") == "system", F.lit("<|im_start|>system\n")).otherwise(F.concat(F.lit("<|im_start|>user name="), F.col("role"), F.lit("\n")))
    rows = rows.withColumns({"head": head, "own": own}).withColumn("rendered", F.concat("head", "text", F.lit("<|im_end|>\n"))).withColumn("size", F.length("rendered").cast("long"))
    rows = rows.repartitionByRange("conv_id", "perspective", "turn", "role", F.substring("text", 1, 64)).withColumn("block", F.spark_partition_id())
    rows = Scratch(turns.sparkSession, "chat-views").put(rows, "rows")
    blocks = rows.groupBy("conv_id", "perspective", "block").agg(F.sum("size").alias("total"))
    before = Window.partitionBy("conv_id", "perspective").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(F.col("conv_id").alias("bc"), F.col("perspective").alias("bp"), F.col("block").alias("bb"), F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("conv_id", "perspective", "block").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("ahead", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    rows = rows.join(blocks, F.col("conv_id").eqNullSafe(F.col("bc")) & (F.col("perspective") == F.col("bp")) & (F.col("block") == F.col("bb")))
    start = F.col("base") + F.col("ahead")
    return rows.select(
        "conv_id",
        "perspective",
        "turn",
        "role",
        "rendered",
        start.alias("start"),
        (start + F.col("size")).alias("stop"),
        F.when(F.col("own"), start + F.length("head")).alias("train_start"),
        F.when(F.col("own"), start + F.col("size") - 1).alias("train_stop"),
    )


def op3_chat_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    return perspectives(table(spark, sf_dir, "conversations"))


OP3_SQL = r"""
WITH turns AS (SELECT conv_id, turn, regexp_replace(replace(coalesce(role, 'unknown'), '<|', '< |'), '[\x20\x09-\x0D]', '_', 'g') AS role, replace(coalesce(text, ''), '<|', '< |') AS text FROM conversations),
people AS (SELECT DISTINCT conv_id, role AS perspective FROM turns WHERE role <> 'system'),
parts AS (
  SELECT t.conv_id, p.perspective, t.turn, t.role, t.text,
    CASE WHEN t.role = p.perspective THEN '<|im_start|>assistant' || chr(10) WHEN t.role = 'system' THEN '<|im_start|>system' || chr(10)
         ELSE '<|im_start|>user name=' || t.role || chr(10) END AS head
  FROM turns t JOIN people p ON t.conv_id IS NOT DISTINCT FROM p.conv_id),
sized AS (SELECT *, head || text || '<|im_end|>' || chr(10) AS rendered, length(head || text || '<|im_end|>' || chr(10)) AS size FROM parts),
placed AS (
  SELECT *, coalesce(sum(size) OVER (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, role, text ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM sized)
SELECT conv_id, perspective, turn, role, rendered, CAST(start AS BIGINT) AS "start", CAST(start + size AS BIGINT) AS stop,
  CAST(CASE WHEN role = perspective THEN start + length(head) END AS BIGINT) AS train_start,
  CAST(CASE WHEN role = perspective THEN start + size - 1 END AS BIGINT) AS train_stop
FROM placed
"""
