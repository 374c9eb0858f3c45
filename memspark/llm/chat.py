"""Multi-party dialogues seen by each participant in turn.

For every participant of a conversation the turns are laid out once more: that
speaker's as the assistant, which training scores (mask 1), all others as users
with their names. A rendering is a sequence of segments with their places in
the whole; segments joined by place are the rendered dialogue. Places are summed
in two steps, over blocks of turns and within them: blocks are stretches of all
turns in their order, so a conversation that holds a third of all rows is
shared out, even if none of its turns has a number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memspark.llm.shared import written

#: Turns of a block.
BLOCK = 512
NOBODY = "unknown"
ASSISTANT, USER = "assistant", "user"
OPEN, NAME, BODY, CLOSE = "<|", " name=", "|>\n", "<|end|>\n"
COLUMNS = "conv_id, perspective, turn, copy, role, name, mask, segment, seg_start, text_start, text_end, seg_end"


def _before(value: Column, window) -> Column:
    return F.coalesce(F.sum(value).over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def perspectives(turns: DataFrame) -> DataFrame:
    """COLUMNS, one row for each participant and turn of a conversation.

    turns has conv_id, turn, role (the speaker) and text. A null or empty
    speaker is called unknown; a null text is empty; null conversations and
    turns are values of their own, null turns first. Equal rows are numbered by
    copy and laid side by side; ties between turns go by speaker, then text.
    Places are code points, ends exclusive: seg_start to seg_end is the segment,
    text_start to text_end the text in it, masked whole. Other columns are not
    read; an empty table gives no rows. Rows out are turns times participants.
    """
    speaker = F.coalesce(F.nullif(F.col("role").cast("string"), F.lit("")), F.lit(NOBODY))
    rows = turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), speaker.alias("speaker"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("body"))
    # equal rows become one with a number of copies before anything is ordered
    rows = rows.groupBy("conv_id", "turn", "speaker", "body").agg(F.count("*").alias("copies"))
    # ranges come from a sample, so the blocks are settled once, in a table
    order = ("conv_id", "turn", "speaker", "body")
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("block", F.expr(f"monotonically_increasing_id() div {BLOCK}"))
    rows = written(rows, "turn-blocks")
    who = rows.select("conv_id", F.col("speaker").alias("perspective")).distinct()

    size = lambda head: F.length("body") + head + len(OPEN) + len(BODY) + len(CLOSE)
    as_user = size(F.lit(len(USER) + len(NAME)) + F.length("speaker"))
    as_self = size(F.lit(len(ASSISTANT)))
    # each speaker's own turns are shorter or longer in their perspective: a place is the sum as users plus the difference in own turns
    own = as_self - as_user
    block = Window.partitionBy("conv_id", "block").orderBy(F.asc_nulls_first("turn"), "speaker", "body")
    placed = rows.withColumn("in_block", _before(F.col("copies") * as_user, block))

    totals = rows.groupBy("conv_id", "block", "speaker").agg(F.sum(F.col("copies") * as_user).alias("users"), F.sum(F.col("copies") * own).alias("own"))
    per_block = totals.groupBy("conv_id", "block").agg(F.sum("users").alias("users"))
    order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("block"))
    starts = per_block.select(F.col("conv_id").alias("b_conv"), F.col("block").alias("b_block"), _before(F.col("users"), order).alias("block_start"))

    # own differences: before the block, for every block and participant that speaks in it or later; within the block, by the speaker's turns
    spoken = who.join(per_block.select(F.col("conv_id").alias("p_conv"), "block"), F.col("conv_id").eqNullSafe(F.col("p_conv"))).select("conv_id", "perspective", "block")
    known = totals.select(F.col("conv_id").alias("t_conv"), F.col("block").alias("t_block"), F.col("speaker").alias("t_speaker"), F.col("own"))
    same = F.col("conv_id").eqNullSafe(F.col("t_conv")) & F.col("block").eqNullSafe(F.col("t_block")) & (F.col("perspective") == F.col("t_speaker"))
    each = spoken.join(known, same, "left")
    mine = Window.partitionBy("conv_id", "perspective").orderBy(F.asc_nulls_first("block"))
    shifts = each.select(F.col("conv_id").alias("s_conv"), F.col("block").alias("s_block"), "perspective", _before(F.col("own"), mine).alias("own_before"))

    based = placed.join(starts, F.col("conv_id").eqNullSafe(F.col("b_conv")) & F.col("block").eqNullSafe(F.col("b_block"))).drop("b_conv", "b_block")
    crossed = based.join(shifts, F.col("conv_id").eqNullSafe(F.col("s_conv")) & F.col("block").eqNullSafe(F.col("s_block"))).drop("s_conv", "s_block")
    is_own = F.col("speaker") == F.col("perspective")
    within = Window.partitionBy("conv_id", "block", "perspective").orderBy(F.asc_nulls_first("turn"), "speaker", "body")
    crossed = crossed.withColumn("own_in_block", _before(F.when(is_own, F.col("copies") * own).otherwise(0), within))

    length = F.when(is_own, as_self).otherwise(as_user)
    head = F.when(is_own, F.lit(OPEN + ASSISTANT + BODY)).otherwise(F.concat(F.lit(OPEN + USER + NAME), "speaker", F.lit(BODY)))
    laid = crossed.select(
        "conv_id",
        "perspective",
        "turn",
        F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).alias("copy"),
        F.when(is_own, ASSISTANT).otherwise(USER).alias("role"),
        F.col("speaker").alias("name"),
        is_own.cast("int").alias("mask"),
        F.concat(head, "body", F.lit(CLOSE)).alias("segment"),
        (F.col("block_start") + F.col("in_block") + F.col("own_before") + F.col("own_in_block")).alias("base"),
        length.cast("long").alias("size"),
        F.length(head).alias("head"),
    )
    start = F.col("base") + F.col("copy") * F.col("size")
    return laid.select(*COLUMNS.split(", ")[:8], start.alias("seg_start"), (start + F.col("head")).alias("text_start"), (start + F.col("size") - len(CLOSE)).alias("text_end"), (start + F.col("size")).alias("seg_end"))


def op2_perspective_rotation(spark, sf_dir: str) -> DataFrame:
    return perspectives(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


SQL = f"""
WITH t AS (SELECT conv_id, turn, coalesce(nullif(role, ''), '{NOBODY}') AS speaker, coalesce(text, '') AS body FROM conversations),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn, speaker, body) - 1 AS copy FROM t),
p AS (SELECT DISTINCT conv_id, speaker AS perspective FROM t),
x AS (SELECT n.*, perspective, CASE WHEN speaker = perspective THEN '{OPEN}{ASSISTANT}|>' || chr(10) ELSE '{OPEN}{USER}{NAME}' || speaker || '|>' || chr(10) END AS head FROM n JOIN p ON n.conv_id IS NOT DISTINCT FROM p.conv_id),
s AS (SELECT *, head || body || '<|end|>' || chr(10) AS segment FROM x),
e AS (SELECT *, sum(length(segment)) OVER (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, speaker, body, copy ROWS UNBOUNDED PRECEDING)::bigint AS seg_end FROM s)
SELECT conv_id, perspective, turn, copy, CASE WHEN speaker = perspective THEN '{ASSISTANT}' ELSE '{USER}' END AS role, speaker AS name, (speaker = perspective)::int AS mask, segment,
  seg_end - length(segment) AS seg_start, seg_end - length(segment) + length(head) AS text_start, seg_end - {len(CLOSE)} AS text_end, seg_end FROM e
"""
