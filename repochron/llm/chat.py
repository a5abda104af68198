"""Multi-party perspective rotation of dialogues, by DataFrame functions only.

For every participant of a conversation the dialogue is rendered once more, with that
speaker's turns as ``assistant`` and the turns of all others as ``user`` turns that carry the
speaker's name.  System turns stay system turns and make no perspective.  The mask has the
character spans that the model is to learn: the texts of the assistant turns with their
end marks.  A long dialogue is rendered in parts that go on where the one before ends: joined in
order they are the whole text, and the spans count from the beginning of the dialogue, so no
part loses what was said before it and no task holds an endless dialogue.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
#: turn numbers of one part, and turns of one piece of it
BLOCK_TURNS = 1024


def neutral(text: Column) -> Column:
    """A text that can no longer hold a control mark: ``<|`` becomes ``<\\u200b|``."""
    return F.replace(text, F.lit("<|"), F.lit("<\u200b|"))


def _heads(speaker: Column) -> tuple[Column, Column]:
    """What stands before a turn for the speaker, and for all others."""
    name = F.regexp_replace(speaker, r"[\s<>|]", "_")
    system = speaker == F.lit("system")
    return F.lit(f"{OPEN}assistant\n"), F.when(system, F.lit(f"{OPEN}system\n")).otherwise(F.concat(F.lit(f"{OPEN}user name="), name, F.lit("\n")))


def _part_offsets(rows: DataFrame, speakers: DataFrame) -> DataFrame:
    """(conv_id, part, piece, assistant, begin): the length of all earlier parts, from sums of lengths only."""
    own, others = _heads(F.col("speaker"))
    place = ["conv_id", "part", "piece"]
    lengths = rows.groupBy(*place).agg(F.sum(F.length(others) + F.length("body") + len(CLOSE) + 1).alias("size"))
    shorter = rows.filter("speaker <> 'system'").groupBy(*place, "speaker").agg(F.sum(F.length(own) - F.length(others)).alias("less"))
    shorter = shorter.select(*[F.col(c).alias(f"s_{c}") for c in (*place, "speaker")], "less")
    grid = lengths.join(speakers, F.col("conv_id").eqNullSafe(F.col("s_conv"))).drop("s_conv")
    same = F.col("conv_id").eqNullSafe(F.col("s_conv_id")) & (F.col("part") == F.col("s_part")) & (F.col("piece") == F.col("s_piece")) & (F.col("assistant") == F.col("s_speaker"))
    before = Window.partitionBy("conv_id", "assistant").orderBy("part", "piece").rowsBetween(Window.unboundedPreceding, -1)
    size = F.col("size") + F.coalesce("less", F.lit(0))
    return grid.join(shorter, same, "left").select(*place, "assistant", F.coalesce(F.sum(size).over(before), F.lit(0)).cast("long").alias("begin"))


def rotate_dialogues(turns: DataFrame, *, conversation: str = "conv_id", position: str = "turn", speaker: str = "role", text: str = "text", block_turns: int = BLOCK_TURNS) -> DataFrame:
    """(conv_id, part, piece, assistant, begin, text, mask, n_turns, n_masked): one row for each participant and piece.

    Turns stand by (position, speaker, text), nulls first; repeated rows stay as repeated turns.
    A part has the turns of ``block_turns`` turn numbers; where more turns share them it has
    several pieces of that many turns.  Every participant has all of them, also those in which
    the participant says nothing; their texts joined by (part, piece) are the whole dialogue,
    ``begin`` is where a text stands in it, and the mask holds (start, end) in characters of it.
    A null text is an empty turn, a null speaker is the participant ``unknown``, a null position
    counts as 0, a null conversation is a conversation.  A conversation of system turns only, or
    an empty table, gives no rows.  Other columns are ignored.
    """
    rows = turns.select(
        F.col(conversation).alias("conv_id"),
        F.coalesce(F.col(position), F.lit(0)).cast("long").alias("turn"), F.coalesce(F.col(speaker), F.lit("unknown")).alias("speaker"),
        neutral(F.coalesce(F.col(text), F.lit(""))).alias("body"),
    ).withColumn("part", F.floor(F.col("turn") / F.lit(block_turns)).cast("long"))
    inside = Window.partitionBy("conv_id", "part").orderBy("turn", "speaker", "body")
    rows = rows.withColumn("n", F.row_number().over(inside)).withColumn("piece", F.floor((F.col("n") - 1) / F.lit(block_turns)).cast("long"))
    gathered = rows.groupBy("conv_id", "part", "piece").agg(F.sort_array(F.collect_list(F.struct("n", "speaker", "body"))).alias("turns"))
    speakers = rows.filter("speaker <> 'system'").select(F.col("conv_id").alias("s_conv"), F.col("speaker").alias("assistant")).distinct()
    offsets = _part_offsets(rows, speakers).select(F.col("conv_id").alias("o_conv"), F.col("part").alias("o_part"), F.col("piece").alias("o_piece"), "assistant", "begin")
    same = F.col("conv_id").eqNullSafe(F.col("o_conv")) & (F.col("part") == F.col("o_part")) & (F.col("piece") == F.col("o_piece"))
    per_person = gathered.join(offsets, same).drop("o_conv", "o_part", "o_piece")

    def piece(t: Column) -> Column:
        own = t["speaker"] == F.col("assistant")
        as_assistant, as_other = _heads(t["speaker"])
        return F.struct(F.when(own, as_assistant).otherwise(as_other).alias("head"), F.concat(t["body"], F.lit(CLOSE)).alias("tail"), own.alias("own"))

    zero = F.struct(F.col("begin").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("mask"))

    def step(acc: Column, p: Column) -> Column:
        begin = acc["at"] + F.length(p["head"])
        end = begin + F.length(p["tail"])
        return F.struct((end + 1).alias("at"), F.when(p["own"], F.concat(acc["mask"], F.array(F.struct(begin.alias("start"), end.alias("end"))))).otherwise(acc["mask"]).alias("mask"))

    pieces = per_person.withColumn("pieces", F.transform("turns", piece))
    rendered = F.concat(F.array_join(F.transform("pieces", lambda p: F.concat(p["head"], p["tail"])), "\n"), F.lit("\n"))
    return pieces.select(
        "conv_id", "part", "piece", "assistant", "begin", rendered.alias("text"), F.aggregate("pieces", zero, step, lambda acc: acc["mask"]).alias("mask"), F.size("turns").alias("n_turns"),
    ).withColumn("n_masked", F.aggregate("mask", F.lit(0).cast("long"), lambda n, m: n + m["end"] - m["start"]))
