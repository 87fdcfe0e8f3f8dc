"""Multi-party perspective rotation of dialogues.

For every participant the dialogue is rendered once with that speaker as the assistant and all others as named users;
only the assistant's own words are trained on. A rendering is a sequence of message rows with their character offsets:
the rows of a perspective, joined in order, are its text. So a dialogue that holds a third of all rows is spread over
many tasks, as places and offsets are running sums in two levels; `joined` makes one value of dialogues that fit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aeroscope.idioms import join_nulls, running
from aeroscope.llm.common import saved

#: Roles that are no participants: their messages keep their role in every rendering.
ASIDE = ("system", "tool")
#: Turns of one block of the running sums.
BLOCK = 4096
END = "<|im_end|>\n"


def head(role: Column, name: Column) -> Column:
    """Opening tag of a message; users are named."""
    return F.concat(F.lit("<|im_start|>"), role, F.when(name.isNull(), "").otherwise(F.concat(F.lit(" name="), name)), F.lit("\n"))


def rotate(
    df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", speaker_col: str = "role", text_col: str = "text", block: int = BLOCK
) -> DataFrame:
    """One row per participant and message: conv_id, perspective, place, turn, role, name, rendered, start, end, mask_start, mask_end.

    Messages come by turn (null last), then speaker, then text. start and end are the message's characters in the
    rendering of the dialogue, mask_start and mask_end those that are trained on: the assistant's text with the tag that
    ends it, null for other messages. A null speaker takes part as "unknown"; a null text is empty. Dialogues without
    participants give no rows, as does an empty table; rows with a null conversation id form one dialogue. Equal rows are
    messages of their own. Other columns of `df` are not read.
    """
    said = df.select(
        F.col(conv_col).alias("conv_id"), F.col(turn_col).cast("bigint").alias("turn"), F.coalesce(speaker_col, F.lit("unknown")).alias("speaker"),
        F.coalesce(text_col, F.lit("")).alias("text"),
    ).withColumn("part", F.coalesce(F.floor(F.col("turn") / block).cast("bigint"), F.lit(1 << 62)))
    inside = Window.partitionBy("conv_id", "part").orderBy(F.col("turn").asc_nulls_last(), "speaker", "text")
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    first = said.groupBy("conv_id", "part").agg(F.count("*").alias("n")).select(
        "conv_id", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first")
    )
    placed = join_nulls(said.withColumn("at", F.row_number().over(inside)), first, ["conv_id", "part"])
    placed = saved(placed.select("conv_id", "turn", "speaker", "text", (F.col("first") + F.col("at") - 1).alias("place")), "chat-messages")
    # offsets come from lengths alone; the texts join at the end, once per message and not per participant
    speakers = placed.where(~F.col("speaker").isin(*ASIDE)).select("conv_id", F.col("speaker").alias("perspective")).distinct()
    rows = join_nulls(placed.select("conv_id", "speaker", "place", F.length("text").cast("bigint").alias("chars")), speakers, ["conv_id"])
    mine, aside = F.col("speaker") == F.col("perspective"), F.col("speaker").isin(*ASIDE)
    rows = rows.withColumn("role", F.when(mine, "assistant").when(aside, F.col("speaker")).otherwise("user"))
    rows = rows.withColumn("name", F.when(~mine & ~aside, F.col("speaker"))).drop("speaker")
    opening = head(F.col("role"), F.col("name"))
    rows = running(rows, ["conv_id", "perspective"], "place", {"end": F.length(opening) + F.col("chars") + len(END)}, block)
    rows = join_nulls(rows, placed.select("conv_id", "place", "turn", "text"), ["conv_id", "place"])
    masked = F.when(F.col("role") == "assistant", F.col("end") - F.col("chars") - len(END))
    return rows.select(
        "conv_id", "perspective", "place", "turn", "role", "name", F.concat(opening, F.col("text"), F.lit(END)).alias("rendered"),
        (F.col("end") - F.length(opening) - F.col("chars") - len(END)).alias("start"), "end",
        masked.alias("mask_start"), F.when(F.col("role") == "assistant", F.col("end")).alias("mask_end"),
    )


def joined(messages: DataFrame) -> DataFrame:
    """conv_id, perspective, text and masks (start, end) of dialogues that fit into one value, from the rows of `rotate`."""
    one = F.sort_array(F.collect_list(F.struct("place", "rendered", "mask_start", "mask_end")))
    rows = messages.groupBy("conv_id", "perspective").agg(one.alias("m"))
    masks = F.transform(F.filter("m", lambda x: x["mask_start"].isNotNull()), lambda x: F.struct(x["mask_start"].alias("start"), x["mask_end"].alias("end")))
    return rows.select("conv_id", "perspective", F.array_join(F.col("m.rendered"), "").alias("text"), masks.alias("masks"))
