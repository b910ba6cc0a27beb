"""Chat formatting by perspective rotation, in DataFrame functions only.

A dialogue is rendered once for every participant: that speaker's turns become the assistant's, all
others' those of users with their names, system turns stay what they are. The loss mask is the
speaker's text with its end mark.

A dialogue is cut into parts of PART_TURNS consecutive turn numbers; its rendering is the concatenation of
its parts, and mask spans count code points from the start of the whole rendering. A part is the
unit of grouping, so a dialogue of any length is spread over tasks; where a part starts follows
from counts and lengths per (part, speaker), which are summed before they are shuffled. The texts are
shuffled once; rotation happens after that.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from churnkit.llm.native import let, prefix_sums

PART_TURNS = 64
BEGIN, END = "<|im_start|>", "<|im_end|>\n"
SYSTEM, NOBODY = "system", "unknown"


def header(role: Column, speaker: Column) -> Column:
    """First line of a turn of `role`, seen by `speaker`."""
    name = F.when(role == SYSTEM, F.lit(SYSTEM)).when(role == speaker, F.lit("assistant")).otherwise(F.concat(F.lit("user name="), role))
    return F.concat(F.lit(BEGIN), name, F.lit("\n"))


def rotated(turns: DataFrame) -> DataFrame:
    """Renderings of dialogues (conv_id, turn, role, text) from every participant's side.

    Returns one row per conversation, speaker and part: conv_id, speaker, part (long), n_turns (long),
    start (long, of the part in the rendering), text, mask (array<struct<start, end>>, long).
    Participants are all roles but "system"; a conversation with none has no rows. Turns are ordered by
    turn number (null first), ties by role, then text; repeated rows are repeated turns. A null or
    empty role is named "unknown", a null text is empty, rows without conv_id are one conversation. Turn
    marks inside texts and names are broken by a space so that they can't pose as marks. Other
    columns aren't read.
    """
    clean = lambda c: F.replace(c, F.lit("<|im_"), F.lit("< |im_"))
    role = F.coalesce(F.nullif(F.col("role"), F.lit("")), F.lit(NOBODY))
    rows = turns.select(
        F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("key"), "conv_id", "turn", clean(role).alias("role"),
        clean(F.coalesce("text", F.lit(""))).alias("body"), F.floor(F.coalesce("turn", F.lit(0)) / PART_TURNS).cast("long").alias("part"))

    # lengths of parts: seen by a bystander, and what changes for each speaker
    nobody = F.lit(None).cast("string")
    other, mine = F.length(F.concat(F.lit(BEGIN + "user name="), F.col("role"), F.lit("\n"))), F.length(F.lit(BEGIN + "assistant\n"))
    seen = F.when(F.col("role") == SYSTEM, F.length(F.lit(f"{BEGIN}{SYSTEM}\n"))).otherwise(other)
    counts = rows.groupBy("key", "part", "role").agg(F.count("*").alias("n"), F.sum(F.length("body")).alias("chars"))
    sized = counts.select("key", "part", "role", (F.col("chars") + F.col("n") * (seen + len(END))).alias("size"), (F.col("n") * (mine - other)).alias("change"))
    parts = sized.groupBy("key", "part").agg(F.sum("size").alias("size"))
    speakers = sized.filter(F.col("role") != SYSTEM).groupBy("key", "role").agg(F.count("*").alias("_n")).select("key", F.col("role").alias("speaker"))
    changes = sized.filter(F.col("role") != SYSTEM).select("key", "part", F.col("role").alias("speaker"), "change")
    views = parts.join(speakers, "key").join(changes, ["key", "part", "speaker"], "left").select("key", "part", "speaker", (F.col("size") + F.coalesce("change", F.lit(0))).alias("size"))
    before = Window.partitionBy("key", "speaker").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    views = views.withColumn("start", F.coalesce(F.sum("size").over(before), F.lit(0)).cast("long"))
    views = views.groupBy("key", "part").agg(F.collect_list(F.struct("speaker", "start")).alias("views"))

    grouped = rows.groupBy("key", "part").agg(F.max("conv_id").alias("conv_id"), F.sort_array(F.collect_list(F.struct("turn", "role", "body"))).alias("turns"))
    each = grouped.join(views, ["key", "part"]).select("conv_id", "part", "turns", F.explode("views").alias("v")).select("conv_id", "part", "turns", "v.speaker", "v.start")

    speaker = F.col("speaker")
    heads = F.transform("turns", lambda t: header(t["role"], speaker))
    said = F.transform("turns", lambda t: F.concat(header(t["role"], speaker), t["body"], F.lit(END)))
    out = each.select("conv_id", "speaker", "part", "start", "turns", said.alias("said"), heads.alias("heads"))

    def masks(at: Column) -> Column:
        own = F.filter(F.sequence(F.lit(1), F.size("turns")), lambda i: F.element_at("turns", i)["role"] == speaker)
        return F.transform(own, lambda i: F.struct(
            (F.col("start") + F.element_at(at, i) + F.length(F.element_at("heads", i))).cast("long").alias("start"),
            (F.col("start") + F.element_at(at, i) + F.length(F.element_at("said", i)) - 1).cast("long").alias("end")))

    return out.select("conv_id", "speaker", "part", F.size("turns").cast("long").alias("n_turns"), "start", F.array_join("said", "").alias("text"),
                      let(prefix_sums(F.transform("said", lambda s: F.length(s))), masks).alias("mask"))
