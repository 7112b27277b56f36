"""Chat formatting of preference pairs: the longest common turn prefix once as prompt, then two masked completions.

A pair is two conversations, chosen and rejected. The prefix ends at the least turn that differs; turns are compared by
count, xor and sum of hashes per pair and turn, which add up within tasks first. The common turns are rendered once, as
prompt, what follows on either side as completion. The mask of a completion are the spans (from, to in code points) that
a loss applies to: content and end mark of the assistant's turns.

One record is emitted per pair, and a conversation of any length is no unbounded group: a record takes PART_TURNS turn
numbers, and longer conversations go on in records of part 1, 2 and so on. The texts of a segment, joined in the order of
part, are the whole segment; a mask counts from the start of its record. `rendered_turns` gives the turns as rows.

`replaced_replies` makes pairs of a table of plain conversations: the rejected side of a conversation has the text of its
last assistant turn replaced by the last reply of the conversation next to it (2k and 2k + 1 take each other's), so the two
share all turns before.

Defined results: a null text is empty, a null role is written as `unknown`, a null turn comes before all others, in part 0.
Repeated rows of a turn are all rendered, in the order of role and text, and a turn is common if both sides have the same
rows. A pair with one side only has no prompt; one with equal sides is all prompt; empty segments are empty strings. Turns
without a conversation id belong to no conversation, and conversations in no pair do not appear. In `replaced_replies` a
conversation without a reply, or whose neighbour has none, is a pair of one side. Extra columns are not read. An empty table
gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, prefix_sums

#: Turn numbers to a record.
PART_TURNS = 1024


@dataclass(frozen=True)
class Template:
    before_role: str = "<|im_start|>"
    after_role: str = "\n"
    end: str = "<|im_end|>"
    after: str = "\n"


def paired(conversations: DataFrame, pairs: DataFrame) -> DataFrame:
    """The turns of conversations (conv_id, turn, role, text) in pairs (pair_id, conv_id, is_chosen), a row for each side."""
    sides = pairs.select("pair_id", F.col("conv_id").alias("_conv"), "is_chosen")
    turns = conversations.select("conv_id", "turn", "role", "text")
    return turns.join(sides, F.col("conv_id") == F.col("_conv")).select("pair_id", "is_chosen", "turn", "role", "text")


def replaced_replies(conversations: DataFrame) -> DataFrame:
    """Turns of pairs (pair_id, is_chosen, turn, role, text); pair_id is the id of the conversation."""
    turns = conversations.select("conv_id", "turn", "role", "text").filter("conv_id IS NOT NULL")
    place = F.coalesce("turn", F.lit(-(2**63)).cast("long"))
    last = turns.filter("role = 'assistant'").groupBy("conv_id").agg(F.max(F.struct(place.alias("place"), F.coalesce("text", F.lit("")).alias("text"))).alias("last"))
    other = last.select(F.col("conv_id").bitwiseXOR(F.lit(1).cast("long")).alias("conv_id"), F.col("last.text").alias("reply"))
    swaps = last.join(other, "conv_id").select(F.col("conv_id").alias("_conv"), F.col("last.place").alias("_place"), "reply")
    sided = turns.join(swaps, F.col("conv_id") == F.col("_conv"), "left")
    swapped = F.when((F.col("role") == "assistant") & (place == F.col("_place")), F.col("reply")).otherwise(F.col("text"))
    sides = F.when(F.col("_conv").isNull(), F.array(F.lit(True))).otherwise(F.array(F.lit(True), F.lit(False)))
    return sided.select("*", F.explode(sides).alias("is_chosen")).select(F.col("conv_id").alias("pair_id"), "is_chosen", "turn", "role", F.when(F.col("is_chosen"), F.col("text")).otherwise(swapped).alias("text"))


def rendered_turns(turns: DataFrame, template: Template = Template()) -> DataFrame:  # noqa: B008
    """turns (pair_id, is_chosen, turn, role, text) as (pair_id, segment, turn, role, rendered, mask_from, mask_to).

    Segment `prompt` has the common prefix once, `chosen` and `rejected` what follows. mask_from and mask_to delimit what a
    loss applies to within the rendered turn, both 0 for nothing."""
    turns = turns.select("pair_id", "is_chosen", "turn", F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    place = F.coalesce(F.col("turn").cast("long"), F.lit(-(2**63)).cast("long"))

    def summary(chosen: bool) -> Column:
        mine = F.col("is_chosen") == chosen
        h = F.xxhash64("role", F.lit("\x00"), "text")
        return F.struct(F.count_if(mine).alias("n"), F.bit_xor(F.when(mine, h)).alias("x"), F.sum(F.when(mine, F.hash("role", F.lit("\x00"), "text").cast("long"))).alias("s"))

    compared = turns.groupBy("pair_id", place.alias("place")).agg(summary(True).alias("c"), summary(False).alias("r"))
    cut = compared.groupBy(F.col("pair_id").alias("_pair")).agg(F.min(F.when(~F.col("c").eqNullSafe(F.col("r")), F.col("place"))).alias("cut"))
    turns = turns.join(cut, F.col("pair_id").eqNullSafe(F.col("_pair")))
    common = F.col("cut").isNull() | (place < F.col("cut"))
    head = F.concat(F.lit(template.before_role), F.col("role"), F.lit(template.after_role))
    rendered = F.concat(head, F.col("text"), F.lit(template.end + template.after))
    trained = (F.col("segment") != "prompt") & (F.col("role") == "assistant")
    out = turns.filter(~common | F.col("is_chosen")).withColumn("segment", F.when(common, "prompt").when(F.col("is_chosen"), "chosen").otherwise("rejected"))
    return out.select(
        "pair_id",
        "segment",
        "turn",
        "role",
        rendered.alias("rendered"),
        F.when(trained, F.length(head)).otherwise(0).alias("mask_from"),
        F.when(trained, F.length(rendered) - len(template.after)).otherwise(0).alias("mask_to"),
    )


def format_pairs(turns: DataFrame, template: Template = Template()) -> DataFrame:  # noqa: B008
    """turns (pair_id, is_chosen, turn, role, text) as records (pair_id, part, prompt, chosen, rejected, chosen_mask,
    rejected_mask). A mask is its spans `from:to`, joined by commas."""
    rows = rendered_turns(turns, template)
    part = F.coalesce(F.greatest(F.floor(F.col("turn") / PART_TURNS), F.lit(0)), F.lit(0)).cast("long").alias("part")
    piece = lambda s: F.when(F.col("segment") == s, F.struct(F.col("turn").alias("turn"), F.col("role").alias("role"), F.col("rendered").alias("rendered"), F.col("mask_from").alias("a"), F.col("mask_to").alias("b")))
    names = ("prompt", "chosen", "rejected")
    grouped = rows.groupBy("pair_id", part).agg(*(F.array_sort(F.collect_list(piece(s))).alias(f"_{s}") for s in names))

    def mask(pieces: Column) -> Column:
        starts = prefix_sums(F.transform(pieces, lambda x: F.length(x.rendered)))
        spans = let(starts, lambda at: F.transform(pieces, lambda x, k: F.when(x.b > 0, F.concat_ws(":", F.element_at(at, k + 1) + x.a, F.element_at(at, k + 1) + x.b))))
        return F.array_join(spans, ",")  # without those that are null

    text = lambda s: F.array_join(F.transform(f"_{s}", lambda x: x.rendered), "").alias(s)
    return grouped.select("pair_id", "part", *map(text, names), mask(F.col("_chosen")).alias("chosen_mask"), mask(F.col("_rejected")).alias("rejected_mask"))
