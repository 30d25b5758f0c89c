"""Chat formatting with cumulative-snapshot collapse.

A service that logs the whole conversation at every turn leaves, for each conversation, all its prefixes. Each turn
gets a rolling hash of its conversation up to and including that turn (128 bits: the running sums of four 32-bit
lanes of hashes of position, role and text). A conversation whose last hash is an inner prefix hash of another is a
snapshot of it: anti-joins leave the maximal ones, of equal ones that with the least id. Only these are rendered.

A conversation may be of any length and may repeat a turn any number of times: equal turns are counted before they
move, turns are dealt by ranges of (conversation, turn, role, text), so that a long conversation lies in many slices,
and only one row for each slice, and then for each part of ``PART`` positions, is added up by conversation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import scratch, settled, written

#: Turns that are rendered together.
PART = 1024
LANES = ("a", "b", "c", "d")


def placed_turns(turns: DataFrame) -> DataFrame:
    """(conv, turn, role, text, x, y, start, copies, turns) of every distinct turn; ``turns`` has no nulls but in turn.

    start is the place, from 1, of the first of its copies in the conversation, ordered by turn, role and text; x and y
    are hashes of role and text; turns is the number of turns of the conversation.
    """
    order = [F.col("turn").asc_nulls_first(), F.col("role").asc(), F.col("text").asc()]
    distinct = turns.groupBy("conv", "turn", "role", "text").agg(F.count("*").alias("copies"))
    dealt = distinct.repartitionByRange(F.col("conv").asc(), *order).withColumn("slice", F.spark_partition_id())
    # written: the slices, which follow from a sample, have to be the same in all that comes
    dealt = written(dealt.withColumn("x", F.xxhash64("role", "text")).withColumn("y", F.xxhash64(F.lit(7), "role", "text")), "dealt-turns")
    counts = dealt.groupBy("conv", "slice").agg(F.sum("copies").alias("n"))
    all_slices = Window.partitionBy("conv")
    earlier = all_slices.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select(F.col("conv").alias("b_conv"), F.col("slice").alias("b_slice"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"), F.sum("n").over(all_slices).alias("turns"))
    inside = Window.partitionBy("conv", "slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        dealt.withColumn("before", F.coalesce(F.sum("copies").over(inside), F.lit(0)))
        .join(bases, (F.col("conv") == F.col("b_conv")) & (F.col("slice") == F.col("b_slice")))
        .select("conv", "turn", "role", "text", "x", "y", (F.col("base") + F.col("before") + 1).alias("start"), "copies", "turns")
    )


def every_place(placed: DataFrame, *kept: str) -> DataFrame:
    """The columns ``kept`` of every turn, with its place pos; copies of a row are told in steps of ``PART``."""
    steps = placed.select(*kept, "start", "copies", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1, F.lit(PART).cast("long"))).alias("step"))
    last = F.col("start") + F.least(F.col("step") + PART, F.col("copies")) - 1
    return steps.select(*kept, F.explode(F.sequence(F.col("start") + F.col("step"), last)).alias("pos"))


def part_of(part_turns: int) -> F.Column:
    return F.floor((F.col("pos") - 1) / part_turns).cast("long").alias("part")


def turn_prefixes(placed: DataFrame, part_turns: int = PART, also: tuple[str, ...] = ()) -> DataFrame:
    """(conv, pos, turns, a, b, c, d) of every turn: its place from 1 and the hash of the conversation up to it.

    The columns ``also`` come along; if there are any, so do p_a to p_d, the hash of the conversation before the turn.
    """
    every = every_place(placed, "conv", "x", "y", "turns", *also)
    h1, h2 = F.xxhash64("pos", "x"), F.xxhash64("pos", "y")
    low = F.lit(0xFFFFFFFF)
    laned = every.select("conv", part_of(part_turns), "pos", "turns", *also, F.shiftrightunsigned(h1, 32).alias("a"), h1.bitwiseAND(low).alias("b"), F.shiftrightunsigned(h2, 32).alias("c"), h2.bitwiseAND(low).alias("d"))
    running = Window.partitionBy("conv", "part").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = laned.groupBy("conv", "part").agg(*(F.sum(x).alias(x) for x in LANES))
    offsets = sums.select(F.col("conv").alias("o_conv"), F.col("part").alias("o_part"), *(F.coalesce(F.sum(x).over(earlier), F.lit(0)).alias(f"o_{x}") for x in LANES))
    own = [F.col(x).alias(f"p_{x}") for x in LANES if also]
    summed = laned.select("conv", "part", "pos", "turns", *also, *own, *(F.sum(x).over(running).alias(x) for x in LANES))
    before = [(F.col(x) + F.col(f"o_{x}") - F.col(f"p_{x}")).alias(f"p_{x}") for x in LANES if also]
    return summed.join(offsets, (F.col("conv") == F.col("o_conv")) & (F.col("part") == F.col("o_part"))).select(
        "conv", "pos", "turns", *also, *before, *((F.col(x) + F.col(f"o_{x}")).alias(x) for x in LANES)
    )


def maximal_conversations(placed: DataFrame, part_turns: int = PART) -> DataFrame:
    """(conv, turns) of the conversations that are no prefix of another, one of each set of equal ones."""
    prefixes = written(turn_prefixes(placed, part_turns), "turn-prefixes")
    key = [*LANES, "pos"]
    ends = prefixes.where("pos = turns").groupBy(*key).agg(F.min("conv").alias("conv"))
    inner = prefixes.where("pos < turns").select(*key).distinct()
    return ends.join(inner, key, "left_anti").select("conv", F.col("pos").alias("turns"))


def format_chats(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", part_turns: int = PART) -> DataFrame:
    """Rendered maximal conversations: conv_id, part, n_turns (of the whole), chat.

    Each turn becomes ``<|im_start|>role\\ntext<|im_end|>\\n``, in order of turn number (equal ones by role, then text).
    A conversation is a snapshot, and left out, if its (role, text) turns are a proper prefix of another's; equal
    conversations leave that of least id. Part k of a conversation holds its turns at places k * ``part_turns`` + 1 to
    (k + 1) * ``part_turns``: the usual conversation is one row, part 0, and the parts in order are the whole.

    Rows with a null conversation id are left out: they belong to no conversation. Null roles count and render as
    "user", null texts as empty, null turn numbers come first. Repeated rows count as turns each. Empty tables give no
    rows; other columns are left out, whatever their names.
    """
    given = turns.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), F.coalesce(role_col, F.lit("user")).alias("role"), F.coalesce(text_col, F.lit("")).alias("text")).where("conv is not null")
    with scratch(turns.sparkSession):
        placed = written(placed_turns(given), "placed-turns")
        kept = written(maximal_conversations(placed, part_turns), "maximal-conversations")
        shown = settled(placed.join(kept.select(F.col("conv").alias("k_conv")), F.col("conv") == F.col("k_conv"), "left_semi").select("conv", "role", "text", "start", "copies", "turns"), "shown-turns")
    rendered = F.concat(F.lit("<|im_start|>"), "role", F.lit("\n"), "text", F.lit("<|im_end|>\n"))
    return (
        every_place(shown.select("conv", "turns", rendered.alias("said"), "start", "copies"), "conv", "turns", "said")
        .groupBy("conv", part_of(part_turns), "turns")
        .agg(F.array_sort(F.collect_list(F.struct("pos", "said"))).alias("said"))
        .select(F.col("conv").alias(conv_col), "part", F.col("turns").alias("n_turns"), F.array_join(F.col("said.said"), "").alias("chat"))
    )
