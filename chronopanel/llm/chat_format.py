"""Chat formatting after collapsing cumulative snapshots; DataFrame functions only.

A logged conversation is a snapshot of a longer one if its turns are the first
turns of that one.  Each turn gets two 64-bit hashes of its place, role and
text; their running XOR over a conversation is the hash of the prefix that ends
there.  A conversation whose whole hash is a proper prefix of another falls to
an anti-join, and of equal conversations the smallest id stays.  Only hashes
are shuffled for that, one row for each distinct prefix, however many
conversations open with it.  What is left is rendered.

Defined cases: turns are ordered by turn, then role and text, so ties have one
order; a repeated row is a turn of its own.  Null roles and texts differ from
empty ones in comparisons and are rendered as empty.  Turns with a null
conversation id make up one conversation.  Only the four named columns are
read, so other columns can't clash.  A conversation is held by one task while
it is rendered, so its size must fit there; the number of its copies does not
matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"


def _turn_hash(seed: int) -> Column:
    return F.xxhash64(F.lit(seed), F.col("i"), F.col("role").isNull(), F.col("role"), F.col("text").isNull(), F.col("text"))


def prefixes(turns: DataFrame) -> DataFrame:
    """(conv, i, n, h1, h2): the hashes of the first i of n turns of each conversation."""
    own = Window.partitionBy("conv")
    order = own.orderBy("turn", "role", "text")
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = turns.withColumn("i", F.row_number().over(order)).withColumn("n", F.count(F.lit(1)).over(own))
    placed = placed.withColumns({"t1": _turn_hash(11), "t2": _turn_hash(97)})
    return placed.select("conv", "i", "n", F.bit_xor("t1").over(so_far).alias("h1"), F.bit_xor("t2").over(so_far).alias("h2"))


def maximal(turns: DataFrame) -> DataFrame:
    """(conv, n_copies): conversations that are no snapshot of another; equal ones counted."""
    marks = prefixes(turns)
    whole = marks.where("i = n").groupBy("n", "h1", "h2").agg(F.min("conv").alias("conv"), F.count(F.lit(1)).alias("n_copies"))
    longer = marks.where("i < n").select(F.col("i").cast("long").alias("n"), "h1", "h2").distinct()
    return whole.join(longer, ["n", "h1", "h2"], "left_anti").select("conv", "n_copies")


def format_chats(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Per maximal conversation: id, n_turns, n_copies, rendered."""
    turns = conversations.select(F.col(id_col).alias("conv"), F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text"))
    kept = maximal(turns).withColumnRenamed("conv", "own")
    said = F.concat(F.lit(OPEN), F.coalesce("role", F.lit("")), F.lit("\n"), F.coalesce("text", F.lit("")), F.lit(CLOSE))
    rows = turns.join(kept, F.col("conv").eqNullSafe(F.col("own"))).select("conv", "n_copies", F.struct("turn", "role", "text", said.alias("said")).alias("x"))
    out = rows.groupBy("conv").agg(F.count(F.lit(1)).alias("n_turns"), F.first("n_copies").alias("n_copies"), F.sort_array(F.collect_list("x")).alias("xs"))
    return out.select(F.col("conv").alias(id_col), "n_turns", "n_copies", F.array_join("xs.said", "").alias("rendered"))
