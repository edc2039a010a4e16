"""Chat formatting with cumulative-snapshot collapse.

Chat logs often store the same conversation again after each turn. Rolling hashes of turn prefixes, one window step for
each turn, find conversations that are a prefix of a longer one; an anti-join keeps the maximal ones, which are then
rendered. DataFrame operations only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, tidy

START, END = "<|im_start|>", "<|im_end|>"


def _turns(df: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    filled = lambda c: F.coalesce(F.col(c), F.lit(""))
    return df.where(F.col(conv_col).isNotNull()).select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), filled(role_col).alias("role"), filled(text_col).alias("text"))


def prefixes(turns: DataFrame) -> DataFrame:
    """conv_id, k, n_turns, h1, h2: hashes of the first k turns of each conversation.

    A turn's hash takes in its place, role and text (each a value of its own, so no two sequences run together), and a
    prefix's is the exclusive or of its turns': one pass over each conversation, in constant space for each turn.
    """
    conversation = Window.partitionBy("conv_id")
    so_far = conversation.orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # Texts are hashed before the shuffle; they travel along for the order of turns that share a number and a role.
    placed = turns.select("conv_id", "turn", "role", "text", F.xxhash64(F.lit(1), "role", "text").alias("a"), F.xxhash64(F.lit(2), "role", "text").alias("b"))
    placed = placed.withColumn("k", F.row_number().over(conversation.orderBy("turn", "role", "text")))
    rolling = lambda seed, c: F.bit_xor(F.xxhash64(F.lit(seed), "k", c)).over(so_far)
    return placed.select("conv_id", "k", F.count("*").over(conversation).cast("int").alias("n_turns"), rolling(3, "a").alias("h1"), rolling(4, "b").alias("h2"))


def render(turns: Column) -> Column:
    """The conversation as chat markup, a block for each turn."""
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(START), t["role"], F.lit("\n"), t["text"], F.lit(END), F.lit("\n"))), "")


def _collapse(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Maximal conversations (conv_id, n_turns, n_copies), and every conversation with the one that stands for it (conv_id, kept_id)."""
    steps = materialize(prefixes(turns))
    key = ["h1", "h2", "k"]
    whole = steps.where("k = n_turns").select("conv_id", *key)
    # Equal conversations meet here, after a map-side minimum; only hashes and ids are shuffled.
    unique = materialize(whole.groupBy(*key).agg(F.min("conv_id").alias("kept_id"), F.count("*").alias("n_copies")))
    shorter = steps.where("k < n_turns").select(*key).distinct()
    maximal = materialize(unique.join(shorter, key, "left_anti"))
    # A snapshot is a prefix of at least one maximal conversation; that of the least id stands for it.
    extended = steps.where("k < n_turns").join(maximal.select(F.col("kept_id").alias("conv_id")), "conv_id", "left_semi")
    absorbed = unique.select(*key).join(extended.groupBy(*key).agg(F.min("conv_id").alias("kept_id")), key)
    standing = maximal.select(*key, "kept_id").unionByName(absorbed)
    return maximal.select(F.col("kept_id").alias("conv_id"), F.col("k").alias("n_turns"), "n_copies"), whole.join(standing, key).select("conv_id", "kept_id")


@tidy
def snapshot_links(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id and kept_id for every conversation: the rendered conversation that equals it or extends it (of the least id, if several do)."""
    return materialize(_collapse(_turns(conversations, conv_col, turn_col, role_col, text_col))[1])


@tidy
def format_chats(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Maximal conversations, rendered: conv_id, n_turns, n_copies, n_snapshots, rendered.

    A conversation whose turns (role and text, in order) are a proper prefix of another's is left out, at any length,
    and counted in the n_snapshots of the conversation that stands for it (see ``snapshot_links``); equal conversations
    are rendered once under their least conv_id, with their number in n_copies. Turns are ordered by turn number (nulls
    first), then role and text; repeated rows are turns of their own. A null role or text counts as empty. Rows without
    conv_id belong to no conversation and are left out. An empty table gives no rows. A conversation becomes one row.
    """
    turns = _turns(conversations, conv_col, turn_col, role_col, text_col)
    maximal, links = _collapse(turns)
    snapshots = links.groupBy("kept_id").agg(F.count("*").alias("n"))
    kept = maximal.join(snapshots, maximal["conv_id"] == snapshots["kept_id"]).select("conv_id", "n_turns", "n_copies", (F.col("n") - F.col("n_copies")).alias("n_snapshots"))
    kept = materialize(kept)
    # Only the turns of maximal conversations are gathered.
    texts = turns.join(kept.select("conv_id"), "conv_id", "left_semi").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    return kept.join(texts, "conv_id").select("conv_id", "n_turns", "n_copies", "n_snapshots", render(F.col("turns")).alias("rendered"))
