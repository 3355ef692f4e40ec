"""Chat formatting: logged conversations that are snapshots of longer ones collapse, the maximal ones
are rendered. Native operators only.

A log may hold a conversation after each of its turns. Each turn has a hash of its place, role and text;
running sums of these, modulo 2^62, give each prefix a 2 x 62-bit hash (two seeds). A conversation whose whole hash
is a proper prefix of another one, or that equals one with a smaller id, goes by anti-join; a prefix is
looked up once however many conversations share it.

Turns count by (turn, role, text); their places are numbered from 0 without gaps. Edge cases: a null
role or text counts as empty; rows that repeat a turn are turns of their own; turns without a conv_id
are dropped; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: How a turn is rendered; {role} and {text} are filled in.
TEMPLATE = "<|{role}|>\n{text}\n<|end|>\n"
#: Hashes have 62 bits. They are added up in halves of 31 bits, whose sums stay below 2^63 for 2^32 turns.
_HALF = 31
_MASK = (1 << _HALF) - 1


def prefix_hashes(conversations: DataFrame) -> DataFrame:
    """conv_id, place, role, text, h1, h2: each turn with the hash of the conversation up to it."""
    turns = conversations.where("conv_id is not null").select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    by = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    placed = turns.withColumn("place", F.row_number().over(by) - 1)
    for name, seed in (("h1", 11), ("h2", 47)):
        own = F.xxhash64(F.lit(seed), "place", "role", "text")
        running = by.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        low = F.sum(own.bitwiseAND(F.lit(_MASK))).over(running)
        high = F.sum(F.shiftrightunsigned(own, _HALF).bitwiseAND(F.lit(_MASK))).over(running) + F.shiftright(low, _HALF)
        placed = placed.withColumn(name, F.shiftleft(high.bitwiseAND(F.lit(_MASK)), _HALF).bitwiseOR(low.bitwiseAND(F.lit(_MASK))))
    return placed.select("conv_id", "place", "role", "text", "h1", "h2")


def maximal(turns: DataFrame) -> DataFrame:
    """conv_id, n_turns, copies: the conversations that no other one continues, the smallest id of equal
    ones, and how many logged conversations equal it."""
    last = turns.groupBy("conv_id").agg(F.max(F.struct("place", "h1", "h2")).alias("m")).select("conv_id", "m.*")
    whole = last.groupBy("place", "h1", "h2").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("copies"))
    ends = last.select("conv_id", F.col("place").alias("end"))
    # the prefixes that go on, each once
    inner = turns.join(ends, "conv_id").where("place < end").select("place", "h1", "h2").distinct()
    kept = whole.join(inner, ["place", "h1", "h2"], "left_anti")
    return kept.select("conv_id", (F.col("place") + 1).cast("long").alias("n_turns"), "copies")


def collapse_and_render(conversations: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """conv_id, n_turns, copies, rendered: the maximal conversations as text."""
    turns = written(prefix_hashes(conversations), "turns")
    kept = written(maximal(turns), "maximal")
    head, middle, tail = (lambda a: (a[0], *a[1].split("{text}")))(template.split("{role}"))
    row = F.struct("place", F.concat(F.lit(head), "role", F.lit(middle), "text", F.lit(tail)).alias("said"))
    texts = turns.join(kept.select("conv_id"), "conv_id", "left_semi").groupBy("conv_id").agg(F.sort_array(F.collect_list(row)).alias("rows"))
    rendered = texts.select("conv_id", F.array_join(F.transform("rows", lambda r: r["said"]), "").alias("rendered"))
    return kept.join(rendered, "conv_id").select("conv_id", "n_turns", "copies", "rendered")
