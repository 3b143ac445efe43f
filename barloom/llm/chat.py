"""Chat formatting: logged snapshots of a conversation are collapsed into the longest one, which is then rendered.

A log that writes a conversation after every turn holds each of its prefixes as a conversation of its own. The hash of
a prefix is a sum over its turns of hashes of (place, role, text), in four lanes of 32 bits; sums roll on from turn to
turn and can be added up in parts, so that one huge conversation is no single task: its turns are dealt into runs of
`RUN` turn numbers, each with a running sum, and the runs' totals have running sums of their own. (Turns that have the
same number, or none, have no order but that of role and text; they are one run, whose sort may spill to disk.)
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut_lineage, renamed

RUN = 1024
#: Turns in one row of the result.
PART = 512
_LANES = ["h1", "h2", "h3", "h4"]


def _running(values: dict[str, Column], keys: list[str], order: list[str]) -> dict[str, Column]:
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return {name: F.sum(v).over(w) for name, v in values.items()}


def _placed(turns: DataFrame) -> DataFrame:
    """Turns with their place in the conversation (from 1) and its last place, without a window over a whole conversation."""
    run = F.floor(F.coalesce(F.col("turn"), F.lit(-1)) / RUN).alias("run")
    turns = turns.select("conv", "turn", "role", "text", run)
    own = Window.partitionBy("conv", "run").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    sizes = turns.groupBy("conv", "run").agg(F.count("*").alias("n"))
    whole = F.sum("n").over(Window.partitionBy("conv"))
    before = sizes.select(F.col("conv").alias("c"), F.col("run").alias("r"), (F.sum("n").over(Window.partitionBy("conv").orderBy("run")) - F.col("n")).alias("before"), whole.alias("last"))
    ranked = turns.withColumn("k", F.row_number().over(own))
    return ranked.join(before, (F.col("conv") == F.col("c")) & (F.col("run") == F.col("r"))).select("conv", "run", "role", "text", (F.col("k") + F.col("before")).alias("place"), "last")


def collapse_conversations(df: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", part_turns: int = PART) -> DataFrame:
    """conv_id, part, n_turns (of the part) and text for every maximal conversation, `part_turns` turns to a part (from 0).

    A conversation goes if its turns (role and text, in order of turn) are the first turns of a longer one; of equal
    conversations the smallest conv_id stays. Turns with the same number are ordered by role and text, null turns come
    first; repeated rows are turns of their own. Null roles and texts equal null only and are rendered as empty. Rows
    with a null conv_id belong to no conversation and go. An empty table gives an empty table. Other columns are not read.
    """
    turns = renamed(df, conv=conv_id, turn=turn, role=role, text=text).where("conv is not null")
    placed = cut_lineage(_placed(turns))
    low, high = lambda h: F.col(h).bitwiseAND(F.lit(0xFFFFFFFF)), lambda h: F.shiftrightunsigned(h, 32)
    fields = ["place", F.coalesce("role", F.lit("")), F.col("role").isNull(), F.coalesce("text", F.lit("")), F.col("text").isNull()]
    hashed = placed.select("conv", "run", "place", "last", F.xxhash64(*fields).alias("a"), F.xxhash64(F.lit("turn"), *reversed(fields)).alias("b"))
    lanes = dict(zip(_LANES, (low("a"), high("a"), low("b"), high("b")), strict=True))
    hashed = hashed.select("conv", "run", "place", "last", *(v.alias(k) for k, v in lanes.items()))
    totals = hashed.groupBy("conv", "run").agg(*(F.sum(x).alias(x) for x in _LANES))
    rolled = totals.select(F.col("conv").alias("c"), F.col("run").alias("r"), *((v - F.col(k)).alias(f"{k}_before") for k, v in _running({x: F.col(x) for x in _LANES}, ["conv"], ["run"]).items()))
    inside = hashed.select("conv", "run", "place", "last", *(v.alias(k) for k, v in _running({x: F.col(x) for x in _LANES}, ["conv", "run"], ["place"]).items()))
    prefixes = inside.where("place < last").join(rolled, (F.col("conv") == F.col("c")) & (F.col("run") == F.col("r"))).select("place", *((F.col(x) + F.col(f"{x}_before")).alias(x) for x in _LANES))
    whole = hashed.groupBy("conv").agg(F.max("place").alias("place"), *(F.sum(x).alias(x) for x in _LANES))
    whole = cut_lineage(whole.groupBy("place", *_LANES).agg(F.min("conv").alias("conv")))
    maximal = whole.join(prefixes.distinct(), ["place", *_LANES], "left_anti").select("conv")
    kept = totals.select("conv", "run").join(maximal, "conv", "left_semi")  # a huge conversation is many runs here as well
    turn_text = F.concat(F.lit("<|"), F.coalesce("role", F.lit("")), F.lit("|>\n"), F.coalesce("text", F.lit("")), F.lit("\n"))
    parts = placed.join(kept, ["conv", "run"], "left_semi").select("conv", F.floor((F.col("place") - 1) / part_turns).alias("part"), F.struct("place", turn_text.alias("t")).alias("turn"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list("turn")), lambda t: t["t"]), "")
    return parts.groupBy(F.col("conv").alias("conv_id"), "part").agg(F.count("*").alias("n_turns"), joined.alias("text"))
