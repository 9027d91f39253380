"""Preference formatting of chosen and rejected conversations.

For each pair the longest common turn prefix is rendered once as the prompt; what
follows in either conversation becomes a completion with a loss mask that covers
the assistant turns only. One aggregation brings a pair's turns together, the
rest is array functions inside that row; an output row is never larger than the
two conversations it renders.

Defined cases: null role and null text are empty strings; turns are ordered by
(turn, role, text), a null turn first; repeated equal rows count once; a pair
with one side only has the other completion empty; a completion without trained
text makes ``valid`` false; rows without a pair id are left out; ``<|`` inside a
turn is written ``< |`` so that no turn can forge a marker; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The markers of the rendered chat template.
OPEN, MIDDLE, CLOSE = "<|im_start|>", "\n", "<|im_end|>\n"


def _safe(text: Column) -> Column:
    return F.replace(text, F.lit("<|"), F.lit("< |"))


def _head(turn: Column) -> Column:
    return F.concat(F.lit(OPEN), _safe(turn["role"]), F.lit(MIDDLE))


def _tail(turn: Column) -> Column:
    return F.concat(_safe(turn["text"]), F.lit(CLOSE))


def _render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(_head(t), _tail(t))), "")


def _mask(turns: Column, role: str) -> Column:
    """Code-point spans [start, end) of the trained turns' bodies, end markers included."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

    def step(acc: Column, t: Column) -> Column:
        body = acc["at"] + F.length(_head(t))
        end = body + F.length(_tail(t))
        span = F.array(F.struct(body.alias("start"), end.alias("end")))
        spans = F.when(t["role"] == role, F.concat(acc["spans"], span)).otherwise(acc["spans"])
        return F.struct(end.alias("at"), spans.alias("spans"))

    return F.aggregate(turns, start, step, lambda acc: acc["spans"])


def format_preferences(turns: DataFrame, train_role: str = "assistant") -> DataFrame:
    """``turns``: pair_id, rejected (boolean), turn, role, text. One row per pair."""
    item = F.struct(
        F.col("turn"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    side = lambda flag: F.array_sort(F.collect_set(F.when(F.col("rejected") == flag, item)))
    pairs = turns.filter(F.col("pair_id").isNotNull()).groupBy("pair_id").agg(side(False).alias("c"), side(True).alias("r"))
    same = F.zip_with("c", "r", lambda a, b: (a["role"] == b["role"]) & (a["text"] == b["text"]))
    first_gap = F.array_position(F.transform(same, lambda x: F.coalesce(x, F.lit(False))), False)
    n = F.when(first_gap > 0, first_gap - 1).otherwise(F.least(F.size("c"), F.size("r"))).cast("int")
    pairs = pairs.withColumn("n_common", n)
    rest = lambda c: F.slice(c, F.col("n_common") + 1, F.greatest(F.size(c), F.lit(1)))
    pairs = pairs.select(
        "pair_id", "n_common", F.slice("c", 1, F.col("n_common")).alias("p"), rest("c").alias("c"), rest("r").alias("r")
    )
    out = pairs.select(
        "pair_id",
        "n_common",
        _render(F.col("p")).alias("prompt"),
        _render(F.col("c")).alias("chosen"),
        _render(F.col("r")).alias("rejected"),
        _mask(F.col("c"), train_role).alias("chosen_mask"),
        _mask(F.col("r"), train_role).alias("rejected_mask"),
    )
    return out.withColumn("valid", (F.size("chosen_mask") > 0) & (F.size("rejected_mask") > 0))


def neighbouring_pairs(conversations: DataFrame) -> DataFrame:
    """Pair conversation 2k (chosen) with 2k + 1 (rejected)."""
    return conversations.select(
        F.floor(F.col("conv_id") / 2).alias("pair_id"), (F.col("conv_id") % 2 != 0).alias("rejected"), "turn", "role", "text"
    )
