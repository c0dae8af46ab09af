"""Preference formatting: common prompt and two masked completions, turn by turn.

Chosen and rejected conversations of a pair are compared turn by turn. Their longest common
prefix is rendered once as the prompt; the turns after it are rendered once for either side
as its completion. A row is one rendered turn, so no conversation is gathered in one place
and one of any length is dealt over many tasks. ``mask_start`` and ``mask_end`` bound the
characters of the row that count in training: the text of assistant turns of a completion
and the mark that ends it; both are 0 elsewhere.

The turns of both sides are brought together by one grouping and written once; the forks
are taken from the written turns, and each turn gives up to two rows.

Defined results: a pair needs rows on both sides; rows with a NULL pair or turn are left
out. NULL roles and texts count as empty. Of several rows of one turn, the smallest by role
and text counts, so repeated rows count once. Equal conversations give a prompt only; if
one is a prefix of the other, its completion is empty. Empty tables give an empty result.
Ids may have any type that can be ordered. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ledgerlens.operators.ranking import running_sums
from ledgerlens.session import Scratch, materialize

# Fixed values of the rendering.
HEAD = "<|{role}|>\n"
END = "<|end|>\n"
TRAINED_ROLE = "assistant"


SAID = "struct<role:string,text:string>"


def _said() -> Column:
    return F.struct(F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))


def _side(turns: DataFrame, pair_col: str, chosen: bool) -> DataFrame:
    none = F.lit(None).cast(SAID)
    kept = turns.where(F.col(pair_col).isNotNull() & F.col("turn").isNotNull())
    return kept.select(F.col(pair_col).alias("pair_id"), F.col("turn").cast("long").alias("turn"),
                       (_said() if chosen else none).alias("chosen"), (none if chosen else _said()).alias("rejected"))


def _by_turn(sides: DataFrame) -> DataFrame:
    """One written row for each turn of a pair: what either side says."""
    grouped = sides.groupBy("pair_id", "turn").agg(F.min("chosen").alias("chosen"), F.min("rejected").alias("rejected"))
    return materialize(grouped, "turns")


def _rendered(part: str, said: Column, completed: bool) -> Column:
    before, after = HEAD.split("{role}")
    head = F.concat(F.lit(before), said["role"], F.lit(after))
    text = F.concat(head, said["text"], F.lit(END))
    trained = (said["role"] == TRAINED_ROLE) if completed else F.lit(False)
    start = F.when(trained, F.length(head)).otherwise(0)
    end = F.when(trained, F.length(text)).otherwise(0)
    return F.struct(F.lit(part).alias("part"), said["role"].alias("role"), text.alias("text"),
                    start.cast("long").alias("mask_start"), end.cast("long").alias("mask_end"))


def _formatted(turns: DataFrame) -> DataFrame:
    differs = ~F.col("chosen").eqNullSafe(F.col("rejected"))
    forks = turns.groupBy("pair_id").agg(
        F.min(F.when(differs, F.col("turn"))).alias("fork"),
        F.count("chosen").alias("n_chosen"), F.count("rejected").alias("n_rejected"),
    ).where("n_chosen > 0 and n_rejected > 0").select("pair_id", "fork")
    common = F.col("fork").isNull() | (F.col("turn") < F.col("fork"))
    sides = [F.when(F.col(side).isNotNull(), _rendered(side, F.col(side), True)) for side in ("chosen", "rejected")]
    parts = F.when(common, F.array(_rendered("prompt", F.col("chosen"), False))).otherwise(
        F.array_compact(F.array(*sides)))
    rows = turns.join(forks, "pair_id").select("pair_id", "turn", F.explode(parts).alias("row"))
    return rows.select("pair_id", "row.part", "turn", "row.role", "row.text", "row.mask_start", "row.mask_end")


def preference_turns(chosen: DataFrame, rejected: DataFrame, pair_col: str = "pair_id") -> DataFrame:
    """``pair_id``, ``part`` (prompt, chosen or rejected), ``turn``, ``role``, ``text``, ``mask_start``, ``mask_end``.

    Both inputs have ``pair_col``, ``turn``, ``role`` and ``text``.
    """
    return _formatted(_by_turn(_side(chosen, pair_col, True).union(_side(rejected, pair_col, False))))


def _served(scratch: Scratch, conversations: DataFrame) -> DataFrame:
    """``conv_id``, ``fork``, ``serves`` (conversations that go on as this one does, at most two, with their forks).

    The fork is the assistant turn of the smallest hash of id and turn. Every conversation
    goes on like the one of the next id that has an assistant turn; the last one like that before it.
    """
    key = F.md5(F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")))
    picked = conversations.where(
        (F.col("role") == TRAINED_ROLE) & F.col("conv_id").isNotNull() & F.col("turn").isNotNull()
    ).groupBy("conv_id").agg(F.min(F.struct(key.alias("key"), F.col("turn").cast("long").alias("turn"))).alias("first"))
    heads = picked.select("conv_id", F.col("first.turn").alias("fork"), F.lit(1).cast("long").alias("one"))
    numbered = scratch.keep(running_sums(scratch, heads, [], ["conv_id"], ["one"]), "numbered")
    forks = [numbered.select((F.col("before_one") + by).alias("before_one"),
                             F.struct(F.col("conv_id").alias("id"), "fork").alias(name))
             for by, name in ((1, "previous"), (-1, "next"))]
    last = F.when(F.col("before_one") == F.col("all_one") - 2, F.col("next"))
    return numbered.join(forks[0], "before_one", "left").join(forks[1], "before_one", "left").select(
        "conv_id", "fork", F.array_compact(F.array("previous", last)).alias("serves"))


def continued_pairs(conversations: DataFrame) -> DataFrame:
    """The result of ``preference_turns`` for pairs made of plain conversations (``conv_id`` is the pair).

    The chosen side is the whole conversation. The rejected side has its turns before one of its
    assistant turns and goes on with the turns of another conversation from an assistant turn of
    that one, so completions have several turns and different lengths. A conversation
    without an assistant turn is its own rejected side and gives a prompt only. If no
    other conversation has an assistant turn, the rejected side ends before its fork; a pair
    that has no rejected turn then is left out.
    """
    rows = conversations.where("conv_id is not null and turn is not null").select(
        "conv_id", F.col("turn").cast("long").alias("turn"), _said().alias("said"))
    own, turn = F.col("fork"), F.col("turn")
    none = F.lit(None).cast(SAID)
    shared = own.isNull() | (turn < own)
    itself = F.struct(F.col("conv_id").alias("pair_id"), turn.alias("turn"), F.col("said").alias("chosen"),
                      F.when(shared, F.col("said")).otherwise(none).alias("rejected"))
    others = F.transform("serves", lambda to: F.struct(
        to["id"].alias("pair_id"), (turn - own + to["fork"]).alias("turn"), none.alias("chosen"),
        F.col("said").alias("rejected")))
    sides = F.when(shared, F.array(itself)).otherwise(F.concat(F.array(itself), others))
    with Scratch(conversations.sparkSession) as scratch:
        joined = rows.join(_served(scratch, conversations), "conv_id", "left")
        turns = _by_turn(joined.select(F.explode(sides).alias("side")).select("side.*"))
    return _formatted(turns)
