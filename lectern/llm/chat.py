"""Preference formatting of chosen and rejected conversations.

Native: DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The turn marks of the template, and what a mark inside a text becomes.
OPEN, CLOSE, SAFE = "<|im_start|>", "<|im_end|>", "<| im_"


def conversations(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv, turns: one row a conversation, its turns an array of (turn, role, text) in order.

    Turns with equal numbers are ordered by role and text, and a turn that is
    repeated entirely counts once; null roles and texts become empty strings,
    null numbers come first.  Rows without a conversation are in none.
    """
    one = F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = turns.select(F.col(conv).alias("conv"), one.alias("t")).filter("conv IS NOT NULL")
    return rows.groupBy("conv").agg(F.array_sort(F.collect_set("t")).alias("turns"))


def _rendered(turn: Column) -> Column:
    clean = F.replace(turn["text"], F.lit("<|im_"), F.lit(SAFE))
    return F.concat(F.lit(OPEN), F.replace(turn["role"], F.lit("<|im_"), F.lit(SAFE)), F.lit("\n"), clean, F.lit(CLOSE + "\n"))


def _text(turns: Column) -> Column:
    return F.array_join(F.transform(turns, _rendered), "")


def _mask(turns: Column) -> Column:
    """`+n` for a turn of n characters that is trained on (the assistant's), `-n` for one that is masked."""
    sign = lambda t: F.when(F.lower(t["role"]) == "assistant", F.lit("+")).otherwise(F.lit("-"))
    return F.array_join(F.transform(turns, lambda t: F.concat(sign(t), F.length(_rendered(t)).cast("string"))), ",")


def _common(a: Column, b: Column) -> Column:
    """Number of turns, from the first, in which both arrays have the same role and text."""
    shorter = F.least(F.size(a), F.size(b))
    same = F.transform(F.slice(a, 1, shorter), lambda t, i: (t["role"] == F.get(b, i)["role"]) & (t["text"] == F.get(b, i)["text"]))
    differs = F.array_position(same, F.lit(False))
    return F.when(differs > 0, differs - 1).otherwise(shorter).cast("int")


def _filled(turns: Column) -> Column:
    """Turns as (role, text) without nulls; a missing side is an empty array, a missing turn has an empty role and text."""
    blank = F.lit("")
    filled = F.transform(turns, lambda t: F.struct(F.coalesce(t["role"], blank).alias("role"), F.coalesce(t["text"], blank).alias("text")))
    return F.coalesce(filled, F.array().cast("array<struct<role:string,text:string>>"))


def preference_pairs(pairs: DataFrame, pair: str = "pair_id", chosen: str = "chosen", rejected: str = "rejected") -> DataFrame:
    """pair_id, n_common, prompt, chosen, rejected, chosen_mask, rejected_mask, status.

    chosen and rejected are arrays of structs with role and text.  The turns
    both begin with are rendered once, as the prompt, which is never trained
    on; each side's further turns are its completion, with a mask of signed
    lengths.  A missing side is an empty array: the prompt is then empty and
    status is `unpaired`.  Two equal conversations have empty completions and
    status `same`; other pairs are `ok`.  Null roles, texts and turns count as
    empty ones: they are rendered, and equal only to empty ones.  Repeated
    pairs each come back, an empty table gives an empty result, and other
    columns play no part.  Marks of the template inside texts
    are broken, so no text can open or close a turn.
    """
    a, b = _filled(F.col("_c")), _filled(F.col("_r"))
    rows = pairs.select(F.col(pair).alias("pair_id"), F.col(chosen).alias("_c"), F.col(rejected).alias("_r"))
    rows = rows.select("pair_id", a.alias("_c"), b.alias("_r"), (F.col("_c").isNull() | F.col("_r").isNull()).alias("_one"))
    rows = rows.withColumn("n_common", _common(F.col("_c"), F.col("_r")))
    rest = lambda side: F.slice(F.col(side), F.col("n_common") + 1, F.greatest(F.size(side) - F.col("n_common"), F.lit(0)))
    rows = rows.withColumns({"_p": F.slice("_c", F.lit(1), F.col("n_common")), "_c": rest("_c"), "_r": rest("_r")})
    both_done = (F.size("_c") == 0) & (F.size("_r") == 0)
    status = F.when(F.col("_one"), "unpaired").when(both_done, "same").otherwise("ok")
    return rows.select(
        "pair_id", "n_common", _text(F.col("_p")).alias("prompt"), _text(F.col("_c")).alias("chosen"), _text(F.col("_r")).alias("rejected"),
        _mask(F.col("_c")).alias("chosen_mask"), _mask(F.col("_r")).alias("rejected_mask"), status.alias("status"),
    )


def paired_replies(turns: DataFrame) -> DataFrame:
    """One pair a conversation: chosen is the conversation, rejected has its sibling's last reply in place of its own.

    Siblings are the conversations 2k and 2k + 1; the reply is the last turn
    of the assistant.  Without a reply on both sides there is no rejected
    conversation (null).  One shuffle brings turns together and one joins
    siblings, two rows a key.
    """
    conv = conversations(turns)
    talks = F.transform("turns", lambda t, i: F.when(F.lower(t["role"]) == "assistant", i).otherwise(F.lit(-1)))
    conv = conv.withColumn("at", F.array_max(talks)).withColumn("reply", F.when(F.col("at") >= 0, F.get("turns", F.col("at"))["text"]))
    pair = conv.groupBy(F.floor(F.col("conv") / 2).alias("k")).agg(F.collect_list(F.struct("conv", "turns", "at", "reply")).alias("two"))
    each = pair.select("two", F.explode("two").alias("own")).select("own", F.get(F.filter("two", lambda o: o["conv"] != F.col("own.conv")), F.lit(0))["reply"].alias("other"))
    swapped = F.transform("own.turns", lambda t, i: F.when(i == F.col("own.at"), t.withField("text", F.col("other"))).otherwise(t))
    return each.select(
        F.col("own.conv").alias("pair_id"), F.col("own.turns").alias("chosen"),
        F.when(F.col("other").isNotNull() & (F.col("own.at") >= 0), swapped).alias("rejected"),
    )
