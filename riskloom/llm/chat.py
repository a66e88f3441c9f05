"""Preference formatting: shared prompt once, two masked completions.

Turns of a conversation are collected into one array by its id, since a rendered
conversation is one value anyway; everything else is array functions within the
row, so the one shuffle is that of the turns. All of it is DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh


def conversations(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, turns): array<struct<role, text>> in order of turn, then role, then text; nulls first, null texts empty."""
    one = F.struct(F.col(f"`{turn_col}`").alias("turn"), F.coalesce(F.col(f"`{role_col}`"), F.lit("")).alias("role"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    gathered = turns.groupBy(F.col(f"`{id_col}`").alias("conv_id")).agg(F.sort_array(F.collect_list(one)).alias("turns"))
    return gathered.select("conv_id", F.transform("turns", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))).alias("turns"))


def stale_reply(turns: Column, role: str = "assistant") -> Column:
    """The conversation with its last reply replaced by the reply before it, empty if there is none; unchanged without a reply."""
    replies = F.filter(turns, lambda x: x["role"] == role)
    place = F.aggregate(turns, F.struct(F.lit(0).alias("at"), F.lit(-1).alias("last")), lambda s, x: F.struct((s["at"] + 1).alias("at"), F.when(x["role"] == role, s["at"]).otherwise(s["last"]).alias("last")), lambda s: s["last"])
    stale = F.coalesce(F.try_element_at(replies, F.greatest(F.size(replies) - 1, F.lit(1)))["text"], F.lit(""))
    stale = F.when(F.size(replies) > 1, stale).otherwise("")
    return F.transform(turns, lambda x, i: F.struct(x["role"].alias("role"), F.when(i == place, stale).otherwise(x["text"]).alias("text")))


def common_prefix(a: Column, b: Column) -> Column:
    """Number of leading turns that are the same in role and text."""
    n = F.least(F.size(a), F.size(b))
    same = F.transform(F.sequence(F.lit(1), n), lambda i: F.element_at(a, i) == F.element_at(b, i))
    differ = F.array_position(same, False)
    return F.when(n == 0, 0).otherwise(F.when(differ == 0, n).otherwise(differ - 1)).cast("int")


def head(turn: Column) -> Column:
    return F.concat(F.lit("<|im_start|>"), turn["role"], F.lit("\n"))


def tail(turn: Column) -> Column:
    return F.concat(turn["text"], F.lit("<|im_end|>\n"))


def segments(turns: Column, role: str) -> Column:
    """array<struct<text, train>>: only what the role says, with its end mark, is trained on."""
    pair = lambda x: F.array(F.struct(head(x).alias("text"), F.lit(False).alias("train")), F.struct(tail(x).alias("text"), (x["role"] == role).alias("train")))
    return F.flatten(F.transform(turns, pair))


def format_preferences(pairs: DataFrame, chosen_col: str = "chosen", rejected_col: str = "rejected", role: str = "assistant") -> DataFrame:
    """pairs with chosen and rejected, arrays of struct<role, text>, replaced by prompt_turns, prompt, chosen and rejected.

    prompt renders the longest common turn prefix once; chosen and rejected are
    the rest of either conversation as segments with a train flag each. The
    prefix may be empty (prompt ''), or all of a conversation (no segment). Null
    conversations are empty. Other columns stay, but for clashing names, which
    these columns replace; repeated rows stay; an empty table returns none.
    """
    empty = F.array().cast("array<struct<role:string,text:string>>")
    one, other = fresh(pairs, "pair_chosen", "pair_rejected")
    named = pairs.withColumns({one: F.coalesce(F.col(f"`{chosen_col}`"), empty), other: F.coalesce(F.col(f"`{rejected_col}`"), empty)})
    a, b = F.col(one), F.col(other)
    n = common_prefix(a, b)
    rest = lambda x: F.slice(x, n + 1, F.greatest(F.size(x) - n, F.lit(0)))
    prompt = F.array_join(F.transform(F.slice(a, 1, n), lambda x: F.concat(head(x), tail(x))), "")
    made = {"prompt_turns": n, "prompt": prompt, "chosen": segments(rest(a), role), "rejected": segments(rest(b), role)}
    others = [F.col(f"`{c}`") for c in pairs.columns if c.lower() not in {*made, chosen_col.lower(), rejected_col.lower()}]
    return named.select(*others, *[v.alias(k) for k, v in made.items()])


def completion(parts: Column) -> Column:
    """The text of a completion."""
    return F.array_join(F.transform(parts, lambda x: x["text"]), "")


def mask(parts: Column) -> Column:
    """Lengths of a completion's segments in code points, each with 1 where it is trained on, as length:flag, comma-joined."""
    return F.array_join(F.transform(parts, lambda x: F.concat(F.length(x["text"]).cast("string"), F.when(x["train"], ":1").otherwise(":0"))), ",")
