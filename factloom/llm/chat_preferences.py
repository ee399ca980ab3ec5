"""Preference formatting of chosen and rejected conversations, with DataFrame functions only.

A pair's conversations are lists of messages ordered by turn. The longest common turn prefix is
rendered once, as the prompt; what follows it in either conversation is that side's completion, where
only the text of the assistant's messages counts in the loss. ``format_preferences`` gathers no conversation in one row:
messages stay rows, and those of a pair that holds very many are dealt to several tasks, so a
conversation with a third of all turns is no harder than others. ``render`` makes one row a pair of them, for
pairs that fit in one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import cut_and_sum, salted_join


def _header(role: Column) -> Column:
    return F.concat(F.lit("<|im_start|>"), role, F.lit("\n"))


def _clean(text: Column) -> Column:
    """Markers inside a text are broken up, so that they stay text."""
    return F.replace(F.coalesce(text, F.lit("")), F.lit("<|"), F.lit("< |"))


def rendered(role: Column, text: Column) -> Column:
    """One message in chat markup."""
    return F.concat(_header(F.coalesce(role, F.lit("unknown"))), _clean(text), F.lit("<|im_end|>\n"))


def _messages(df: DataFrame, pair_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    named = df.select(F.col(pair_col).alias("pair_id"), F.col(turn_col).cast("long").alias("turn"), F.col(role_col).cast("string").alias("role"), F.col(text_col).cast("string").alias("text"))
    return named.where("pair_id is not null and turn is not null")


def _format(messages: DataFrame) -> DataFrame:
    """``messages(pair_id, turn, role, text, sides)``, ``sides`` 1 for the chosen, 2 for the rejected conversation."""
    both = messages.groupBy("pair_id", "turn", "role", "text").agg(F.bit_or("sides").alias("sides"))
    in_chosen, in_rejected = (F.col("sides").bitwiseAND(k) > 0 for k in (1, 2))
    ends = both.groupBy("pair_id").agg(
        F.min(F.when(F.col("sides") < 3, F.col("turn"))).alias("parting"),
        F.max(F.when(in_chosen, F.col("turn"))).alias("chosen_end"),
        F.max(F.when(in_rejected, F.col("turn"))).alias("rejected_end"),
        F.count("*").alias("n"),
    )
    paired = F.coalesce((F.col("chosen_end") >= F.col("parting")) & (F.col("rejected_end") >= F.col("parting")), F.lit(False))
    ends, total, most = cut_and_sum(ends.select("pair_id", "parting", paired.alias("paired"), "n"), "n")
    placed = salted_join(both, ends, ["pair_id"], "n", total, most).withColumn("common", F.col("parting").isNull() | (F.col("turn") < F.col("parting")))
    sides = F.when(F.col("common"), F.array(F.lit("prompt"))).otherwise(F.array_compact(F.array(F.when(in_chosen, "chosen"), F.when(in_rejected, "rejected"))))
    role = F.coalesce("role", F.lit("unknown"))
    train = ~F.col("common") & (F.coalesce("role", F.lit("")) == "assistant")
    begin = F.length(_header(role))
    return placed.select(
        "pair_id",
        F.explode(sides).alias("side"),
        "turn",
        role.alias("role"),
        rendered(F.col("role"), F.col("text")).alias("content"),
        train.alias("train"),
        F.when(train, begin).alias("train_from"),
        F.when(train, begin + F.length(_clean(F.col("text")))).alias("train_to"),
        "paired",
    )


def format_preferences(chosen: DataFrame, rejected: DataFrame, pair_col: str = "pair_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``(pair_id, side, turn, role, content, train, train_from, train_to, paired)``: one row per message of prompt, chosen and rejected.

    Order by ``turn, role, content`` within ``(pair_id, side)`` gives the rendered text. ``train`` is
    true for the assistant's messages of completions and false elsewhere; the loss counts the characters of ``content`` from
    ``train_from`` to before ``train_to``, which leave out the role header and the markup. ``paired`` says whether
    both sides have a completion: equal sides are a prompt only, a pair with one side has no common prefix and
    one completion, and where one conversation goes on after the other has ended only the longer has one; these are not paired.
    Messages are compared by turn, role and text, null equal to null.

    Messages without a pair or turn belong to no conversation and are left out; a null role is
    rendered ``unknown``, a null text as empty. A message that repeats one of the same turn counts
    once; different messages of one turn are all kept. Texts may be empty or very long. Other columns are ignored, whatever their names. Empty tables give an empty result.
    """
    columns = pair_col, turn_col, role_col, text_col
    return _format(_messages(chosen, *columns).withColumn("sides", F.lit(1)).unionByName(_messages(rejected, *columns).withColumn("sides", F.lit(2))))


def render(messages: DataFrame) -> DataFrame:
    """``(pair_id, prompt, chosen, rejected, chosen_spans, rejected_spans)`` of what ``format_preferences`` returns, one row for each pair with two completions.

    Spans ``(from, to)`` are the characters of a completion that count in the loss. A pair's messages meet in one
    row here, so it must fit in one.
    """
    order = Window.partitionBy("pair_id", "side").orderBy("turn", "role", "content")
    before = F.coalesce(F.sum(F.length("content")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = messages.where("paired").withColumn("at", F.row_number().over(order)).withColumn("before", before)
    span = F.when(F.col("train"), F.struct((F.col("before") + F.col("train_from")).alias("from"), (F.col("before") + F.col("train_to")).alias("to")))
    one = placed.withColumn("span", span)

    def text(side: str) -> Column:
        return F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("side") == side, F.struct("at", "content")))), lambda x: x["content"]), "").alias(side)

    def spans(side: str) -> Column:
        return F.sort_array(F.collect_list(F.when(F.col("side") == side, F.col("span")))).alias(f"{side}_spans")

    return one.groupBy("pair_id").agg(text("prompt"), text("chosen"), text("rejected"), spans("chosen"), spans("rejected"))


#: The text that takes the place of a conversation's last answer in its stale twin.
REFUSAL = "I can't help with that."


def stale_preferences(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``format_preferences`` of pairs made of ``conversations``: each as it is, chosen, and one that ends with a refusal in place of its
    last answer, rejected. Both share all turns before that answer.

    A conversation without an answer has equal sides, and one whose last answer is the refusal too: a prompt only, not paired, or, if turns follow that answer, a chosen completion only.
    """
    rows = _messages(conversations, id_col, turn_col, role_col, text_col)
    last = rows.groupBy("pair_id").agg(F.max(F.when(F.col("role") == "assistant", F.col("turn"))).alias("last"), F.count("*").alias("n"))
    last, total, most = cut_and_sum(last, "n")
    known = salted_join(rows, last, ["pair_id"], "n", total, most)
    stale = F.when((F.col("turn") == F.col("last")) & (F.col("role") == "assistant"), F.lit(REFUSAL)).otherwise(F.col("text"))
    sides = F.array_compact(
        F.array(
            F.struct(F.col("text").alias("text"), F.lit(1).alias("sides")),
            F.when(F.col("last").isNull() | (F.col("turn") <= F.col("last")), F.struct(stale.alias("text"), F.lit(2).alias("sides"))),
        )
    )
    return _format(known.select("pair_id", "turn", "role", F.explode(sides).alias("x")).select("pair_id", "turn", "role", "x.text", "x.sides"))
