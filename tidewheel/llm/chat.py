"""Chat formatting in budgeted windows.

Prefix sums of turn tokens cut a conversation into turn-aligned spans. Each span
is written with the conversation's system turn and a limited number of the turns
before it; those are context. What a span writes stays within `budget` tokens:
its own turns get what the system turn and `history_tokens` leave. A system turn
that would take more than half of the budget is written only at its own place. A
turn over that share stands alone, without history or system turn, and is the
only thing that may exceed the budget. The loss mask covers the assistant texts
of the span's own turns, so each target is learned once. DataFrame functions only.

Template: <|turn|>role<|text|>text<|end|> for each turn. In roles and texts `&`
is written `&amp;` and `<|` is written `&lt;|`, so no control string can stand
there and the original is restored by undoing both.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._native import word_count

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
BUDGET = 512
HISTORY_TURNS = 2
HISTORY_TOKENS = 128
TURN_TOKENS = 4


def escaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<|"), F.lit("&lt;|"))


def restored(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&lt;"), F.lit("<")), F.lit("&amp;"), F.lit("&"))


def format_conversations(turns: DataFrame, budget: int = BUDGET, history_turns: int = HISTORY_TURNS, history_tokens: int = HISTORY_TOKENS, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, span, n_context, n_turns, n_tokens, formatted, loss) per span.

    Turn tokens are words plus TURN_TOKENS; n_tokens counts every turn written.
    formatted holds n_context turns of context, then n_turns own turns; loss is
    an array of (at, n): places in formatted, in code points from 0. The system
    turn is the first turn if its role is `system`. Null texts and roles are
    empty; equal turn numbers are ordered by role and text, null ones come first;
    a null conversation id is a conversation. A very long text is a turn like any
    other. An empty table gives no spans; other columns are ignored."""
    if history_tokens * 2 > budget:
        raise ValueError("history_tokens must leave half of the budget")
    rows = turns.select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("tokens", word_count(F.col("text")) + TURN_TOKENS)
    order = W.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    first = order.rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumn("idx", F.row_number().over(order)).withColumn("before", F.sum("tokens").over(first) - F.col("tokens"))
    rows = rows.withColumn("head", F.concat(F.lit(TURN), escaped(F.col("role")), F.lit(TEXT))).withColumn("body", escaped(F.col("text")))
    fits = (F.first("role").over(first) == "system") & (F.first("tokens").over(first) <= (budget - history_tokens) // 2)
    rows = rows.withColumn("system", F.when(fits, F.first(F.concat("head", "body", F.lit(END))).over(first)))
    rows = rows.withColumn("system_tokens", F.when(fits, F.first("tokens").over(first)).otherwise(F.lit(0)))
    rows = rows.withColumn("room", budget - history_tokens - F.col("system_tokens"))
    block, last = F.expr("before div room"), F.expr("(before + tokens - 1) div room")
    rows = rows.withColumn("span", block * 2 + (block != last).cast("long"))
    rows = rows.withColumn("start", F.coalesce(F.lag("span").over(order) != F.col("span"), F.lit(True)))
    # A turn over the room has a span of its own, without context.
    rows = rows.withColumn("alone", F.col("tokens") > F.col("room"))
    places = [F.struct(F.col("span").alias("span"), F.lit(True).alias("own"), F.when(~F.col("alone"), F.struct("system", "system_tokens")).alias("system"))]
    none = F.lit(None).cast("struct<system:string,system_tokens:bigint>")
    for k in range(1, history_turns + 1):
        near = F.lead("start", k).over(order) & ~F.lead("alone", k).over(order) & (F.lead("before", k).over(order) - F.col("before") <= history_tokens)
        rows = rows.withColumn(f"next{k}", F.when(near, F.lead("span", k).over(order)))
        places.append(F.when(F.col(f"next{k}").isNotNull(), F.struct(F.col(f"next{k}").alias("span"), F.lit(False).alias("own"), none.alias("system"))))
    rows = rows.withColumn("place", F.explode(F.array_compact(F.array(*places))))
    part = F.struct("idx", F.col("place.own").alias("own"), "role", "head", "body", "tokens")
    spans = rows.groupBy("conv_id", F.col("place.span").alias("span")).agg(F.sort_array(F.collect_list(part)).alias("parts"), F.max("place.system").alias("system"))
    spans = spans.withColumn("leads", (F.col("parts")[0]["idx"] > 1) & F.col("system.system").isNotNull())
    spans = spans.withColumn("lead", F.when(F.col("leads"), F.col("system.system")).otherwise(F.lit("")))
    text = F.concat("lead", F.expr(f"array_join(transform(parts, p -> concat(p.head, p.body, '{END}')), '')"))
    loss = F.expr(
        "aggregate(parts, struct(length(lead) as at, array(struct(0 as at, 0 as n)) as found), (a, p) -> struct("
        f"a.at + length(p.head) + length(p.body) + {len(END)} as at,"
        " if(p.own and p.role = 'assistant', array_append(a.found, struct(a.at + length(p.head) as at, length(p.body) as n)), a.found) as found),"
        " a -> slice(a.found, 2, size(a.found)))"
    )
    own = F.expr("size(filter(parts, p -> p.own))")
    n_tokens = F.expr("aggregate(parts, 0L, (a, p) -> a + p.tokens)") + F.when(F.col("leads"), F.col("system.system_tokens")).otherwise(F.lit(0))
    return spans.select(
        "conv_id", "span", (F.size("parts") - own + F.coalesce(F.col("leads"), F.lit(False)).cast("int")).alias("n_context"), own.alias("n_turns"), n_tokens.alias("n_tokens"), text.alias("formatted"), loss.alias("loss"),
    )


def read_back(spans: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars)
    from formatted spans alone: own turns are parsed and unescaped, and loss
    texts are cut out at the mask and unescaped."""
    turns = F.split("formatted", r"<\|turn\|>")
    turns = F.slice(turns, F.col("n_context") + 2, F.greatest(F.size(turns) - 1 - F.col("n_context"), F.lit(0)))

    def shown(x: Column) -> Column:
        parts = F.split(F.replace(x, F.lit(END), F.lit("")), r"<\|text\|>")
        return F.concat(restored(parts[0]), F.lit("\n"), restored(parts[1]), F.lit("\n"))

    rows = spans.withColumn("turns", turns).select(
        "conv_id", "span", F.size("turns").cast("long").alias("n"), F.array_join(F.transform("turns", shown), "").alias("said"),
        F.array_join(F.transform("loss", lambda x: restored(F.substring(F.col("formatted"), x["at"] + 1, x["n"]))), "").alias("lost"), F.length("formatted").cast("long").alias("chars"),
    )
    got = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("span", "said", "lost"))).alias("l"), F.sum("n").alias("n_turns"), F.sum("chars").alias("formatted_chars"))
    said, lost = F.expr("array_join(transform(l, x -> x.said), '')"), F.expr("array_join(transform(l, x -> x.lost), '')")
    return got.select("conv_id", "n_turns", F.sha2(said, 256).alias("turns_sha256"), F.length(lost).cast("long").alias("loss_chars"), F.sha2(lost, 256).alias("loss_sha256"), "formatted_chars")
