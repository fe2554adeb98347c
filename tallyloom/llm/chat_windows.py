"""Chat formatting in budgeted windows. DataFrame functions only.

Prefix sums of the turns' tokens place each turn in a span: a cell of half the room that a window has, by where the turn
begins; a turn longer than half the room is a span of its own. So a span never outgrows its window, and spans follow from
sums, without walking a conversation. A window is the system turn, as many turns before the span as the history's tokens
allow, and the span. Only assistant turns of the span are under the loss mask: what is repeated is masked out.

The sums are taken within blocks of turns and then over blocks, so that one very long conversation is no single task.

A window reads ``<s>``, then ``[INST] new role [/INST]text</s>`` for each turn (``old`` for a repeated one). In roles and texts a
backslash goes into each string that looks like one of these marks; one more if it has some already.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Tokens of a window, and those of them that repeated turns may take.
BUDGET, HISTORY = 2048, 512
#: Turn numbers of a block of the prefix sums.
BLOCK = 1024
#: Bytes of text that count as a token where no count is given.
BYTES_PER_TOKEN = 4

_OPEN, _END = "<s>", "</s>"


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])(\\*)(/?(?:s>|INST\]))", r"$1\\$2$3")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])\\(\\*)(/?(?:s>|INST\]))", "$1$2$3")


def _placed(turns: DataFrame, budget: int, history: int) -> DataFrame:
    """Each turn with its number in the conversation (``k``), tokens before it, span and the history its windows have."""
    order = ["turn", "role", "text"]
    block = Window.partitionBy("key", "block").orderBy(*order)
    turns = turns.withColumn("block", F.floor(F.col("turn") / BLOCK))
    inside = turns.withColumns(
        {"k": F.row_number().over(block), "upto": F.sum("tokens").over(block.rowsBetween(Window.unboundedPreceding, 0))}
    )
    sums = turns.groupBy("key", "block").agg(
        F.count(F.lit(1)).alias("n"), F.sum("tokens").alias("total"), F.min(F.struct(*order, "tokens")).alias("first")
    )
    whole = Window.partitionBy("key")
    earlier = whole.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(
        "key",
        "block",
        F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("n_before"),
        F.coalesce(F.sum("total").over(earlier), F.lit(0)).alias("total_before"),
        F.sum("n").over(whole).alias("n_turns"),
        F.min("first").over(whole).alias("first"),
    )
    led = F.when(F.col("first.role") == "system", F.col("first.tokens")).otherwise(F.lit(0))
    half = F.greatest(F.floor((F.lit(budget - history) - F.col("led")) / 2), F.lit(1))
    placed = inside.join(sums, ["key", "block"]).withColumns({"led": led, "k": F.col("k") + F.col("n_before")})
    placed = placed.withColumns(
        {
            "is_system": (F.col("k") == 1) & (F.col("role") == "system"),
            "half": half,
            "before": F.col("total_before") + F.col("upto") - F.col("tokens") - F.col("led"),
        }
    )
    cell = F.floor(F.col("before") / F.col("half"))
    return placed.withColumns(
        {
            "cell": cell,
            "span": cell * 2 + (F.col("tokens") > F.col("half")).cast("int"),
            "reach": F.col("before") + F.least(F.lit(history), F.col("half")),
        }
    ).select("key", "conv", "k", "role", "text", "tokens", "before", "half", "cell", "span", "reach", "is_system", "n_turns")


def chat_windows(
    conversations: DataFrame,
    budget: int = BUDGET,
    history: int = HISTORY,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    tokens_col: str | None = None,
) -> DataFrame:
    """One row for each window: ``conv``, ``window_start`` (tokens before its span), ``text``, ``loss`` (spans of characters,
    ``start`` and ``end``), ``n_turns`` (new ones) and ``n_tokens``.

    * Turns go by number, then role and text; a null number comes last; repeated rows are turns of their own. Null roles
      and texts are empty. Rows without a conversation form one. Other columns are ignored.
    * A first turn by ``system`` leads every window. Turns are never cut: one that exceeds the budget has a window of its
      own, with what history fits its limit.
    * A turn counts at least one token: ``tokens_col``, or its bytes over ``BYTES_PER_TOKEN``.
    * Every turn is new in exactly one window. ``loss`` has the assistant turns that are new there.
    """
    text, role = F.coalesce(F.col(text_col), F.lit("")), F.coalesce(F.col(role_col), F.lit(""))
    bytes_ = F.ceil(F.octet_length(text) / BYTES_PER_TOKEN)
    tokens = bytes_ if tokens_col is None else F.coalesce(F.col(tokens_col).cast("long"), F.lit(0))
    turns = conversations.select(
        F.coalesce(F.concat(F.lit("#"), F.col(conv_col).cast("string")), F.lit("")).alias("key"),
        F.col(conv_col).alias("conv"),
        F.coalesce(F.col(turn_col).cast("long"), F.lit((1 << 63) - 1)).alias("turn"),
        role.alias("role"),
        text.alias("text"),
        F.greatest(tokens, F.lit(1)).alias("tokens"),
    )
    placed = _placed(turns, budget, history)
    body, system = placed.where(~F.col("is_system")), placed.where("is_system")
    parts = ["key", "conv", "span", "start", "k", "role", "text", "tokens", "is_new"]

    spans = body.groupBy("key", "span").agg(F.min("before").alias("start"))
    lone = system.where("n_turns = 1").select("key", F.lit(0).cast("long").alias("span"), F.lit(0).cast("long").alias("start"))
    spans = spans.unionByName(lone)

    # A turn is repeated in later spans that begin within its reach, which a cell that begins beyond it can't hold.
    later = F.array(*[F.col("cell") * 2 + i for i in (1, 2, 3)])
    later = F.filter(later, lambda s: (s > F.col("span")) & (F.floor(s / 2) * F.col("half") <= F.col("reach")))
    again = body.withColumn("at", F.explode(later)).drop("span")
    again = again.join(spans.withColumnRenamed("span", "at"), ["key", "at"]).where("start <= reach").withColumnRenamed("at", "span")
    own = body.withColumns({"start": F.col("before"), "is_new": F.lit(True)})
    again = again.withColumns({"start": F.lit(None).cast("long"), "is_new": F.lit(False)})
    lead = spans.join(system.drop("span"), "key").withColumn("is_new", F.col("start") == 0)
    turns = own.select(parts).unionByName(again.select(parts)).unionByName(lead.select(parts))

    head = F.concat(F.lit("[INST] "), F.when(F.col("is_new"), "new").otherwise("old"), F.lit(" "), escaped(F.col("role")), F.lit(" [/INST]"))
    turns = turns.withColumns({"head": head, "body": escaped(F.col("text"))})
    turns = turns.withColumn("piece", F.concat("head", "body", F.lit(_END)))
    ahead = Window.partitionBy("key", "span").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    start = F.lit(len(_OPEN)) + F.coalesce(F.sum(F.length("piece")).over(ahead), F.lit(0)) + F.length("head")
    turns = turns.withColumn("from", start)
    scored = F.col("is_new") & (F.col("role") == "assistant")
    target = F.struct(F.col("from").alias("start"), (F.col("from") + F.length("body")).alias("end"))
    windows = turns.groupBy("key", "span").agg(
        F.first("conv").alias("conv"),
        F.min("start").alias("window_start"),
        F.sort_array(F.collect_list(F.struct("k", "piece"))).alias("pieces"),
        F.sort_array(F.collect_list(F.when(scored, target))).alias("loss"),
        F.sum(F.col("is_new").cast("long")).alias("n_turns"),
        F.sum("tokens").alias("n_tokens"),
    )
    formatted = F.concat(F.lit(_OPEN), F.array_join(F.transform("pieces", lambda p: p.piece), ""))
    return windows.select("conv", "window_start", formatted.alias("text"), "loss", "n_turns", "n_tokens")


def read_back(windows: DataFrame) -> DataFrame:
    """One row for each conversation, from the windows alone: ``conv``, ``turns`` (role and text of the new turns, in order),
    ``losses`` (the unescaped texts under the loss mask, in order) and ``formatted_chars``.

    A conversation becomes one row here; the windows are what training reads.
    """
    pieces = F.split(F.expr(f"substring(text, {len(_OPEN) + 1})"), _END)
    shape = r"(?s)^\[INST\] (new|old) (.*?) \[/INST\](.*)$"
    parsed = F.transform(
        F.filter(pieces, lambda p: p != ""),
        lambda p: F.struct(
            F.regexp_extract(p, shape, 1).alias("kind"),
            unescaped(F.regexp_extract(p, shape, 2)).alias("role"),
            unescaped(F.regexp_extract(p, shape, 3)).alias("text"),
        ),
    )
    new = F.filter(parsed, lambda t: t.kind == "new")
    turns = F.transform(new, lambda t: F.struct(t.role.alias("role"), t.text.alias("text")))
    losses = F.transform("loss", lambda s: unescaped(F.substring(F.col("text"), s.start.cast("int") + 1, (s.end - s.start).cast("int"))))
    each = windows.select(
        "conv", "window_start", turns.alias("turns"), losses.alias("losses"), F.length("text").cast("long").alias("chars")
    )
    whole = each.groupBy("conv").agg(
        F.sort_array(F.collect_list(F.struct("window_start", "turns", "losses"))).alias("w"), F.sum("chars").alias("formatted_chars")
    )
    return whole.select(
        "conv",
        F.flatten(F.transform("w", lambda w: w.turns)).alias("turns"),
        F.flatten(F.transform("w", lambda w: w.losses)).alias("losses"),
        "formatted_chars",
    )
