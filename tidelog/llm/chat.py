"""Chat formatting into budgeted, turn-aligned windows with a loss mask (DataFrame functions only).

A turn is written as  <|role|>text<|end|>  and inside roles and texts the characters that control strings need are escaped: ~ as ~0, < as ~1,
[ as ~2, | as ~3. So no text can contain a control string of this template or of common ones such as [INST] or </s>, and
undoing the escapes in the opposite order gives back every text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

# Escaped characters in the order of escaping.
ESCAPES = (("~", "~0"), ("<", "~1"), ("[", "~2"), ("|", "~3"))
END = "<|end|>"
WORD = r"[^\x20\x09-\x0D]+"
#: Production parameters, in words: of a window, of the history repeated at its start, and the turns of that history at most.
BUDGET, HISTORY_TOKENS, HISTORY_TURNS = 512, 128, 2


def escape(c: Column) -> Column:
    for plain, coded in ESCAPES:
        c = F.replace(c, F.lit(plain), F.lit(coded))
    return c


def unescape(c: Column) -> Column:
    for plain, coded in reversed(ESCAPES):
        c = F.replace(c, F.lit(coded), F.lit(plain))
    return c


def format_chat(
    turns: DataFrame, *, budget: int = BUDGET, history_tokens: int = HISTORY_TOKENS, history_turns: int = HISTORY_TURNS,
) -> DataFrame:
    """One row per window: conv_id, window, n_context, n_own, tokens, formatted, loss (array of start, length in code points).

    A first turn of the role system is the conversation's system turn. What the budget leaves beside it and the history is dealt in slots of half of it: prefix sums of
    the other turns' tokens (words, and one for the turn) place each turn in a slot, a window is a run of turns in the same slot, and a turn larger than a slot has a window to
    itself (the conversation's first one together with the system turn, if both fit into the budget).
    Every later window repeats, out of the loss, the system turn if it fits beside the window's own turns, and up to history_turns turns before the
    window, as long as they are within history_tokens and what the budget then leaves. So a window passes the budget only if it has one own turn that does so alone.
    Each assistant turn is under the loss once, in its own window. Turns of equal number are ordered by role and text. A null role or text
    counts as empty, a null conv_id is a conversation, a null turn comes first; other columns are ignored.
    """
    rows = turns.select(
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
    ).withColumn("tokens", F.regexp_count("text", F.lit(WORD)) + 1)
    order = W.partitionBy("conv_id").orderBy("turn", "role", "text")
    upto = order.rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumns({
        "n": F.row_number().over(order), "sum": F.sum("tokens").over(upto),
        "system": F.when(F.first("role").over(upto) == "system", F.first("tokens").over(upto)).otherwise(F.lit(0))})
    is_system = (F.col("n") == 1) & (F.col("system") > 0)
    size = F.greatest(F.lit(1), F.floor((F.lit(budget - history_tokens) - F.col("system")) / 2))
    rows = rows.withColumns({
        "slot": F.when(is_system, F.lit(0).cast("long")).otherwise(F.floor((F.col("sum") - F.col("system") - 1) / size)), "big": ~is_system & (F.col("tokens") > size)})
    with_system = (F.col("n") == 2) & (F.col("system") > 0)
    cut = F.when(with_system, F.col("system") + F.col("tokens") > budget).otherwise((F.col("slot") != F.lag("slot").over(order)) | F.col("big") | F.lag("big").over(order))
    rows = rows.withColumn("window", F.sum(F.coalesce(cut, F.lit(False)).cast("int")).over(upto))
    # a turn is history of the next window if few turns and tokens lie between it and that window
    rest = W.partitionBy("conv_id", "window").orderBy(F.desc("n")).rowsBetween(W.unboundedPreceding, 0)
    last = F.max("window").over(W.partitionBy("conv_id"))
    rows = rows.withColumns({
        "back": F.row_number().over(W.partitionBy("conv_id", "window").orderBy(F.desc("n"))),
        "tail": F.sum("tokens").over(rest), "last": last})
    repeated = (F.col("back") <= history_turns) & (F.col("tail") <= history_tokens) & (F.col("window") < F.col("last"))
    places = F.array_compact(F.array(
        F.struct("window", F.lit(2).alias("part")),
        F.when(repeated & ~is_system, F.struct((F.col("window") + 1).alias("window"), F.lit(1).alias("part")))))
    system = F.when(is_system & (F.col("last") > 0), F.transform(
        F.sequence(F.lit(1).cast("long"), F.col("last")), lambda w: F.struct(w.alias("window"), F.lit(0).alias("part"))))
    head = F.concat(F.lit("<|"), escape(F.col("role")), F.lit("|>"))
    placed = rows.select(
        "conv_id", "n", "tokens", "tail", "role", head.alias("head"), escape(F.col("text")).alias("body"),
        F.explode(F.concat(places, F.coalesce(system, F.array().cast("array<struct<window:bigint,part:int>>")))).alias("at"))
    items = placed.groupBy("conv_id", F.col("at.window").alias("window")).agg(
        F.array_sort(F.collect_list(F.struct("at.part", "n", "role", "head", "body", "tokens", "tail"))).alias("items"))  # the budget bounds them
    total = lambda part: F.aggregate(F.filter("items", lambda x: x["part"] == part), F.lit(0).cast("long"), lambda a, x: a + x["tokens"])
    items = items.withColumn("room", F.lit(budget) - total(2))
    items = items.withColumn("room_after", F.col("room") - F.when(total(0) <= F.col("room"), total(0)).otherwise(F.lit(0)))
    items = items.withColumn("items", F.filter("items", lambda x: (x["part"] == 2) | ((x["part"] == 0) & (x["tokens"] <= F.col("room"))) | ((x["part"] == 1) & (x["tail"] <= F.col("room_after")))))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("loss"))

    def step(acc: Column, x: Column) -> Column:
        start, size = acc["at"] + F.char_length(x["head"]), F.char_length(x["body"])
        target = (x["part"] == 2) & (x["role"] == "assistant")
        return F.struct(
            (start + size + len(END)).alias("at"),
            F.when(target, F.array_append(acc["loss"], F.struct(start.alias("start"), size.alias("length")))).otherwise(acc["loss"]).alias("loss"))

    own = F.size(F.filter("items", lambda x: x["part"] == 2))
    return items.select(
        "conv_id", "window", (F.size("items") - own).alias("n_context"), own.alias("n_own"),
        F.aggregate("items", F.lit(0), lambda a, x: a + x["tokens"]).alias("tokens"),
        F.array_join(F.transform("items", lambda x: F.concat(x["head"], x["body"], F.lit(END))), "").alias("formatted"),
        F.aggregate("items", zero, step, lambda acc: acc["loss"]).alias("loss"))


def read_back(windows: DataFrame) -> DataFrame:
    """conv_id, window, turns (array of role, text: the window's own) and loss_texts, all decoded from formatted and loss."""
    marked = F.slice(F.split("formatted", r"<\|end\|>"), F.col("n_context") + 1, F.col("n_own"))
    turn = lambda s: F.struct(
        unescape(F.regexp_extract(s, r"(?s)^<\|(.*?)\|>", 1)).alias("role"), unescape(F.regexp_extract(s, r"(?s)^<\|.*?\|>(.*)$", 1)).alias("text"))
    under = F.transform("loss", lambda x: unescape(F.substring(F.col("formatted"), x["start"] + 1, x["length"])))
    return windows.select("conv_id", "window", F.transform(marked, turn).alias("turns"), under.alias("loss_texts"), "formatted")


def digests(windows: DataFrame) -> DataFrame:
    """Per conversation, read back from the windows: n_turns, digests and lengths. A digest needs its conversation's whole text in one row."""
    read = read_back(windows).select(
        "conv_id", "window", F.size("turns").alias("n"), F.char_length("formatted").alias("chars"),
        F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "").alias("turns"),
        F.array_join("loss_texts", "").alias("loss"))
    whole = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("window", c))), lambda x: x[c]), "")
    per = read.groupBy("conv_id").agg(
        F.sum("n").alias("n_turns"), whole("turns").alias("turns"), whole("loss").alias("loss"), F.sum("chars").alias("formatted_chars"))
    return per.select(
        "conv_id", "n_turns", F.sha2("turns", 256).alias("turns_sha256"), F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")
