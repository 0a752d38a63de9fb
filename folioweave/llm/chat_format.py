"""Operator 6, chat formatting: budgeted windows of turns, in DataFrame functions alone.

Prefix sums of turn tokens put each turn into a span: spans start where the sum passes a multiple
of half the room, so that a span of turns no longer than that half never overflows, and a longer
turn closes its span's quantum and stands alone.  Every later window repeats the system turn and
the last turns before it, within a limit; what is repeated is masked.  The prefix sums are taken
over blocks of turns, so no task needs all turns of one conversation.

Template: ``<|role|>text<|end|>`` for each turn.  In roles and texts ``%``, ``<`` and ``|`` are
written ``%25``, ``%3C`` and ``%7C``, so control strings inside them can't be taken for the template's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

#: Tokens of a window; of the turns repeated before it; turns repeated; tokens of a turn's marks; turns of a block of prefix sums.
BUDGET, HISTORY, HISTORY_TURNS, MARKS, BLOCK = 1024, 128, 2, 4, 256
#: A span has this room at least, however long the system turn is.
LEAST_ROOM = 256
END = "<|end|>"


def escaped(x: Column) -> Column:
    return F.replace(F.replace(F.replace(x, F.lit("%"), F.lit("%25")), F.lit("<"), F.lit("%3C")), F.lit("|"), F.lit("%7C"))


def unescaped(x: Column) -> Column:
    return F.replace(F.replace(F.replace(x, F.lit("%7C"), F.lit("|")), F.lit("%3C"), F.lit("<")), F.lit("%25"), F.lit("%"))


def tokens(text: Column) -> Column:
    """Words, digits and marks of a text, and the marks of its turn."""
    return (F.regexp_count(text, F.lit("\\p{L}+|\\p{N}|[^\\s\\p{L}\\p{N}]")) + MARKS).cast("long")


def _tail(turns: Column) -> Column:
    """The last turns of a span that may be repeated: HISTORY_TURNS at most, HISTORY tokens at most, the latest ones if not all fit."""
    last = F.filter(F.slice(turns, -F.least(F.lit(HISTORY_TURNS), F.size(turns)), HISTORY_TURNS), lambda t: ~t["lead"])
    total = lambda k: F.aggregate(F.slice(last, k + 1, HISTORY_TURNS), F.lit(0).cast("long"), lambda a, t: a + t["tokens"])
    return F.filter(last, lambda t, k: total(k) <= HISTORY)


def format_chats(turns: DataFrame, budget: int = BUDGET) -> DataFrame:
    """One row per window: conv_id, window (from 1), n_context (repeated turns at its start), n_turns (new ones), n_tokens, formatted, loss_spans.

    loss_spans has start and length, in code points of ``formatted``, of each assistant text that is
    new in the window.  Turns go by turn, then role, then text.  Null roles and texts are empty, a null
    conv_id is a conversation of its own, repeated rows are turns of their own, an empty table gives
    an empty result, and further columns are not read.  A single turn beyond the room stands alone,
    over the budget.
    """
    clean = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    base = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), clean("role").alias("role"), clean("text").alias("text"))
    # a key that is never null: joins by it need no further shuffle
    base = base.withColumn("key", F.coalesce(F.col("conv_id").cast("string"), F.lit("-")))
    base = base.withColumn("tokens", tokens(F.col("text"))).withColumn("block", F.floor(F.coalesce("turn", F.lit(-1)) / BLOCK))
    order = [F.col("turn").asc_nulls_first(), "role", "text"]

    heads = base.groupBy("key", "block").agg(F.sum("tokens").alias("own"), F.count("*").alias("n"), F.min(F.struct("turn", "role", "text", "tokens")).alias("head"))
    by_conv = Window.partitionBy("key").orderBy("block")
    before = by_conv.rowsBetween(Window.unboundedPreceding, -1)
    heads = heads.select(
        F.col("key").alias("c"), F.col("block").alias("b"),
        F.coalesce(F.sum("own").over(before), F.lit(0)).alias("sum0"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n0"),
        F.first("head").over(by_conv).alias("head"),
    )
    heads = heads.withColumn("system", F.when(F.col("head.role") == "system", F.col("head"))).drop("head")
    room = F.greatest(F.lit(LEAST_ROOM), F.lit(budget - HISTORY) - F.coalesce(F.col("system.tokens"), F.lit(0)))
    heads = heads.withColumn("half", (room / 2).cast("long"))

    in_block = Window.partitionBy("key", "block").orderBy(*order)
    placed = base.withColumn("upto", F.sum("tokens").over(in_block.rowsBetween(Window.unboundedPreceding, 0)) - F.col("tokens")).withColumn("at", F.row_number().over(in_block))
    placed = placed.join(heads, (F.col("key") == F.col("c")) & (F.col("block") == F.col("b")))
    span = 2 * F.floor((F.col("sum0") + F.col("upto")) / F.col("half")) + (F.col("tokens") > F.col("half")).cast("int")
    place = F.col("n0") + F.col("at")
    turn = F.struct(place.alias("place"), "role", "text", "tokens", ((place == 1) & F.col("system").isNotNull()).alias("lead"))
    spans = placed.groupBy("key", span.alias("span")).agg(F.first("conv_id").alias("conv_id"), F.sort_array(F.collect_list(turn)).alias("new"), F.first("system").alias("system"))

    # the window over a conversation carries span numbers and what may be repeated, and not the turns
    by_span = Window.partitionBy("key").orderBy("span")
    tails = spans.select("key", "span", _tail(F.col("new")).alias("tail"))
    tails = tails.select("key", "span", F.row_number().over(by_span).alias("window"), F.lag("tail").over(by_span).alias("history"))
    spans = spans.join(tails, ["key", "span"])
    plain = lambda c, fresh: F.transform(c, lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"), t["tokens"].alias("tokens"), F.lit(fresh).alias("fresh")))
    none = plain(F.slice("new", 1, 0), False)
    again = F.when(F.col("window") > 1, F.concat(F.coalesce(plain(F.filter(F.array("system"), lambda t: t.isNotNull()), False), none), F.coalesce(plain(F.col("history"), False), none))).otherwise(none)
    spans = spans.withColumn("again", again).withColumn("turns", F.concat("again", plain(F.col("new"), True)))
    marked = F.transform("turns", lambda t: F.struct(F.concat(F.lit("<|"), escaped(t["role"]), F.lit("|>")).alias("mark"), escaped(t["text"]).alias("body"), (t["fresh"] & (t["role"] == "assistant")).alias("loss")))
    spans = spans.withColumn("marked", marked)
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,length:bigint>>").alias("spans"))

    def step(a: Column, t: Column) -> Column:
        begins, n = a["at"] + F.length(t["mark"]), F.length(t["body"]).cast("long")
        here = F.when(t["loss"], F.array(F.struct(begins.alias("start"), n.alias("length")))).otherwise(F.array().cast("array<struct<start:bigint,length:bigint>>"))
        return F.struct((begins + n + len(END)).alias("at"), F.concat(a["spans"], here).alias("spans"))

    return spans.select(
        "conv_id", "window",
        F.size("again").alias("n_context"), F.size("new").alias("n_turns"),
        F.aggregate("turns", F.lit(0).cast("long"), lambda a, t: a + t["tokens"]).alias("n_tokens"),
        F.array_join(F.transform("marked", lambda t: F.concat(t["mark"], t["body"], F.lit(END))), "").alias("formatted"),
        F.aggregate("marked", start, step, lambda a: a["spans"]).alias("loss_spans"),
    )


def read_back(windows: DataFrame) -> DataFrame:
    """conv_id, window, turns (role and text of each new turn), loss (texts under the mask), as the formatted windows have them."""
    parts = F.split("formatted", "<\\|end\\|>")
    new = F.slice(parts, F.col("n_context") + 1, F.greatest(F.size(parts) - 1 - F.col("n_context"), F.lit(0)))
    turns = F.transform(new, lambda p: F.struct(unescaped(F.substring_index(F.substring(p, 3, 1 << 30), "|>", 1)).alias("role"), unescaped(F.substring(p, F.instr(p, F.lit("|>")) + 2, F.lit(1 << 30))).alias("text")))
    loss = F.transform("loss_spans", lambda s: unescaped(F.substring(F.col("formatted"), (s["start"] + 1).cast("int"), s["length"].cast("int"))))
    return windows.select("conv_id", "window", "formatted", turns.alias("turns"), loss.alias("loss"))


def digests(windows: DataFrame) -> DataFrame:
    """What the contract asks for of each conversation.  A digest of a whole conversation needs its windows together, in order."""
    back = read_back(windows)
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    each = back.select("conv_id", "window", F.size("turns").alias("n"), lines.alias("said"), F.array_join("loss", "").alias("loss"), F.length("formatted").alias("chars"))
    whole = each.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("window", "said", "loss"))).alias("w"), F.sum("n").alias("n_turns"), F.sum("chars").alias("formatted_chars"))
    loss = F.array_join(F.transform("w", lambda x: x["loss"]), "")
    return whole.select(
        "conv_id", "n_turns", F.sha2(F.array_join(F.transform("w", lambda x: x["said"]), ""), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), "formatted_chars",
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    talks = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    own = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    return digests(format_chats(talks.unionByName(own)))
