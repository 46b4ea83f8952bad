"""Chat formatting into budgeted windows, in SQL functions.

Prefix sums of the turns' tokens cut a conversation into turn-aligned spans.
Each span becomes a window: the system turn, a limited history of the turns
before the span, and the span's own turns; the loss mask covers each assistant
text in the one window where it is new."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from spanalign.llm.common import cut, word_count
from spanalign.llm.prefix import prefix_sums

#: The template's own marks, and control strings of other templates: in a text each is broken by a backslash.
BEGIN, MIDDLE, END = "<|turn|>", "<|says|>", "<|end|>"
CONTROL = r"[<\[](\\*)(\|(?:turn|says|end|im_start|im_end|im_sep|endoftext|system|user|assistant|eot_id|begin_of_text|end_of_text|start_header_id|end_header_id)\|>|/?s>|/?INST\]|<SYS>>|</SYS>>|pad>|unk>)"


@dataclass(frozen=True)
class Budget:
    """Tokens of a window; of the history repeated in it; the marks of a turn
    count as ``per_turn``."""

    window: int = 1024
    history: int = 256
    per_turn: int = 3


def escape(text: Column) -> Column:
    """One more backslash after the opening character of each control string,
    whether it has backslashes already or not, so that no control string is
    left and ``unescape`` gives the text back."""
    return F.regexp_replace(text, r"([<\[])" + CONTROL.removeprefix(r"[<\[]"), r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])\\" + CONTROL.removeprefix(r"[<\[]"), "$1$2$3")


def turns(rows: DataFrame, per_turn: int, block: int = 256) -> DataFrame:
    """Rows in the order (turn, role, text; null turns last) within
    their conversation (``ord``) with the tokens before them (``before``).

    Prefix sums run within blocks of ``block`` turn values and over the blocks'
    totals, so that a conversation with a third of all rows is summed in many
    tasks. ``rows`` is read twice."""
    t = rows.select(F.col("conv_id"), F.col("conv_id").isNull().alias("_no"), F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("_conv"), F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    t = t.withColumn("_block", F.coalesce(F.floor(F.col("turn") / block), F.lit((1 << 63) - 1))).withColumn("tokens", word_count(F.col("text")) + F.lit(per_turn))
    t = prefix_sums(t, ["_no", "_conv"], ["_block"], ["turn", "role", "text"], {"ord": "1", "before": "tokens"})
    return t.drop("_block", "turn")


def windows(rows: DataFrame, budget: Budget = Budget()) -> DataFrame:
    """``(conv_id, turn, role, text)`` -> a row a window: ``conv_id, window``
    (0, 1, ... in order of the turns), ``formatted``, ``loss`` (spans of code
    points, end exclusive), ``n_turns``, ``n_repeated`` (turns at the front
    that an earlier window has already), ``n_tokens``, ``over_budget``.

    The tokens left for new turns are cut into cells of three quarters of
    them; a turn belongs to the cell in which it starts, so the last turn of a
    span may reach into the fourth quarter. A turn longer than that quarter is
    a span of its own. No turn is cut and the system turn is always retained,
    so a window is over the budget (and says so) where such a turn is too long
    or the system turn leaves less than a quarter of the budget; no other is. Null texts and roles are empty, null conv_ids one conversation;
    repeated rows are turns; no rows give no windows; other columns are not
    used."""
    conv = ["_no", "_conv"]
    texts = cut(turns(rows, budget.per_turn), "ordered")
    # the spans are chosen on rows without texts
    system = texts.filter("ord = 0 and role = 'system'").select(*conv, F.col("tokens").alias("_system"))
    t = texts.select("conv_id", *conv, "ord", "before", "tokens").join(system, conv, "left")
    room = F.greatest(F.lit(budget.window // 4), F.lit(budget.window - budget.history) - F.coalesce("_system", F.lit(0)))
    t = t.withColumn("_is_system", F.col("_system").isNotNull() & (F.col("ord") == 0)).withColumn("_from", F.greatest(F.lit(0), F.col("before") - F.coalesce("_system", F.lit(0))))
    t = t.withColumn("_long", ~F.col("_is_system") & (F.col("tokens") > F.floor(room / 4))).withColumn("_cell", F.floor(F.col("_from") / F.greatest(F.lit(1), F.floor(room * 3 / 4))))
    # a long turn stands alone; turns after it in its cell are a span of their own
    t = t.withColumn("_block", F.floor(F.col("ord") / 256)).withColumn("_one", F.col("_long").cast("long"))
    t = cut(prefix_sums(t, conv, ["_block"], ["ord"], {"_longs": "_one"}), "spans")
    span = [*conv, "_cell", "_longs", "_long"]
    starts = t.groupBy(*span).agg(F.min("ord").alias("_start"), F.min("_from").alias("_at"), F.max("conv_id").alias("conv_id"), F.max("_system").alias("_system"), F.sum("tokens").alias("_own"))
    left = F.least(F.lit(budget.history), F.lit(budget.window) - F.col("_own") - F.coalesce("_system", F.lit(0)))
    piece = lambda role, text: F.concat(F.lit(BEGIN), escape(role), F.lit(MIDDLE), escape(text), F.lit(END))
    own = t.join(starts.select(*span, "_start"), span).select(*conv, "_start", "ord", F.lit(False).alias("_again"))
    # history: turns that end before a span starts and begin at most ``history`` tokens before it, as far as the window has room
    h = max(1, budget.history)
    some = starts.filter("_start > 0").select(*conv, "_start", "_at", F.explode(F.array(F.floor(F.col("_at") / h), F.floor(F.col("_at") / h) - 1)).alias("_bin"), left.alias("_left"))
    past = t.filter(~F.col("_is_system")).select(*conv, "ord", "_from", F.floor(F.col("_from") / h).alias("_bin"))
    past = past.join(some, [*conv, "_bin"]).filter((F.col("ord") < F.col("_start")) & (F.col("_at") - F.col("_from") <= F.col("_left")))
    past = past.select(*conv, "_start", "ord", F.lit(True).alias("_again"))
    head = starts.filter("_start > 0 and _system is not null").select(*conv, "_start", F.lit(0).cast("long").alias("ord"), F.lit(True).alias("_again"))
    every = own.union(past).union(head).join(texts.select(*conv, "ord", "role", "text", "tokens"), [*conv, "ord"])
    every = every.withColumn("piece", piece(F.col("role"), F.col("text")))
    upto = W.partitionBy(*conv, "_start").orderBy("ord").rowsBetween(W.unboundedPreceding, -1)
    every = every.withColumn("_shift", F.coalesce(F.sum(F.char_length("piece")).over(upto), F.lit(0)))
    lead = F.col("_shift") + F.char_length(F.concat(F.lit(BEGIN), escape(F.col("role")), F.lit(MIDDLE)))
    mask = F.when((F.col("role") == "assistant") & ~F.col("_again"), F.struct(lead.alias("start"), (lead + F.char_length(escape(F.col("text")))).alias("end")))
    out = every.select(*conv, "_start", "ord", "piece", "_again", "tokens", mask.alias("mask")).groupBy(*conv, "_start").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "piece"))), lambda x: x["piece"]), "").alias("formatted"),
        F.array_sort(F.collect_list("mask")).alias("loss"), F.count("*").alias("n_turns"), F.count_if("_again").alias("n_repeated"), F.sum("tokens").alias("n_tokens"))
    names = starts.select(*conv, "_start", "conv_id")
    out = out.join(names, [*conv, "_start"])
    # a conversation has many fewer windows than rows; their numbers go by blocks of turns as well
    out = prefix_sums(out.withColumn("_block", F.floor(F.col("_start") / 4096)), conv, ["_block"], ["_start"], {"window": "1"})
    return out.select("conv_id", "window", "formatted", "loss", "n_turns", "n_repeated", "n_tokens", (F.col("n_tokens") > budget.window).alias("over_budget"))


def read_back(formatted: Column) -> Column:
    """The turns of a window: array of (role, text), unescaped."""
    parts = F.filter(F.split(formatted, r"\Q" + END + r"\E", -1), lambda p: p != "")
    cut_at = lambda p: F.split(F.substr(p, F.lit(len(BEGIN) + 1)), r"\Q" + MIDDLE + r"\E", -1)
    return F.transform(parts, lambda p: F.struct(unescape(cut_at(p)[0]).alias("role"), unescape(cut_at(p)[1]).alias("text")))


def masked_text(formatted: Column, loss: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(loss, lambda s: unescape(F.substr(formatted, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))), "")


def digest(made: DataFrame) -> DataFrame:
    """Per conversation, read back from its windows (their new turns are the
    last ones, after the repeated): ``conv_id, n_turns,
    turns_sha256, loss_chars, loss_sha256, formatted_chars``.

    A digest over a whole conversation needs it in one row; that is the
    digest's definition, the windows themselves are bounded."""
    new = F.slice(read_back(F.col("formatted")), (F.col("n_repeated") + 1).cast("int"), F.greatest(F.lit(1), F.col("n_turns") - F.col("n_repeated")).cast("int"))
    lines = F.array_join(F.transform(new, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    w = made.select("conv_id", "window", (F.col("n_turns") - F.col("n_repeated")).alias("n"), lines.alias("lines"), masked_text(F.col("formatted"), F.col("loss")).alias("loss_text"), F.char_length("formatted").alias("chars"))
    joined = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("window", c))), lambda x: x[c]), "")
    g = w.groupBy("conv_id").agg(F.sum("n").alias("n_turns"), joined("lines").alias("_lines"), joined("loss_text").alias("_loss"), F.sum("chars").alias("formatted_chars"))
    return g.select("conv_id", "n_turns", F.sha2("_lines", 256).alias("turns_sha256"), F.char_length("_loss").cast("long").alias("loss_chars"), F.sha2("_loss", 256).alias("loss_sha256"), F.col("formatted_chars").cast("long"))
