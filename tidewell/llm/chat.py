"""Chat formatting in budgeted windows, in DataFrame functions only (operator 7)."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.llm.common import few, staged

# fixed values: the template's own marks, and foreign control strings that texts may hold
TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
CONTROL = [TURN, TEXT, END, "<|system|>", "<|user|>", "<|assistant|>", "<|im_start|>", "<|im_end|>", "<|endoftext|>",
           "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"]
#: Tokens of a window, and those among them that are kept for history.
BUDGET, HISTORY = 2048, 256
#: Spans are chosen one after another within this many budgets of tokens, and anew from there.
BLOCK_BUDGETS = 16
#: Turns whose prefix sums are taken in one window partition.
RUN_TURNS = 1024
SYSTEM, TARGET = "system", "assistant"

#: The first character of a control string, which an escape mark follows.
_FIRST = r"([<\[])(?=" + "|".join(re.sub(r"([|\]])", r"\\\1", c[1:]) for c in CONTROL) + ")"


def escape(text: Column) -> Column:
    r"""No control string is left in the result: ``\`` is doubled, and a control string gets a ``\`` after its first character."""
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit(_FIRST), F.lit(r"$1\\"))


def unescape(text: Column) -> Column:
    r"""Inverse of ``escape``: a single ``\`` goes, a double one becomes one."""
    return F.regexp_replace(text, F.lit(r"\\(\\?)"), F.lit("$1"))


def token_estimate(text: Column) -> Column:
    """A native stand-in for a token count: a token for every four bytes, begun ones too."""
    return F.ceil(F.octet_length(text) / 4).cast("long")


def format_windows(turns: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
                   budget: int = BUDGET, history: int = HISTORY, tokens=token_estimate, target: str = TARGET) -> DataFrame:
    """Conversations as training windows: ``(<conv_col>, window, formatted, loss, n_turns, n_repeated, n_tokens)``.

    A turn is written ``<|turn|>role<|text|>text<|end|>`` with control strings inside role and text
    escaped.  A window holds ``budget`` tokens at most: the conversation's first system turn (unless
    that is among its own turns), the turns just before it within ``history`` tokens, and the longest
    span of its own turns that fits into the rest, by prefix sums of the turns' tokens.  Spans follow
    one another within blocks of ``BLOCK_BUDGETS`` budgets, where they begin anew.  Only a single own
    turn that is longer than its room goes beyond the budget; such a window repeats no history.

    ``window`` is the place of its first own turn.  ``n_repeated`` counts the turns before that.
    ``loss`` has the spans (``first``, ``n`` in code points) of the window's own ``target`` texts;
    repeated ones are masked, so each counts once.

    Prefix sums run in two levels, over runs of turn numbers and then over the runs' totals, and spans
    are chosen by block on numbers alone, so that a very long conversation spreads over many tasks.
    Only one window's turns are gathered at a time.

    Turns are ordered by turn number, then role, then text.  Null role and text are empty; a null
    turn number comes first, a null conversation id is a conversation of its own.  Repeated rows are
    turns of their own.  An empty table gives no windows; other columns are ignored.
    """
    if not 0 <= history <= budget:
        raise ValueError("history must be between 0 and the budget")
    placed = staged(_placed(turns, conv_col, turn_col, role_col, text_col, tokens), "turns")
    sized = placed.select("conv", "pos", "start", "n_tok", (F.col("role") == SYSTEM).alias("is_system"))
    system = sized.where("is_system").groupBy(F.col("conv").alias("s_conv")).agg(F.min_by(F.struct("pos", "n_tok"), "pos").alias("s"))
    roomy = sized.join(system, F.col("conv").eqNullSafe(F.col("s_conv")), "left") \
        .select("conv", "pos", "start", "n_tok", F.col("s.pos").alias("s_pos"), F.greatest(F.lit(budget - history) - F.coalesce("s.n_tok", F.lit(0)), F.lit(0)).cast("long").alias("room"))
    windows = staged(_spans(roomy, budget), "windows")
    targets = staged(_targets(sized, windows, history), "window-turns")
    parts = placed.join(few(targets), F.col("conv").eqNullSafe(F.col("t_conv")) & (F.col("pos") == F.col("t_pos"))) \
        .select("conv", "window", "kind", "pos", "role", "raw", "n_tok")
    return _assembled(parts, target).withColumnRenamed("conv", conv_col)


def _placed(turns: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str, tokens) -> DataFrame:
    """``(conv, role, raw, n_tok, pos, start)``: each turn's place from 1 and the tokens before it."""
    role, text = F.coalesce(F.col(role_col).cast("string"), F.lit("")), F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = turns.select(F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"), role.alias("role"), text.alias("raw"),
                        tokens(_written(role, text)).alias("n_tok"), F.floor(F.col(turn_col) / F.lit(RUN_TURNS)).cast("long").alias("run"))
    inside = Window.partitionBy("conv", "run").orderBy("turn", "role", "raw")
    rows = rows.withColumns({"nth": F.row_number().over(inside), "upto": F.sum("n_tok").over(inside.rowsBetween(Window.unboundedPreceding, 0))})
    earlier = Window.partitionBy("t_conv").orderBy("t_run").rowsBetween(Window.unboundedPreceding, -1)
    # the runs' totals come from rows without texts
    runs = rows.select("conv", "run", "nth", "upto").groupBy(F.col("conv").alias("t_conv"), F.col("run").alias("t_run")).agg(F.max("upto").alias("tok"), F.max("nth").alias("n")) \
        .withColumns({"tok_before": F.coalesce(F.sum("tok").over(earlier), F.lit(0)), "n_before": F.coalesce(F.sum("n").over(earlier), F.lit(0))}) \
        .where("n_before > 0").select("t_conv", "t_run", "tok_before", "n_before")
    none = F.lit(0).cast("long")
    return rows.join(runs, F.col("conv").eqNullSafe(F.col("t_conv")) & F.col("run").eqNullSafe(F.col("t_run")), "left").select(
        "conv", "role", "raw", "n_tok", (F.coalesce("n_before", none) + F.col("nth")).alias("pos"), (F.coalesce("tok_before", none) + F.col("upto") - F.col("n_tok")).alias("start"))


def _spans(roomy: DataFrame, budget: int) -> DataFrame:
    """``(w_conv, window, last, w_start, own, room, s_pos)``: in each block, spans of turns as long as the room allows."""
    size = F.lit(BLOCK_BUDGETS * budget)
    blocks = roomy.groupBy("conv", F.floor(F.col("start") / size).alias("block"), "room", "s_pos") \
        .agg(F.sort_array(F.collect_list(F.struct("pos", "start", "n_tok"))).alias("turns"))
    empty = F.array().cast("array<struct<window: bigint, w_start: bigint>>")

    def step(acc, t):
        fits = (acc["used"] > 0) & (acc["used"] + t["n_tok"] <= acc["room"])
        return F.struct(F.when(fits, acc["used"] + t["n_tok"]).otherwise(t["n_tok"]).alias("used"), acc["room"].alias("room"),
                        F.when(fits, acc["begins"]).otherwise(F.array_append(acc["begins"], F.struct(t["pos"].alias("window"), t["start"].alias("w_start")))).alias("begins"))

    begins = F.aggregate("turns", F.struct(F.lit(0).cast("long").alias("used"), F.col("room"), empty.alias("begins")), step)["begins"]
    end = F.element_at("turns", -1)
    found = blocks.select("conv", "room", "s_pos", end["pos"].alias("b_last"), (end["start"] + end["n_tok"]).alias("b_end"), begins.alias("begins"))
    after = F.concat(F.slice("begins", F.lit(2), F.size("begins")), F.array(F.struct((F.col("b_last") + 1).alias("window"), F.col("b_end").alias("w_start"))))
    each = found.select(F.col("conv").alias("w_conv"), "room", "s_pos", F.inline(F.zip_with("begins", after, lambda a, b: F.struct(
        a["window"].alias("window"), (b["window"] - 1).alias("last"), a["w_start"].alias("w_start"), (b["w_start"] - a["w_start"]).alias("own")))))
    return each.select("w_conv", "window", "last", "w_start", "own", "room", "s_pos")


def _targets(sized: DataFrame, windows: DataFrame, history: int) -> DataFrame:
    """``(t_conv, window, t_pos, kind)``: which turns a window holds, as system turn (0), history (1) or its own (2)."""
    own = windows.select(F.col("w_conv").alias("t_conv"), "window", F.explode(F.sequence("window", "last")).alias("t_pos"), F.lit(2).alias("kind"))
    system = windows.where("s_pos < window").select(F.col("w_conv").alias("t_conv"), "window", F.col("s_pos").alias("t_pos"), F.lit(0).alias("kind"))
    # a turn that starts within `history` tokens before a window is in the window's stretch of that many tokens, or in the one before
    stretch = lambda c: F.floor(F.col(c) / F.lit(max(1, history)))
    near = windows.where((F.col("own") <= F.col("room")) & (F.lit(history) > 0)).select("w_conv", "window", "w_start", F.explode(F.array(stretch("w_start"), stretch("w_start") - 1)).alias("w_stretch"))
    before = sized.join(near, F.col("conv").eqNullSafe(F.col("w_conv")) & (stretch("start") == F.col("w_stretch")) & (F.col("pos") < F.col("window")) & (F.col("w_start") - F.col("start") <= history)) \
        .select(F.col("conv").alias("t_conv"), "window", F.col("pos").alias("t_pos"), F.lit(1).alias("kind"))
    return own.unionByName(system.unionByName(before).groupBy("t_conv", "window", "t_pos").agg(F.min("kind").alias("kind")))


def _written(role: Column, text: Column) -> Column:
    return F.concat(_head(role), escape(text), F.lit(END))


def _head(role: Column) -> Column:
    return F.concat(F.lit(TURN), escape(role), F.lit(TEXT))


def _assembled(parts: DataFrame, target: str) -> DataFrame:
    """One row a window from its turns."""
    part = F.struct("kind", "pos", _head(F.col("role")).alias("head"), escape(F.col("raw")).alias("body"), "n_tok", ((F.col("role") == target) & (F.col("kind") == 2)).alias("is_target"))
    turns = parts.groupBy("conv", "window").agg(F.sort_array(F.collect_list(part)).alias("all"))
    whole = lambda t: F.concat(t["head"], t["body"], F.lit(END))
    sizes = F.transform("all", lambda t: F.char_length(whole(t)))
    # places of the turns: a running sum by fold, over one window's turns
    places = F.aggregate(sizes, F.struct(F.array().cast("array<int>").alias("at"), F.lit(0).alias("sum")),
                         lambda acc, n: F.struct(F.array_append(acc["at"], acc["sum"]).alias("at"), (acc["sum"] + n).alias("sum")))
    spans = F.transform(F.filter(F.arrays_zip(F.col("all").alias("t"), F.col("at").alias("p")), lambda x: x["t"]["is_target"]),
                        lambda x: F.struct((x["p"] + F.char_length(x["t"]["head"])).alias("first"), F.char_length(x["t"]["body"]).alias("n")))
    return turns.withColumn("at", places["at"]).select(
        "conv", "window", F.array_join(F.transform("all", whole), "").alias("formatted"), spans.alias("loss"),
        F.size("all").alias("n_turns"), F.size(F.filter("all", lambda t: t["kind"] < 2)).alias("n_repeated"),
        F.aggregate("all", F.lit(0).cast("long"), lambda acc, t: acc + t["n_tok"]).alias("n_tokens"))


def parse_window(formatted: Column, n_repeated: Column) -> Column:
    """The window's own turns read back from its text: ``array<struct<role, text>>``."""
    parts = F.split(formatted, TURN.replace("|", r"\|"), -1)
    turns = F.slice(parts, n_repeated + 2, F.greatest(F.size(parts) - 1 - n_repeated, F.lit(0)))
    half = lambda t, k: F.get(F.split(F.left(t, F.char_length(t) - len(END)), TEXT.replace("|", r"\|"), -1), k)
    return F.transform(turns, lambda t: F.struct(unescape(half(t, 0)).alias("role"), unescape(half(t, 1)).alias("text")))


def loss_text(formatted: Column, loss: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    return F.array_join(F.transform(loss, lambda s: unescape(F.substring(formatted, s["first"] + 1, s["n"]))), "")
