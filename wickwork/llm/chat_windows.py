"""Conversations as budgeted training windows, with a loss mask.

A conversation's turns are packed into windows of at most ``budget`` tokens, cut at turns. Prefix
sums of turn tokens choose the spans: a turn belongs to the stride of ``step`` tokens in which it
begins, a turn longer than that has a window of its own. Each further window repeats the leading
system turn and as much of the turns before it as ``history`` tokens allow (of the window before
only). Repeated turns are context: their assistant texts are not under the loss mask again, so
every assistant text is a target exactly once.

Template, for each turn: ``<|im_start|>role\\ntext<|im_end|>\\n``. Control strings inside roles and
texts are escaped by a backslash after the ``<`` (and one more where there are some already), line
breaks in roles are written ``<|nl|>``; :func:`parsed` and :func:`unescaped` undo both.

DataFrame functions only. Running sums are taken within blocks of turns, after sums per block, so
that a conversation of any length is shared out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, END, BREAK = "<|im_start|>", "<|im_end|>", "<|nl|>"
BUDGET = 2048
HISTORY = 256
#: Tokens of the template around a turn.
FRAME = 5
#: Turns summed up together.
BLOCK = 512


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def tokens(text: Column) -> Column:
    """Words and single signs: the size of a turn, until a tokenizer has been chosen."""
    return F.regexp_count(text, F.lit(r"\w+|[^\w\s]")).cast("long")


def _prefix_sums(turns: DataFrame) -> DataFrame:
    """``_before``: tokens of all earlier turns of the conversation."""
    block = F.coalesce(F.floor(F.col("turn") / BLOCK).cast("long"), F.lit(-(2**60)))
    turns = turns.withColumn("_block", block)
    sums = turns.groupBy("conv_id", "_block").agg(F.sum("_tokens").alias("_sum"))
    earlier = Window.partitionBy("conv_id").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(
        F.col("conv_id").alias("_conv"), F.col("_block").alias("_b"), F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_start")
    )
    order = Window.partitionBy("conv_id", "_block").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, -1)
    inside = turns.withColumn("_within", F.coalesce(F.sum("_tokens").over(order), F.lit(0)))
    joined = inside.join(sums, inside.conv_id.eqNullSafe(sums._conv) & (inside._block == sums._b))
    return joined.withColumn("_before", F.col("_start") + F.col("_within")).drop("_conv", "_b", "_start", "_within", "_block")


def chat_windows(
    turns: DataFrame,
    budget: int = BUDGET,
    history: int = HISTORY,
    system_budget: int = 256,
) -> DataFrame:
    """One row per window: conv_id, window (from 0), formatted, loss_spans, n_turns, n_repeated, n_tokens.

    ``loss_spans`` are (start, end) in code points of ``formatted``; ``n_repeated`` counts the
    leading turns that are context from earlier windows. Rows are ordered by turn, then role and text (ties,
    repeated rows: each is a turn of its own); a null turn comes first, null roles and texts are
    empty, a null conv_id is one conversation. A window exceeds ``budget`` only if one turn does, or if
    the system turn exceeds ``system_budget``. An empty table gives no rows. Columns other than
    conv_id, turn, role and text play no part.
    """
    step = (budget - history - system_budget) // 2
    if step < 1:
        raise ValueError("the budget leaves no room for turns beside system turn and history")
    named = turns.select(
        "conv_id",
        F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    sized = _prefix_sums(named.withColumn("_tokens", tokens(F.col("text")) + FRAME))
    # Even numbers: turns that begin in one stride. Odd: a turn longer than a stride.
    cell = F.floor(F.col("_before") / step) * 2 + (F.col("_tokens") > step).cast("long")
    sized = sized.withColumn("_cell", cell)

    of_conversation = Window.partitionBy("conv_id").orderBy("_cell")
    cells = sized.groupBy("conv_id", "_cell").agg(F.min("_before").alias("_from"))
    cells = cells.select(
        F.col("conv_id").alias("_conv"),
        F.col("_cell").alias("_c"),
        (F.row_number().over(of_conversation) - 1).cast("long").alias("window"),
        F.lead("_from").over(of_conversation).alias("_next_from"),
        F.max("_cell").over(Window.partitionBy("conv_id")).alias("_last_cell"),
    )
    placed = sized.join(cells, sized.conv_id.eqNullSafe(cells._conv) & (sized._cell == cells._c))
    leading = (F.col("_before") == 0) & (F.col("role") == "system") & (F.col("window") == 0)
    near = F.col("_next_from") - F.col("_before") <= history
    again = F.when(leading | near.isNull() | ~near, F.array()).otherwise(F.array(F.col("window") + 1))
    again = F.when(leading, F.lit(None)).otherwise(again).cast("array<bigint>")

    fields = ("turn", "_before", "role", "text", "_tokens")
    own = F.array(F.struct("window", F.lit(False).alias("repeated")))
    repeats = F.transform(again, lambda w: F.struct(w.alias("window"), F.lit(True).alias("repeated")))
    shown = placed.select("conv_id", *fields, F.explode(F.concat(own, F.coalesce(repeats, F.array().cast("array<struct<window:bigint,repeated:boolean>>")))).alias("_at"))
    shown = shown.select("conv_id", *fields, "_at.window", "_at.repeated")

    system = placed.where(leading).select(
        F.col("conv_id").alias("_conv"), F.struct(F.lit(True).alias("repeated"), *[F.col(f) for f in fields]).alias("_system")
    )
    gathered = shown.groupBy("conv_id", "window").agg(
        F.sort_array(F.collect_list(F.struct("_before", "turn", "role", "text", "repeated", "_tokens"))).alias("_turns")
    )
    joined = gathered.join(system, gathered.conv_id.eqNullSafe(system._conv) & (gathered.window > 0), "left")
    one = "struct<repeated:boolean,role:string,text:string,_tokens:bigint>"
    listed = F.transform("_turns", lambda t: F.struct(t["repeated"].alias("repeated"), t["role"].alias("role"), t["text"].alias("text"), t["_tokens"].alias("_tokens")))
    first = F.when(F.col("_system").isNull(), F.array().cast(f"array<{one}>")).otherwise(
        F.array(F.struct(F.col("_system.repeated").alias("repeated"), F.col("_system.role").alias("role"), F.col("_system.text").alias("text"), F.col("_system._tokens").alias("_tokens")))
    )
    windows = joined.select("conv_id", "window", F.concat(first, listed).alias("_turns"))

    pieces = F.transform(
        "_turns",
        lambda t: F.struct(
            F.concat(F.lit(START), F.regexp_replace(escaped(t["role"]), "\n", BREAK), F.lit("\n")).alias("head"),
            escaped(t["text"]).alias("body"),
            ((t["role"] == "assistant") & ~t["repeated"]).alias("target"),
        ),
    )
    windows = windows.withColumn("_pieces", pieces)
    tail = len(END) + 1
    # Running offset of each piece; the spans of target bodies.
    state = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))
    spans = F.aggregate(
        F.transform("_pieces", lambda p: F.struct(F.length(p["head"]).alias("head"), F.length(p["body"]).alias("body"), p["target"].alias("target"))),
        state,
        lambda s, p: F.struct(
            (s["at"] + p["head"] + p["body"] + tail).alias("at"),
            F.when(
                p["target"],
                F.concat(s["spans"], F.array(F.struct((s["at"] + p["head"]).alias("start"), (s["at"] + p["head"] + p["body"]).alias("end")))),
            )
            .otherwise(s["spans"])
            .alias("spans"),
        ),
    )
    return windows.select(
        "conv_id",
        "window",
        F.array_join(F.transform("_pieces", lambda p: F.concat(p["head"], p["body"], F.lit(f"{END}\n"))), "").alias("formatted"),
        spans["spans"].alias("loss_spans"),
        F.size("_turns").cast("long").alias("n_turns"),
        F.size(F.filter("_turns", lambda t: t["repeated"])).cast("long").alias("n_repeated"),
        F.aggregate("_turns", F.lit(0).cast("long"), lambda s, t: s + t["_tokens"]).alias("n_tokens"),
    )


def parsed(formatted: Column) -> Column:
    """The turns of a formatted window: array of (role, text), unescaped."""
    pieces = F.slice(F.split(formatted, r"<\|im_start\|>"), 2, 2**30)
    bare = F.transform(pieces, lambda p: F.substring_index(p, END, 1))

    def turn(piece: Column) -> Column:
        role = F.substring_index(piece, "\n", 1)
        text = piece.substr(F.length(role) + 2, F.length(piece))
        return F.struct(unescaped(F.regexp_replace(role, r"<\|nl\|>", "\n")).alias("role"), unescaped(text).alias("text"))

    return F.transform(bare, turn)


def masked(formatted: Column, spans: Column) -> Column:
    """The texts under the loss mask, unescaped, one after the other."""
    return F.array_join(F.transform(spans, lambda s: unescaped(formatted.substr(s["start"] + 1, s["end"] - s["start"]))), "")
