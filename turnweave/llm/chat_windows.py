"""Chat formatting in budgeted windows, with DataFrame functions only.

The running sum of turn tokens places every turn on its conversation's token axis. The axis is cut into equal cells, and a window
takes the turns that start in its cell, so spans keep whole turns. Before them it repeats the system turn and the latest
turns of the window before, up to a limit. Repeated turns are masked: each assistant turn is a target once.

A conversation may hold a third of all turns. Running sums are taken in bins that are summed up afterwards, and all
other work is per window, so no task sees a whole conversation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from turnweave.llm.tables import kept
from turnweave.operators.running import Running, running

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
BUDGET = 1_024
HISTORY = 256
TURN_BIN = 4_096
OVERHEAD = 4  # tokens of a turn's marks


def escaped(text: Column) -> Column:
    """Text in which no control string occurs: between ``<`` and ``|`` goes one more ``!``."""
    return F.regexp_replace(text, r"<(!*n?)\|", r"<!$1|")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<!(!*n?)\|", r"<$1|")


def escaped_role(role: Column) -> Column:
    """As ``escaped``; line breaks, which would end the role, become ``<n|``."""
    return F.replace(escaped(role), F.lit("\n"), F.lit("<n|"))


def unescaped_role(role: Column) -> Column:
    return unescaped(F.replace(role, F.lit("<n|"), F.lit("\n")))


def estimated_tokens(text: Column) -> Column:
    """One token per four characters, and the marks of the turn."""
    return (F.ceil(F.char_length(text) / 4) + OVERHEAD).cast("bigint")


def windows(
    turns: DataFrame,
    conversation: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    tokens: Column | None = None,
    budget: int = BUDGET,
    history: int = HISTORY,
) -> DataFrame:
    """One row per window: conversation, window, formatted, n_tokens, n_repeated, targets.

    ``formatted`` has the turns as ``<|im_start|>role``, a line break, the text and ``<|im_end|>`` with a line break;
    control strings inside roles and texts are escaped reversibly. ``n_repeated`` counts the leading turns that another window has
    as its own: the system turn, then history. ``targets`` lists (start, size) in code points of ``formatted`` for the texts of the
    window's own assistant turns, the loss mask. ``window`` numbers cells of the token axis, so numbers may be skipped.

    A window keeps to ``budget`` unless one of its turns alone exceeds half of what system turn and history leave. The
    first system turn of a conversation is the one repeated. Turns are ordered by turn, role and text; null texts and
    roles are empty, a null turn comes as -1, and a null conversation is one of its own. Repeated rows are turns like any
    other. Further columns are ignored, whatever their names. ``tokens`` replaces the estimate (an expression over ``_text``).
    """
    rows = turns.select(
        F.coalesce(F.col(conversation).cast("string"), F.lit("")).alias("_conv"),
        F.coalesce(F.col(turn).cast("bigint"), F.lit(-1)).alias("_turn"),
        F.coalesce(F.col(role).cast("string"), F.lit("")).alias("_role"),
        F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_text"),
    )
    rows = rows.withColumn("_tokens", tokens if tokens is not None else estimated_tokens(F.col("_text")))
    rows = rows.withColumn("_bin", F.floor(F.col("_turn") / TURN_BIN))
    summed = running(rows, ["_conv"], "_bin", ["_turn", "_role", "_text"], _start=Running("sum", F.col("_tokens")))
    system = rows.filter("_role = 'system'").groupBy("_conv").agg(
        F.min(F.struct("_turn", "_text", "_tokens")).alias("system")
    )
    summed = summed.join(kept(system, "system-turns"), "_conv", "left")
    # Two cells' worth of turns and all that is repeated stay within the budget.
    share = F.greatest(F.lit(1), (F.lit(budget - history) - F.coalesce("system._tokens", F.lit(0))) / 2).cast("bigint")
    placed = summed.withColumn("_cell", F.floor(F.col("_start") / share)).withColumn("_share", share)
    inside = Window.partitionBy("_conv", "_cell")
    placed = kept(
        placed.withColumn("_end", F.max(F.col("_start") + F.col("_tokens")).over(inside))
        .withColumn("_line", F.row_number().over(inside.orderBy("_start")))
        .drop("_bin"),
        "placed-turns",
    )
    cells = placed.filter("_line = 1").select(
        "_conv", "_cell", "system", (F.col("_turn") == F.col("system._turn")).alias("_first")
    )
    own = placed.select("_conv", "_cell", F.lit(2).alias("_part"), "_start", "_turn", "_role", "_text", "_tokens")
    # The next window begins where this one ends; what starts within the limit before that is its history.
    following = F.floor(F.col("_end") / F.col("_share"))
    late = (F.col("_start") >= F.col("_end") - history) & (following > F.col("_cell"))
    before = placed.filter(late).select(
        "_conv", following.alias("_cell"), F.lit(1).alias("_part"),
        "_start", "_turn", "_role", "_text", "_tokens",
    ).join(cells.select("_conv", "_cell"), ["_conv", "_cell"], "left_semi")
    both = own.union(before)
    # Windows that show the system turn as their own or as history do not repeat it.
    is_system = (F.col("_role") == "system") & (F.col("_turn") == F.col("s._turn")) & (F.col("_text") == F.col("s._text"))
    shown = (
        both.join(placed.filter("_line = 1").select("_conv", "_cell", F.col("system").alias("s")), ["_conv", "_cell"])
        .filter(is_system)
        .select("_conv", "_cell")
        .distinct()
    )
    repeated = cells.filter("system is not null").join(shown, ["_conv", "_cell"], "left_anti").select(
        "_conv", "_cell", F.lit(0).alias("_part"), F.lit(-1).cast("bigint").alias("_start"), "system._turn",
        F.lit("system").alias("_role"), "system._text", "system._tokens",
    )
    return _formatted(both.union(repeated)).withColumnRenamed("_conv", conversation)


def _formatted(parts: DataFrame) -> DataFrame:
    head = F.concat(F.lit(OPEN), escaped_role(F.col("_role")), F.lit("\n"))
    shown = parts.select(
        "_conv", "_cell", "_part", "_start", "_tokens",
        ((F.col("_part") == 2) & (F.col("_role") == "assistant")).alias("target"),
        F.char_length(head).alias("before"),
        escaped(F.col("_text")).alias("body"),
        F.concat(head, escaped(F.col("_text")), F.lit(CLOSE + "\n")).alias("shown"),
    )
    line = Window.partitionBy("_conv", "_cell").orderBy("_part", "_start").rowsBetween(Window.unboundedPreceding, -1)
    placed = shown.withColumn("at", F.coalesce(F.sum(F.char_length("shown")).over(line), F.lit(0)))
    order = ("_part", "_start")
    span = F.struct((F.col("at") + F.col("before")).alias("start"), F.char_length("body").cast("bigint").alias("size"))
    return (
        placed.groupBy("_conv", "_cell")
        .agg(
            F.array_sort(F.collect_list(F.struct(*order, "shown"))).alias("lines"),
            F.sum("_tokens").alias("n_tokens"),
            F.sum(F.when(F.col("_part") < 2, 1).otherwise(0)).alias("n_repeated"),
            F.array_sort(F.collect_list(F.when(F.col("target"), span))).alias("targets"),
        )
        .select(
            F.expr("try_cast(_conv as bigint)").alias("_conv"),
            F.col("_cell").alias("window"),
            F.array_join(F.col("lines.shown"), "").alias("formatted"),
            "n_tokens",
            "n_repeated",
            "targets",
        )
    )


def turns_of(formatted: Column) -> Column:
    """The turns (role, text) of a formatted window, unescaped."""
    split = F.split(formatted, r"<\|im_start\|>")
    pieces = F.slice(split, F.lit(2), F.size(split))

    def turn(piece: Column) -> Column:
        cut = F.locate("\n", piece)
        body = F.substring(piece, cut + 1, F.char_length(piece) - cut - len(CLOSE) - 1)
        return F.struct(unescaped_role(F.substring(piece, F.lit(1), cut - 1)).alias("role"), unescaped(body).alias("text"))

    return F.transform(pieces, turn)


def under_mask(formatted: Column, targets: Column) -> Column:
    """The unescaped texts under the loss mask, in order."""
    return F.transform(targets, lambda t: unescaped(F.substring(formatted, (t["start"] + 1).cast("int"), t["size"].cast("int"))))
