r"""Conversations to training windows of a token budget, with a loss mask, and back. DataFrame work only.

Turns are taken in the order of turn, role and text. Prefix sums of turn tokens choose the spans: a turn that begins
after ``k * budget`` and before ``(k + 1) * budget`` tokens belongs to span k, so spans are aligned to turns and a turn
is never cut. A window holds the conversation's leading system turn, then the turns that begin at most ``history``
tokens before the span, then the span's own turns. Only assistant texts of the span itself are under the loss mask; a
repeated turn is masked, so every assistant text is a target exactly once.

By default the budget is the stride of the spans and no bound of a window: the system turn, the repeated turns and the
rest of the span's last turn come on top. ``within_budget`` makes it a bound. Spans are then ``budget`` less the system
turn and ``history`` wide, a turn that crosses the border of two has a span of its own, and fewer turns are repeated
where a long turn leaves less room. Only one turn that does not fit beside the system turn makes such a window longer,
and no other turn is repeated in it.

A turn is written ``<s>[INST] role [/INST]text</s>``. Control strings inside roles and texts are broken up by a
backslash after their first character, and those that look broken up already get one more, so reading is exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from promolift.llm.common import staged

BUDGET = 512
HISTORY = 128

_CONTROL = r"s>|/s>|INST\]|/INST\]|<SYS>>|</SYS>>"
_TURN = r"(?s)<s>\[INST\] (.*?) \[/INST\](.*?)</s>"


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[])(\\*)({_CONTROL})", r"$1\\$2$3")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[])\\(\\*)({_CONTROL})", r"$1$2$3")


def estimated_tokens(text: Column) -> Column:
    """One token for four bytes of UTF-8 and four for a turn's marks; pass a column of your own for exact counts."""
    return F.ceil(F.octet_length(text) / 4) + 4


def formatted_windows(
    conversations: DataFrame,
    budget: int = BUDGET,
    history: int = HISTORY,
    tokens: Column | None = None,
    id_column: str = "conv_id",
    within_budget: bool = False,
) -> DataFrame:
    """One row per window: conv_id, window_no, text, n_repeated, n_own, and loss_spans.

    Window numbers ascend and may have gaps. ``loss_spans`` are code points of ``text``, end exclusive. The first ``n_repeated`` turns are repeated ones. Null
    ids form one conversation; a null turn sorts first; null roles and texts count as empty; repeated rows are turns of
    their own; other columns, whatever their names, are not read; an empty table gives no windows.
    """
    rows = conversations.select(
        F.col(id_column).alias("conv_id"),
        "turn",
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
        *([] if tokens is None else [tokens.alias("cost")]),
    )
    cost = F.greatest(F.lit(1), estimated_tokens(F.col("text")) if tokens is None else F.col("cost")).cast("long")
    in_order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    before = F.coalesce(F.sum("cost").over(in_order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    system_cost = F.first(F.when(F.col("role") == "system", F.col("cost")).otherwise(0)).over(in_order)
    width = F.greatest(F.lit(1), budget - history - system_cost) if within_budget else F.lit(budget)
    bucket = F.floor(F.col("starts") / F.col("width")).cast("long")
    crosses = F.floor((F.col("starts") + F.col("cost") - 1) / F.col("width")) > bucket
    placed = staged(
        rows.withColumn("cost", cost)
        .withColumn("place", F.row_number().over(in_order))
        .withColumn("starts", before)
        .withColumn("system_cost", system_cost.cast("long"))
        .withColumn("width", width.cast("long"))
        .withColumn("span", 2 * bucket + crosses.cast("long") if within_budget else bucket)
        .withColumn("is_system", (F.col("place") == 1) & (F.col("role") == "system"))
        .select("conv_id", "role", "text", "place", "cost", "starts", "system_cost", "width", "span", "is_system"),
        "turns",
    )
    repeated = _repeated(placed, budget, history, within_budget)
    return _assembled(placed.withColumn("window_no", F.col("span")).unionByName(repeated))


def _repeated(placed: DataFrame, budget: int, history: int, within_budget: bool) -> DataFrame:
    """The turns that later windows repeat: the system turn in all, others in the spans that begin soon enough.

    A turn is looked up only in the spans that can repeat it, at most ``history`` / width + 1 or twice as many within
    the budget, so a conversation's work grows with its turns.
    """
    room = F.greatest(F.lit(0), budget - F.max("system_cost") - F.sum("cost"))
    spans = placed.groupBy(F.col("conv_id").alias("_conv"), F.col("span").alias("window_no")).agg(
        F.min("starts").alias("_span_starts"),
        (F.least(F.lit(history), room) if within_budget else F.lit(history)).alias("_history"),
    )
    same = F.col("conv_id").eqNullSafe(F.col("_conv"))
    system = placed.where("is_system").join(spans, same).where("window_no > span")
    reach = F.floor((F.col("starts") + history) / F.col("width")).cast("long")
    reach = 2 * reach + 1 if within_budget else reach
    later = F.when(reach > F.col("span"), F.sequence(F.col("span") + 1, reach))
    looked_up = placed.where("not is_system").withColumn("_later", F.explode(later))
    recent = looked_up.join(spans, same & (F.col("_later") == F.col("window_no"))).where(
        F.col("starts") >= F.col("_span_starts") - F.col("_history")
    )
    return system.unionByName(recent.drop("_later")).select(*placed.columns, "window_no")


def _assembled(placed: DataFrame) -> DataFrame:
    head = F.concat(F.lit("<s>[INST] "), escaped(F.col("role")), F.lit(" [/INST]"))
    turns = placed.select(
        "conv_id",
        "place",
        "window_no",
        F.concat(head, escaped(F.col("text")), F.lit("</s>")).alias("piece"),
        F.length(head).alias("head_chars"),
        (F.col("role") == "assistant").alias("target"),
        (F.col("window_no") != F.col("span")).alias("repeated"),
    )
    parts = F.sort_array(F.collect_list(F.struct("place", "piece", "head_chars", "target", "repeated")))
    windows = turns.groupBy("conv_id", "window_no").agg(parts.alias("parts"))
    ends = F.aggregate(
        "parts",
        F.array(F.lit(0).cast("long")),
        lambda done, part: F.concat(done, F.array(F.element_at(done, -1) + F.length(part["piece"]))),
    )
    spans_of = F.transform(
        F.filter(
            F.arrays_zip("parts", F.slice("ends", 1, F.size("parts")).alias("start")),
            lambda row: row["parts"]["target"] & ~row["parts"]["repeated"],
        ),
        lambda row: F.struct(
            (row["start"] + row["parts"]["head_chars"]).alias("start"),
            (row["start"] + F.length(row["parts"]["piece"]) - 4).alias("end"),
        ),
    )
    n_repeated = F.size(F.filter("parts", lambda part: part["repeated"]))
    return (
        windows.withColumn("ends", ends)
        .withColumn("loss_spans", spans_of)
        .select(
            "conv_id",
            "window_no",
            F.concat_ws("", F.transform("parts", lambda part: part["piece"])).alias("text"),
            n_repeated.alias("n_repeated"),
            (F.size("parts") - n_repeated).alias("n_own"),
            "loss_spans",
        )
    )


def turns_back(windows: DataFrame) -> DataFrame:
    """One row per window, read from its text: own turns (role, text) in order and unescaped target texts."""
    own = lambda column: F.slice(column, F.col("n_repeated") + 1, F.greatest(F.col("n_own"), F.lit(0)))
    read = lambda group: F.transform(
        own(F.regexp_extract_all("text", F.lit(_TURN), F.lit(group))), lambda value: unescaped(value)
    )
    masked = F.transform("loss_spans", lambda span: unescaped(F.substr("text", span["start"] + 1, span["end"] - span["start"])))
    return windows.select(
        "conv_id",
        "window_no",
        F.arrays_zip(read(1).alias("role"), read(2).alias("text")).alias("turns"),
        masked.alias("targets"),
        F.length("text").alias("chars"),
    )


def read_back(windows: DataFrame) -> DataFrame:
    """One row per conversation: n_turns, all its turns and targets as text, and the windows' length."""
    per_window = turns_back(windows).select(
        "conv_id",
        F.struct(
            "window_no",
            F.size("turns").alias("n_turns"),
            F.concat_ws("", F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))).alias("turns"),
            F.concat_ws("", "targets").alias("targets"),
            "chars",
        ).alias("window"),
    )
    windows_of = F.sort_array(F.collect_list("window"))
    total = lambda name: F.aggregate("w", F.lit(0).cast("long"), lambda done, one: done + one[name])
    return (
        per_window.groupBy("conv_id")
        .agg(windows_of.alias("w"))
        .select(
            "conv_id",
            total("n_turns").alias("n_turns"),
            F.concat_ws("", F.transform("w", lambda one: one["turns"])).alias("turns"),
            F.concat_ws("", F.transform("w", lambda one: one["targets"])).alias("targets"),
            total("chars").alias("formatted_chars"),
        )
    )
