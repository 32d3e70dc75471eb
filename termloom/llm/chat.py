r"""Chat formatting from an event log, with DataFrame functions only.

Events are (conv_id, seq, turn, role, op, text). ``message`` (or a null op) is a
whole message; ``delta`` adds text to the turn; ``edit`` and ``regenerate`` replace
what the turn held by their own text, and later deltas add to that. Events are
dealt out by conversation and turn, sorted by sequence and folded into final
messages; these are sorted by turn and rendered.

A turn is rendered as ``<turn ROLE>TEXT</turn>`` and a newline. In roles and texts a
backslash becomes ``\b``, ``<`` becomes ``\l`` and ``>`` becomes ``\g``, so no text can
hold a control string, and ``read_back`` restores every text exactly. The loss mask is
a list of [start, end) spans, in code points of the formatted string, one for each
assistant text.

Folding is dealt out by conversation and turn, so a conversation with very many
deltas is spread; only its final messages meet in one task, as its formatted string
is one value.

Defined cases: null text and null role are empty; message rows that share
conversation and turn stay separate messages, ordered by sequence, role and text;
of a turn with delta, edit or regenerate events one message comes out, with the role
of its last event that has one; a null conversation id is a conversation; an empty
log gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The template's control strings and the escapes.
TURN, ROLE_END, TURN_END = "<turn ", ">", "</turn>\n"
ESCAPES = (("\\", "\\b"), ("<", "\\l"), (">", "\\g"))
STREAMED = ("delta", "edit", "regenerate")


def escape(text: Column) -> Column:
    for plain, coded in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(coded))
    return text


def unescape(text: Column) -> Column:
    for plain, coded in reversed(ESCAPES):
        text = F.replace(text, F.lit(coded), F.lit(plain))
    return text


def fold(events: DataFrame) -> DataFrame:
    """Final messages (conv_id, turn, place, role, text)."""
    e = events.select("conv_id", F.col("seq").cast("long").alias("seq"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.coalesce(F.col("op"), F.lit("message")).alias("op"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    turn = Window.partitionBy("conv_id", "turn")
    ordered = turn.orderBy("seq", "role", "text")
    starts = F.col("op") != "delta"
    e = e.select("*", F.max(F.col("op").isin(*STREAMED)).over(turn).alias("streamed"), F.max(F.when(starts, F.col("seq"))).over(turn).alias("reset"), F.row_number().over(ordered).alias("n"), F.max(F.when(F.col("role").isNotNull(), F.struct("seq", "role"))).over(turn).alias("last"))
    e = e.where(~F.col("streamed") | F.col("reset").isNull() | (F.col("seq") >= F.col("reset")))
    place = F.when(F.col("streamed"), F.lit(0)).otherwise(F.col("n"))
    part = F.struct("seq", (~starts).alias("later"), "text")
    spoken = F.when(F.col("streamed"), F.col("last.role")).otherwise(F.col("role"))
    folded = e.groupBy("conv_id", "turn", place.alias("place"), F.coalesce(spoken, F.lit("")).alias("role")).agg(F.array_sort(F.collect_list(part)).alias("parts"))
    return folded.select("conv_id", "turn", "place", "role", F.array_join(F.col("parts.text"), "").alias("text"))


def render(messages: DataFrame) -> DataFrame:
    """(conv_id, formatted, loss_spans) of each conversation."""
    piece = F.concat(F.lit(TURN), escape(F.col("role")), F.lit(ROLE_END), escape(F.col("text")), F.lit(TURN_END))
    in_order = Window.partitionBy("conv_id").orderBy("turn", "place", "role", "text")
    m = messages.withColumn("piece", piece).withColumn("n", F.row_number().over(in_order)).withColumn("end", F.sum(F.length("piece")).over(in_order.rowsBetween(Window.unboundedPreceding, 0)))
    body_end = F.col("end") - len(TURN_END)
    span = F.when(F.col("role") == "assistant", F.struct((body_end - F.length(escape(F.col("text")))).cast("long").alias("start"), body_end.cast("long").alias("end")))
    rows = m.select("conv_id", F.struct("n", "piece").alias("p"), span.alias("span"))
    whole = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("p")).alias("pieces"), F.array_sort(F.collect_list("span")).alias("loss_spans"))
    return whole.select("conv_id", F.array_join(F.col("pieces.piece"), "").alias("formatted"), "loss_spans")


def read_back(formatted: Column) -> Column:
    """The turns of a formatted string: array of (role, text)."""
    turns = F.filter(F.split(formatted, TURN_END, -1), lambda t: t != "")
    fields = F.transform(turns, lambda t: F.split(t, "[<>]", -1))
    return F.transform(fields, lambda f: F.struct(unescape(F.substr(F.get(f, F.lit(1)), F.lit(len(TURN)))).alias("role"), unescape(F.get(f, F.lit(2))).alias("text")))


def format_log(events: DataFrame) -> DataFrame:
    """(conv_id, formatted, loss_spans) of an event log."""
    return render(fold(events))


def digests(formatted: DataFrame) -> DataFrame:
    """What a reader of the formatted strings gets: counts and digests by conversation."""
    d = formatted.withColumn("turns", read_back(F.col("formatted")))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    masked = F.array_join(F.transform("loss_spans", lambda s: unescape(F.substr(F.col("formatted"), (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))), "")
    d = d.withColumn("masked", masked)
    return d.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.length("masked").cast("long").alias("loss_chars"), F.sha2("masked", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )
