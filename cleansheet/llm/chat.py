"""Chat formatting from an event log: fold each conversation's events into messages, then render them.

All steps are DataFrame operations. An event says what happened to a message
of a conversation, in the order of `seq`:

- `delta` (or null): its text is appended to the message
- `edit`: its text replaces what the message has said so far
- `regenerate`: the message starts anew, and what later messages had said
  before this event is withdrawn

Other kinds of events change nothing. Events of equal seq count in the order
of kind, then text; null seqs come first. A null text is empty. Events that
repeat in full are folded like any others. A message's role is its first one
that is not null; a message without any has an empty role. Messages of which
nothing is left but withdrawn events disappear. Columns other than the six
named ones are ignored.

A conversation becomes one row and one text, so it has to fit into a cell;
its messages are folded separately before that.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN, CLOSE, INSTRUCT, ANSWER = "<s>", "</s>", "[INST]", "[/INST]"
_CONTROL = r"(?:s>|INST\])"
LEARNED_ROLE = "assistant"


def escape(text: Column) -> Column:
    """Put a backslash behind the opening bracket of every control string, and one more where some stand already."""
    return F.regexp_replace(text, rf"([<\[])(\\*)(/?{_CONTROL})", r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[])\\(\\*)(/?{_CONTROL})", "$1$2$3")


def _role_out(role: Column) -> Column:
    return escape(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")))


def _role_in(role: Column) -> Column:
    return F.replace(F.replace(unescape(role), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def fold_events(events: DataFrame) -> DataFrame:
    """(conv_id, message, role, text): the messages that an event log leaves behind.

    Expects conv_id, seq, message, event, role and text.
    """
    log = events.select("conv_id", "message", "seq", F.coalesce("event", F.lit("delta")).alias("event"), "role", "text")
    by_seq = F.struct("seq", "event", "text")
    messages = log.groupBy("conv_id", "message").agg(
        F.max(F.when(F.col("event") == "regenerate", F.col("seq"))).alias("anew"),
        F.min(F.when(F.col("role").isNotNull(), F.struct("seq", "event", "role"))).alias("first"),
        F.sort_array(F.collect_list(by_seq)).alias("log"))
    before = Window.partitionBy("conv_id").orderBy("message").rowsBetween(Window.unboundedPreceding, -1)
    messages = messages.withColumn("withdrawn", F.max("anew").over(before))
    live = F.filter("log", lambda e: F.col("withdrawn").isNull() | (e["seq"] > F.col("withdrawn")))
    messages = messages.select(
        "conv_id", "message", F.coalesce(F.col("first.role"), F.lit("")).alias("role"), live.alias("log"))
    messages = messages.where(F.size("log") > 0).withColumn("reset", F.array_max(F.transform(
        "log", lambda e, i: F.when(e["event"].isin("edit", "regenerate"), i))))
    said = F.filter("log", lambda e, i: (
        e["event"].isin("delta", "edit") & (F.col("reset").isNull() | (i >= F.col("reset")))))
    text = F.array_join(F.transform(said, lambda e: F.coalesce(e["text"], F.lit(""))), "")
    return messages.select("conv_id", "message", "role", text.alias("text"))


def render(messages: DataFrame, learned_role: str = LEARNED_ROLE) -> DataFrame:
    """One row per conversation: conv_id, formatted, turns.

    Each turn is `<s>`, `[INST]` unless it is of the learned role, the role, a
    line feed, the text, `[/INST]` likewise, `</s>`. `turns` has the place of
    each turn in `formatted` (start and length, in code points) and of its
    loss span, null where nothing is learned. Messages come in the order of
    `message`, then role and text.
    """
    learned = F.col("role") == learned_role
    role = _role_out(F.coalesce("role", F.lit("")))
    parts = messages.select(
        "conv_id", "message", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
    ).withColumns({"head": F.concat(F.lit(OPEN), F.when(learned, "").otherwise(INSTRUCT), role, F.lit("\n")),
                   "body": escape(F.col("text"))})
    parts = parts.select(
        "conv_id", "message", "role", "text",
        F.concat("head", "body", F.when(learned, "").otherwise(ANSWER), F.lit(CLOSE)).alias("segment"),
        F.when(learned, F.char_length("head")).alias("skip"), F.when(learned, F.char_length("body")).alias("learn"))
    order = Window.partitionBy("conv_id").orderBy("message", "role", "text").rowsBetween(Window.unboundedPreceding, 0)
    size = F.char_length("segment").cast("long")
    placed = parts.select(
        "conv_id", F.count("*").over(order).alias("place"), "segment", "skip", "learn", size.alias("length"),
        (F.sum(size).over(order) - size).alias("start"))
    turns = placed.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct(
        "place", "segment", "start", "length", (F.col("start") + F.col("skip")).alias("loss_start"),
        F.col("learn").cast("long").alias("loss_length")))).alias("all"))
    return turns.select(
        "conv_id", F.array_join(F.transform("all", lambda t: t["segment"]), "").alias("formatted"),
        F.transform("all", lambda t: F.struct(
            t["start"].alias("start"), t["length"].alias("length"), t["loss_start"].alias("loss_start"),
            t["loss_length"].alias("loss_length"))).alias("turns"))


def read_back(formatted: DataFrame) -> DataFrame:
    """The turns (role, text) and the unescaped text under the loss mask, from formatted conversations alone."""
    cut = formatted.select("*", F.slice(F.split("formatted", OPEN, -1), 2, 2147483647).alias("raw"))

    def turn(segment: Column) -> Column:
        bare = F.left(segment, F.char_length(segment) - len(CLOSE))
        asked = bare.startswith(INSTRUCT)
        bare = F.when(asked, F.substring(bare, F.lit(len(INSTRUCT) + 1),
                                         F.char_length(bare) - len(INSTRUCT) - len(ANSWER))).otherwise(bare)
        role = F.substring_index(bare, "\n", 1)
        return F.struct(_role_in(role).alias("role"),
                        unescape(F.substring(bare, F.char_length(role) + 2, F.char_length(bare))).alias("text"))

    def learned(segment: Column, place: Column) -> Column:
        own = place["loss_start"] - place["start"] - len(OPEN) + 1
        return F.when(place["loss_start"].isNull(), "").otherwise(
            unescape(F.substring(segment, own.cast("int"), place["loss_length"].cast("int"))))

    return cut.select(
        "conv_id", "formatted", F.transform("raw", turn).alias("read"),
        F.array_join(F.zip_with("raw", "turns", learned), "").alias("loss"))
