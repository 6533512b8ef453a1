"""Chat logs as events, folded into final messages and rendered for training, in DataFrame expressions.

An event has conv_id, message (any sortable key that orders the messages of a conversation), seq (order of events), kind,
role and text. Kinds:

* ``message``     starts a message, or starts it over: role and text are the event's;
* ``delta``       appends its text to the message;
* ``edit``        replaces the text; a null role leaves the role;
* ``regenerate``  empties the message and takes back every later message that was last started before this event.

Events are first folded by message and then by conversation, so only what one message received meets in one group, and then
what one conversation says: its rendered text is one value anyway.

Template: ``<|im_start|>role<|im_sep|>text<|im_end|>`` and a newline, for each message. Within roles and texts every ``<``
that is followed by backslashes and ``|`` gets one more backslash, so no control string can occur there and taking one away
restores every text. The loss mask lists the spans (start, length in code points of the output) of assistant texts.

Defined results: null texts and roles are empty; deltas before a start begin an empty message without a role; ties of seq
fall back to kind, role and text; a null message key comes first; events with a null conv_id form one conversation;
an unknown kind is ignored; events repeated with the same seq count as often as they occur, except that starting over twice
is as good as once; other columns are ignored; no events give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def row_events(conversations: DataFrame) -> DataFrame:
    """A table of finished turns as events: each row, repeated ones too, starts a message of its own, ordered by turn."""
    turns = conversations.groupBy("conv_id", "turn", "role", "text").agg(F.count("*").alias("n"))
    each = turns.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("n"))))
    return each.select("conv_id", F.struct("turn", "role", "text", "copy").alias("message"), F.lit(0).cast("bigint").alias("seq"),
                       F.lit("message").alias("kind"), "role", "text")


def messages(events: DataFrame) -> DataFrame:
    """Final messages: conv_id, message, role, text."""
    blank = lambda c: F.coalesce(c, F.lit(""))
    told = events.groupBy("conv_id", "message").agg(F.array_sort(F.collect_list(F.struct("seq", "kind", "role", "text"))).alias("log"))
    last = lambda *kinds: F.coalesce(F.array_max(  # noqa: E731  place of the last event of such a kind
        F.transform("log", lambda e, i: F.when(e["kind"].isin(*kinds), i))), F.lit(-1))
    speaks = lambda e: e["kind"].isin("message", "edit", "delta")
    told = told.withColumn("begun", last("message")).withColumn("reset", last("message", "edit", "regenerate"))
    said = F.filter("log", lambda e, i: (i >= F.col("reset")) & speaks(e))
    roles = F.filter("log", lambda e, i: (i >= F.col("begun")) & speaks(e) & e["role"].isNotNull())
    starts = F.filter("log", lambda e: e["kind"].isin("message", "regenerate"))
    again = F.filter("log", lambda e: e["kind"] == "regenerate")
    folded = told.select(
        "conv_id", "message", blank(F.get(roles, F.size(roles) - 1)["role"]).alias("role"),
        F.array_join(F.transform(said, lambda e: blank(e["text"])), "").alias("text"),
        F.get(starts, F.size(starts) - 1)["seq"].alias("started"), F.get(again, F.size(again) - 1)["seq"].alias("regenerated"),
        F.exists("log", lambda e: speaks(e) | (e["kind"] == "regenerate")).alias("known"))
    return folded.where("known").drop("known")


def folded(events: DataFrame) -> DataFrame:
    """One row per conversation: its final turns, array of (role, text) in order."""
    turn = F.struct("message", "role", "text", "started", "regenerated")
    whole = messages(events).groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    again = F.filter("turns", lambda t: t["regenerated"].isNotNull())
    taken_back = lambda t, a: F.exists(a, lambda r: (r["message"] < t["message"]) & (
        t["started"].isNull() | (t["started"] < r["regenerated"])))
    live = F.when(F.size("again") == 0, F.col("turns")).otherwise(F.filter("turns", lambda t: ~F.coalesce(taken_back(t, F.col("again")), F.lit(False))))
    return whole.withColumn("again", again).select("conv_id", F.transform(live, lambda t: F.struct(t["role"], t["text"])).alias("turns"))


def rendered(turns: DataFrame) -> DataFrame:
    """conv_id, formatted, loss_spans: the output, and where in it the assistant speaks."""
    each = turns.select("conv_id", F.posexplode_outer("turns").alias("place", "turn"))
    each = each.select("conv_id", "place", F.concat(F.lit(START), escape(F.col("turn.role")), F.lit(SEP)).alias("head"),
                       escape(F.col("turn.text")).alias("body"), (F.col("turn.role") == "assistant").alias("loss"))
    size = F.length("head") + F.length("body") + len(END) + 1
    before = F.sum(size).over(Window.partitionBy("conv_id").orderBy("place")) - size  # running, so no turn is summed twice
    span = F.when(F.col("loss"), F.struct((before + F.length("head")).cast("int").alias("start"), F.length("body").alias("length")))
    part = F.struct("place", F.concat("head", "body", F.lit(END + "\n")).alias("text"), span.alias("span"))
    whole = each.withColumn("part", part).groupBy("conv_id").agg(F.array_sort(F.collect_list("part")).alias("parts"))
    return whole.select(
        "conv_id", F.array_join(F.transform("parts", lambda p: p["text"]), "").alias("formatted"),
        F.filter(F.transform("parts", lambda p: p["span"]), lambda s: s.isNotNull()).alias("loss_spans"))


def read_back(outputs: DataFrame) -> DataFrame:
    """conv_id, turns and loss_text, from the formatted text and its spans alone."""
    pieces = F.filter(F.split("formatted", r"<\|im_start\|>"), lambda p: p != "")
    turns = F.transform(pieces, lambda p: F.struct(
        unescape(F.substring_index(p, SEP, 1)).alias("role"),
        unescape(F.substring_index(F.substring_index(p, SEP, -1), END, 1)).alias("text")))
    said = F.transform("loss_spans", lambda s: unescape(F.substring(F.col("formatted"), s["start"] + 1, s["length"])))
    return outputs.select("conv_id", turns.alias("turns"), F.array_join(said, "").alias("loss_text"), F.length("formatted").cast("bigint").alias("formatted_chars"))


def digests(outputs: DataFrame) -> DataFrame:
    """Per conversation: number of turns, and digests of turns and loss text as read back from the output."""
    line = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read_back(outputs).select(
        "conv_id", F.size("turns").cast("bigint").alias("n_turns"), F.sha2(F.encode(line, "UTF-8"), 256).alias("turns_sha256"),
        F.length("loss_text").cast("bigint").alias("loss_chars"), F.sha2(F.encode(F.col("loss_text"), "UTF-8"), 256).alias("loss_sha256"), "formatted_chars")
