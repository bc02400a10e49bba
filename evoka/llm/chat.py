"""Chat formatting from an event log, in DataFrame functions only.

A log holds events of messages: (conversation, message, sequence, kind, role,
text). Kinds: ``message`` starts a message with a text, ``delta`` appends to
it, ``edit`` replaces its text, ``regenerate`` discards its text so that the
deltas after it build the new version, ``delete`` removes the message. The log
is partitioned by conversation and message, ordered by sequence and folded to
the final text; messages are then rendered with a template that marks turns
and escapes control strings inside texts reversibly.

Template: ``<|im_start|>role\\n text <|im_end|>\\n`` (no spaces). Inside a text
every ``<``, any backslashes, ``|`` gets one more backslash before the bar, so
a rendered text never holds ``<|``; reading takes one backslash away again.
Roles are URL-encoded, so they hold neither marks nor line ends.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

START, END = "<|im_start|>", "<|im_end|>\n"
RESETS = ("message", "edit", "regenerate", "delete")


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def fold_events(events: DataFrame, conv: str = "conv_id", message: str = "message", seq: str = "seq", kind: str = "kind", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, message, role, text): the final messages of the log.

    The last reset event by sequence (``message``, ``edit``, ``regenerate`` or
    ``delete``) starts the version that stands; its text and the texts of the
    later deltas are joined in order of sequence. A message without a reset is
    built from its deltas. Ties in sequence: resets first, then by text; exact
    repeats of an event count each. The role is the one of the earliest event
    that has any. Null texts and roles count as empty, unknown kinds are
    ignored. A message whose last reset is ``delete`` yields no row, whatever
    deltas come later. Null conversations and messages are values like others;
    other columns are ignored; an empty log has no messages. Grouping is by conversation and
    message, so no task gathers a conversation here."""
    known = events.select(F.col(conv).alias("conv"), F.col(message).alias("message"), F.col(seq).alias("seq"), F.col(kind).alias("kind"), F.col(role).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text")).where(F.col("kind").isin(*RESETS, "delta"))
    order = F.when(F.col("kind").isin(*RESETS), 0).otherwise(1)
    event = F.struct("seq", order.alias("o"), "text", "kind")
    g = known.groupBy("conv", "message").agg(
        F.array_sort(F.collect_list(event)).alias("events"),
        F.max(F.when(F.col("kind").isin(*RESETS), event)).alias("reset"),
        F.min(F.when(F.col("role").isNotNull(), F.struct("seq", "role"))).alias("first"),
    )
    later = F.filter("events", lambda e: (e["o"] == 1) & (F.col("reset").isNull() | (e["seq"] >= F.col("reset.seq"))))
    head = F.when(F.col("reset.kind").isin("message", "edit"), F.col("reset.text")).otherwise("")
    body = F.concat(head, F.array_join(F.transform(later, lambda e: e["text"]), ""))
    alive = g.where(F.col("reset").isNull() | (F.col("reset.kind") != "delete"))
    return alive.select(F.col("conv").alias(conv), F.col("message").alias(message), F.coalesce(F.col("first.role"), F.lit("")).alias("role"), body.alias("text"))


def render_messages(messages: DataFrame, conv: str = "conv_id", message: str = "message", loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """(conv, message, rendered, in_loss): one rendered turn per message; the
    text of a turn is under the loss mask when its role is in ``loss_roles``."""
    rendered = F.concat(F.lit(START), F.url_encode("role"), F.lit("\n"), escape(F.col("text")), F.lit(END))
    return messages.select(conv, message, rendered.alias("rendered"), F.col("role").isin(*loss_roles).alias("in_loss"))


def loss_spans(rendered: DataFrame, conv: str = "conv_id", message: str = "message") -> DataFrame:
    """(conv, message, start, length) of each text under the loss mask, in code
    points of the formatted conversation. Running sums, so no row of a whole
    conversation is built."""
    own = Window.partitionBy(conv).orderBy(message)
    chars = F.length("rendered")
    before = F.coalesce(F.sum(chars).over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    head = F.instr("rendered", "\n")
    return rendered.select(conv, message, "in_loss", (before + head).alias("start"), (chars - head - len(END)).alias("length")).where("in_loss").drop("in_loss")


def format_conversations(messages: DataFrame, conv: str = "conv_id", message: str = "message", loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """(conv, formatted, loss_turns): a text per conversation, turns in order of
    message, and which of its turns are under the loss mask."""
    turns = render_messages(messages, conv, message, loss_roles).groupBy(conv).agg(F.array_sort(F.collect_list(F.struct(F.col(message).alias("m"), "rendered", "in_loss"))).alias("turns"))
    return turns.select(conv, F.array_join(F.transform("turns", lambda t: t["rendered"]), "").alias("formatted"), F.transform("turns", lambda t: t["in_loss"]).alias("loss_turns"))


def read_formatted(formatted: DataFrame, conv: str = "conv_id") -> DataFrame:
    """(conv, turns array<struct<role, text, in_loss>>): formatted texts parsed
    back, by the template's marks alone."""
    blocks = F.split(F.col("formatted"), r"<\|im_end\|>\n")
    blocks = F.slice(blocks, 1, F.size(blocks) - 1)

    def turn(block, k):
        inner = F.substr(block, F.lit(len(START) + 1))
        at = F.instr(inner, "\n")
        return F.struct(F.url_decode(F.substr(inner, F.lit(1), at - 1)).alias("role"), unescape(F.substr(inner, at + 1)).alias("text"), F.get(F.col("loss_turns"), k).alias("in_loss"))

    return formatted.select(conv, F.transform(blocks, turn).alias("turns"), F.length("formatted").cast("long").alias("formatted_chars"))
