"""Conversations rebuilt from an event log and rendered as training text.

A log has one row for each event. The events of a message are folded in order of
their sequence: deltas append to its text, an edit replaces it, a regeneration
discards it and starts anew, a retraction removes the message. Messages are then
rendered in order between control strings, with a mask of the text to learn from.

Everything is built-in DataFrame functions. An event acts on its own message only, so
the log of a conversation is sorted by sequence within its messages: events are dealt by
(conversation, turn) and messages by (conversation, run of PIECE_TURNS turns), so a conversation
that holds a large part of the log is folded and rendered by many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Turn numbers that share a piece of output.
PIECE_TURNS = 64
#: Characters of a streamed delta in the log made from finished turns.
DELTA_CHARS = 256

START, END = "<|im_start|>", "<|im_end|>"


def escape(text: Column) -> Column:
    """Text without the opening of a control string; undone by unescape()."""
    text = F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\\\"))
    return F.replace(text, F.lit("<|"), F.lit("<\\|"))


def escape_role(role: Column) -> Column:
    """A role on one line."""
    return F.replace(escape(role), F.lit("\n"), F.lit("<\\n"))


def unescape(text: Column) -> Column:
    # backslashes of the text come in pairs, so one alone after "<" is the escape's own
    text = F.replace(F.replace(text, F.lit("<\\|"), F.lit("<|")), F.lit("<\\n"), F.lit("\n"))
    return F.replace(text, F.lit("\\\\"), F.lit("\\"))


def events_of_turns(turns: DataFrame) -> DataFrame:
    """A log that finished turns (conv_id, turn, role, text) may have left.

    Each row becomes one message: opened, then streamed in deltas of DELTA_CHARS
    characters. The first delta comes out wrong: an assistant's message is regenerated,
    any other is edited, and then goes on. Equal rows become messages of their own.
    Columns: conv_id, turn, message, seq, kind, role, payload; seq puts all events of a
    conversation in one order. A null role or text is empty; extra columns are left out.
    """
    key = W.partitionBy("conv_id", "turn").orderBy(F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first())
    rows = turns.select("conv_id", "turn", "role", "text").withColumn("message", F.row_number().over(key))
    text, again = F.coalesce("text", F.lit("")), F.coalesce(F.col("role") == "assistant", F.lit(False))

    def event(k, kind: Column, role: Column, payload: Column) -> Column:
        seq = F.struct(F.col("turn"), F.col("message"), k.alias("step"))
        return F.struct(seq.alias("seq"), kind.alias("kind"), role.cast("string").alias("role"), payload.cast("string").alias("payload"))

    nothing = F.lit(None)
    deltas = F.transform(
        F.sequence(F.lit(0), F.floor((F.length(text) - 1) / DELTA_CHARS).cast("int")),
        lambda i: event(i + 3, F.lit("delta"), nothing, F.substring(text, i * DELTA_CHARS + 1, F.lit(DELTA_CHARS))),
    )
    first = F.substring(text, 1, DELTA_CHARS)
    opened = event(F.lit(0), F.lit("open"), F.col("role"), nothing)
    wrong = event(F.lit(1), F.lit("delta"), nothing, F.reverse(first))
    mended = event(F.lit(2), F.when(again, "regenerate").otherwise("edit"), nothing, F.when(~again, first))
    rest = F.when(again, deltas).otherwise(F.slice(deltas, 2, F.size(deltas)))
    log = F.when(F.length(text) > 0, F.concat(F.array(opened, wrong, mended), rest)).otherwise(F.array(opened))
    return rows.select("conv_id", "turn", "message", F.inline(log))


def fold(events: DataFrame) -> DataFrame:
    """The final messages: conv_id, turn, message, role, text.

    events: conv_id, turn, message, seq, kind, role, payload; seq is a number, or anything
    else with an order, by which all events of a conversation are sorted. Kinds: open (sets
    the role), delta, edit, regenerate, retract; others are ignored. Events of
    equal seq are taken in order of kind, role and payload. A message with no
    events but deltas has the role null; a null payload is empty; after a
    retraction later events bring the message back. Repeated events count again.
    """
    events = events.select("conv_id", "turn", "message", "seq", "kind", "role", "payload")
    log = events.groupBy("conv_id", "turn", "message").agg(F.array_sort(F.collect_list(F.struct("seq", "kind", "role", "payload"))).alias("log"))
    last = F.expr("""
      aggregate(sequence(0, size(log) - 1), named_struct('base', -1, 'gone', false, 'role', cast(null as string)),
        (a, i) -> named_struct(
          'base', if(log[i].kind in ('edit', 'regenerate', 'retract'), i, a.base),
          'gone', log[i].kind = 'retract' or (a.gone and not (log[i].kind in ('delta', 'edit', 'regenerate', 'open'))),
          'role', if(log[i].kind = 'open', log[i].role, a.role)))""")
    text = F.expr("""
      array_join(transform(filter(slice(log, greatest(last.base, 0) + 1, size(log)), (e, i) ->
          e.kind = 'delta' or (e.kind = 'edit' and i = 0 and last.base >= 0)), e -> coalesce(e.payload, '')), '')""")
    return (
        log.withColumn("last", last)
        .where("not last.gone")
        .select("conv_id", "turn", "message", F.col("last.role").alias("role"), text.alias("text"))
    )


def render(messages: DataFrame, learn_role: str = "assistant") -> DataFrame:
    """Rendered pieces: conv_id, piece, formatted, loss_mask, n_turns.

    A conversation's pieces, put together in order of ``piece``, are its whole
    text; a piece holds the turns of PIECE_TURNS consecutive numbers. loss_mask:
    array<struct<start,end>>, code points of the piece, over the escaped text of
    each message of ``learn_role``. Messages of one turn come in order of role
    and text; null turns come first.
    """
    role, text = escape_role(F.col("role")), escape(F.col("text"))
    head = F.concat(F.lit(START), role, F.lit("\n"))
    one = F.struct(
        F.col("turn"), F.col("role"), F.col("text"), F.concat(head, text, F.lit(END + "\n")).alias("out"), F.length(head).alias("head"), F.length(text).alias("size")
    )
    pieces = (
        messages.groupBy("conv_id", F.floor(F.col("turn") / PIECE_TURNS).alias("piece")).agg(F.array_sort(F.collect_list(one)).alias("m"))
    )
    mask = F.expr(f"""
      aggregate(m, named_struct('p', 0, 'o', cast(array() as array<struct<start:int,end:int>>)),
        (a, x) -> named_struct('p', a.p + length(x.out), 'o', if(x.role = '{learn_role}',
          concat(a.o, cast(array(named_struct('start', a.p + x.head, 'end', a.p + x.head + x.size)) as array<struct<start:int,end:int>>)), a.o)),
        a -> a.o)""")
    return pieces.select("conv_id", "piece", F.array_join(F.transform("m", lambda x: x["out"]), "").alias("formatted"), mask.alias("loss_mask"), F.size("m").cast("long").alias("n_turns"))


def read_back(pieces: DataFrame) -> DataFrame:
    """What rendered pieces say: conv_id, piece, turns array<struct<role,text>>, learned array<string>.

    Read from ``formatted`` and ``loss_mask`` alone.
    """
    parts = F.expr(f"slice(p, 1, size(p) - 1)").alias("parts")
    out = pieces.withColumn("p", F.split("formatted", r"\Q" + END + r"\E\n", -1)).select("conv_id", "piece", "formatted", "loss_mask", parts)

    def turn(x: Column) -> Column:
        line = F.substring_index(x, "\n", 1)
        return F.struct(unescape(F.substr(line, F.lit(len(START) + 1))).alias("role"), unescape(F.substr(x, F.length(line) + 2)).alias("text"))

    learned = F.transform("loss_mask", lambda s: unescape(F.substr(F.col("formatted"), s["start"] + 1, s["end"] - s["start"])))
    return out.select("conv_id", "piece", F.transform("parts", turn).alias("turns"), learned.alias("learned"), F.length("formatted").cast("long").alias("chars"))
