r"""Chat formatting by event-sourced reconstruction.

A log of events (conv_id, seq, message, kind, role, text) is partitioned by conversation, sorted by sequence and folded
into final messages:

* message: sets role and text of a message (a first or whole version);
* delta: appends text to the message, which a first delta creates;
* edit: replaces the text of an existing message, or creates it;
* regenerate: clears the text of the message and drops all later messages, whose answers no longer hold;
* delete: drops the message.

Messages are rendered in order of their number as `<turn>role<text>text</turn>` and a newline. Inside roles and texts a
backslash becomes `\s` and `<` becomes `\l`, so no control string can occur there, and `unescape` restores both: every
backslash of the output starts one of the two. The text of an assistant's turn is under the loss mask.

Everything is DataFrame functions. The fold is relational, so no state is carried from event to event: events are grouped by
conversation and message; of each message the last reset (a message, edit, regeneration or deletion of its own, or a
regeneration of an earlier one) is found by comparing sequences, and the deltas after it are joined in order. Only the
final messages of a conversation come together, as its digests are of the whole conversation; its text must fit a row,
2 GB.

Edge cases: null texts and roles are empty; a null conv_id is one conversation; events of equal sequence are folded in the
order of message, kind, role and text, so the result does not depend on their place; a message without number is that
of its sequence; unknown kinds are ignored; a table without rows gives none; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TURN, TEXT, END = "<turn>", "<text>", "</turn>\n"
TRAINED_ROLE = "assistant"
KINDS = ("message", "delta", "edit", "regenerate", "delete")
#: Characters of a streamed delta.
DELTA_CHARS = 512


def escape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("\\"), F.lit("\\s")), F.lit("<"), F.lit("\\l"))


def unescape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("\\l"), F.lit("<")), F.lit("\\s"), F.lit("\\"))


def final_messages(events: DataFrame) -> DataFrame:
    """(conv_id, messages): an array of (number, role, text) in order, of every conversation that has any."""
    number = F.coalesce(F.col("message"), F.col("seq")).cast("long")
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    known = events.select("conv_id", number.alias("number"), F.col("seq").cast("long").alias("seq"), "kind", text("role").alias("role"), text("text").alias("text")).filter(F.col("kind").isin(*KINDS))
    at = F.struct("seq", "number", "kind", "role", "text")
    regenerated = F.when(F.col("kind") == "regenerate", F.struct("seq", "number", "kind", "role"))
    one = known.groupBy("conv_id", "number").agg(F.array_sort(F.collect_list(at)).alias("log"), F.max(regenerated).alias("again"))
    # A regeneration drops all messages of larger numbers that came before it.
    earlier = Window.partitionBy("conv_id").orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    one = one.withColumn("cut", F.max("again").over(earlier))
    # Null numbers sort first and are not before any other; a struct comparison puts a null sequence first, as the sort does.
    after = lambda e: F.col("cut").isNull() | F.col("number").isNull() | (F.struct(e["seq"], e["number"], e["kind"], e["role"]) > F.col("cut"))
    one = one.withColumn("log", F.filter("log", after))
    place = lambda kinds: F.coalesce(F.array_max(F.transform("log", lambda e, i: F.when(e["kind"].isin(*kinds), i))), F.lit(-1))
    one = one.withColumns({"gone": place(["delete"]), "reset": place(["message", "edit", "regenerate", "delete"])})
    one = one.filter(F.size("log") > F.col("gone") + 1)
    # The role is the last one named since the message came up; its text begins with the reset.
    named = F.filter(F.slice("log", F.col("gone") + 2, F.size("log")), lambda e: e["role"] != "")
    role = F.when(F.size(named) > 0, F.get(named, F.size(named) - 1)["role"]).otherwise("")
    said = F.transform(F.slice("log", F.greatest("reset", F.lit(0)) + 1, F.size("log")), lambda e: F.when(e["kind"].isin("message", "edit", "delta"), e["text"]).otherwise(""))
    one = one.select("conv_id", F.struct("number", role.alias("role"), F.array_join(said, "").alias("text")).alias("message"))
    return one.groupBy("conv_id").agg(F.array_sort(F.collect_list("message")).alias("messages"))


def render(messages: DataFrame) -> DataFrame:
    """(conv_id, formatted) of (conv_id, messages)."""
    turn = F.transform("messages", lambda m: F.concat(F.lit(TURN), escape(m["role"]), F.lit(TEXT), escape(m["text"]), F.lit(END)))
    return messages.select("conv_id", F.array_join(turn, "").alias("formatted"))


def parse(formatted: DataFrame) -> DataFrame:
    """(conv_id, formatted, turns): the turns (role, text) read back from the output."""
    parts = F.slice(F.split("formatted", END), 1, F.size(F.split("formatted", END)) - 1)

    def turn(x: Column) -> Column:
        cut = F.instr(x, TEXT)
        return F.struct(unescape(F.substring(x, F.lit(len(TURN) + 1), cut - len(TURN) - 1)).alias("role"), unescape(F.substring(x, cut + len(TEXT), F.length(x))).alias("text"))

    return formatted.select("conv_id", "formatted", F.transform(parts, turn).alias("turns"))


def events_of_conversations(conversations: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) as whole messages; each row is one, ordered by turn, then role and text."""
    return conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("seq"), F.lit(None).cast("long").alias("message"), F.lit("message").alias("kind"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))


def streamed(conversations: DataFrame) -> DataFrame:
    """The event log of rows (conv_id, turn, role, text), each a message of its own, repeated turn numbers included.

    What trained roles say comes as a stream does: a regeneration opens the answer, and deltas of DELTA_CHARS characters
    bring its text. All other rows are whole messages. Rows of a conversation are in order of turn, role and text."""
    rows = events_of_conversations(conversations)
    rows = rows.select("conv_id", "seq", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    order = Window.partitionBy("conv_id").orderBy("seq", "role", "text")
    rows = rows.withColumn("number", F.row_number().over(order).cast("long"))
    parts = F.transform(F.sequence(F.lit(0), F.floor(F.length("text") / DELTA_CHARS)), lambda i: F.substring(F.col("text"), i.cast("int") * DELTA_CHARS + 1, F.lit(DELTA_CHARS)))
    event = lambda kind, text: F.struct(F.lit(kind).alias("kind"), text.alias("text"))
    deltas = F.concat(F.array(event("regenerate", F.lit(""))), F.transform(parts, lambda x: event("delta", x)))
    log = F.when(F.col("role") == TRAINED_ROLE, deltas).otherwise(F.array(event("message", F.col("text"))))
    rows = rows.select("conv_id", "number", "role", F.posexplode(log).alias("step", "event"))
    return rows.select("conv_id", (F.shiftleft("number", 32) + F.col("step")).alias("seq"), F.col("number").alias("message"), "event.kind", "role", "event.text")


def format_rows(conversations: DataFrame) -> DataFrame:
    """(conv_id, formatted): every row of conversations is a turn of its own, folded from its event log."""
    return render(final_messages(streamed(conversations)))
