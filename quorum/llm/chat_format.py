"""Chat formatting by prefix-target expansion, with DataFrame functions only.

Every assistant turn becomes an example of its own: all turns before it are context, and only its reply is trainable.
Turns after the last assistant turn (or a conversation without one) become one more example that trains nothing, so
that the examples of a conversation hold all its turns.

A turn is rendered as ``### role: text</turn>`` and a line feed. Backslash, ``#`` and ``<`` never stand in a rendered
role or text, nor does ``:`` in a role: they are written as a backslash and one letter, which ``unescape`` reverses.

Defined cases: turns are ordered by turn, role and text, nulls first; a null role or text is empty; repeated rows are
turns of their own; a row without a conv_id is a conversation of its own, as nothing says what it belongs to; very long
texts are taken whole; an empty table gives no example; further columns of the input are left aside. An example holds
its whole prefix by definition, so one row is as long as its conversation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TARGET_ROLE = "assistant"
TURN_START, ROLE_END, TURN_END = "### ", ": ", "</turn>\n"
#: What is escaped, and the letter after the backslash. The backslash comes first when escaping.
TEXT_ESCAPES = (("\\", "\\b"), ("#", "\\h"), ("<", "\\l"))
ROLE_ESCAPES = (*TEXT_ESCAPES, (":", "\\c"))


def _replaced(c: Column, pairs) -> Column:
    for old, new in pairs:
        c = F.replace(c, F.lit(old), F.lit(new))
    return c


def escape(c: Column, pairs=TEXT_ESCAPES) -> Column:
    return _replaced(c, pairs)


def unescape(c: Column) -> Column:
    return _replaced(c, [(new, old) for old, new in reversed(ROLE_ESCAPES)])


def _header(turn: Column) -> Column:
    return F.concat(F.lit(TURN_START), escape(turn["role"], ROLE_ESCAPES), F.lit(ROLE_END))


def format_examples(conversations: DataFrame) -> DataFrame:
    """(conv_id, own: a number that tells rows without a conv_id apart, else null; target long: place of the trained turn, null for the rest; n_context, formatted; loss_start, loss_length in code points)."""
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    own = F.when(F.col("conv_id").isNull(), F.monotonically_increasing_id()).alias("own")
    turns = conversations.select("conv_id", own, turn.alias("turn"))
    talks = turns.groupBy("conv_id", "own").agg(F.sort_array(F.collect_list("turn")).alias("turns"))
    talks = talks.withColumn("rendered", F.transform("turns", lambda t: F.concat(_header(t), escape(t["text"]), F.lit(TURN_END))))
    places = F.sequence(F.lit(1), F.size("turns"))
    targets = F.filter(places, lambda i: F.element_at("turns", i)["role"] == TARGET_ROLE)
    rest = F.when(F.element_at("turns", -1)["role"] != TARGET_ROLE, F.array(F.size("turns") + 1)).otherwise(F.array().cast("array<int>"))
    each = talks.select("conv_id", "own", "turns", "rendered", F.explode(F.concat(targets, rest)).alias("place"))
    context = F.array_join(F.slice("rendered", F.lit(1), F.col("place") - 1), "")
    target = F.when(F.col("place") <= F.size("turns"), F.get("turns", F.col("place") - 1))
    each = each.select("conv_id", "own", "place", context.alias("context"), target.alias("target"))
    prefix, reply = F.concat("context", _header(F.col("target"))), escape(F.col("target.text"))
    trained = F.col("target").isNotNull()
    return each.select(
        "conv_id",
        "own",
        F.when(trained, F.col("place").cast("long")).alias("target"),
        (F.col("place") - 1).cast("long").alias("n_context"),
        F.when(trained, F.concat(prefix, reply, F.lit(TURN_END))).otherwise(F.col("context")).alias("formatted"),
        F.when(trained, F.length(prefix).cast("long")).alias("loss_start"),
        F.coalesce(F.length(reply), F.lit(0)).cast("long").alias("loss_length"),
    )


def loss_text(example_formatted: Column, start: Column, length: Column) -> Column:
    """The text under an example's loss mask, unescaped."""
    return unescape(F.substr(example_formatted, (start + 1).cast("int"), length.cast("int")))


def parse_turns(formatted: Column) -> Column:
    """The (role, text) turns of a formatted text, unescaped."""
    pieces = F.split(formatted, TURN_END)
    return F.transform(
        F.slice(pieces, F.lit(1), F.size(pieces) - 1),
        lambda p: F.struct(
            unescape(F.substr(F.substring_index(p, ROLE_END, 1), F.lit(len(TURN_START) + 1))).alias("role"),
            unescape(F.substr(p, F.length(F.substring_index(p, ROLE_END, 1)) + len(ROLE_END) + 1)).alias("text"),
        ),
    )


def digests(examples: DataFrame) -> DataFrame:
    """One row for each conversation, read back from its examples; a turn without a conv_id is one of its own."""
    loss = F.struct("target", loss_text(F.col("formatted"), F.col("loss_start"), F.col("loss_length")).alias("text"))
    e = examples.select("conv_id", "own", "target", "n_context", "formatted", F.when(F.col("target").isNotNull(), loss).alias("loss"))
    whole = F.max_by("formatted", F.struct("n_context", F.col("target").isNotNull())).alias("whole")
    rows = e.groupBy("conv_id", "own").agg(whole, F.sort_array(F.collect_list("loss")).alias("losses"), F.sum(F.length("formatted")).alias("formatted_chars"), F.count("*").alias("n_examples"))
    rows = rows.withColumn("trained", F.array_join(F.transform("losses", lambda x: x["text"]), "")).withColumn("turns", parse_turns(F.col("whole")))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return rows.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("trained").cast("long").alias("loss_chars"),
        F.sha2("trained", 256).alias("loss_sha256"),
        F.col("formatted_chars").cast("long").alias("formatted_chars"),
        "n_examples",
    )
