"""Chat formatting from an event log, in DataFrame functions only.

A log row says what happened to one message of one conversation: it was
received (``message``), grew by a piece (``delta``), was replaced (``edit``) or
was thrown away to be written anew (``regenerate``). ``fold_events`` replays the
log into final messages, ``render`` lays them out as one training string per
conversation with a loss mask, and ``read_back`` parses that string again.

Layout of a turn, where ``\\`` escapes control strings inside texts::

    ### role:
    text
    </turn>
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

OPEN, BREAK, CLOSE = "### ", ":\n", "\n</turn>\n"
RESETS = ("message", "edit", "regenerate")
_TEXT_CONTROL = r"(\\|### |</turn>)"
_ROLE_CONTROL = r"([\\:<#\n])"
_HEADER = r"^### (?:[^\\:]++|\\[\\:<#\n])*+:\n"


def escape_text(c: Column) -> Column:
    return F.regexp_replace(c, _TEXT_CONTROL, r"\\$1")


def unescape_text(c: Column) -> Column:
    return F.regexp_replace(c, r"\\" + _TEXT_CONTROL, "$1")


def escape_role(c: Column) -> Column:
    return F.regexp_replace(c, _ROLE_CONTROL, r"\\$1")


def unescape_role(c: Column) -> Column:
    return F.regexp_replace(c, r"\\" + _ROLE_CONTROL, "$1")


def fold_events(events: DataFrame) -> DataFrame:
    """Final messages of a log with columns conv_id, seq, event, message, role, text.

    Events of one message are sorted by ``seq`` (ties: event, role, text); the
    text is what the last ``message``, ``edit`` or ``regenerate`` left, followed by
    all later deltas. A null or unknown event counts as ``delta``, a null text as
    empty; the last role that is not null wins, none is empty. The group is one
    message, so a conversation of any length is folded in many tasks. Returns
    conv_id, position (first seq of the message), message, role, text. No rows
    give no rows; other columns are ignored.
    """
    event = F.struct("seq", "event", "role", "text")
    found = events.groupBy("conv_id", "message").agg(F.array_sort(F.collect_list(event)).alias("log"))
    last = F.array_max(
        F.transform("log", lambda e, i: F.when(e["event"].isin(*RESETS), i + 1).otherwise(F.lit(1)))
    )
    tail = F.slice("log", last, F.size("log"))
    body = F.array_join(
        F.transform(
            tail,
            lambda e: F.when(e["event"] == "regenerate", "").otherwise(F.coalesce(e["text"], F.lit(""))),
        ),
        "",
    )
    roles = F.filter(F.transform("log", lambda e: e["role"]), lambda r: r.isNotNull())
    role = F.when(F.size(roles) > 0, F.element_at(roles, -1)).otherwise("")
    return found.select(
        "conv_id", F.col("log")[0]["seq"].alias("position"), "message", role.alias("role"), body.alias("text")
    )


def render(messages: DataFrame, learn: str = "assistant") -> DataFrame:
    """One row per conversation: conv_id, formatted, loss.

    ``loss`` has one entry per turn: the half-open code point range of the
    (escaped) text if the role is ``learn``, else null. Offsets come from a
    running sum per conversation; the one string a conversation must become is
    the only thing put together in one row. Null conv_id is a conversation of its
    own, null role or text counts as empty.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    head = F.concat(F.lit(OPEN), escape_role(role), F.lit(BREAK))
    turns = messages.select(
        "conv_id", "position", "message", head.alias("head"), escape_text(text).alias("body"),
        (role == learn).alias("learn"),
    )
    order = Window.partitionBy("conv_id").orderBy("position", "message", "head", "body")
    size = F.length("head") + F.length("body") + len(CLOSE)
    ends = F.sum(size.cast("long")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    placed = turns.select("*", F.row_number().over(order).alias("i"), ends.alias("after")).select(
        "conv_id", "i", F.concat("head", "body", F.lit(CLOSE)).alias("chunk"),
        F.when(
            F.col("learn"),
            F.struct(
                (F.col("after") - len(CLOSE) - F.length("body")).alias("start"),
                (F.col("after") - len(CLOSE)).alias("end"),
            ),
        ).alias("span"),
    )
    sorted_turns = F.array_sort(F.collect_list(F.struct("i", "chunk", "span")))
    return placed.groupBy("conv_id").agg(sorted_turns.alias("t")).select(
        "conv_id",
        F.array_join(F.transform("t", lambda x: x["chunk"]), "").alias("formatted"),
        F.transform("t", lambda x: x["span"]).alias("loss"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """Turns parsed from ``formatted``: conv_id, i (from 0), role, text, learned.

    ``learned`` is the unescaped text that the loss range covers in the string,
    null where the turn has no loss.
    """
    parts = F.split("formatted", CLOSE, -1)
    parts = F.slice(parts, 1, F.size(parts) - 1)
    turns = formatted.select("conv_id", F.posexplode(F.arrays_zip(parts.alias("chunk"), "loss")).alias("i", "x"))
    turns = turns.select("conv_id", "i", F.col("x")["chunk"].alias("chunk"), F.col("x")["loss"].alias("span"))
    order = Window.partitionBy("conv_id").orderBy("i")
    ends = F.sum((F.length("chunk") + len(CLOSE)).cast("long")).over(order)
    turns = turns.withColumn("begin", ends - F.length("chunk") - len(CLOSE))
    head = F.regexp_extract("chunk", _HEADER, 0)
    role = F.substring(head, F.lit(len(OPEN) + 1), F.length(head) - len(OPEN) - len(BREAK))
    under = F.substring(
        F.col("chunk"),
        (F.col("span")["start"] - F.col("begin") + 1).cast("int"),
        (F.col("span")["end"] - F.col("span")["start"]).cast("int"),
    )
    return turns.select(
        "conv_id", "i", unescape_role(role).alias("role"),
        unescape_text(F.substring(F.col("chunk"), F.length(head) + 1, F.length("chunk"))).alias("text"),
        unescape_text(under).alias("learned"),
    )


def log_of_turns(turns: DataFrame) -> DataFrame:
    """An event log from finished turns (conv_id, turn, role, text).

    Every row is one message: an assistant's arrives as a streamed delta, any
    other at once. Rows that share conversation and turn are told apart by role
    and text, then by copy.
    """
    order = Window.partitionBy("conv_id", "turn").orderBy("role", "text")
    rows = turns.select("conv_id", "turn", "role", "text", F.row_number().over(order).alias("copy"))
    key = F.struct("turn", "copy")
    event = F.when(F.col("role") == "assistant", "delta").otherwise("message")
    return rows.select("conv_id", key.alias("seq"), event.alias("event"), key.alias("message"), "role", "text")
