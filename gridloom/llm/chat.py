r"""Chat formatting by event-sourced reconstruction.

The log holds events (conv_id, seq, message_id, kind, role, text). Events of one message are sorted by
``seq`` and folded: ``message`` is a finished turn of its own; ``edit`` and ``regenerate`` replace what the
message held so far (a regeneration usually has an empty text and is followed by deltas); ``delta``
appends. Messages are then ordered by their first ``seq`` and rendered as
``### role: text</turn>\n``. Inside roles and texts a backslash becomes ``\\``, ``</turn>`` becomes ``\e``,
``### `` becomes ``\m`` and, in roles, ``:`` becomes ``\c``, so no control string survives in content and
the rendering can be read back exactly. ``mask`` holds start and length (in code points of ``formatted``)
of each assistant text.

DataFrame code throughout. Folding partitions the log by conversation and message, which deals a hot conversation to many
tasks, and rendering is done before the conversation is gathered and sorted, so of a long conversation only finished
strings meet; the one string per conversation that the operator is asked for bounds a conversation's length to what
one string holds (2 GB).

Edge cases: null texts and roles count as empty; unknown kinds are treated as deltas; at equal ``seq`` deltas come before
edits and those before regenerations, so that a reset takes what stands beside it, and equal kinds are ordered by
(role, text); repeated ``message`` rows are separate turns; conversations without rows do not appear; columns beyond
those named are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE = "### ", "</turn>"
END = CLOSE + "\n"
ASSISTANT = "assistant"


def escape(text: Column, role: bool = False) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    out = F.replace(F.replace(out, F.lit(CLOSE), F.lit("\\e")), F.lit(OPEN), F.lit("\\m"))
    return F.replace(out, F.lit(":"), F.lit("\\c")) if role else out


def unescape(text: Column) -> Column:
    """Inverse of escape: pairs of backslashes are split off first, left to right, so what else follows a backslash is an escape."""

    def plain(part: Column) -> Column:
        out = F.replace(F.replace(part, F.lit("\\e"), F.lit(CLOSE)), F.lit("\\m"), F.lit(OPEN))
        return F.replace(out, F.lit("\\c"), F.lit(":"))

    return F.array_join(F.transform(F.split(text, r"\\\\", -1), plain), "\\")


def fold_events(events: DataFrame) -> DataFrame:
    """Final messages: conv_id, seq (of the message's first event), role, text."""
    tidy = events.select(
        "conv_id",
        "message_id",
        F.coalesce("seq", F.lit(-(2**62))).cast("long").alias("seq"),
        F.coalesce("kind", F.lit("delta")).alias("kind"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    order = F.when(F.col("kind") == "regenerate", 2).when(F.col("kind") == "edit", 1).otherwise(0).alias("order")
    log = tidy.groupBy("conv_id", "message_id").agg(F.array_sort(F.collect_list(F.struct("seq", order, "role", "text", "kind"))).alias("log"))
    whole = F.filter("log", lambda e: e["kind"] == "message")
    stream = F.filter("log", lambda e: e["kind"] != "message")
    log = log.select("conv_id", whole.alias("whole"), stream.alias("stream"))
    # what counts of a stream begins with its last reset
    resets = F.transform("stream", lambda e, i: F.when(e["kind"].isin("edit", "regenerate"), i).otherwise(F.lit(-1)))
    start = F.greatest(F.array_max(resets), F.lit(0))
    live = F.slice("stream", start + 1, F.size("stream"))
    folded = F.struct(
        F.col("stream")[0]["seq"].alias("seq"),
        F.col("stream")[0]["role"].alias("role"),
        F.array_join(F.transform(live, lambda e: e["text"]), "").alias("text"),
    )
    turns = F.transform("whole", lambda e: F.struct(e["seq"].alias("seq"), e["role"].alias("role"), e["text"].alias("text")))
    both = F.concat(turns, F.when(F.size("stream") > 0, F.array(folded)).otherwise(F.slice(turns, 1, 0)))
    return log.select("conv_id", F.explode(both).alias("m")).select("conv_id", "m.*")


def render(messages: DataFrame) -> DataFrame:
    """One row per conversation: conv_id, formatted, mask (array of start, length in code points; starts count from 0)."""
    body = messages.select(
        "conv_id",
        "seq",
        "role",
        "text",
        F.concat(F.lit(OPEN), escape(F.col("role"), role=True), F.lit(": ")).alias("head"),
        escape(F.col("text")).alias("body"),
    )
    piece = F.struct(
        "seq",
        "role",
        "text",
        F.concat("head", "body", F.lit(END)).alias("block"),
        F.char_length("head").alias("head_n"),
        F.char_length("body").alias("body_n"),
    )
    convs = body.groupBy("conv_id").agg(F.array_sort(F.collect_list(piece)).alias("m"))
    step = len(END)
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.expr("cast(array() as array<struct<start: bigint, length: bigint>>)").alias("spans"))

    def mark(acc: Column, m: Column) -> Column:
        span = F.struct((acc["at"] + m["head_n"]).alias("start"), m["body_n"].cast("long").alias("length"))
        spans = F.when(m["role"] == ASSISTANT, F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"])
        return F.struct((acc["at"] + m["head_n"] + m["body_n"] + step).alias("at"), spans.alias("spans"))

    return convs.select(
        "conv_id",
        F.array_join(F.transform("m", lambda m: m["block"]), "").alias("formatted"),
        F.aggregate("m", zero, mark)["spans"].alias("mask"),
    )


def format_chats(events: DataFrame) -> DataFrame:
    """Log of events to one formatted string and loss mask per conversation."""
    return render(fold_events(events))


def read_back(formatted: DataFrame) -> DataFrame:
    """Parses the rendering: conv_id, turns (array of role, text) and loss_text (all text under the mask, unescaped)."""
    blocks = F.filter(F.split("formatted", END, -1), lambda b: b != "")

    def turn(b: Column) -> Column:
        head = F.substring_index(b, ": ", 1)
        role = unescape(F.substr(head, F.lit(len(OPEN) + 1)))
        return F.struct(role.alias("role"), unescape(F.substr(b, F.char_length(head) + 3)).alias("text"))

    loss = F.array_join(F.transform("mask", lambda s: unescape(F.substr("formatted", s["start"].cast("int") + 1, s["length"].cast("int")))), "")
    return formatted.select("*", F.transform(blocks, turn).alias("turns"), loss.alias("loss_text"))


def chat_digests(formatted: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, all read back from the rendering."""
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read_back(formatted).select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(lines, 256).alias("turns_sha256"),
        F.char_length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


def turns_as_events(conversations: DataFrame) -> DataFrame:
    """A table of finished turns (conv_id, turn, role, text) as a log of finished messages."""
    return conversations.select(
        "conv_id", F.col("turn").alias("seq"), F.col("turn").alias("message_id"), F.lit("message").alias("kind"), "role", "text"
    )


def turns_as_streams(conversations: DataFrame) -> DataFrame:
    """A table of finished turns (conv_id, turn, role, text) as the log of the streams that led to them.

    An assistant's turn begins with a false start, is regenerated and arrives in two deltas; any other turn is a draft that is
    edited. Each row is a message of its own, whatever rows it shares its turn with."""
    text = F.coalesce("text", F.lit(""))
    half = F.floor(F.char_length(text) / 2).cast("int")
    first, second = F.substr(text, F.lit(1), half), F.substr(text, half + 1)
    event = lambda at, kind, part: F.struct(F.lit(at).alias("at"), F.lit(kind).alias("kind"), part.alias("part"))
    answer = F.array(event(0, "delta", second), event(1, "regenerate", F.lit("")), event(2, "delta", first), event(3, "delta", second))
    draft = F.array(event(0, "delta", second), event(1, "edit", text))
    begin = F.coalesce(F.col("turn").cast("long"), F.lit(-(2**58))) * 4
    # numbered before the rows are multiplied, so that a row's events share its number
    rows = conversations.select("conv_id", "role", "text", begin.alias("begin"), F.monotonically_increasing_id().alias("message_id"))
    rows = rows.select(
        "conv_id",
        "begin",
        "message_id",
        "role",
        F.explode(F.when(F.col("role") == ASSISTANT, answer).otherwise(draft)).alias("e"),
    )
    return rows.select("conv_id", (F.col("begin") + F.col("e.at")).alias("seq"), "message_id", F.col("e.kind").alias("kind"), "role", F.col("e.part").alias("text"))
