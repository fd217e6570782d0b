"""Chat formatting: messages are rebuilt from a log of events and rendered, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The template's control strings (fixed values).
TURN_START, TURN_END, CONTROL = "<|im_start|>", "<|im_end|>", "<|"
LOSS_ROLE = "assistant"
#: Turns whose places are summed up together.
BLOCK = 256
EVENTS_SCHEMA = "conv_id long, seq long, turn long, kind string, role string, text string"


def escape(text: Column) -> Column:
    """Doubles each backslash, then puts one inside each <|, so no control string is left in the text."""
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit(CONTROL), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("<\\|"), F.lit(CONTROL)), F.lit("\\\\"), F.lit("\\"))


def escape_role(role: Column) -> Column:
    """As escape(), and a line break, which ends the role in the template, becomes backslash n."""
    return F.replace(escape(role), F.lit("\n"), F.lit("\\n"))


def unescape_role(role: Column) -> Column:
    """Pairs of backslashes are set apart first, so that a doubled backslash before an n stays one."""
    parts = F.split(F.replace(role, F.lit("<\\|"), F.lit(CONTROL)), r"\\\\")
    return F.array_join(F.transform(parts, lambda p: F.replace(p, F.lit("\\n"), F.lit("\n"))), "\\")


def fold(events: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text): the final messages of a log (conv_id, seq, turn, kind, role, text).

    kind: `message` opens a turn with its text, `delta` adds to it, `edit` replaces it, `regenerate` drops
    what it has and starts again with its text (empty, if deltas follow). Events count by seq, ties by kind,
    role, then text. A turn's text is that of its last event other than a delta, and the deltas after
    it. A null kind is a message, a null text is empty; the role is the last one given, else empty. A
    message is grouped by (conv_id, turn), a null being a value of its own. An unknown kind is a message.
    """
    kind = F.when(F.col("kind").isin("delta", "edit", "regenerate"), F.col("kind")).otherwise("message")
    one = F.struct("seq", kind.alias("kind"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), F.col("role").isNotNull().alias("named"))
    log = events.groupBy("conv_id", "turn").agg(F.array_sort(F.collect_list(one)).alias("log"))
    start = F.aggregate(F.sequence(F.lit(1), F.size("log")), F.lit(0), lambda last, i: F.when(F.element_at("log", i)["kind"] != "delta", i).otherwise(last))
    kept = F.slice(F.col("log"), F.greatest(F.col("start"), F.lit(1)), F.size("log"))
    named = F.transform(F.filter("log", lambda e: e["named"]), lambda e: e["role"])
    return log.withColumn("start", start).select(
        "conv_id", "turn", F.coalesce(F.try_element_at(named, F.lit(-1)), F.lit("")).alias("role"), F.array_join(F.transform(kept, lambda e: e["text"]), "").alias("text"),
    )


def fold_rows(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) of plain rows, each an event of kind `message`, by way of fold().

    seq and turn are a row's place in its conversation (by turn, role, text), so rows with the same turn stay
    separate messages and repeated rows stay repeated.
    """
    row = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    placed = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(row)).alias("rows")).select("conv_id", F.posexplode("rows").alias("seq", "row"))
    return fold(placed.select("conv_id", "seq", F.col("seq").alias("turn"), F.lit("message").alias("kind"), "row.role", "row.text"))


def render(messages: DataFrame) -> DataFrame:
    """(conv_id, n_turns, formatted, loss_spans) of final `messages` (conv_id, turn, role, text).

    Turns are in the order of turn, role, text. formatted is, for each turn, the start mark, the role, a line break,
    the text, the end mark and a line break. loss_spans: (start, length) in code points, from 0, of each
    assistant text as it stands in formatted. A null conv_id is a conversation of its own, a null
    turn comes first, null texts and roles are empty. No rows, no conversations. Other columns are dropped.
    """
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    body = lambda t: F.concat(F.lit(TURN_START), escape_role(t["role"]), F.lit("\n"), escape(t["text"]), F.lit(f"{TURN_END}\n"))
    grouped = messages.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    shown = grouped.select("conv_id", F.transform("turns", lambda t: F.struct(t["role"].alias("role"), F.length(escape(t["text"])).alias("n"), body(t).alias("body"))).alias("shown"))
    # places of turns are sums over the turns before: of each block first, then inside the blocks
    blocks = F.transform(F.sequence(F.lit(0), ((F.size("shown") - 1) / BLOCK).cast("int")), lambda i: F.slice("shown", i * BLOCK + 1, BLOCK))
    ends = F.aggregate(blocks, F.array(F.lit(0)), lambda acc, b: F.concat(acc, F.array(F.element_at(acc, -1) + F.aggregate(b, F.lit(0), lambda n, t: n + F.length(t["body"])))))
    inside = lambda block, at: F.aggregate(
        block,
        F.struct(at.alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans")),
        lambda acc, t: F.struct(
            (acc["at"] + F.length(t["body"])).alias("at"),
            F.when(t["role"] == LOSS_ROLE, F.concat(acc["spans"], F.array(F.struct((acc["at"] + F.length(t["body"]) - len(TURN_END) - 1 - t["n"]).alias("start"), t["n"].alias("length"))))).otherwise(acc["spans"]).alias("spans"),
        ),
    )["spans"]
    spans = F.flatten(F.zip_with(blocks, F.slice(ends, 1, F.size(ends) - 1), inside))
    return shown.select("conv_id", F.size("shown").alias("n_turns"), F.array_join(F.transform("shown", lambda t: t["body"]), "").alias("formatted"), spans.alias("loss_spans"))


def parse(formatted: Column) -> Column:
    """The turns (role, text) that a formatted conversation holds."""
    pieces = F.slice(F.split(formatted, r"<\|im_start\|>"), F.lit(2), F.greatest(F.size(F.split(formatted, r"<\|im_start\|>")), F.lit(1)))

    def turn(piece: Column) -> Column:
        inside = F.substring(piece, F.lit(1), F.length(piece) - F.lit(len(TURN_END) + 1))
        end = F.locate("\n", inside)
        return F.struct(unescape_role(F.substring(inside, F.lit(1), end - 1)).alias("role"), unescape(F.substring(inside, end + 1, F.length(inside))).alias("text"))

    return F.transform(pieces, turn)


def format_chats(events: DataFrame) -> DataFrame:
    """render() of fold(): a log of events (EVENTS_SCHEMA) to formatted conversations."""
    return render(fold(events))
