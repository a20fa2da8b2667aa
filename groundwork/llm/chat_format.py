"""Chat formatting with Spark expressions only.

A conversation is a list of segments whose concatenation is the formatted
text; segments under the loss mask are the assistant's texts.  Adjacent turns
of one role share a header:

    ### user: first text</join>
    second text</turn>
    ### assistant: answer</turn>

Control strings inside texts and roles are written with a backslash and one
letter, so that reading back gives the very same turns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

OPEN, COLON, JOIN, CLOSE = "### ", ": ", "</join>\n", "</turn>\n"
#: Written first to last, read last to first.  A backslash in formatted text always begins one of these.
ESCAPES = (("\\", "\\s"), ("###", "\\h"), ("</turn>", "\\e"), ("</join>", "\\j"))
#: In a role also the colon that ends it.
COLON_ESCAPE = (":", "\\c")
LOSS_ROLE = "assistant"


def escape(text: Column, pairs=ESCAPES) -> Column:
    for plain, code in pairs:
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescape(text: Column, pairs=ESCAPES) -> Column:
    for plain, code in reversed(pairs):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def _segment(text: Column, loss: Column) -> Column:
    return F.struct(text.alias("text"), loss.alias("loss"))


def format_conversations(turns: DataFrame) -> DataFrame:
    """``(conv_id, segments array<struct<text, loss>>, formatted)``, one row per conversation.

    Turns are taken in the order of (turn, role, text), a null turn first, so
    repeated rows and ties have one order; null roles and texts are empty; a
    null conv_id is a conversation like any other.  An empty table gives no
    rows; other columns are ignored.  A conversation is one output value, so
    its turns meet in one row; they are aggregated as sorted structs and
    written piece by piece in time that grows with their length.
    """
    t = F.struct(F.col("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    sorted_ = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(t)).alias("t"))

    def pieces(x: Column, i: Column) -> Column:
        same = (i > 0) & (F.get(F.col("t"), i - 1)["role"] == x["role"])
        header = F.concat(F.lit(OPEN), escape(x["role"], (*ESCAPES, COLON_ESCAPE)), F.lit(COLON))
        before = F.when(same, F.lit(JOIN)).when(i > 0, F.concat(F.lit(CLOSE), header)).otherwise(header)
        return F.array(_segment(before, F.lit(False)), _segment(escape(x["text"]), x["role"] == LOSS_ROLE))

    segments = F.concat(F.flatten(F.transform("t", pieces)), F.array(_segment(F.lit(CLOSE), F.lit(False))))
    return sorted_.select("conv_id", segments.alias("segments")).select("conv_id", "segments", F.array_join(F.col("segments.text"), "").alias("formatted"))


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted conversation: ``array<struct<role, text>>``."""
    blocks = F.split(formatted, CLOSE, -1)
    blocks = F.slice(blocks, 1, F.size(blocks) - 1)

    def turns(block: Column) -> Column:
        head = F.substring_index(block, COLON, 1)
        role = unescape(F.substr(head, F.lit(len(OPEN) + 1)), (*ESCAPES, COLON_ESCAPE))
        body = F.split(F.substr(block, F.length(head) + len(COLON) + 1), JOIN, -1)
        return F.transform(body, lambda x: F.struct(role.alias("role"), unescape(x).alias("text")))

    return F.flatten(F.transform(blocks, turns))


def loss_text(segments: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"])), "")


def digests(formatted: DataFrame) -> DataFrame:
    """What the formatted conversations hold, read back from them."""
    back = formatted.select("conv_id", read_turns(F.col("formatted")).alias("back"), loss_text(F.col("segments")).alias("loss"), F.length("formatted").cast("long").alias("formatted_chars"))
    line = F.transform("back", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n")))
    return back.select(
        "conv_id",
        F.size("back").cast("long").alias("n_turns"),
        F.sha2(F.array_join(line, ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars",
    )
