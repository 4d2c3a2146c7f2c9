"""Chat formatting with typed content parts, in DataFrame functions only.

A turn's content is an ordered list of parts: text, image, audio or document. The visitor writes text parts
escaped and every other part as a placeholder, records where each attachment stands and to how many tokens it
expands. Turns are written as ``<|turn|>role<|body|>text</s>``. Inside texts and roles a backslash is doubled and a
control string gets one after its first character, so no control string is left and reading back is exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

TURN, BODY, END = "<|turn|>", "<|body|>", "</s>"
#: Begins of strings that a template may use, here or elsewhere.
CONTROL = r"([<\[])(?=\||/?s>|/?INST\]|</?SYS>>)"
PLACEHOLDER = {"image": "<|image|>", "audio": "<|audio|>", "document": "<|document|>"}
#: Expansion: image tiles of so many pixels a side, audio frames of so many milliseconds, tokens of a document page.
TILE, FRAME_MS, PAGE_TOKENS = 28, 40, 512
PART = "struct<type:string,text:string,ref:string,width:bigint,height:bigint,millis:bigint,pages:bigint>"


def escaped(text: Column) -> Column:
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), CONTROL, "$1\\\\")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"\\(\\?)", "$1")


def text_part(text: Column) -> Column:
    """A turn's plain text as its only part."""
    null = [F.lit(None).cast("long").alias(c) for c in ("width", "height", "millis", "pages")]
    return F.array(F.struct(F.lit("text").alias("type"), text.cast("string").alias("text"), F.lit(None).cast("string").alias("ref"), *null))


def part_tokens(p: Column) -> Column:
    """The tokens that an attachment expands to: tiles, frames or pages; at least one."""
    tiles = F.ceil(F.coalesce(p["width"], F.lit(0)) / TILE) * F.ceil(F.coalesce(p["height"], F.lit(0)) / TILE)
    n = F.when(p["type"] == "image", tiles).when(p["type"] == "audio", F.ceil(F.coalesce(p["millis"], F.lit(0)) / FRAME_MS)).when(p["type"] == "document", F.coalesce(p["pages"], F.lit(0)) * PAGE_TOKENS)
    return F.greatest(n, F.lit(1)).cast("long")


def visited(parts: Column) -> Column:
    """The text of a turn's parts in order; unknown kinds and null parts are left out."""
    kind = lambda p: F.coalesce(*(F.when(p["type"] == k, F.lit(v)) for k, v in PLACEHOLDER.items()))
    return F.array_join(F.transform(F.coalesce(parts, F.array().cast(f"array<{PART}>")), lambda p: F.when(p["type"] == "text", escaped(F.coalesce(p["text"], F.lit("")))).otherwise(F.coalesce(kind(p), F.lit("")))), "")


def attachments(parts: Column, turn: Column) -> Column:
    """The references of a turn's attachments in order, with their kinds and token counts."""
    other = F.filter(F.coalesce(parts, F.array().cast(f"array<{PART}>")), lambda p: p["type"].isin(*PLACEHOLDER))
    return F.transform(other, lambda p, i: F.struct(turn.cast("long").alias("turn"), i.cast("long").alias("place"), p["type"].alias("kind"), p["ref"].alias("ref"), part_tokens(p).alias("tokens")))


def format_chats(rows: DataFrame, parts: Column, conv: str = "conv_id", turn: str = "turn", role: str = "role") -> DataFrame:
    """One row for each conversation: its turns in order, written with the template.

    Columns: conv_id, formatted, loss_spans (start and length of each assistant text, in bytes, in order),
    attachments, attachment_tokens. Turns of equal number are ordered by role, then text; null turns come
    first, null roles and texts are empty, null conversations are one conversation, repeated rows are repeated
    turns, an empty table gives none. Other columns are left out.
    """
    who = escaped(F.coalesce(F.col(role).cast("string"), F.lit("")))
    head = F.concat(F.lit(TURN), who, F.lit(BODY))
    one = F.struct(F.col(turn).cast("long").alias("turn"), who.alias("who"), visited(parts).alias("body"), F.octet_length(head).alias("head"), attachments(parts, F.col(turn)).alias("attached"))
    # each turn's first byte is a running sum over its conversation, so that a long one costs its turns, not their square
    before = Window.partitionBy("conv_id").orderBy("turn", "who", "body", "attached").rowsBetween(Window.unboundedPreceding, -1)
    begin = F.coalesce(F.sum(F.col("head") + F.octet_length("body") + len(END)).over(before), F.lit(0)).cast("long")
    placed = rows.select(F.col(conv).alias("conv_id"), one.alias("t")).select("conv_id", "t.*").withColumn("begin", begin)
    chats = placed.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("begin", "who", "body", "head", "attached"))).alias("turns"))
    spoken = F.filter("turns", lambda t: t["who"] == "assistant")
    attached = F.flatten(F.transform("turns", lambda t: t["attached"]))
    return chats.select(
        "conv_id",
        F.array_join(F.transform("turns", lambda t: F.concat(F.lit(TURN), t["who"], F.lit(BODY), t["body"], F.lit(END))), "").alias("formatted"),
        F.transform(spoken, lambda t: F.struct((t["begin"] + t["head"]).alias("start"), F.octet_length(t["body"]).cast("long").alias("length"))).alias("loss_spans"),
        attached.alias("attachments"),
        F.aggregate(attached, F.lit(0).cast("long"), lambda n, a: n + a["tokens"]).alias("attachment_tokens"),
    )


def read_turns(formatted: Column) -> Column:
    """The (role, text) turns of a formatted conversation, unescaped; placeholders stay as they are."""
    pieces = F.filter(F.split(formatted, r"<\|turn\|>"), lambda x: x != "")
    two = lambda x: F.split(x, r"<\|body\|>", 2)
    return F.transform(pieces, lambda x: F.struct(unescaped(two(x)[0]).alias("role"), unescaped(F.substring(two(x)[1], F.lit(1), F.char_length(two(x)[1]) - len(END))).alias("text")))


def read_loss(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped."""
    cut = lambda raw: F.transform(spans, lambda s: unescaped(F.substring(raw, (s["start"] + 1).cast("int"), s["length"].cast("int")).cast("string")))
    # the bytes are an array's only element, so that they are made once and not for every span
    return F.array_join(F.flatten(F.transform(F.array(formatted.cast("binary")), cut)), "")
