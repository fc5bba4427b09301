"""Chat formatting with typed content parts, by DataFrame functions only.

A turn has a role and parts of type text, image, audio or document. The visitor turns
each part into a piece: escaped text, or a placeholder that stands for the attachment.
Pieces of a conversation are laid out one behind the other; running sums give every piece
its place, so attachments are recorded in order with their reference, place and expanded
token count, and the text of the trained role gets its span in the loss mask.

Template: ``<|role|>`` content ``<|end|>``; placeholders are ``<|image|>``, ``<|audio|>``,
``<|document|>`` and, for unknown types, ``<|attachment|>``. Roles and texts are escaped: a
backslash becomes ``\\b`` and a bar ``\\p``, so that no control string can occur in them,
and both can be had back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

END = "<|end|>"
TRAINED = "assistant"
PATCH = 14  # pixels a side that make one token
AUDIO_TOKENS = 25  # a second
PAGE_TOKENS = 576
IMAGE_TOKENS = 256  # of an image of unknown size

PART = "struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"


def text_parts(text: Column) -> Column:
    """The parts of a turn that is text only; a null text is an empty one."""
    null = lambda kind: F.lit(None).cast(kind)
    return F.array(F.struct(
        F.lit("text").alias("type"), F.coalesce(text.cast("string"), F.lit("")).alias("text"), null("string").alias("ref"),
        null("int").alias("width"), null("int").alias("height"), null("double").alias("seconds"), null("int").alias("pages"),
    ))


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\b")), F.lit("|"), F.lit("\\p"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\p"), F.lit("|")), F.lit("\\b"), F.lit("\\"))


def expanded_tokens(part: Column) -> Column:
    """Tokens an attachment stands for; 0 for text, negative sizes count as none."""
    positive = lambda c: F.when(c > 0, c).when(c.isNotNull(), F.lit(0))
    patches = F.ceil(positive(part["width"]) / F.lit(PATCH)) * F.ceil(positive(part["height"]) / F.lit(PATCH))
    kind = part["type"]
    return (
        F.when(kind == "image", F.coalesce(patches, F.lit(IMAGE_TOKENS)))
        .when(kind == "audio", F.coalesce(F.ceil(positive(part["seconds"]) * AUDIO_TOKENS), F.lit(1)))
        .when(kind == "document", positive(F.coalesce(part["pages"], F.lit(1))) * PAGE_TOKENS)
        .otherwise(0).cast("bigint")
    )


def _piece(kind: Column, content: Column, ref: Column, tokens: Column) -> Column:
    return F.struct(kind.alias("kind"), content.alias("content"), ref.alias("ref"), tokens.cast("bigint").alias("tokens"))


def _visit(part: Column) -> Column:
    kind = F.coalesce(part["type"], F.lit("text"))
    name = F.when(kind.isin("image", "audio", "document"), kind).otherwise("attachment")
    content = F.when(kind == "text", escape(F.coalesce(part["text"], F.lit("")))).otherwise(F.concat(F.lit("<|"), name, F.lit("|>")))
    return _piece(kind, content, part["ref"], expanded_tokens(part))


def format_turns(
    turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
    parts: Column | None = None, text_col: str = "text", trained: str = TRAINED,
) -> DataFrame:
    """One row per conversation: id, n_turns, formatted, loss_spans, attachments, expanded_tokens.

    ``parts`` is a column of array<PART>; without it the turns' ``text_col`` is their only part.
    ``loss_spans``: (start, length) in characters of ``formatted``, in order, of the texts of
    the ``trained`` role. ``attachments``: (place, type, ref, tokens), in order.

    Turns are in the order of their number, nulls first, equal numbers by role and content;
    a repeated row is a turn of its own. Null roles and texts count as empty; null or empty
    parts make a turn without content; a part without type is text. Rows with a null id are
    one conversation. Texts of any length stay whole; an empty table gives none; other
    columns are left behind. A conversation's output is one string, so it is put together in
    one task; its turns reach that task in a single shuffle.
    """
    content = text_parts(F.col(text_col)) if parts is None else F.coalesce(parts, F.array()).cast(f"array<{PART}>")
    none, role = F.lit(None).cast("string"), F.coalesce(F.col(role_col).cast("string"), F.lit(""))
    rows = turns.select(
        F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), role.alias("role"),
        F.transform(content, _visit).alias("visited"),
    )
    body = F.array_join(F.transform("visited", lambda p: p["content"]), "")
    place = Window.partitionBy("conv").orderBy(F.col("turn").asc_nulls_first(), "role", body)
    head = _piece(F.lit("head"), F.concat(F.lit("<|"), escape(F.col("role")), F.lit("|>")), none, F.lit(0))
    tail = _piece(F.lit("tail"), F.lit(END), none, F.lit(0))
    pieces = rows.withColumn("nth", F.row_number().over(place)).select(
        "conv", "nth", "role", F.posexplode(F.concat(F.array(head), "visited", F.array(tail))).alias("pos", "piece")
    ).select("conv", "nth", "role", "pos", "piece.*")
    before = Window.partitionBy("conv").orderBy("nth", "pos").rowsBetween(Window.unboundedPreceding, -1)
    length = F.length("content").cast("bigint")
    laid = pieces.withColumn("start", F.coalesce(F.sum(length).over(before), F.lit(0).cast("bigint")))
    trained_text = (F.col("kind") == "text") & (F.col("role") == trained)
    attached = ~F.col("kind").isin("head", "text", "tail")
    whole = laid.groupBy("conv").agg(
        F.sort_array(F.collect_list(F.struct("nth", "pos", "content"))).alias("pieces"),
        F.sort_array(F.collect_list(F.when(trained_text, F.struct("start", length.alias("length"))))).alias("loss_spans"),
        F.sort_array(F.collect_list(F.when(attached, F.struct("nth", "pos", "start", F.col("kind").alias("type"), "ref", "tokens")))).alias("attachments"),
        F.max("nth").cast("bigint").alias("n_turns"), F.sum("tokens").alias("expanded_tokens"),
    )
    return whole.select(
        F.col("conv").alias(conv_col), "n_turns",
        F.array_join(F.transform("pieces", lambda p: p["content"]), "").alias("formatted"),
        "loss_spans",
        F.transform("attachments", lambda a: F.struct(a["start"].alias("place"), a["type"].alias("type"), a["ref"].alias("ref"), a["tokens"].alias("tokens"))).alias("attachments"),
        "expanded_tokens",
    )


def read_turns(formatted: Column) -> Column:
    """Array of (role, text) read back from a formatted conversation; placeholders stay in the text."""
    def turn(x: Column) -> Column:
        mark = F.instr(x, "|>")
        return F.struct(
            unescape(F.substr(x, F.lit(3), mark - 3)).alias("role"), unescape(F.substr(x, mark + 2)).alias("text")
        )

    shut = F.split(formatted, r"<\|end\|>", -1)
    return F.transform(F.slice(shut, F.lit(1), F.size(shut) - 1), turn)


def masked_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, in order, nothing between."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substr(formatted, s["start"].cast("int") + 1, s["length"].cast("int")))), "")
