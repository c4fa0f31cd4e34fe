r"""Conversations as one training string each, with loss mask and attachments.

A turn is a list of typed parts. A visitor walks the parts in order: text is escaped
and kept, image, audio and document parts leave a placeholder and are recorded as
attachments with the number of tokens that the placeholder will be expanded to. Turns
become ``<|turn|>role<|text|>body<|end|>``.

Control strings all begin with ``<|``. In texts and roles a backslash is doubled and
``<|`` is written ``<\|``, so ``<|`` never occurs in an escaped text and the output can
be split into turns and parts again without loss.

Everything is DataFrame functions. Positions inside a conversation come from a running
sum over the same partitioning that collects it, so there is one shuffle. A conversation
is one output row and so is bounded by what a row can hold; hot conversations beyond
that are not a training string any more.

Defined results: a null text, role or list of parts is empty; a part whose type is none
of image, audio, document is text; turns are ordered by turn (null first), then role,
then body, and repeated rows stay; a null conversation id is a conversation of its own;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
MEDIA = ("image", "audio", "document")
# What a list of parts has to look like; fields that do not concern a type are null.
PARTS = "array<struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>>"


@dataclass(frozen=True)
class TokenCosts:
    """Tokens that a placeholder is expanded to."""

    image_tile: int = 512
    image_tokens_per_tile: int = 170
    image_base: int = 85
    audio_tokens_per_second: float = 25.0
    document_tokens_per_page: int = 1024


def escape(text: Column) -> Column:
    doubled = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.replace(doubled, F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    single = F.replace(text, F.lit("<\\|"), F.lit("<|"))
    return F.replace(single, F.lit("\\\\"), F.lit("\\"))


def text_parts(text: Column) -> Column:
    """A plain text as a list of one part."""
    return F.array(
        F.struct(
            F.lit("text").alias("type"),
            text.alias("text"),
            F.lit(None).cast("string").alias("ref"),
            F.lit(None).cast("int").alias("width"),
            F.lit(None).cast("int").alias("height"),
            F.lit(None).cast("double").alias("seconds"),
            F.lit(None).cast("int").alias("pages"),
        )
    )


def _is_media(part: Column) -> Column:
    return F.coalesce(part["type"].isin(*MEDIA), F.lit(False))


def _visit(part: Column) -> Column:
    marked = F.concat(F.lit("<|"), part["type"], F.lit("|>"))
    return F.when(_is_media(part), marked).otherwise(escape(F.coalesce(part["text"], F.lit(""))))


def _merged(parts: Column) -> Column:
    """Parts with neighbouring texts as one, so that no control string can form between them."""

    def add(done: Column, part: Column) -> Column:
        last = F.get(done, F.size(done) - 1)
        texts = ~_is_media(part) & F.coalesce(~_is_media(last) & last.isNotNull(), F.lit(False))
        both = F.concat(F.coalesce(last["text"], F.lit("")), F.coalesce(part["text"], F.lit("")))
        joined = F.array(part.withField("text", both))
        return F.when(texts, F.concat(F.slice(done, 1, F.size(done) - 1), joined)).otherwise(F.concat(done, F.array(part)))

    return F.aggregate(parts, F.array().cast(PARTS), add)


def _tokens(part: Column, costs: TokenCosts) -> Column:
    def tiles(side: Column) -> Column:
        return F.ceil(F.coalesce(side, F.lit(0)) / costs.image_tile)

    image = costs.image_base + costs.image_tokens_per_tile * tiles(part["width"]) * tiles(part["height"])
    audio = F.ceil(F.coalesce(part["seconds"], F.lit(0.0)) * costs.audio_tokens_per_second)
    pages = F.coalesce(part["pages"], F.lit(0)) * costs.document_tokens_per_page
    return (
        F.when(part["type"] == "image", image).when(part["type"] == "audio", audio).otherwise(pages)
    ).cast("long")


def format_conversations(
    turns: DataFrame,
    parts: Column,
    trained_roles: Sequence[str] = ("assistant",),
    costs: TokenCosts = TokenCosts(),
) -> DataFrame:
    """One row per conversation of ``turns`` (conv_id, turn, role and ``parts``).

    Gives conv_id, n_turns, formatted, loss_spans (start and length in code points of
    the bodies to be learned), attachments (type, ref, tokens, in the order of their
    placeholders) and attachment_tokens.
    """
    listed = F.coalesce(parts, F.array().cast(PARTS))
    role = F.coalesce(F.col("role"), F.lit(""))
    seen = turns.select(
        "conv_id",
        "turn",
        role.alias("role"),
        F.concat(F.lit(TURN), escape(role), F.lit(TEXT)).alias("head"),
        F.array_join(F.transform(_merged(listed), _visit), "").alias("body"),
        F.transform(
            F.filter(listed, _is_media),
            lambda p: F.struct(p["type"].alias("type"), p["ref"].alias("ref"), _tokens(p, costs).alias("tokens")),
        ).alias("media"),
    )
    before = Window.partitionBy("conv_id").orderBy("turn", "role", "body")
    whole = F.length("head") + F.length("body") + F.lit(len(END))
    placed = seen.select(
        "conv_id",
        F.struct(
            (F.sum(whole.cast("long")).over(before.rowsBetween(Window.unboundedPreceding, 0)) - F.length("body") - len(END)).alias("start"),
            F.col("role").isin(*trained_roles).alias("trained"),
            F.length("body").cast("long").alias("length"),
            F.concat("head", "body", F.lit(END)).alias("text"),
            "media",
        ).alias("t"),
    )
    media = F.flatten(F.transform("turns", lambda t: t["media"]))
    return (
        placed.groupBy("conv_id")
        .agg(F.sort_array(F.collect_list("t")).alias("turns"))
        .select(
            "conv_id",
            F.size("turns").cast("long").alias("n_turns"),
            F.array_join(F.transform("turns", lambda t: t["text"]), "").alias("formatted"),
            F.transform(
                F.filter("turns", lambda t: t["trained"]),
                lambda t: F.struct(t["start"].alias("start"), t["length"].alias("length")),
            ).alias("loss_spans"),
            media.alias("attachments"),
            F.aggregate(media, F.lit(0).cast("long"), lambda n, a: n + a["tokens"]).alias("attachment_tokens"),
        )
    )


def read_back(formatted: Column) -> Column:
    """The turns of a formatted conversation: role and parts (type, text)."""

    def part(piece: Column, i: Column) -> Column:
        kind = F.when(i > 0, F.substring_index(piece, "|>", 1)).otherwise(F.lit("text"))
        rest = F.when(i > 0, F.substr(piece, F.instr(piece, "|>") + F.lit(2))).otherwise(piece)
        return F.struct(kind.alias("type"), unescape(rest).alias("text"))

    def turn(piece: Column) -> Column:
        body = F.substring_index(F.substring_index(piece, TEXT, -1), END, 1)
        return F.struct(
            unescape(F.substring_index(piece, TEXT, 1)).alias("role"),
            F.transform(F.split(body, r"<\|"), part).alias("parts"),
        )

    return F.transform(F.array_compact(F.array_remove(F.split(formatted, r"<\|turn\|>"), "")), turn)


def turn_text(turn: Column) -> Column:
    """The text of a turn that ``read_back`` gave, without placeholders."""
    return F.array_join(F.transform(turn["parts"], lambda p: p["text"]), "")


def loss_text(formatted: Column, loss_spans: Column) -> Column:
    """All text under the loss mask, unescaped, one span after the other."""
    return F.array_join(
        F.transform(loss_spans, lambda s: unescape(F.substring(formatted, s["start"] + 1, s["length"]))), ""
    )
