"""Chat formatting of typed content parts, with a loss mask and reversible escapes.

A turn's parts are visited in order: text is escaped, every other part becomes
a numbered placeholder, and its reference and the tokens it expands to are
recorded. Turns of a conversation are rendered apart, so only the joining of
the rendered strings needs a conversation's rows together.

Markers hold < and >; inside texts, roles and type names these two and the
escape character itself are written as two characters that hold neither. So no
marker can occur inside a text, and the output splits back at the markers.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Each character and what stands for it. The escape character comes first on the way in and last on the way out.
ESCAPES = (("\\", "\\-"), ("<", "\\("), (">", "\\)"))


def escape(text: Column) -> Column:
    for plain, written in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(written))
    return text


def unescape(text: Column) -> Column:
    for plain, written in reversed(ESCAPES):
        text = F.replace(text, F.lit(written), F.lit(plain))
    return text


@dataclass(frozen=True)
class ChatTemplate:
    """Markers must hold < or >. Tokens that a part takes if it does not say so, by type."""

    turn: str = "<turn "
    role_end: str = ">"
    turn_end: str = "</turn>\n"
    loss_role: str = "assistant"
    tokens: tuple[tuple[str, int], ...] = (("image", 256), ("audio", 128), ("document", 512))

    def render_part(self, part: Column, number: Column) -> Column:
        kind = F.coalesce(part["type"], F.lit("text"))
        return F.when(kind == "text", escape(F.coalesce(part["text"], F.lit("")))).otherwise(F.concat(F.lit("<"), escape(kind), F.lit(" "), number.cast("string"), F.lit("/>")))

    def tokens_of(self, part: Column) -> Column:
        usual = F.lit(0)
        for kind, n in self.tokens:
            usual = F.when(part["type"] == kind, F.lit(n)).otherwise(usual)
        return F.coalesce(part["tokens"].cast("int"), usual)


def text_part(text: str) -> Column:
    """The parts of a message that is only text."""
    nothing = F.lit(None)
    return F.array(F.struct(F.lit("text").alias("type"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"), nothing.cast("string").alias("ref"), nothing.cast("int").alias("tokens")))


def format_chats(messages: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", parts: str = "parts", template: ChatTemplate = ChatTemplate()) -> DataFrame:
    """One row for each conversation: conv_id, formatted, loss, attachments, expanded_tokens.

    parts: array of structs type, text, ref, tokens. loss: array of (turn, start,
    chars), ordered: the spans of the loss role's content, with turn counted from
    0 and start from 0 within that turn of the output. attachments: array of
    (number, type, ref, tokens), numbered from 1 through the conversation in
    the order of their placeholders.

    Rows go by turn, null first; equal turns by role, then content. Null role:
    the empty role. Null or empty parts: an empty turn; a null type is text. A
    null conv_id is a conversation of its own. Repeated rows are turns of their
    own. Empty table: empty result. Other columns are ignored.
    """
    m = messages.select(F.col(conv_id).alias("conv"), F.col(turn).alias("turn"), F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(parts), F.expr("array()").cast(messages.schema[parts].dataType)).alias("parts"))
    extra = lambda p: F.coalesce(p["type"], F.lit("text")) != "text"
    order = W.partitionBy("conv").orderBy(F.col("turn").asc_nulls_first(), "role", "parts")
    m = m.withColumn("n_extra", F.size(F.filter("parts", extra)).cast("long"))
    m = m.withColumn("no", F.row_number().over(order) - 1).withColumn("base", F.sum("n_extra").over(order.rowsBetween(W.unboundedPreceding, 0)) - F.col("n_extra"))
    ordinal = lambda i: F.col("base") + F.size(F.filter(F.slice(F.col("parts"), F.lit(1), i + 1), extra))
    content = F.array_join(F.transform("parts", lambda p, i: template.render_part(p, ordinal(i))), "")
    head = F.concat(F.lit(template.turn), escape(F.col("role")), F.lit(template.role_end))
    m = m.withColumn("content", content).withColumn("head", head)
    found = F.transform(F.filter("parts", extra), lambda p, i: F.struct((F.col("base") + i + 1).alias("number"), p["type"].alias("type"), p["ref"].alias("ref"), template.tokens_of(p).alias("tokens")))
    m = m.select(
        "conv", "no", F.concat("head", "content", F.lit(template.turn_end)).alias("text"), found.alias("found"),
        F.when(F.col("role") == template.loss_role, F.struct(F.col("no").alias("turn"), F.length("head").alias("start"), F.length("content").alias("chars"))).alias("loss"),
    )
    turns = F.sort_array(F.collect_list(F.struct("no", "text", "found", "loss"))).alias("turns")
    g = m.groupBy("conv").agg(turns)
    attachments = F.flatten("turns.found")
    return g.select(
        F.col("conv").alias(conv_id), F.array_join("turns.text", "").alias("formatted"), F.filter("turns.loss", lambda x: x.isNotNull()).alias("loss"),
        attachments.alias("attachments"), F.aggregate(attachments, F.lit(0).cast("long"), lambda a, x: a + x["tokens"]).alias("expanded_tokens"),
    )


def read_turns(formatted: Column, template: ChatTemplate = ChatTemplate()) -> Column:
    """The turns of a formatted conversation as written, without their end markers."""
    pieces = F.split(formatted, "\\Q" + template.turn_end.rstrip("\n") + "\\E\n")
    return F.slice(pieces, F.lit(1), F.size(pieces) - 1)


def read_role(piece: Column, template: ChatTemplate = ChatTemplate()) -> Column:
    inner = F.substring(piece, F.lit(len(template.turn) + 1), F.length(piece))
    return unescape(F.substring_index(inner, template.role_end, 1))


def read_content(piece: Column, template: ChatTemplate = ChatTemplate()) -> Column:
    """The content of a turn, unescaped; placeholders stay as they are."""
    return unescape(F.substring(piece, F.locate(template.role_end, piece) + len(template.role_end), F.length(piece)))
