r"""Chat formatting with typed content parts.

A message's content is an array of parts (type, text, ref, size). A visitor flattens the parts in order: text parts
become escaped text; image, audio and document parts become placeholders ``\p<kind letter><number>;``, their references
are recorded with the number, and the tokens that a placeholder stands for are counted.

Template: ``<turn role="user">content</turn>`` and a line end; what the model is to learn stands between ``<learn>`` and
``</learn>`` inside an assistant turn, which is the loss mask. Escapes: a backslash becomes ``\b``, ``<`` becomes ``\l``
and, in roles, ``"`` becomes ``\q``; so ``<`` occurs in markup only, no text can imitate a turn or a placeholder, and
undoing the escapes (``\q``, ``\l``, then ``\b``) gives every text back.

Only SQL functions are used. Defined cases: NULL text or role counts as empty; equal (conversation, turn) rows are
ordered by role and text and all kept; a NULL conversation id is a conversation of its own; a NULL turn comes first; an
empty table gives an empty result; extra columns are ignored. A conversation becomes one row, as its format asks, so one
conversation must fit in a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD

PART = "struct<type:string,text:string,ref:string,size:bigint>"
# The letter of each attachment kind and the unit of size (pixels, milliseconds, pages) that is one token.
KINDS = (("image", "i", 784), ("audio", "a", 40), ("document", "d", 1))
LEARN_ROLE = "assistant"
TURN = r'<turn role="([^"<]*)">(?:<learn>)?([^<]*)(?:</learn>)?</turn>'
LEARNED = r"<learn>([^<]*)</learn>"


def escape(text: Column) -> Column:
    return F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\b")), F.lit("<"), F.lit("\\l"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("\\q"), F.lit('"')), F.lit("\\l"), F.lit("<")), F.lit("\\b"), F.lit("\\"))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit('"'), F.lit("\\q"))


def text_parts(text: Column) -> Column:
    """Plain text as content: one text part."""
    return F.array(F.struct(F.lit("text").alias("type"), text.alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("long").alias("size"))).cast(f"array<{PART}>")


def _is_text(part: Column) -> Column:
    return ~F.coalesce(part["type"].isin(*[k for k, _, _ in KINDS]), F.lit(False))


def visit(parts: Column) -> Column:
    """Struct (body, attachments, tokens) of a content column: escaped text with placeholders; (number, type, ref, tokens)
    of each attachment in order; words plus attachment tokens. Unknown part types count as text."""
    letter = F.create_map(*[F.lit(x) for k, c, _ in KINDS for x in (k, c)])
    unit = F.create_map(*[F.lit(x) for k, _, u in KINDS for x in (k, u)])
    tokens = lambda p: F.when(_is_text(p), F.coalesce(F.regexp_count(p["text"], F.lit(WORD)), F.lit(0)).cast("long")).otherwise(F.ceil(F.coalesce(p["size"], F.lit(0)) / F.element_at(unit, p["type"])))
    places = F.filter(F.transform(parts, lambda p, i: F.when(_is_text(p), -1).otherwise(i)), lambda i: i >= 0)

    def piece(p: Column, i: Column, files: Column) -> Column:
        number = (F.array_position(files, i) - 1).cast("string")
        return F.when(_is_text(p), escape(p["text"])).otherwise(F.concat(F.lit("\\p"), F.element_at(letter, p["type"]), number, F.lit(";")))

    pieces = F.get(F.transform(F.array(places), lambda files: F.transform(parts, lambda p, i: piece(p, i, files))), 0)  # places are found once
    attachments = F.transform(F.filter(parts, lambda p: ~_is_text(p)), lambda p, i: F.struct(i.alias("number"), p["type"].alias("type"), p["ref"].alias("ref"), tokens(p).alias("tokens")))
    total = F.aggregate(parts, F.lit(0).cast("long"), lambda a, p: a + tokens(p))
    return F.struct(F.array_join(pieces, "").alias("body"), attachments.alias("attachments"), total.alias("tokens"))


def format_turns(turns: DataFrame, content: str | None = None) -> DataFrame:
    """One row (conv_id, formatted, attachments, tokens) for each conversation of rows (conv_id, turn, role, and text or
    ``content``, an array of parts; plain text is visited as one text part); attachments keep the turn's place in the
    conversation."""
    parts = F.coalesce(F.col(content), F.array().cast(f"array<{PART}>")) if content else text_parts(F.col("text"))
    seen = turns.select("conv_id", "turn", escape_role(F.col("role")).alias("role"), visit(parts).alias("seen"))
    line = seen.select("conv_id", F.struct("turn", "role", "seen.body", "seen.attachments", "seen.tokens").alias("t"))
    held = line.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    opened = lambda t: F.concat(F.lit('<turn role="'), t["role"], F.lit('">'))
    learnt = lambda t: F.when(t["role"] == LEARN_ROLE, F.concat(F.lit("<learn>"), t["body"], F.lit("</learn>"))).otherwise(t["body"])
    return held.select(
        "conv_id",
        F.array_join(F.transform("turns", lambda t: F.concat(opened(t), learnt(t), F.lit("</turn>\n"))), "").alias("formatted"),
        F.flatten(F.transform("turns", lambda t, i: F.transform(t["attachments"], lambda a: F.struct(i.alias("place"), a.alias("attachment"))))).alias("attachments"),
        F.aggregate("turns", F.lit(0).cast("long"), lambda a, t: a + t["tokens"]).alias("tokens"),
    )


def read_turns(formatted: Column) -> Column:
    """The turns (role, text) of a formatted conversation, unescaped; placeholders stay."""
    roles, bodies = F.regexp_extract_all(formatted, F.lit(TURN), F.lit(1)), F.regexp_extract_all(formatted, F.lit(TURN), F.lit(2))
    return F.transform(F.arrays_zip(roles.alias("role"), bodies.alias("text")), lambda t: F.struct(unescape(t["role"]).alias("role"), unescape(t["text"]).alias("text")))


def read_learnt(formatted: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    return F.array_join(F.transform(F.regexp_extract_all(formatted, F.lit(LEARNED), F.lit(1)), unescape), "")
