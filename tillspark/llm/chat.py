"""Chat formatting with typed content parts, in column expressions only.

A conversation's rows become one text. A turn reads ``<turn>role NEWLINE body</turn> NEWLINE``; the body is
its parts in order: text as it is, anything else as a placeholder ``<attachment kind>``. The k-th
placeholder belongs to the k-th entry of ``attachments``.

Reversible escapes: ``\\`` becomes ``\\b``, the ``<`` of a control string inside a text becomes ``\\l``, and a
line break inside a role ``\\e``. No text can then hold a control string.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

OPEN, CLOSE = "<turn>", "</turn>\n"
#: Tokens that one unit of a part expands to: an image's tile, a second of audio, a document's page.
UNIT_TOKENS = {"image": 256, "audio": 25, "document": 600}
#: Units of a part that does not say.
DEFAULT_UNITS = 1.0

PARTS_TYPE = "array<struct<kind:string,text:string,ref:string,units:double>>"
_ATTACHMENTS = "array<struct<position:int,kind:string,ref:string,tokens:long>>"


def escape(text: Column) -> Column:
    text = F.replace(text, F.lit("\\"), F.lit("\\b"))
    return F.regexp_replace(text, "<(/?(?:turn|attachment))", r"\\l$1")


def unescape(text: Column) -> Column:
    for mark, char in (("\\l", "<"), ("\\e", "\n"), ("\\b", "\\")):
        text = F.replace(text, F.lit(mark), F.lit(char))
    return text


def text_part(text: Column) -> Column:
    """The parts of a turn that is one text; NULL is the empty text."""
    return F.array(F.struct(
        F.lit("text").alias("kind"), F.coalesce(text, F.lit("")).alias("text"),
        F.lit(None).cast("string").alias("ref"), F.lit(None).cast("double").alias("units"),
    )).cast(PARTS_TYPE)


def _is_text(part: Column) -> Column:
    return F.coalesce(part["kind"], F.lit("text")) == "text"


def _shown(part: Column) -> Column:
    marker = F.concat(F.lit("<attachment "), escape(part["kind"]), F.lit(">"))
    return F.when(_is_text(part), escape(F.coalesce(part["text"], F.lit("")))).otherwise(marker)


def _tokens(part: Column) -> Column:
    units = F.greatest(F.coalesce(part["units"], F.lit(DEFAULT_UNITS)), F.lit(0.0))
    each = F.lit(UNIT_TOKENS["document"])
    for kind, n in UNIT_TOKENS.items():
        each = F.when(part["kind"] == kind, F.lit(n)).otherwise(each)
    return F.ceil(units * each).cast("long")


def _starts(lengths: Column) -> Column:
    """Where each of consecutive pieces starts, and where the last ends."""
    return F.aggregate(lengths, F.array(F.lit(0)), lambda seen, n: F.concat(seen, F.array(F.element_at(seen, -1) + n)))


def _visit(parts: Column) -> Column:
    """One turn's body and its attachments, placed within the body."""
    shown = F.transform(parts, _shown)
    starts = _starts(F.transform(shown, F.length))
    placed = F.transform(parts, lambda p, i: F.struct(
        F.get(starts, i).alias("position"), p["kind"].alias("kind"), p["ref"].alias("ref"), _tokens(p).alias("tokens")))
    return F.struct(
        F.array_join(shown, "").alias("body"),
        F.filter(placed, lambda p: F.coalesce(p["kind"], F.lit("text")) != "text").cast(_ATTACHMENTS).alias("attachments"))


def format_conversations(
    turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
    parts: str | None = None, learn_roles: tuple[str, ...] = ("assistant",),
) -> DataFrame:
    """One row per conversation: conv_id, formatted, loss_spans, attachments, expanded_tokens.

    ``parts`` names a column of ``PARTS_TYPE`` that replaces ``text``. Positions and lengths count code
    points of ``formatted``; ``loss_spans`` cover the bodies of ``learn_roles``; ``expanded_tokens`` is what
    the attachments stand for.

    NULL roles, texts and part lists are empty, a part of NULL kind is text, and one of an unknown kind counts as a
    document. Turns are ordered by (turn, role, parts), NULL turns first, so repeated rows stay and ties
    have one order. Rows of NULL conv_id are one conversation. No rows in, no rows out. Other columns
    are ignored. A conversation is one output row, so its size is bounded by what a row can hold.
    """
    content = F.coalesce(F.col(parts).cast(PARTS_TYPE), F.array().cast(PARTS_TYPE)) if parts else text_part(F.col(text))
    rows = turns.select(
        F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"),
        F.filter(content, lambda p: p.isNotNull()).alias("parts"))
    rendered = rows.withColumns({
        "head": F.concat(F.lit(OPEN), F.replace(escape(F.col("role")), F.lit("\n"), F.lit("\\e")), F.lit("\n")), "flat": _visit(F.col("parts"))})
    # Where turns start is a running sum over the rows, which also puts them in order.
    earlier = W.partitionBy("conv_id").orderBy("turn", "role", "parts").rowsBetween(W.unboundedPreceding, -1)
    size = F.length("head") + F.length("flat.body") + len(CLOSE)
    placed = rendered.withColumn("start", F.coalesce(F.sum(size).over(earlier), F.lit(0)).cast("int"))
    placed = placed.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("start", "role", "head", "flat"))).alias("turns"))
    body_at = lambda t: t["start"] + F.length(t["head"])
    spans = F.transform("turns", lambda t: F.struct(
        t["role"].alias("role"), body_at(t).alias("start"), F.length(t["flat"]["body"]).alias("length")))
    moved = F.flatten(F.transform("turns", lambda t: F.transform(t["flat"]["attachments"], lambda a: F.struct(
        (a["position"] + body_at(t)).alias("position"), a["kind"].alias("kind"), a["ref"].alias("ref"),
        a["tokens"].alias("tokens")))))
    return placed.select(
        "conv_id",
        F.array_join(F.transform("turns", lambda t: F.concat(t["head"], t["flat"]["body"], F.lit(CLOSE))), "").alias("formatted"),
        F.transform(F.filter(spans, lambda s: s["role"].isin(*learn_roles)),
                    lambda s: F.struct(s["start"].alias("start"), s["length"].alias("length"))).alias("loss_spans"),
        moved.alias("attachments"),
        F.aggregate(moved, F.lit(0).cast("long"), lambda n, a: n + a["tokens"]).alias("expanded_tokens"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, turns (role, text) and loss_text, from the columns formatted and loss_spans alone.

    Placeholders of attachments come back as they stand in the text.
    """
    chunks = F.filter(F.split("formatted", CLOSE, -1), lambda c: c != "")
    body = lambda c: F.substring(c, len(OPEN) + 1, 2**31 - 1)
    turns = F.transform(chunks, lambda c: F.struct(
        unescape(F.substring_index(body(c), "\n", 1)).alias("role"),
        unescape(F.substring(body(c), F.locate("\n", body(c)) + 1, F.lit(2**31 - 1))).alias("text")))
    loss = F.array_join(F.transform("loss_spans", lambda s: unescape(
        F.substring(F.col("formatted"), s["start"] + 1, s["length"]))), "")
    return formatted.select("conv_id", "formatted", turns.alias("turns"), loss.alias("loss_text"))
