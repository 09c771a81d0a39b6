"""Chat formatting with typed content parts.

A conversation becomes one string. Each turn is

    <s>ROLE[INST]CONTENT</s>        or, for a turn under the loss mask,
    <s>ROLE[/INST]CONTENT</s>

A visitor walks the content parts of a turn in order: text parts are escaped and kept,
image, audio and document parts become numbered placeholders such as ``<|image:0|>``, and
each such attachment is recorded with its reference and the tokens it expands to.

Escaping is reversible. Backslashes in texts are doubled and every control string gets one
backslash after its first character, so that none is left; removing one backslash of each
pair, and each single one, restores the text. No control string has ``<`` or ``[`` behind
its first character, so none can arise across the border between text and template.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN, CLOSE, ASK, ANSWER = "<s>", "</s>", "[INST]", "[/INST]"
PLACEHOLDER = "<|"
CONTROL = (OPEN, CLOSE, ASK, ANSWER, PLACEHOLDER)
#: Tokens that an attachment expands to when the part does not say.
EXPANSION = {"image": 256, "audio": 128, "document": 512}
PART = "struct<kind:string,text:string,ref:string,tokens:bigint>"


def escape(text: Column) -> Column:
    text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for control in CONTROL:
        text = F.replace(text, F.lit(control), F.lit(f"{control[0]}\\{control[1:]}"))
    return text


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\(\\?)", "$1")


def text_parts(text: Column) -> Column:
    """The content parts of a plain text; NULL counts as empty."""
    none = F.lit(None).cast("string")
    return F.array(
        F.struct(
            F.lit("text").alias("kind"),
            F.coalesce(text, F.lit("")).alias("text"),
            none.alias("ref"),
            F.lit(None).cast("bigint").alias("tokens"),
        )
    )


def _is_text(part: Column) -> Column:
    return F.coalesce(part["kind"], F.lit("text")) == "text"


def _visit(part: Column, number: Column) -> Column:
    """The string of one part; ``number`` is its place among the attachments of the turn."""
    mark = F.concat(F.lit(PLACEHOLDER), escape(part["kind"]), F.lit(":"), number, F.lit("|>"))
    return F.when(_is_text(part), escape(F.coalesce(part["text"], F.lit("")))).otherwise(mark)


def _tokens(part: Column, expansion: Mapping[str, int]) -> Column:
    default = F.lit(0).cast("bigint")
    for kind, tokens in expansion.items():
        default = F.when(part["kind"] == kind, F.lit(tokens).cast("bigint")).otherwise(default)
    return F.coalesce(part["tokens"], default)


def format_conversations(
    turns: DataFrame,
    parts: str = "parts",
    loss_roles: tuple[str, ...] = ("assistant",),
    expansion: Mapping[str, int] = EXPANSION,
) -> DataFrame:
    """One row per ``conv_id``: ``formatted``, ``loss_spans``, ``attachments``, ``n_turns``,
    ``expanded_tokens``.

    ``turns`` has ``conv_id``, ``turn``, ``role`` and the array column ``parts`` (type
    ``PART``); other columns are ignored. Turns are ordered by turn, then role, then
    content. NULL roles, parts and texts count as empty, a NULL kind as text, a NULL
    conv_id is a conversation of its own, and repeated rows are turns like any other.
    Spans are [start, end) in code points of ``formatted``. An empty table gives no rows.
    A conversation is one output row and has to fit into a task; nothing else does.
    """
    role = F.coalesce(F.col("role"), F.lit(""))
    content = F.coalesce(F.col(parts), F.array().cast(f"array<{PART}>"))
    before = lambda i: F.size(F.filter(F.slice(F.col("_parts"), 1, i), lambda p: ~_is_text(p)))
    visited = F.array_join(
        F.transform(F.col("_parts"), lambda p, i: _visit(p, before(i).cast("string"))), ""
    )
    rendered = turns.select("conv_id", "turn", role.alias("_role"), content.alias("_parts")).select(
        "conv_id",
        "turn",
        "_role",
        "_parts",
        F.col("_role").isin(*loss_roles).alias("_loss"),
        visited.alias("_content"),
    )
    head = F.concat(
        F.lit(OPEN), escape(F.col("_role")), F.when(F.col("_loss"), ANSWER).otherwise(ASK)
    )
    in_order = Window.partitionBy("conv_id").orderBy("turn", "_role", "_content")
    running = in_order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = (
        rendered.withColumn("_head", head)
        .withColumn("_text", F.concat("_head", "_content", F.lit(CLOSE)))
        .withColumn("_end", F.sum(F.char_length("_text")).over(running))
        .withColumn("_number", F.row_number().over(in_order))
    )
    start = F.col("_end") - F.char_length("_text") + F.char_length("_head")
    span = F.struct(start.alias("start"), (F.col("_end") - len(CLOSE)).alias("end"))
    found = F.transform(
        F.filter(F.col("_parts"), lambda p: ~_is_text(p)),
        lambda p, i: F.struct(
            F.col("_number").alias("turn_number"),
            i.alias("part_number"),
            p["kind"].alias("kind"),
            p["ref"].alias("ref"),
            _tokens(p, expansion).alias("tokens"),
        ),
    )
    gathered = placed.groupBy("conv_id").agg(
        F.array_sort(
            F.collect_list(
                F.struct(
                    F.col("_number").alias("number"),
                    F.col("_text").alias("text"),
                    F.when(F.col("_loss"), span).alias("span"),
                    found.alias("found"),
                )
            )
        ).alias("_turns")
    )
    turns_of = F.col("_turns")
    attachments = F.flatten(F.transform(turns_of, lambda t: t["found"]))
    return gathered.select(
        "conv_id",
        F.array_join(F.transform(turns_of, lambda t: t["text"]), "").alias("formatted"),
        F.filter(F.transform(turns_of, lambda t: t["span"]), lambda s: s.isNotNull()).alias("loss_spans"),
        attachments.alias("attachments"),
        F.size(turns_of).cast("long").alias("n_turns"),
    ).withColumn(
        "expanded_tokens",
        F.aggregate(F.col("attachments"), F.lit(0).cast("bigint"), lambda a, x: a + x["tokens"]),
    )


def read_back(formatted: Column) -> Column:
    """The turns (role, text, loss) in a formatted conversation.

    Attachments stay as their placeholders.
    """

    def turn(piece: Column) -> Column:
        body = F.substring(piece, len(OPEN) + 1, 2**31 - 1)
        sides = F.split(body, r"\[/?INST\]", 2)
        return F.struct(
            unescape(sides[0]).alias("role"),
            unescape(sides[1]).alias("text"),
            F.contains(body, F.lit(ANSWER)).alias("loss"),
        )

    pieces = F.split(formatted, CLOSE)
    return F.transform(F.slice(pieces, F.lit(1), F.size(pieces) - 1), turn)


def text_under_mask(formatted: Column, spans: Column) -> Column:
    """All unescaped text that the spans cover, nothing between."""
    cut = lambda s: unescape(F.substr(formatted, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))
    return F.array_join(F.transform(spans, cut), "")
