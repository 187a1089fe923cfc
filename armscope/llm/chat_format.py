"""Chat formatting by prefix-target expansion.

A turn is written as ``<s>[INST]role[/INST]text</s>``.  Those four marks, line
breaks in roles and the backslash are escaped inside roles and texts, so the
formatted text reads back to the very turns it was made of.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The template's control strings.
OPEN, ROLE, END_ROLE, CLOSE = "<s>", "[INST]", "[/INST]", "</s>"
CONTROLS = (CLOSE, OPEN, END_ROLE, ROLE)


def escape(text: Column) -> Column:
    """Backslashes doubled, then one put after the first character of every control string."""
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for mark in CONTROLS:
        out = F.replace(out, F.lit(mark), F.lit(f"{mark[0]}\\{mark[1:]}"))
    return out


def unescape(text: Column) -> Column:
    """The inverse of ``escape``: after it, runs of backslashes are even but for the marks."""
    out = text
    for mark in CONTROLS:
        out = F.replace(out, F.lit(f"{mark[0]}\\{mark[1:]}"), F.lit(mark))
    return F.replace(out, F.lit("\\\\"), F.lit("\\"))


def _turn(role: Column, text: Column) -> Column:
    return F.concat(F.lit(OPEN + ROLE), escape(role), F.lit(END_ROLE), escape(text), F.lit(CLOSE))


def prefix_targets(
    turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
    trained_role: str = "assistant",
) -> DataFrame:
    """One training example per turn of ``trained_role``.

    Columns: the conversation, target_turn (position from 0), formatted (all
    turns up to and with the target), loss_start and loss_chars (the target's
    escaped text in ``formatted``, 0-based code points): only that reply is
    trainable.  A conversation whose last turn is of another role gives one more
    example that holds all its turns and has no target: target_turn null and
    loss_chars 0, so no turn is lost.

    Turns go by ``turn``, then role and text; repeated turns are all kept.  Null
    texts and roles count as empty; a null conversation is one conversation.
    A conversation is gathered in one row, as its last example is anyway.
    Other columns of ``turns`` are ignored.
    """
    one = F.struct(
        F.col(turn).alias("turn"),
        F.coalesce(F.col(role), F.lit("")).alias("role"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
    )
    whole = turns.groupBy(F.col(conv).alias(conv)).agg(F.sort_array(F.collect_list(one)).alias("turns"))
    written = whole.select(
        conv,
        F.col("turns.role").alias("roles"),
        F.transform("turns", lambda t: _turn(t["role"], t["text"])).alias("parts"),
        F.transform("turns", lambda t: F.length(escape(t["text"]))).alias("sizes"),
    )
    last = F.size("roles") - 1
    wanted = F.filter(
        F.transform("roles", lambda r, i: F.struct(i.alias("at"), (r == trained_role).alias("trained"))),
        lambda x: x["trained"] | (x["at"] == last),
    )
    formatted = F.array_join(F.slice("parts", F.lit(1), F.col("x.at") + 1), "")
    size = F.when(F.col("x.trained"), F.get("sizes", F.col("x.at"))).otherwise(0)
    return (
        written.select(conv, "parts", "sizes", F.explode(wanted).alias("x"))
        .select(conv, F.when(F.col("x.trained"), F.col("x.at")).alias("target_turn"), formatted.alias("formatted"), size.alias("loss_chars"))
        .select(
            conv, "target_turn", "formatted",
            (F.length("formatted") - F.lit(len(CLOSE)) - F.col("loss_chars")).alias("loss_start"),
            "loss_chars",
        )
    )


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted text: array of (role, text)."""
    pieces = F.split(formatted, "</s>", -1)
    turns = F.slice(pieces, F.lit(1), F.size(pieces) - 1)

    def back(piece: Column) -> Column:
        halves = F.split(F.substring(piece, len(OPEN + ROLE) + 1, 2**31 - 1), r"\[/INST\]", 2)
        return F.struct(unescape(halves[0]).alias("role"), unescape(halves[1]).alias("text"))

    return F.transform(turns, back)


def trained_text(formatted: Column, start: Column, size: Column) -> Column:
    """The text under the loss mask, unescaped."""
    return unescape(F.substring(formatted, start + 1, size))


def digest(examples: DataFrame, conv: str = "conv_id") -> DataFrame:
    """What the examples of each conversation say, read back from their texts.

    n_turns and turns_sha256 (role, line break, text, line break per turn) come
    from the longest example, which holds all turns; loss_chars and loss_sha256
    from the masked texts in order; formatted_chars is the length of all
    examples.
    """
    read = examples.select(
        conv,
        F.length("formatted").alias("n"),
        F.struct(
            F.coalesce("target_turn", F.lit(2**31 - 1)).alias("at"),
            trained_text(F.col("formatted"), F.col("loss_start"), F.col("loss_chars")).alias("text"),
        ).alias("reply"),
        "formatted",
    )
    grouped = read.groupBy(conv).agg(
        F.max_by("formatted", "n").alias("longest"),
        F.array_join(F.transform(F.sort_array(F.collect_list("reply")), lambda r: r["text"]), "").alias("loss"),
        F.sum("n").alias("formatted_chars"),
    )
    turns = grouped.withColumn("turns", read_turns(F.col("longest")))
    said = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return turns.select(
        conv,
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(F.encode(F.array_join(said, ""), "UTF-8"), 256).alias("turns_sha256"),
        F.length("loss").cast("bigint").alias("loss_chars"),
        F.sha2(F.encode(F.col("loss"), "UTF-8"), 256).alias("loss_sha256"),
        F.col("formatted_chars").cast("bigint").alias("formatted_chars"),
    )
