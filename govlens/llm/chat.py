"""Multi-party dialogues rendered from every participant's side, in DataFrame functions only.

For each participant a dialogue is written out once with that speaker as ``assistant`` and
all others as users named after their role. Loss masks mark the speaker's own words.
Turns of ``context_roles`` (instructions) are nobody's: they are written as ``system`` in every
rendering.

Every participant of a dialogue has a rendering of all of it. Dialogues longer than
``part_turns`` turn numbers are rendered in consecutive parts, each from the side of every
participant of the whole dialogue, whether they speak in it or not: a participant's parts
joined in order are the dialogue. Parts bound a group as far as turns are numbered; turns
that share one number, or have none, stay together.

Defined results: messages are ordered by turn (nulls first), then role and text; repeated
rows are messages of their own. A null role is the speaker ``unknown``; a null text is an
empty message. Rows without conv_id belong to no dialogue and are left out. A dialogue in
which only context roles speak has no rendering. Marks of the format inside a text lose their
angle bracket, so a text cannot forge a turn.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PART_TURNS = 256
CONTEXT_ROLES = ("system",)
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"


def _safe(text: Column) -> Column:
    return F.replace(text, F.lit("<|"), F.lit("< |"))


def rotate(
    turns: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    part_turns: int = PART_TURNS,
    context_roles: tuple[str, ...] = CONTEXT_ROLES,
) -> DataFrame:
    """One row per dialogue part and participant.

    conv_id, part, speaker, n_messages, text (the rendering), spans (start and end of the
    speaker's words in it, in characters, end exclusive: the loss mask) and messages (role,
    name, content, learn).
    """
    role = _safe(F.coalesce(F.col(role_col).cast("string"), F.lit("unknown")))
    text = _safe(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    context = role.isin(*context_roles) if context_roles else F.lit(False)
    message = F.struct(
        F.col(turn_col).cast("long").alias("turn"),
        role.alias("role"),
        text.alias("content"),
        context.alias("context"),
    )
    part = F.coalesce(F.floor(F.col(turn_col).cast("long") / part_turns), F.lit(0)).cast("long")
    known = turns.where(F.col(conv_col).isNotNull())
    talks = known.groupBy(F.col(conv_col).alias("conv_id"), part.alias("part")).agg(
        F.sort_array(F.collect_list(message)).alias("turns")
    )
    # a row per participant and dialogue, which is few rows however long the dialogue is
    speakers = known.where(~context).select(F.col(conv_col).alias("conv_id"), role.alias("speaker")).distinct()
    sides = talks.join(speakers, "conv_id")
    own = sides.withColumn(
        "messages",
        F.transform(
            "turns",
            lambda m: F.struct(
                F.when(m["context"], F.lit("system"))
                .when(m["role"] == F.col("speaker"), F.lit("assistant"))
                .otherwise(F.lit("user"))
                .alias("role"),
                m["role"].alias("name"),
                m["content"].alias("content"),
                (~m["context"] & (m["role"] == F.col("speaker"))).alias("learn"),
            ),
        ),
    ).withColumn(
        "heads",
        F.transform(
            "messages",
            lambda m: F.concat(
                F.lit(OPEN),
                m["role"],
                F.when(m["role"] == "user", F.concat(F.lit(" name="), m["name"])).otherwise(
                    F.lit("")
                ),
                F.lit("\n"),
            ),
        ),
    )
    rendered = F.array_join(
        F.zip_with("heads", "messages", lambda h, m: F.concat(h, m["content"], F.lit(CLOSE))), ""
    )
    span = "array<struct<start:int,end:int>>"
    walked = F.aggregate(
        F.arrays_zip("heads", "messages"),
        F.struct(F.lit(0).alias("at"), F.lit([]).cast(span).alias("out")),
        lambda acc, x: _step(acc, x, span),
    )["out"]
    return own.select(
        "conv_id",
        "part",
        "speaker",
        F.size("messages").alias("n_messages"),
        rendered.alias("text"),
        walked.alias("spans"),
        "messages",
    )


def _step(acc: Column, x: Column, span: str) -> Column:
    """Move over one message; note its words where the speaker is to be learned."""
    start = acc["at"] + F.char_length(x["heads"])
    end = start + F.char_length(x["messages"]["content"])
    return F.struct(
        (end + len(CLOSE)).alias("at"),
        F.concat(
            acc["out"],
            F.when(
                x["messages"]["learn"], F.array(F.struct(start.alias("start"), end.alias("end")))
            ).otherwise(F.lit([]).cast(span)),
        ).alias("out"),
    )


def report(turns: DataFrame) -> DataFrame:
    """Every rendering with its mask as text."""
    return rotate(turns).select(
        "conv_id",
        "part",
        "speaker",
        F.col("n_messages").cast("long").alias("n_messages"),
        "text",
        F.array_join(
            F.transform("spans", lambda s: F.concat_ws(":", s["start"], s["end"])), ","
        ).alias("spans"),
    )
