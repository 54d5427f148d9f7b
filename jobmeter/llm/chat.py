"""Multi-party perspective rotation of dialogues.

For every participant the dialogue is rendered with that speaker as the assistant and all others as
named users; the mask marks the characters that the assistant wrote. Long dialogues are rendered in
segments of a fixed number of turns, so that no task ever holds a whole dialogue.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobmeter.llm.tables import col
from jobmeter.operators.ranking import with_position

SEGMENT_TURNS = 64
SYSTEM = "system"


def _guarded(text: Column) -> Column:
    """Text that cannot be taken for a marker of the format."""
    return F.replace(F.coalesce(text, F.lit("")), F.lit("<|"), F.lit("< |"))


def _header(speaker: Column, participant: Column, system: str) -> Column:
    other = F.concat(F.lit("user name="), F.regexp_replace(_guarded(speaker), r"\s+", "_"))
    role = (
        F.when(speaker.isNull(), F.lit("user"))
        .when(speaker == system, F.lit("system"))
        .when(speaker == participant, F.lit("assistant"))
        .otherwise(other)
    )
    return F.concat(F.lit("<|im_start|>"), role, F.lit("\n"))


def perspectives(
    turns: DataFrame,
    *,
    conversation: str = "conv_id",
    turn: str = "turn",
    speaker: str = "role",
    text: str = "text",
    system: str = SYSTEM,
    segment_turns: int = SEGMENT_TURNS,
) -> DataFrame:
    """(conversation, perspective, segment, n_turns, text, mask) for each participant and segment.

    Turns are in order of ``turn``, then speaker, then text; null comes first. Every speaker but
    ``system`` is a participant and gets all segments of the dialogue, also those it is silent in.
    A turn is ``<|im_start|>role``, a line feed, its text and ``<|im_end|>``, a line feed; the role is
    assistant, system, or user with the speaker's name (white space in it as ``_``). ``<|`` in a text
    or name becomes ``< |``. ``mask`` holds the (start, end) code points of the assistant's texts with
    their end marker.

    Null text is empty. A turn without speaker is shown as an unnamed user, who is no participant; a
    dialogue with no participant gives no row. Null is a conversation of its own. Repeated rows are
    turns of their own. Extra columns are not read. An empty table gives an empty table.
    """
    kind = turns.schema[conversation].dataType
    rows = turns.select(
        col(conversation).cast("string").alias("c"),
        col(turn).alias("at"),
        col(speaker).cast("string").alias("who"),
        col(text).cast("string").alias("said"),
    )
    # One global order, ties down to the whole text, minus the place of each dialogue's first turn.
    placed = with_position(rows, [F.col(x) for x in ("c", "at", "who", "said")])
    first = placed.groupBy(F.col("c").alias("d"), F.length("c").alias("n")).agg(F.min("position").alias("first"))
    place = F.col("position") - F.col("first")
    told = placed.join(first.drop("n"), F.col("c").eqNullSafe(F.col("d"))).select(
        "c", "who", "said", place.alias("place"), F.floor(place / segment_turns).alias("segment")
    )
    segments = told.groupBy("c", "segment").agg(
        F.sort_array(F.collect_list(F.struct("place", "who", "said"))).alias("turns")
    )
    people = rows.where(F.col("who").isNotNull() & (F.col("who") != system)).select("c", "who").distinct()
    people = people.select(F.col("c").alias("d"), F.col("who").alias("perspective"))
    joined = segments.join(people, F.col("c").eqNullSafe(F.col("d")))

    me = F.col("perspective")
    parts = F.transform(
        "turns",
        lambda t: F.struct(
            _header(t["who"], me, system).alias("head"),
            F.concat(_guarded(t["said"]), F.lit("<|im_end|>")).alias("body"),
            (t["who"] == me).alias("mine"),
        ),
    )

    def spans(state: Column, part: Column) -> Column:
        start = state["n"] + F.length(part["head"])
        end = start + F.length(part["body"])
        span = F.array(F.struct(start.alias("start"), end.alias("end")))
        return F.struct(
            (end + 1).alias("n"),
            F.when(F.coalesce(part["mine"], F.lit(False)), F.concat(state["spans"], span))
            .otherwise(state["spans"])
            .alias("spans"),
        )

    nothing = F.struct(F.lit(0).alias("n"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))
    return joined.withColumn("parts", parts).select(
        F.col("c").cast(kind).alias(conversation),
        "perspective",
        F.col("segment").cast("long").alias("segment"),
        F.size("turns").cast("long").alias("n_turns"),
        F.array_join(F.transform("parts", lambda p: F.concat(p["head"], p["body"], F.lit("\n"))), "").alias("text"),
        F.aggregate("parts", nothing, spans)["spans"].alias("mask"),
    )
