"""Multi-party dialogues rendered once from the perspective of each speaker, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SEGMENT = 64  # turn numbers in one rendered piece
END = "<|end|>\n"


def perspectives(turns: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """One row per conversation, speaker and segment: conv_id, speaker, segment, n_turns, text, masks.

    For every participant the dialogue is written with that speaker as ``<|assistant|>``, all others as
    ``<|user:name|>`` and system turns as ``<|system|>``; ``masks`` are the [start, end) character ranges
    that are trained on: what the speaker says, without tags.  A segment holds the turns of ``segment``
    consecutive turn numbers, so no row grows with a conversation; segments follow each other in order.

    A NULL role is the speaker ``unknown``, a NULL text is empty, a NULL turn comes first in a segment of
    its own (NULL).  Turns with equal numbers follow by role, then text; repeated rows are all rendered.  A
    NULL conv_id is one conversation.  ``<|`` in a text becomes ``< |``, so that no text can write tags.
    Conversations of system turns alone have no perspective.  An empty table gives an empty result;
    further columns are ignored.
    """
    own = turns.select(
        "conv_id", "turn", F.coalesce(F.col("role").cast("string"), F.lit("unknown")).alias("role"),
        F.replace(F.coalesce(F.col("text").cast("string"), F.lit("")), F.lit("<|"), F.lit("< |")).alias("text"),
    )
    pieces = own.groupBy("conv_id", F.floor(F.col("turn") / segment).alias("segment")).agg(
        F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns")
    )
    speakers = own.where("role != 'system'").select("conv_id", "role").distinct().select(F.col("conv_id").alias("of"), F.col("role").alias("speaker"))
    each = pieces.join(speakers, F.col("conv_id").eqNullSafe(F.col("of")))

    def tag(role):
        return (
            F.when(role == F.col("speaker"), F.lit("<|assistant|>\n")).when(role == "system", F.lit("<|system|>\n"))
            .otherwise(F.concat(F.lit("<|user:"), role, F.lit("|>\n")))
        )

    def step(state, t):
        start = state["at"] + F.char_length(tag(t["role"]))
        end = start + F.char_length(t["text"])
        spans = F.when(t["role"] == F.col("speaker"), F.array_append(state["masks"], F.struct(start.alias("start"), end.alias("end")))).otherwise(state["masks"])
        return F.struct((end + len(END)).alias("at"), spans.alias("masks"))

    none = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("masks"))
    return each.select(
        "conv_id", "speaker", "segment", F.size("turns").cast("long").alias("n_turns"),
        F.array_join(F.transform("turns", lambda t: F.concat(tag(t["role"]), t["text"], F.lit(END))), "").alias("text"),
        F.aggregate("turns", none, step, lambda s: s["masks"]).alias("masks"),
    )
