"""Voice commands in transcribed text."""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tempora.functions.scalar import holds


#: A command is any of these; a list of words stands for all of them held at once.
WORDS: dict[str, list] = {"ball": ["ball", "bowl"], "background": ["background", ["back", "ground"]], "reset": ["reset"]}


def command_flags(text: Column, words: dict[str, list] = WORDS) -> dict[str, Column]:
    """ball, background and reset, each by words held in the lower-cased text; they don't exclude one another."""
    every = lambda w: reduce(and_, [holds(F.lower(text), x) for x in ([w] if isinstance(w, str) else w)])
    return {kind: reduce(or_, map(every, rules)) for kind, rules in words.items()}


def commands(rows: DataFrame, text: str = "text", words: dict[str, list] = WORDS) -> DataFrame:
    return rows.withColumns({k: F.coalesce(c, F.lit(False)) for k, c in command_flags(F.col(text), words).items()})


def last_command(rows: DataFrame, keys: list[str], order: str, words: dict[str, list] = WORDS) -> DataFrame:
    """The latest text of each key that holds a command."""
    held = commands(rows, words=words).where("ball or background or reset")
    return held.groupBy(*keys).agg(F.max_by("text", order).alias("last_command"))


def consumed(frames: DataFrame, rows: DataFrame, keys: list[str], time: str = "timestamp", words: dict[str, list] = WORDS) -> DataFrame:
    """frames plus ball, background and reset: whether such a command came since the frame before.

    A command is taken by the next frame of its key and then forgotten; several of a kind before a frame are one.
    """
    kinds = ("ball", "background", "reset")
    marks = commands(rows, words=words).select(*keys, time, *[F.col(k).cast("int").alias(f"tempora_{k}") for k in kinds])
    both = frames.withColumns({f"tempora_{k}": F.lit(0) for k in kinds}).withColumn("tempora_frame", F.lit(1)).unionByName(marks.withColumn("tempora_frame", F.lit(0)), allowMissingColumns=True)
    order = Window.partitionBy(*keys).orderBy(time, "tempora_frame").rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumns({f"tempora_{k}": F.sum(f"tempora_{k}").over(order) for k in kinds}).where("tempora_frame = 1")
    order = Window.partitionBy(*keys).orderBy(time)
    return both.withColumns({k: F.col(f"tempora_{k}") > F.coalesce(F.lag(f"tempora_{k}").over(order), F.lit(0)) for k in kinds}).drop("tempora_frame", *[f"tempora_{k}" for k in kinds])
