"""Mixing sources to target weights by capped water-filling, in DataFrame operations alone.

Sources share a budget of words by weight. A source whose share is more than its words times the
largest number of epochs is clamped there, and what that leaves is shared anew by the others, until no
share is above. What the driver sees of a round are two sums. Documents are then repeated: each as
many whole times as its source's target holds, and in a seeded order the first ones once more. The last
of these is taken in part, so that the source's words end at its target.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldcount.llm.ordered import in_order, source_key
from fieldcount.session import materialize


def count_words(text: Column) -> Column:
    """Runs of anything but ASCII white space; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def water_fill(sources: DataFrame, budget: int, epochs: int) -> DataFrame:
    """``sources`` (size, weight, ...) with ``target``: a share of ``budget`` by weight, at most ``epochs`` sizes.

    A round clamps every source that is over its cap at the present level of words per weight, which
    raises the level for the others; it ends when no more are over. Where all caps together are less
    than the budget, every source of some weight ends at its cap. ``sources`` is read each round.
    """
    weight, cap = F.col("weight").cast("double"), F.col("size") * epochs
    left, weights = float(budget), float(sources.agg(F.sum("weight")).first()[0] or 1)
    while True:
        share = F.lit(left) * weight / F.lit(weights)
        over = cap < share
        clamped, still = sources.agg(F.sum(F.when(over, cap)), F.sum(F.when(~over, F.col("weight")))).first()
        now = float(budget - (clamped or 0)), float(still or 0)
        if now == (left, weights) or not now[1]:
            return sources.withColumn("target", F.when(over, cap.cast("double")).otherwise(share))
        left, weights = now


def mix(
    docs: DataFrame,
    weights: Sequence[int] = (1, 2, 3),
    epochs: int = 3,
    seed: str = "mix",
    id_col: str = "doc_id",
    group_col: str = "source",
    text_col: str = "text",
) -> DataFrame:
    """One row per row: id, size, source_size, target, taken, whole, part.

    Sizes are numbers of words; a null text has none. Sources in the order of their code points, null
    last, get ``weights`` in turn and again from the first. The budget is all words. ``target`` is what
    its source may have of it and ``taken`` what the mix takes of the document: ``whole`` repetitions and
    the first ``part`` words once more. A source's taken words are its target, rounded.

    The order in which documents are repeated once more depends on ``seed`` and their ids; of equal ids
    the shorter comes first, and rows equal in both may take each other's place. A null id is one value. Empty
    documents take nothing, and a source of nothing but those has the target 0. Other columns are not
    looked at. An empty table gives an empty result.
    """
    draw = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("-"))))
    sized = materialize(
        docs.select(
            source_key(F.col(group_col)).alias("key"),
            F.col(id_col).alias("id"),
            count_words(F.col(text_col)).alias("size"),
            draw.alias("draw"),
        ),
        "mix-sizes",
    )
    totals = materialize(sized.groupBy("key").agg(F.sum("size").alias("size")), "mix-sources")
    named = totals.select(F.lit("").alias("all"), F.col("key") == "", "key", "size").toDF("all", "last", "key", "size")
    turn = F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int"))
    weighed = materialize(in_order(named, "all", ["last", "key"]).withColumn("weight", turn), "mix-weights")
    budget = totals.agg(F.sum("size")).first()[0] or 0
    targets = materialize(water_fill(weighed.select("key", "size", "weight"), budget, epochs), "mix-targets")

    rows = in_order(sized, "key", ["draw", "id", "size"], "size", targets.select("key", "target"))
    whole = F.coalesce(F.floor(F.try_divide(F.col("target"), F.col("total"))), F.lit(0))
    more = F.floor(F.col("target") + 0.5) - F.col("whole") * F.col("total")
    part = F.greatest(F.lit(0), F.least(F.col("size"), more - F.col("before")))
    parted = rows.withColumn("whole", whole).withColumn("part", part)
    return parted.select(
        F.col("id").alias(id_col),
        "size",
        F.col("total").alias("source_size"),
        "target",
        (F.col("whole") * F.col("size") + F.col("part")).alias("taken"),
        "whole",
        "part",
    )
