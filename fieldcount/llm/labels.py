"""Labels to learn from: a bounded sample of the rows that are not held out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Bytes of text that the driver takes to learn from, of each label.
MOST_BYTES = 16 << 20


def held_out(id_col: str) -> Column:
    """Whether a row is kept from training: one id in five."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False))


def training_sample(
    docs: DataFrame,
    labels: DataFrame,
    label: str,
    most: int,
    id_col: str = "doc_id",
    text_col: str = "text",
    most_bytes: int = MOST_BYTES,
) -> tuple[list[str], list[int]]:
    """At most ``most`` labelled texts, whole: half of each label, in an order that their ids' hashes
    decide, and of each label the first ones that have ``most_bytes`` together, but one at least.

    Sizes are added up in Spark before any text is collected. The ids are drawn before the texts are looked up, so the join's small side has at most
    ``most`` rows. Rows without a label and ids labelled differently are left out; an id that
    several documents have counts once.
    """
    usable = (
        labels.filter(F.col(label).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col))
        .groupBy(id_col)
        .agg(F.min(label).alias("label"), F.max(label).alias("other"))
        .filter(F.col("label") == F.col("other"))
        .select(id_col, "label", F.xxhash64(id_col).alias("draw"))
    )
    no, yes = (usable.filter(F.col("label") == v).orderBy("draw", id_col).limit(most // 2) for v in (0, 1))
    texts = docs.select(id_col, F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    sizes = (
        texts.select(id_col, F.octet_length("text").alias("size"))
        .join(F.broadcast(no.unionByName(yes)), id_col)
        .groupBy(id_col, "draw", "label")
        .agg(F.max("size").alias("size"))
    )
    drawn = Window.partitionBy("label").orderBy("draw", id_col)
    total = F.sum("size").over(drawn.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    kept = sizes.select(id_col, "draw", "label", total.alias("total"), F.row_number().over(drawn).alias("place"))
    kept = kept.filter((F.col("total") <= most_bytes) | (F.col("place") == 1)).select(id_col, "draw", "label")
    rows = (
        texts.join(F.broadcast(kept), id_col)
        .groupBy(id_col, "draw", "label")
        .agg(F.min("text").alias("text"))
        .collect()
    )
    rows.sort(key=lambda r: (r["draw"], r[id_col]))
    return [r["text"] for r in rows], [int(r["label"]) for r in rows]
