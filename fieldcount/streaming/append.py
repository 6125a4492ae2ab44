"""Append yearly deliveries from a stream, each year from one delivery."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from fieldcount.sources.store import take_in, write_partitioned


def batch_writer(
    table: str,
    source: str,
    year_col: str = "year",
    mode: str = "reject",
    delivery_col: str | None = None,
) -> Callable[[DataFrame, int], None]:
    """The ``foreachBatch`` function. ``source`` tells apart the streams that feed one table.

    ``mode`` is what happens to a year already stored: ``reject`` keeps the stored rows and puts the
    others into the table of rejects, ``replace`` overwrites that year's partition. ``delivery_col``
    names the delivery of each row; rows of one delivery belong together, in however many batches
    they arrive. Without it, every batch is a delivery of its own.
    """
    if mode not in ("reject", "replace"):
        raise ValueError(f"unknown mode {mode!r}")

    def write(batch: DataFrame, batch_id: int) -> None:
        if mode == "replace":
            write_partitioned(batch, table, year_col)
            return
        part = f"{source}-{batch_id}"
        delivery = F.col(delivery_col) if delivery_col else F.lit(part)
        take_in(batch, table, part, delivery, year_col)

    return write


def append_stream(
    incoming: DataFrame,
    table: str,
    checkpoint: str,
    year_col: str = "year",
    mode: str = "reject",
    delivery_col: str | None = None,
) -> StreamingQuery:
    """Take in everything that has arrived and stop; run it again for later files."""
    source = hashlib.sha256(checkpoint.encode()).hexdigest()[:16]
    return (
        incoming.writeStream.foreachBatch(batch_writer(table, source, year_col, mode, delivery_col))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
