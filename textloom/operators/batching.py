"""Order, fixed-size batches and per-batch widths."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written
from . import ordering


def assign_batches(
    df: DataFrame, id_col: str = "id", *, order: Sequence[str] | None = None, seed: int | None = None,
    batch_size: int = 8, lengths: dict[str, Column] | None = None, bucket: Column | None = None, ranges: int | None = None,
) -> DataFrame:
    """Add ``position``, ``batch_id``, ``place`` in the batch and, per entry of ``lengths``, its maximum in the batch.

    ``seed`` shuffles the examples reproducibly; otherwise they follow ``order`` (the id by default). ``bucket`` comes before
    both: with a length class, batches hold examples of like length and carry less padding.

    The rows get a key of their own and are written once. Position, batch and widths are worked out on the key, order and length
    columns alone; the wide rows are shuffled once, to meet their batch, and rows that repeat an id stay rows of their own.
    """
    lengths = lengths or {}
    order = list(order or [id_col])
    rows = written(df.withColumn("_row", F.monotonically_increasing_id()), "examples")
    classes = [] if bucket is None else [bucket.alias("_bucket")]
    widest = [c.cast("bigint").alias(n) for n, c in lengths.items()]
    narrow = rows.select("_row", *dict.fromkeys([id_col, *order]), *widest, *classes)
    if seed is not None:
        narrow = ordering.seeded_order(narrow, id_col, seed)
        order = ["shuffle_key", id_col]
    if classes:
        order = ["_bucket", *order]
    placed = ordering.running_sum(narrow, [*order, "_row"], out="position", ranges=ranges)
    placed = placed.withColumns({"batch_id": F.floor(F.col("position") / batch_size), "place": F.col("position") % batch_size})
    whole_batch = Window.partitionBy("batch_id")
    widths = [F.max(n).over(whole_batch).alias(n) for n in lengths]
    # A merge join keeps the wide rows in as many tasks as the shuffle has; a small table's rows would else be broadcast to few.
    return rows.hint("merge").join(placed.select("_row", "position", "batch_id", "place", *widths), "_row").drop("_row")


def length_class(length: Column, step: int = 64) -> Column:
    """Bucket of examples whose length differs by less than ``step``."""
    return F.floor(length / step)
