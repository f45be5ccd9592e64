"""Writers of results. A target that exists is an error unless ``overwrite``."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, DataFrameWriter
from pyspark.sql import functions as F

from ..operators.ordering import running_sum
from ..session import bound_batches


def _mode(overwrite: bool) -> str:
    return "overwrite" if overwrite else "errorifexists"


def _csv(df: DataFrame, overwrite: bool) -> DataFrameWriter:
    """CSV writer with a header that doubles quotes inside fields and keeps outer spaces."""
    return (
        df.write.mode(_mode(overwrite)).option("header", True).option("quote", '"').option("escape", '"')
        .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
    )


def write_predictions(df: DataFrame, path: str, fmt: str = "csv", overwrite: bool = False) -> None:
    """``(id, hyp, label)``."""
    if fmt == "csv":
        _csv(df, overwrite).csv(path)
    else:
        df.write.mode(_mode(overwrite)).format(fmt).save(path)


def write_json_array(df: DataFrame, path: str, overwrite: bool = False, compression: str = "none") -> None:
    """One JSON array of objects per partition, as other tools expect it; the rows stay in their partitions.

    A compressed file takes a fraction of the space and is read whole by one task, so its partition should not be large.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for b in batches:
            lines = b.column(0).to_pylist()
            if not lines:
                continue
            out = ["["] if held is None else [held + ","]
            out += [line + "," for line in lines[:-1]]
            held = lines[-1]
            yield pa.RecordBatch.from_pydict({"value": out})
        if held is not None:
            yield pa.RecordBatch.from_pydict({"value": [held, "]"]})

    bound_batches(df.sparkSession)
    objects = df.select(F.to_json(F.struct("*")).alias("value"))
    objects.mapInArrow(run, "value string").write.mode(_mode(overwrite)).option("compression", compression).text(path)


def write_metric_summary(
    df: DataFrame, path: str, length_penalty: float | None = None, overwrite: bool = False
) -> None:
    """Metric summary as CSV; with a run parameter, one folder per value of it under ``path``.

    A value that was written before is an error unless ``overwrite``; other values stay.
    """
    folder = path if length_penalty is None else f"{path.rstrip('/')}/length_penalty={length_penalty}"
    _csv(df, overwrite).csv(folder)


def write_vocab(vocab: DataFrame, path: str, fmt: str = "json", overwrite: bool = False) -> None:
    """``(token, token_id)`` rows."""
    vocab.select("token", "token_id").write.format(fmt).mode(_mode(overwrite)).save(path)


def write_splits(df: DataFrame, path: str, overwrite: bool = False) -> None:
    """Parquet, one folder per task and split, so later reads prune to what they need."""
    df.write.mode(_mode(overwrite)).partitionBy("task", "split").parquet(path)


def write_submission(
    predictions: DataFrame, path: str, order: list[str], columns: list[str], overwrite: bool = False,
    single_file: bool = False,
) -> None:
    """``index`` (place in ``order``) and prediction columns as CSV, sorted by index.

    The parts follow each other in index order. ``single_file`` sends all rows through one task
    and is meant for a submission of test-set size only.
    """
    indexed = running_sum(predictions.select(*dict.fromkeys([*order, *columns])), order, out="index")
    ordered = indexed.select("index", *columns)
    ordered = ordered.coalesce(1).sortWithinPartitions("index") if single_file else ordered.orderBy("index")
    _csv(ordered, overwrite).csv(path)
