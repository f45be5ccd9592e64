"""Fixed-layout rows of padded ids, one layout per model family and per labelling task.

Input rows carry the id arrays and the longest length of their batch (from ``batching``); the
output columns of a batch all have the same width. Everything is array expressions in the row.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import mask, pad, repeat, take
from .batching import assign_batches, length_class


@dataclass(frozen=True)
class LayoutIds:
    """Token ids and limits a layout needs."""

    pad: int = 1
    bos: int = 0
    eos: int = 2
    source_language: int = 40001
    target_language: int = 40002
    label_pad: int = -100
    max_len: int = 512
    prefix: tuple[int, ...] = ()


def _ids(*values: int) -> Column:
    return F.array(*[F.lit(v).cast("bigint") for v in values])


def _width(longest: Column, extra: int, cap: int) -> Column:
    return F.least(F.lit(cap), longest + extra)


def language_tagged(x: Column, y: Column, x_longest: Column, y_longest: Column, c: LayoutIds) -> dict[str, Column]:
    """enc ``x EOS SRC``, dec ``TGT y EOS``, label ``y EOS TGT``."""
    we, wd = _width(x_longest, 2, c.max_len), _width(y_longest, 2, c.max_len)
    x, y = take(x, we - 2), take(y, wd - 2)
    return {
        "enc": pad(F.concat(x, _ids(c.eos, c.source_language)), we, c.pad),
        "dec": pad(F.concat(_ids(c.target_language), y, _ids(c.eos)), wd, c.pad),
        "enc_mask": mask(F.size(x) + 2, we),
        "dec_mask": F.lit(None).cast("array<float>"),
        "label": pad(F.concat(y, _ids(c.eos, c.target_language)), wd, c.label_pad),
    }


def prefixed(x: Column, y: Column, x_longest: Column, y_longest: Column, c: LayoutIds) -> dict[str, Column]:
    """enc ``prefix x``, dec ``BOS y``, label ``y EOS``."""
    k = len(c.prefix)
    we, wd = _width(x_longest, k, c.max_len), _width(y_longest, 1, c.max_len)
    x, y = take(x, we - k), take(y, wd - 1)
    head = _ids(*c.prefix) if k else F.array().cast("array<bigint>")
    return {
        "enc": pad(F.concat(head, x), we, c.pad),
        "dec": pad(F.concat(_ids(c.bos), y), wd, c.pad),
        "enc_mask": mask(F.size(x) + k, we),
        "dec_mask": F.lit(None).cast("array<float>"),
        "label": pad(F.concat(y, _ids(c.eos)), wd, c.label_pad),
    }


def unprefixed(x: Column, y: Column, x_longest: Column, y_longest: Column, c: LayoutIds) -> dict[str, Column]:
    """enc ``x``, dec ``BOS y``, label ``y EOS``."""
    return prefixed(x, y, x_longest, y_longest, replace(c, prefix=()))


def decoder_only(x: Column, y: Column, x_longest: Column, y_longest: Column, c: LayoutIds) -> dict[str, Column]:
    """enc ``x PAD.. BOS`` with BOS in the last column; dec the same, then ``y``.

    The label is empty under the prompt, then ``y EOS``.
    """
    we, wd = _width(x_longest, 1, c.max_len), _width(y_longest, 1, c.max_len)
    x, y = take(x, c.max_len - 1), take(y, c.max_len - 1)
    prompt = F.concat(pad(x, we - 1, c.pad), _ids(c.bos))
    prompt_mask = F.concat(mask(F.size(x), we - 1), repeat(1, 1, "float"))
    return {
        "enc": prompt,
        "dec": F.concat(prompt, pad(y, wd, c.pad)),
        "enc_mask": prompt_mask,
        "dec_mask": F.concat(prompt_mask, mask(F.size(y), wd)),
        "label": F.concat(repeat(c.label_pad, we), pad(F.concat(y, _ids(c.eos)), wd, c.label_pad)),
    }


Layout = Callable[[Column, Column, Column, Column, LayoutIds], dict[str, Column]]

LAYOUTS: dict[str, Layout] = {
    "transformer": language_tagged,
    "bart": language_tagged,
    "mbart": language_tagged,
    "t5": prefixed,
    "gpt2": decoder_only,
    "mt5": unprefixed,
}


def model_family(model_type: str) -> str:
    """The family is the last part of a model type: ``baseline-mbart`` -> ``mbart``."""
    return model_type.rsplit("-", 1)[-1]


def layout_for(model_type: str) -> Layout:
    family = model_family(model_type)
    if family not in LAYOUTS:
        raise ValueError(f"unknown model type {model_type!r}")
    return LAYOUTS[family]


def generation_batches(
    df: DataFrame, model_type: str, ids: LayoutIds, *, id_col: str = "id", source: str = "x",
    target: str = "y", batch_size: int = 8, seed: int | None = None, bucket: int | None = None,
) -> DataFrame:
    """Batches for a model family: ``(id, batch_id, place, enc, dec, enc_mask, dec_mask, label)``.

    ``place`` counts from 0 in the batch. ``bucket`` puts examples whose source length falls in the same class of that many ids together.
    """
    layout = layout_for(model_type)
    placed = assign_batches(
        df, id_col, batch_size=batch_size, seed=seed, bucket=length_class(F.size(source), bucket) if bucket else None,
        lengths={"_wx": F.size(source), "_wy": F.size(target)},
    )
    columns = layout(F.col(source), F.col(target), F.col("_wx"), F.col("_wy"), ids)
    return placed.select(id_col, "batch_id", "place", *[c.alias(n) for n, c in columns.items()])


def labelling_batches(
    df: DataFrame, *, id_col: str = "id", ids: str = "ids", label: Column | str = "label",
    label_kind: str = "single", segments: str | None = None, word_index: str | None = None,
    raw: Column | str | None = None, max_len: int = 512, batch_size: int = 8, seed: int | None = None, bucket: int | None = None,
) -> DataFrame:
    """Batches for classification and tagging.

    Ids and segments are padded with 0, word indices with -1. ``label_kind``:
    ``single`` one label, ``vector`` a fixed-width vector, ``tags`` one label per word padded
    with -100 to the longest sentence of the batch (tags are never cut). ``place`` and ``bucket`` as in ``generation_batches``.
    """
    if label_kind not in ("single", "vector", "tags"):
        raise ValueError(f"unknown label kind {label_kind!r}")
    label = F.col(label) if isinstance(label, str) else label
    rows = df.withColumn("_label", label)
    lengths = {"_w": F.size(ids)}
    if label_kind == "tags":
        lengths["_wt"] = F.size("_label")
    classes = length_class(F.size(ids), bucket) if bucket else None
    placed = assign_batches(rows, id_col, batch_size=batch_size, seed=seed, lengths=lengths, bucket=classes)
    width = F.least(F.lit(max_len), F.col("_w"))
    out = [
        pad(F.col(ids), width, 0).alias("ids"),
        mask(F.least(F.size(ids), width), width).alias("mask"),
    ]
    if segments:
        out.append(pad(F.col(segments), width, 0).alias("segments"))
    if word_index:
        out.append(pad(F.col(word_index), width, -1).alias("word_index"))
    if label_kind == "tags":
        out.append(pad(F.col("_label"), F.col("_wt"), -100).alias("label"))
    else:
        out.append(F.col("_label").alias("label"))
    if raw is not None:
        out.append((F.col(raw) if isinstance(raw, str) else raw).alias("raw"))
    return placed.select(id_col, "batch_id", "place", *out)
