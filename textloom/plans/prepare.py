"""From the files of a task to batches of padded ids: read, encode, lay out.

A task's layout says which of its columns are encoded and how they are put together:

* ``pairs``: source and target text. ``question``: context, separator and question against the answer.
* ``dialogue``: the history under the token budget, with speaker markers, against the reply.
* ``tags``: words with one tag each. ``span``: a question and a passage with one tag per passage word.
* ``single``, ``two_texts``, ``vector``, ``several``: a text, or two, with one label, one per aspect, or a 0/1 vector.

The first three are laid out for a model family, the others as labelling batches between a start and an end id.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.labels import multi_hot
from ..functions.sequences import encode_segments, join_with_separator, wrap_sentence
from ..functions.text import lower_words
from ..operators import alignment, dialogue, vocab as vocabulary
from ..operators.layouts import LayoutIds, generation_batches, labelling_batches
from .tasks import LANGUAGE_ALIASES, LANGUAGE_TOKENS, Task, language_id, markers, orient, read_task, task

SPEAKERS = ("\nspeaker1", "\nspeaker2")  # no word holds a line break


def _languages(t: Task, ids: LayoutIds) -> LayoutIds:
    """Language ids of the task, where its languages have one."""
    known = lambda name: name and LANGUAGE_ALIASES.get(name, name) in LANGUAGE_TOKENS
    found = {k: language_id(v) for k, v in (("source_language", t.source_language), ("target_language", t.target_language)) if known(v)}
    return replace(ids, **found)


def encode_task(
    rows: DataFrame, t: Task, vocab: DataFrame, model_type: str, ids: LayoutIds, tokenize: Callable[[Column], Column], **unknown,
) -> DataFrame:
    """Rows of a task as read -> ``x`` and ``y``, or ``ids`` with ``label`` and, where the layout has them, ``segments`` and ``word_index``."""
    encode = lambda df, arrays, keep=(): vocabulary.encode(df, "id", arrays, vocab, keep=keep, **unknown)
    if t.layout == "pairs":
        two = orient(rows, swap=t.swap)
        return encode(two, {"x": tokenize(F.col("source")), "y": tokenize(F.col("target"))})
    if t.layout == "question":
        parts = encode(rows, {c: tokenize(F.col(c)) for c in ("context", "question", "label")})
        x = join_with_separator(F.col("context"), markers(model_type).separator, F.col("question"))
        return parts.select("id", x.alias("x"), F.col("label").alias("y"))
    if t.layout == "dialogue":
        own = markers(model_type)
        history = dialogue.truncate_history(dialogue.running_history(rows, ids.max_len, tokenize), ids.max_len)
        marked = dialogue.mark_speakers(history, *SPEAKERS)
        speakers = F.inline(F.array(*[F.struct(F.lit(s).alias("token"), F.lit(i).cast("bigint").alias("token_id")) for s, i in zip(SPEAKERS, (own.speaker_1, own.speaker_2))]))
        known = vocab.select("token", "token_id").unionByName(vocab.sparkSession.range(1).select(speakers))
        return vocabulary.encode(marked, "id", {"x": F.col("marked"), "y": F.col("reply_tokens")}, known, **unknown)
    one_piece = lambda c: F.transform(c, lambda i: F.array(i))
    if t.layout == "tags":
        found = encode(rows, {"words": F.col("tokens")}, ["seq_label"])
        wrapped, index = alignment.align_words(one_piece("words"), ids.bos, ids.eos)
        return found.select("id", wrapped.alias("ids"), index.alias("word_index"), F.col("seq_label").alias("label"))
    if t.layout == "span":
        found = encode(rows, {"q": F.col("question"), "p": F.col("passage")}, ["label_indices"])
        wrapped, index, segments = alignment.align_question_passage(one_piece("q"), one_piece("p"), ids.bos, ids.eos)
        return found.select("id", wrapped.alias("ids"), index.alias("word_index"), segments.alias("segments"), F.col("label_indices").alias("label"))
    if t.layout == "two_texts":
        found = encode(rows, {"a": tokenize(F.col("sent_A")), "b": tokenize(F.col("sent_B"))}, ["label_index"])
        wrapped, segments = encode_segments(F.col("a"), F.col("b"), cls_id=ids.bos, sep_id=ids.eos)
        return found.select("id", wrapped.alias("ids"), segments.alias("segments"), F.col("label_index").alias("label"))
    label, text = {
        "single": ("label_index", "tweet" if t.reader == "emotion" else "text"),
        "vector": ("label_indices", "review" if t.reader == "absa_hotel" else "sentence"), "several": ("label_indices", "text"),
    }[t.layout]
    found = encode(rows, {"w": tokenize(F.col(text))}, [label])
    shown = multi_hot(F.col(label), len(t.labels)) if t.layout == "several" else F.col(label)
    return found.select("id", wrap_sentence(F.col("w"), start_id=ids.bos, end_id=ids.eos).alias("ids"), shown.alias("label"))


def prepare_task(
    spark: SparkSession, name: str, split: str = "train", path: str | None = None, *, vocab: DataFrame, model_type: str = "bart",
    ids: LayoutIds = LayoutIds(), tokenize: Callable[[Column], Column] = lower_words, batch_size: int = 8, seed: int | None = None,
    bucket: int | None = None, on_unknown: str = "error", unknown: int | None = None,
) -> DataFrame:
    """Batches of one split of a task, ready for a model; see the module for the layouts.

    ``vocab`` is a table ``(token, token_id)``. ``seed`` shuffles the examples, ``bucket`` puts those of like length together.
    Words the vocabulary does not have are an error, null, or the id ``unknown`` (``on_unknown="unk"``).
    """
    t = task(name)
    rows = read_task(spark, name, split, path)
    encoded = encode_task(rows, t, vocab, model_type, ids, tokenize, on_unknown=on_unknown, unknown=unknown)
    options = {"batch_size": batch_size, "seed": seed, "bucket": bucket}
    if t.layout in ("pairs", "question", "dialogue"):
        return generation_batches(encoded, model_type, _languages(t, ids), **options)
    return labelling_batches(
        encoded, max_len=ids.max_len, label_kind={"tags": "tags", "span": "tags", "vector": "vector", "several": "vector"}.get(t.layout, "single"),
        segments="segments" if "segments" in encoded.columns else None, word_index="word_index" if "word_index" in encoded.columns else None, **options,
    )
