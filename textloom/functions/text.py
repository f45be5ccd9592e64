"""Tokenizers and text normalisers as built-in Column expressions; the v13a form is a short Arrow function, whose patterns run on whole batches."""

from __future__ import annotations

import sys
from collections.abc import Callable
from functools import reduce

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .arrays import in_steps

# The functions travel with the job, so workers need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# --- fixed values -------------------------------------------------------------------------
# White space as Python's str.split() knows it: Unicode white space plus four separators.
WHITESPACE = r"(?U)[\s\x1c-\x1f]+"

# mteval-v13a tokenisation: plain replacements, then patterns with their substitutions. The first
# class is known with the space in it (" -&"); putting spaces around a space changes no token,
# so it starts at "!" here.
V13A_REPLACEMENTS = [
    ("<skipped>", ""),
    ("-\n", ""),
    ("\n", " "),
    ("&quot;", '"'),
    ("&amp;", "&"),
    ("&lt;", "<"),
    ("&gt;", ">"),
]
V13A_PATTERNS = [
    (r"([\{-~\[-`!-&\(-\+:-@/])", r" \1 "),
    (r"([^0-9])([\.,])", r"\1 \2 "),
    (r"([\.,])([^0-9])", r" \1 \2"),
    (r"([0-9])(-)", r"\1 \2 "),
]

# Penn Treebank word tokenisation (public word-tokenizer rules) in order of application. A step
# is the texts one of which must occur for its patterns to match, and the patterns.
TREEBANK_STEPS = [
    (["«", "“", "‘", "„", "`"], [(r"([«“‘„]|[`]+)", " $1 ")]),
    (['"', "''", "``"], [(r'^\"', "``"), (r"(``)", " $1 "), (r"([ \(\[{<])(\"|'{2})", "$1 `` ")]),
    (["'"], [(r"(?iU)(')(?!re|ve|ll|m|t|s|d)(\w)\b", "$1 $2")]),
    # The stop at the end. A later, narrower rule for it can match nothing new.
    (["."], [(r"(?U)(?<=[^\.])(\.)([\]\)}>\"'»”’ ]*)\s*$", " $1 $2 ")]),
    ([":", ","], [(r"(?U)([:,])([^\d])", " $1 $2"), (r"([:,])$", " $1 ")]),
    (["..."], [(r"\.\.\.", " ... ")]),
    ([";", "@", "#", "$", "%", "&"], [(r"([;@#\$%&])", " $1 ")]),
    (["?", "!"], [(r"([?!])", " $1 ")]),
    (["' "], [(r"([^'])' ", "$1 ' ")]),
    (["[", "]", "(", ")", "{", "}", "<", ">"], [(r"([\]\[\(\)\{\}<>])", " $1 ")]),
    (["--"], [(r"--", " -- ")]),
]
# After one space has been put around the sentence.
TREEBANK_LAST_STEPS = [
    (["»", "”", "’"], [(r"([»”’])", " $1 ")]),
    (["''"], [(r"''", " '' ")]),
    (['"'], [(r'"', " '' ")]),
    (["'"], [
        (r"([^' ])('[sS]|'[mM]|'[dD]|') ", "$1 $2 "),
        (r"([^' ])('ll|'LL|'re|'RE|'ve|'VE|n't|N'T) ", "$1 $2 "),
    ]),
]
TREEBANK_CONTRACTIONS = [
    ("cannot", r"(?iU)\b(can)(not)\b"),
    ("d'ye", r"(?iU)\b(d)('ye)\b"),
    ("gimme", r"(?iU)\b(gim)(me)\b"),
    ("gonna", r"(?iU)\b(gon)(na)\b"),
    ("gotta", r"(?iU)\b(got)(ta)\b"),
    ("lemme", r"(?iU)\b(lem)(me)\b"),
    ("mor'n", r"(?iU)\b(mor)('n)\b"),
    ("wanna", r"(?iU)\b(wan)(na)\s"),
    ("'tis", r"(?iU) ('t)(is)\b"),
    ("'twas", r"(?iU) ('t)(was)\b"),
]
ABBREVIATIONS = ("dr", "mr", "mrs", "ms", "prof", "st", "vs", "etc", "e.g", "i.e", "no")

ASCII_PUNCTUATION = r"[!-/:-@\[-`{-~]"
ARTICLES = r"(?U)\b(a|an|the)\b"
# ------------------------------------------------------------------------------------------

SENTENCE_BREAK = "\u0002"


def _replace_all(text: Column, patterns: list[tuple[str, str]]) -> Column:
    return reduce(lambda acc, p: F.regexp_replace(acc, p[0], p[1]), patterns, text)


def words(text: Column) -> Column:
    """White-space words."""
    return F.array_remove(F.split(text, WHITESPACE), "")


def split_words(texts: pa.Array) -> pa.Array:
    """White-space words of a batch; a text may have empty ones first.

    The ends are trimmed since Arrow's split reads on behind white space at the end of a text, and misses it if no text follows in the
    buffer but other bytes.
    """
    return pc.utf8_split_whitespace(pc.utf8_rtrim_whitespace(texts))


def lower_words(text: Column) -> Column:
    return words(F.lower(text))


def v13a_batch(texts: pa.Array) -> pa.Array:
    """:func:`v13a_text` of a batch."""
    out = pc.utf8_rtrim_whitespace(texts)
    for old, new in V13A_REPLACEMENTS:
        out = pc.replace_substring(out, old, new)
    out = pc.binary_join_element_wise(" ", out, " ", "")
    for pattern, new in V13A_PATTERNS:
        out = pc.replace_substring_regex(out, pattern, new)
    return out


def v13a_text(text: Column) -> Column:
    """Text with v13a tokens separated by white space."""
    return F.arrow_udf(v13a_batch, StringType())(text)


def v13a_tokens(text: Column) -> Column:
    return words(v13a_text(text))


def rouge_text(text: Column) -> Column:
    """Lower case with every run of characters outside ``a-z0-9`` turned into one space."""
    return F.regexp_replace(F.lower(text), "[^a-z0-9]+", " ")


def rouge_tokens(text: Column) -> Column:
    return F.array_remove(F.split(rouge_text(text), " "), "")


def sentences(text: Column, abbreviations: tuple[str, ...] = ABBREVIATIONS) -> Column:
    """Split after a token ending in ``.``, ``?`` or ``!`` (closing quotes and brackets allowed).

    This rule stands in for a trained sentence splitter, so texts with abbreviations outside
    the list may be cut differently.
    """
    known = "|".join(a.replace(".", r"\.") for a in abbreviations)
    guard = rf"(?<!(?i:(?<![\p{{L}}\p{{N}}])(?:{known})\.))" if abbreviations else ""
    marked = F.regexp_replace(
        text, rf"(?U)([.?!][\"'\)\]}}»”’]*){guard}\s+", "$1" + SENTENCE_BREAK
    )
    return F.array_remove(F.split(marked, SENTENCE_BREAK), "")


def _any_in(text: Column, needles: list[str]) -> Column:
    return reduce(lambda acc, n: acc | F.contains(text, F.lit(n)), needles[1:], F.contains(text, F.lit(needles[0])))


def _steps(parts: Column, steps: list[tuple[list[str], list[tuple[str, str]]]]) -> Column:
    """Apply gated steps to every text of an array; a plain search is cheaper than a pattern."""
    for needles, patterns in steps:
        parts = F.transform(parts, _gated(needles, patterns))
    return parts


def _gated(needles: list[str], patterns: list[tuple[str, str]]):
    return lambda s: F.when(_any_in(s, needles), _replace_all(s, patterns)).otherwise(s)


def treebank_sentences(parts: Column) -> Column:
    """Array of sentences -> array of their Penn-Treebank tokens, separated by white space."""
    out = _steps(parts, TREEBANK_STEPS)
    out = F.transform(out, lambda s: F.concat(F.lit(" "), s, F.lit(" ")))
    out = _steps(out, TREEBANK_LAST_STEPS)
    contracted = lambda s: F.when(
        _any_in(F.lower(s), [n for n, _ in TREEBANK_CONTRACTIONS]),
        _replace_all(s, [(p, " $1 $2 ") for _, p in TREEBANK_CONTRACTIONS]),
    ).otherwise(s)
    return F.transform(out, contracted)


def treebank_text(text: Column, abbreviations: tuple[str, ...] = ABBREVIATIONS) -> Column:
    """Sentence split, then Treebank tokens in text order, separated by white space."""
    return F.array_join(treebank_sentences(sentences(text, abbreviations)), " ")


def treebank_tokens(text: Column, abbreviations: tuple[str, ...] = ABBREVIATIONS) -> Column:
    return words(treebank_text(text, abbreviations))


def normalise_answer(text: Column) -> Column:
    """Lower case, no ASCII punctuation, no English articles, single spaces."""
    bare = F.regexp_replace(F.lower(text), ASCII_PUNCTUATION, "")
    return F.array_join(words(F.regexp_replace(bare, ARTICLES, " ")), " ")


def answer_tokens(text: Column) -> Column:
    return words(normalise_answer(text))


def pieces_to_text(pieces: Column, marker: str = "\u2581") -> Column:
    """Sub-word pieces -> text: join, turn the word marker into a space, trim."""
    return F.trim(F.replace(F.array_join(pieces, ""), F.lit(marker), F.lit(" ")))


def pair_text(left: Column, right: Column) -> Column:
    """Display text of a pair."""
    return F.concat(left, F.lit("|"), right)


def word_pair_text(left: Column, right: Column) -> Column:
    """Display text of a pair of word arrays."""
    return pair_text(F.array_join(left, " "), F.array_join(right, " "))


def parse_list_literal(cell: Column) -> Column:
    """``"['a', 'b']"`` -> array of strings, never evaluated as code.

    Covers lists with one kind of quote and no backslash. Other cells are null here; see
    ``operators.literals`` for those.
    """
    has = lambda text, c: F.contains(text, F.lit(c))

    def body(bare: Column) -> Column:
        listed = F.startswith(bare, F.lit("[")) & F.endswith(bare, F.lit("]")) & (F.length(bare) >= 2)
        quote = F.when(has(bare, "'"), F.when(~has(bare, '"'), "'")).when(has(bare, '"'), '"')
        text = F.when(listed & ~has(bare, "\\"), F.trim(F.substr(bare, F.lit(2), F.length(bare) - 2)))
        return F.struct(text.alias("text"), quote.alias("quote"))

    def without_last_comma(s: Column) -> Column:
        # The pattern reads the whole text, so only where a comma is last, or before a line end.
        inner = F.when(has(F.substring(s["text"], -3, 3), ","), F.regexp_replace(s["text"], r"\s*,$", "")).otherwise(s["text"])
        return F.struct(inner.alias("inner"), s["quote"].alias("quote"))

    def split(s: Column) -> Column:
        inner, quote = s["inner"], s["quote"]
        shaped = (F.length(inner) >= 2) & F.startswith(inner, quote) & F.endswith(inner, quote)
        between = F.concat(quote, F.lit(r"\s*,\s*"), quote)
        items = F.when(shaped, F.split(F.substr(inner, F.lit(2), F.length(inner) - 2), between))
        quotes = F.octet_length(inner) - F.octet_length(F.replace(inner, quote, F.lit("")))
        return F.struct((inner == "").alias("empty"), quotes.alias("quotes"), items.alias("items"))

    # Every item has two quotes around it, and none inside.
    sound = lambda s: F.when(s["empty"], F.array().cast("array<string>")).when(
        s["items"].isNotNull() & (s["quotes"] == 2 * F.size(s["items"])), s["items"]
    )
    return in_steps(F.trim(cell), body, without_last_comma, split, sound)


TOKENIZERS: dict[str, Callable[[Column], Column]] = {
    "words": words, "lower_words": lower_words, "v13a": v13a_tokens, "rouge": rouge_tokens,
    "treebank": treebank_tokens, "answer": answer_tokens,
}


def register_tokenizer(name: str, tokenize: Callable[[Column], Column]) -> None:
    """``tokenize``: text column -> array column; built-in expressions or an Arrow function."""
    TOKENIZERS[name] = tokenize


def tokenizer(name: str) -> Callable[[Column], Column]:
    if name not in TOKENIZERS:
        raise ValueError(f"unknown tokenizer {name!r}")
    return TOKENIZERS[name]
