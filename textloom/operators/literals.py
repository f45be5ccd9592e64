"""List literals that the built-in parser leaves out: mixed quotes and escapes."""

from __future__ import annotations

import ast
import re
import sys

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from ..functions.text import parse_list_literal

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# A string in quotes of either kind that holds no other escapes than of quotes and backslashes, up to the next one.
_STRING = "|".join(rf"{q}[^{q}\\\x00-\x08\x0a-\x1f]*(?:\\['\"\\][^{q}\\\x00-\x08\x0a-\x1f]*)*{q}" for q in "'\"")
_ITEM = re.compile(rf"(({_STRING})[ \t\n\r]*(?:,[ \t\n\r]*|\Z))")
_ESCAPE = re.compile(r"\\(.)")


def _strings(text: str) -> list[str] | None:
    """Items of a list of such strings alone; null for any other text."""
    if not (text.startswith("[") and text.endswith("]")):
        return None
    found = _ITEM.findall(text, 1, len(text) - 1)
    if sum(len(whole) for whole, _ in found) != len(text) - 2:
        return None
    return [_ESCAPE.sub(r"\1", item[1:-1]) if "\\" in item else item[1:-1] for _, item in found]


@F.pandas_udf(ArrayType(StringType()))
def _literal(cells: pd.Series) -> pd.Series:
    """Literals only: ``ast.literal_eval`` runs no code. Lists of plain strings, which most are, need no syntax tree."""

    def items(cell):
        if cell is None:
            return None
        text = cell.strip()
        if (plain := _strings(text)) is not None:
            return plain
        try:
            value = ast.literal_eval(text)
        except (ValueError, SyntaxError, MemoryError, RecursionError):
            return None
        return [str(v) for v in value] if isinstance(value, (list, tuple)) else None

    return pd.Series([items(c) for c in cells], index=cells.index, dtype=object)


def parse_any_list_literal(cell: Column) -> Column:
    """Built-in parse first; only cells it cannot read go through Python. Null if no list."""
    simple = parse_list_literal(cell)
    return F.coalesce(simple, _literal(F.when(simple.isNull(), cell)))
