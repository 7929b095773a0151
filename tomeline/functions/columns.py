"""Column expressions that several operators share."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import OTHER_RANK, TYPE_RANK

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Characters that a full-text query can't hold.
OPERATORS = '+-@^"(){}:!|&~<>'


def ascii_lower(column: Column | str) -> Column:
    """A-Z lower-cased; other letters keep their case."""
    return F.translate(column, _UPPER, _LOWER)


def like(column: Column | str, pattern: str) -> Column:
    """LIKE that ignores the case of ASCII letters and has no escape character."""
    folded = "".join(c.lower() if "A" <= c <= "Z" else c for c in pattern)
    return F.expr(f"translate({_name(column)}, '{_UPPER}', '{_LOWER}') LIKE {_literal(folded)} ESCAPE '\x01'")


def _name(column: Column | str) -> str:
    if not isinstance(column, str):
        raise TypeError("like takes a column name")
    return f"`{column}`"


def _literal(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def depth(column: Column | str) -> Column:
    """Dots in a qualified name."""
    return F.length(column) - F.length(F.translate(column, ".", ""))


def parent(column: Column | str) -> Column:
    """A qualified name without its last part; a name without dots is its own parent."""
    return F.regexp_replace(column, "[.][^.]*$", "")


def by_name() -> list[Column]:
    """Keys that sort by name and tell qualified names apart: the last part, and all. A name is the last part of its qualified name."""
    return [F.substring_index("qualified_name", ".", -1), F.col("qualified_name")]


def parent_key(column: str) -> Column:
    """The parent of a qualified name, A-Z lower-cased; null for a name without dots."""
    return F.when(F.contains(column, F.lit(".")), ascii_lower(parent(column)))


def type_rank(column: Column | str) -> Column:
    column = F.col(column) if isinstance(column, str) else column
    return reduce(lambda w, kv: w.when(column == kv[0], kv[1]), list(TYPE_RANK.items())[1:], F.when(column == "module", 0)).otherwise(OTHER_RANK)


def visibility(column: Column | str) -> Column:
    """0 for public names, 1 for those that begin with two underscores, 2 for one."""
    column = F.col(column) if isinstance(column, str) else column
    return F.when(column.startswith("__"), 1).when(column.startswith("_"), 2).otherwise(0)


def sort_key() -> list[Column]:
    """Order of results: type, visibility, name by code points."""
    return [type_rank("symbol_type"), visibility("name"), F.col("name")]


def sanitized(column: Column | str) -> Column:
    """The full-text query of user input: its parts with a star each, joined by spaces."""
    spaced = F.translate(column, OPERATORS + "_.", " " * (len(OPERATORS) + 2))
    parts = F.filter(F.split(spaced, r"\s+"), lambda x: x != "")
    return F.array_join(F.transform(parts, lambda x: F.concat(x, F.lit("*"))), " ")


def query_terms(query: str) -> list[str]:
    """The parts of user input that a full-text query looks for."""
    return re.sub(f"[{re.escape(OPERATORS)}_.]", " ", query).split()


def valid_terms(terms: list[str]) -> bool:
    """Whether a full-text query of these parts parses: bare words only, and no operator words."""
    return bool(terms) and all(re.fullmatch(r"[A-Za-z0-9_\x80-\U0010ffff]+", t) and t not in ("AND", "OR", "NOT") for t in terms)


def valid_query(column: Column | str) -> Column:
    """:func:`valid_terms` of the terms of user input, for a column of it."""
    spaced = F.translate(column, OPERATORS + "_.", " " * (len(OPERATORS) + 2))
    parts = F.filter(F.split(spaced, r"\s+"), lambda x: x != "")
    bad = F.exists(parts, lambda x: ~x.rlike(r"^[A-Za-z0-9_\x{80}-\x{10ffff}]+$") | x.isin("AND", "OR", "NOT"))
    return (F.size(parts) > 0) & ~bad


def absolute_module(level: str, module: str, package: str) -> Column:
    """The module that a relative import in a package names; null beyond the top."""
    parts = F.split(package, "[.]")
    kept = F.slice(parts, F.lit(1), F.greatest(F.size(parts) - F.col(level) + 1, F.lit(0)))
    return F.when(F.col(level) <= F.size(parts), F.concat_ws(".", F.array_join(kept, "."), module))
