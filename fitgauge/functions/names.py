"""Expressions over object names and type names."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fitgauge import settings as s

TABLE_KEYS = ["database_name", "schema_name", "table_name"]
COLUMN_KEYS = [*TABLE_KEYS, "column_name"]


def name_matches_any(col: Column, words: Sequence[str]) -> Column:
    """True where the upper-cased name contains one of the words; false for null."""
    if not words:
        return F.lit(False)
    pattern = "|".join(re.escape(word) for word in words)
    return F.coalesce(F.upper(col).rlike(pattern), F.lit(False))


def name_like_any(col: Column, patterns: Sequence[str]) -> Column:
    """True where the upper-cased name is LIKE one of the patterns; false for null."""
    if not patterns:
        return F.lit(False)
    return F.coalesce(reduce(or_, [F.upper(col).like(p) for p in patterns]), F.lit(False))


def name_regex_any(col: Column, patterns: Sequence[str]) -> Column:
    """True where one of the regular expressions is found, in any letter case."""
    if not patterns:
        return F.lit(False)
    return F.coalesce(reduce(or_, [col.rlike(f"(?i){p}") for p in patterns]), F.lit(False))


def base_type(data_type: Column) -> Column:
    """Upper-cased type name without its parameters: ``number(38,0)`` is ``NUMBER``."""
    return F.trim(F.split_part(F.upper(F.coalesce(data_type, F.lit(""))), F.lit("("), F.lit(1)))


def type_family(data_type: Column) -> Column:
    base = base_type(data_type)
    return (
        F.when(base.isin(*s.UNSUPPORTED_TYPES), "unsupported")
        .when(base.isin(*s.SEMI_STRUCTURED_TYPES), "semi_structured")
        .when(base.isin(*s.TEXT_TYPES), "text")
        .when(base.isin(*s.NUMERIC_TYPES), "numeric")
        .when(base.isin(*s.TEMPORAL_TYPES), "temporal")
        .otherwise("other")
    )


def is_text_like(data_type: Column) -> Column:
    base = base_type(data_type)
    return base.isin(*s.TEXT_TYPES) | name_matches_any(base, s.TEXT_TYPE_PARTS)


def is_numeric_like(data_type: Column) -> Column:
    base = base_type(data_type)
    return base.isin(*s.NUMERIC_TYPES) | name_matches_any(base, s.NUMERIC_TYPE_PARTS)


def fqn(*cols: Column | str, width: int | None = None) -> Column:
    """Dotted name; null parts are left out."""
    full = F.concat_ws(".", *cols)
    return full if width is None else F.substring(full, 1, width)


def present(col: Column) -> Column:
    """True where the text is neither null nor blank (any white space)."""
    return F.coalesce(col.rlike(r"\S"), F.lit(False))


def joined_on(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """An equi-join on keys that may be null: null meets null. The keys of ``left`` are kept."""
    renamed = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_right_{k}")) for k in keys])
    return left.join(renamed, same, how).drop(*(f"_right_{k}" for k in keys))
