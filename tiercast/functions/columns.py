"""Column expressions shared by the operators; all stay inside the JVM."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, functions as F

# Fixed value: the name given to a feature whose own name is blank.
UNLABELED = "(unlabeled)"


def quoted(name: str) -> str:
    """``name`` as SQL text, also when it holds dots, blanks or backticks.

    Wide selections are written as text: one call instead of one per function
    and column.
    """
    return "`" + name.replace("`", "``") + "`"


def safe_date(col: Column) -> Column:
    """DATE of a date, timestamp or text column; unreadable text becomes null."""
    return col.try_cast("date")


def sanitize_name(col: Column) -> Column:
    """Square and angle brackets become underscores; blank names get a label."""
    cleaned = F.regexp_replace(col, r"[\[\]<>]", "_")
    cleaned = F.regexp_replace(cleaned, r"(?U)^\s+|\s+$", "")
    return F.when(cleaned == "", F.lit(UNLABELED)).otherwise(cleaned)


def sanitize_text(name: str) -> str:
    """The rule of :func:`sanitize_name` for a name held in the configuration."""
    return name.translate(str.maketrans("[]<>", "____")).strip() or UNLABELED


def iso_day(col: Column) -> Column:
    return F.date_format(col, "yyyy-MM-dd")


def month_label(col: Column) -> Column:
    return F.date_format(col, "MMMM yyyy")


def any_of(flags: Sequence[Column]) -> Column:
    """True if any flag is true; null counts as false."""
    return reduce(lambda a, b: a | b, [F.coalesce(f, F.lit(False)) for f in flags], F.lit(False))


def seeded_hash(seed: int | str, *keys: Column) -> Column:
    """Uniform 32-bit value of the key columns and a seed, as BIGINT.

    md5 rather than an engine-specific hash, so that other engines can repeat it.
    """
    text = F.concat_ws(":", *[k.cast("string") for k in keys], F.lit(str(seed)))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")
