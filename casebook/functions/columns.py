"""Column derivations. All are built-in expressions; bad values become null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casebook.sources.schema import DOUBLES, FLAGS, INTEGERS, TEXTS, TIMESTAMPS


def to_flag(c: Column) -> Column:
    """True and false for exactly these words, else null."""
    text = c.cast("string")
    return F.when(text == "true", F.lit(True)).when(text == "false", F.lit(False))


def padded(c: Column, width: int) -> Column:
    """Trimmed and zero-padded; longer values stay whole, blank ones become null."""
    value = F.trim(c.cast("string"))
    return F.when(F.length(value) == 0, F.lit(None).cast("string")).when(F.length(value) >= width, value).otherwise(F.lpad(value, width, "0"))


def normal_code(c: Column) -> Column:
    return padded(c, 4)


def typed(df: DataFrame) -> DataFrame:
    """The feed's text columns in their types; columns that are missing are skipped."""
    kinds = {c: F.expr(f"try_cast(`{c}` AS timestamp_ntz)") for c in TIMESTAMPS}
    kinds |= {c: F.expr(f"try_cast(`{c}` AS double)") for c in DOUBLES}
    kinds |= {c: F.expr(f"try_cast(`{c}` AS bigint)") for c in INTEGERS}
    kinds |= {c: to_flag(F.col(c)) for c in FLAGS} | {c: F.col(c).cast("string") for c in TEXTS}
    return df.withColumns({c: e for c, e in kinds.items() if c in df.columns})


def category_key(c: Column) -> Column:
    """A category as it is compared: trimmed, upper case."""
    return F.upper(F.trim(c))


def geography_key(c: Column, level: str) -> Column:
    """A geography value as it is stored; null where it cannot be one."""
    if level in ("ward", "community_area"):
        return F.trim(c.cast("string")).try_cast("bigint")
    widths = {"beat": 4, "district": 3}
    if level not in widths:
        raise ValueError(f"{level} has no values")
    return padded(c, widths[level])


def period(c: Column, grain: str) -> Column:
    """First day of the month, quarter or year of a date or timestamp, as a date."""
    return F.trunc(c.cast("date"), grain)


def next_period(start: Column, grain: str) -> Column:
    return F.add_months(start, {"month": 1, "quarter": 3, "year": 12}[grain])


def rate(part: Column, whole: Column) -> Column:
    """A share of counts; 0 if there is nothing."""
    return F.coalesce(F.try_divide(part, whole), F.lit(0.0))
