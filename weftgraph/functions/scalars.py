"""Column functions shared by the operators; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def norm_path(c: Column | str) -> Column:
    """Backslashes become slashes."""
    return F.translate(col(c), "\\", "/")


def instant_ms(c: Column | str) -> Column:
    """Milliseconds since the epoch of an instant written as text.

    Digits are seconds (up to 11 digits), milliseconds (up to 14) or microseconds; anything else is read as an
    ISO 8601 timestamp in UTC. Outer blanks do not matter. What cannot be read gives null.
    """
    t = F.trim(col(c))
    n = t.try_cast("bigint")
    return (
        F.when(t.rlike("^[0-9]{1,11}$"), n * 1000)
        .when(t.rlike("^[0-9]{12,14}$"), n)
        .when(t.rlike("^[0-9]{15,18}$"), F.floor(n / 1000))
        .otherwise(F.unix_millis(t.try_cast("timestamp")))
        .cast("bigint")
    )


def blank(c: Column | str) -> Column:
    """True for null and for text of white space only."""
    return F.coalesce(F.trim(col(c)) == "", F.lit(True))
