"""Times as numbers, the same in any session time zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The moment that reports take as now; every scorer has it as a parameter.
AS_OF = "2024-02-01 00:00:00"


def epoch(column: str) -> Column:
    """Whole seconds since 1970 of a timestamp column's wall clock."""
    return F.expr(f"timestampdiff(SECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', cast({column} AS timestamp_ntz))")


def epoch_micros(column: str) -> Column:
    """Microseconds since 1970 of a timestamp column's wall clock."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', cast({column} AS timestamp_ntz))")


def epoch_of(text: str) -> Column:
    return F.expr(f"timestampdiff(SECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', TIMESTAMP_NTZ '{text}')")


def age_days(column: str, as_of: str = AS_OF) -> Column:
    """Fractional days before as_of."""
    return (epoch_of(as_of) - epoch(column)) / F.lit(86400.0)


def day(column: str) -> Column:
    return F.date_format(F.col(column), "yyyy-MM-dd")
