"""Small scalar rules that parameters and logs need."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that mean true.
TRUE_WORDS = ["yes", "true", "t", "y", "1"]
#: Words that mean false.
FALSE_WORDS = ["no", "false", "f", "n", "0"]


def to_bool(text: Column) -> Column:
    """True, false, or null for any other word."""
    word = F.lower(F.trim(text))
    return F.when(word.isin(TRUE_WORDS), F.lit(True)).when(word.isin(FALSE_WORDS), F.lit(False))


def to_ms(seconds: Column) -> Column:
    """Whole milliseconds, cut off."""
    return (seconds * 1000).cast("long")


def replication(processes: Column) -> Column:
    """The largest power of two whose square is at most the number of processes."""
    return F.pow(F.lit(2), F.floor(F.log2(processes.cast("double")) / 2 + 1e-12)).cast("long")


def grid_fits(processes: Column, copies: Column) -> Column:
    """Whether a replicated grid divides evenly: copies and their square divide the processes."""
    return (processes % copies == 0) & (processes % (copies * copies) == 0)
