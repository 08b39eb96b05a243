"""Labels of called numbers: a letter for each range of 15, and the number."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The column letters, each for 15 numbers.
LETTERS = "BINGO"
WIDTH = 15


def letter_of(n: Column) -> Column:
    """The letter of a number in 1..75; null outside."""
    at = F.floor((n - 1) / WIDTH).cast("int") + 1
    return F.when((n >= 1) & (n <= WIDTH * len(LETTERS)), F.element_at(F.array(*map(F.lit, LETTERS)), at))


def label_of(n: Column) -> Column:
    """Letter and number; null outside 1..75."""
    return F.concat(letter_of(n), n.cast("string"))


def lenient_label(text: Column) -> Column:
    """Upper-cased text; digits (of any length) lose leading zeros and get the letter of their range, where 0 and all above 60 get the last."""
    t = F.upper(F.trim(text))
    digits = F.regexp_replace(t, "^0+(?=[0-9])", "")
    n = F.when(F.length(digits) <= 2, digits.try_cast("int"))
    letter = F.coalesce(F.when(n <= 60, letter_of(n)), F.lit(LETTERS[-1]))
    return F.when(t.rlike("^[0-9]+$"), F.concat(letter, digits)).otherwise(t)


def strict_label(text: Column) -> Column:
    """A label from digits, or from a letter with digits that agree; null for anything else."""
    t = F.upper(F.trim(text))
    given, digits = F.regexp_extract(t, "^([A-Z]?)([0-9]+)$", 1), F.regexp_extract(t, "^([A-Z]?)([0-9]+)$", 2)
    n = digits.try_cast("int")
    return F.when((given == "") | (given == letter_of(n)), label_of(n))
