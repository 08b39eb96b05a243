"""Numbers from words and digits, and small arithmetic of readers and clients."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The words of 0 to 19, and the word of the free cell.
WORDS = (
    "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen "
    "eighteen nineteen"
).split()
FREE = "FREE"
#: A whole token, between ASCII white space, that ``number_of`` or ``is_free`` knows.
TOKEN = rf"(?i)(?<![^\x20\x09-\x0D]),*(?:[0-9]+|{'|'.join(WORDS)}|{FREE}),*(?![^\x20\x09-\x0D])"


def _bare(token: Column) -> Column:
    return F.btrim(F.btrim(F.btrim(token), F.lit(",")))


def is_free(token: Column) -> Column:
    return F.upper(_bare(token)) == FREE


def number_of(token: Column) -> Column:
    """The value of digits or of a word of 0 to 19, commas around it left out; null for the free cell and anything else."""
    bare = _bare(token)
    digits = F.when(bare.rlike("^[0-9]+$"), bare.try_cast("long"))
    place = F.array_position(F.array(*map(F.lit, WORDS)), F.lower(bare))
    return F.coalesce(digits, F.when(place > 0, place - 1))


def digit_pair(tens: Column, ones: Column) -> Column:
    """The number that two read digits make."""
    return tens * 10 + ones


def backoff_ms(attempt: Column, jitter: Column) -> Column:
    """The wait before a reconnect: one second doubled each time, 30 at most, and up to 30 % more by ``jitter`` (0 to 1)."""
    wait = F.least(F.lit(1000.0) * F.pow(F.lit(2.0), attempt), F.lit(30_000.0))
    return wait * (F.lit(1.0) + jitter * 0.3)
