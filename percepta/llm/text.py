"""Column expressions on texts that several operators share."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Runs of the six ASCII blanks, and the rest.
BLANKS = r"[\x20\x09-\x0D]+"


def ascii_lower(text: Column) -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def words(text: Column) -> Column:
    """Maximal runs without blanks; an empty array for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BLANKS), "")
