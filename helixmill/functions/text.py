"""String normalisation as Column expressions; nothing here leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Letters with marks and their plain letters.
MARKED = "àáâãäåçèéêëìíîïñòóôõöøùúûüýÿ"
PLAIN = "aaaaaaceeeeiiiinoooooouuuuyy"


def fold(value: Column) -> Column:
    """Lower case, without marks on letters, with single blanks and no outer blanks."""
    plain = F.translate(F.lower(value), MARKED, PLAIN)
    return F.trim(F.regexp_replace(F.regexp_replace(plain, r"\p{M}", ""), r"[\s\p{Z}]+", " "))


def id_key(value: Column) -> Column:
    """The record an identifier means, whatever its letter case, blanks and punctuation."""
    return F.upper(F.regexp_replace(value, r"[^\p{L}\p{N}]+", ""))


def versioned_id_key(value: Column) -> Column:
    """As ``id_key`` for identifiers that may carry a version after a dot."""
    return id_key(F.substring_index(F.trim(value), ".", 1))


def is_blank(value: Column) -> Column:
    """True for NULL and for text of nothing but white space (of any Unicode kind)."""
    return value.isNull() | ~value.rlike(r"[^\s\p{Z}]")


def clean_number(value: Column) -> Column:
    """A double in which NaN has become NULL."""
    number = value.cast("double")
    return F.when(~F.isnan(number), number)
