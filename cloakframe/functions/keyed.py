"""Keyed-hash randomness: the same salt, scope and value always give the same draw.

A draw needs neither a memo table nor a shuffle, is stable when a task is run
again, and two jobs that share the salt agree with each other.
"""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

# Digits of the 62-letter alphabet that random replacement strings are made of.
ALPHABET = string.ascii_letters + string.digits


def as_column(value) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def keyed_digest(value: Column, salt, scope: str = "") -> Column:
    """Hex digest of ``salt|scope:value``.  ``salt`` may be a Column, e.g. ``secrets.scalar()``."""
    material = F.concat(as_column(salt), F.lit(f"|{scope}:"), value.cast("string"))
    return F.sha2(material, 256)


def uniform(digest: Column) -> Column:
    """Uniform double in [0, 1) from the first 32 bits of a hex digest."""
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def jabber(digest: Column, length: int = 8) -> Column:
    """Alphanumeric string: one letter from every four hex digits of the digest."""
    letters = []
    for i in range(length):
        number = F.conv(F.substring(digest, 1 + 4 * i, 4), 16, 10).cast("int")
        letters.append(F.substr(F.lit(ALPHABET), number % len(ALPHABET) + 1, F.lit(1)))
    return F.concat(*letters)
