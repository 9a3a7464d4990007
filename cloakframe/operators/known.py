"""A Bloom filter over the keys of a lookup: rows that cannot find anything stay out of the join.

The filter is a bit array of a size that follows the number of keys up to a limit.  It is built
by bitmap aggregates, a row per 32,768 bits, and read as a scalar subquery: a literal in
the plan of the rows, so that testing them is narrow.  It never denies a key that is there.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Bits per key, and hashes; about 1.4 % of the unknown keys pass.
BITS_PER_KEY = 16
HASHES = 2
# Largest filter in bytes; with more than a key per four bits none is built.
FILTER_BYTES = 32 * 1024 * 1024
_BUCKET = 32_768


@dataclass
class KeyFilter:
    """``bits`` is an array of bitmaps; ``size`` the number of bits."""

    bits: Column
    size: int

    def might_hold(self, *key: Column) -> Column:
        """False only for a key that is not there; a NULL part makes it False."""
        found = F.lit(True)
        for place in _places(self.size, *key):
            bitmap = F.get(self.bits, F.floor(place / _BUCKET).cast("int"))
            at = F.pmod(place, F.lit(_BUCKET)).cast("int")
            byte = F.conv(F.hex(F.substr(bitmap, F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
            found = found & (F.getbit(byte, at % 8) == 1)
        return F.coalesce(found, F.lit(False))


def _places(size: int, *key: Column) -> list[Column]:
    whole = F.lit(True)
    for part in key:
        whole = whole & part.isNotNull()
    return [F.when(whole, F.pmod(F.xxhash64(F.lit(i), *[k.cast("string") for k in key]), F.lit(size).cast("bigint"))) for i in range(HASHES)]


def key_filter(lookup: DataFrame, keys: list[str], filter_bytes: int | None = None) -> KeyFilter | None:
    """The filter of a lookup's keys, or None where they are too many for the largest one."""
    most = 8 * (FILTER_BYTES if filter_bytes is None else filter_bytes)
    n = lookup.count()
    size = _BUCKET
    while size < BITS_PER_KEY * n and size < most:
        size *= 2
    if n * 4 > size:
        return None
    spark = lookup.sparkSession
    places = lookup.select(F.explode(F.array(*_places(size, *[F.col(k) for k in keys]))).alias("p")).where("p is not null")
    bitmaps = places.groupBy(F.floor(F.col("p") / _BUCKET).alias("bucket")).agg(F.bitmap_construct_agg(F.pmod("p", F.lit(_BUCKET).cast("bigint"))).alias("bitmap"))
    # One row of at most FILTER_BYTES; a bucket without a key has no bitmap.
    every = spark.range(size // _BUCKET).withColumnRenamed("id", "bucket").join(bitmaps, "bucket", "left")
    row = every.agg(F.transform(F.sort_array(F.collect_list(F.struct("bucket", "bitmap"))), lambda x: x["bitmap"]).alias("bits"))
    return KeyFilter(row.scalar(), size)
