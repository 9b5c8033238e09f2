"""A set of rows as a bitmap of bounded size, to spare others a shuffle.

A bitmap says of a row that it surely isn't in the set, or that it may be: what is
shuffled for an exact join is then only the latter.  It has about 16 bits for each
row of the set and at most 2**BITS bits (8 MB), whatever the size of the set; a set
so large that most bits are set spares little, and changes no result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.scratch import Cuts

BITS = 26


@dataclass(frozen=True)
class Bitmap:
    rows: DataFrame
    bits: int


def _place(columns: list[str], bits: int):
    return F.pmod(F.xxhash64(F.lit(3), *[F.col(c) for c in columns]), F.lit(1 << bits)) + 1


def bitmap(rows: DataFrame, columns: list[str], cuts: Cuts) -> Bitmap:
    """The set of these columns' values, written: at most 2048 rows of 4 KB."""
    bits = min(BITS, max(15, (16 * rows.count()).bit_length()))
    place = _place(columns, bits)
    made = rows.select(F.bitmap_bucket_number(place).alias("_bucket"), F.bitmap_bit_position(place).alias("_bit")).groupBy("_bucket").agg(F.bitmap_construct_agg("_bit").alias("_bits"))
    return Bitmap(cuts.cut(made), bits)


def marked(rows: DataFrame, columns: list[str], made: Bitmap, name: str) -> DataFrame:
    """rows with a column: whether the row may be in the set of a bitmap."""
    place = _place(columns, made.bits)
    wide = rows.withColumns({"_bucket": F.bitmap_bucket_number(place), "_bit": F.bitmap_bit_position(place)}).join(F.broadcast(made.rows), "_bucket", "left")
    byte = F.conv(F.hex(F.substr(F.col("_bits"), (F.col("_bit") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    hit = F.coalesce(F.getbit(byte, (F.col("_bit") % 8).cast("int")) == 1, F.lit(False))
    return wide.withColumn(name, hit).drop("_bucket", "_bit", "_bits")
