"""Selections as bitmaps over row numbers: a bit a row, and set operations on them.

A ``RowIndex`` numbers the rows of a table once, in series order.  A selection then is one
binary per 32,768 rows that has any selected one, made by the built-in bitmap aggregates;
union and intersection are grouped aggregates over those, inversion flips their bits, and
counting never unfolds them.  Only ``rows`` goes back to row keys.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from seriesmend.model import SeriesSpec, join_on_key
from seriesmend.plans.blocks import ROW_NUMBER, number_rows
from seriesmend.plans.staging import stage

BYTES = 4096   # of a built-in bitmap
BITS = 8 * BYTES
HEX, FLIPPED = "0123456789ABCDEF", "FEDCBA9876543210"


@dataclass(frozen=True)
class RowIndex:
    """``df`` with a dense row number ``_rn`` from 0, written once."""

    df: DataFrame
    spec: SeriesSpec

    @classmethod
    def build(cls, df: DataFrame, spec: SeriesSpec, columns: tuple[str, ...] = ()) -> "RowIndex":
        """Number the rows of ``df``; conditions may use ``columns`` besides the row key."""
        kept = df.select(*dict.fromkeys((*spec.row_key, *columns)))
        partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        return cls(stage(number_rows(kept, spec, partitions)), spec)

    def select(self, where: Column) -> "BitSelection":
        """Rows where a condition on the indexed columns holds."""
        return self._selection(self.df.filter(where))

    def select_rows(self, rows: DataFrame) -> "BitSelection":
        """Rows whose key is in a table of row keys (of a detector, or of other values)."""
        keys = rows.select(*self.spec.row_key)
        return self._selection(join_on_key(self.df, keys, self.spec.row_key, "left_semi"))

    def _selection(self, rows: DataFrame) -> "BitSelection":
        # the built-in functions number from 1
        at = F.col(ROW_NUMBER) + 1
        bits = rows.groupBy(F.bitmap_bucket_number(at).alias("bucket")).agg(
            F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits"))
        return BitSelection(self, bits)

    def everything(self) -> "BitSelection":
        return self._selection(self.df)

    def nothing(self) -> "BitSelection":
        return self._selection(self.df.limit(0))


@dataclass(frozen=True)
class BitSelection:
    """Selected rows of an index: ``bits`` has bucket and bits, no bucket twice."""

    index: RowIndex
    bits: DataFrame

    def frozen(self) -> "BitSelection":
        """Written: later corrections don't change it."""
        return BitSelection(self.index, stage(self.bits))

    def _with(self, other: "BitSelection") -> DataFrame:
        if other.index.df is not self.index.df:
            raise ValueError("selections of different row indexes have no common row numbers")
        return self.bits.unionAll(other.bits)

    def union(self, other: "BitSelection") -> "BitSelection":
        return BitSelection(self.index, self._with(other).groupBy("bucket").agg(F.bitmap_or_agg("bits").alias("bits")))

    def intersection(self, other: "BitSelection") -> "BitSelection":
        both = self._with(other).groupBy("bucket").agg(
            F.bitmap_and_agg("bits").alias("bits"), F.count(F.lit(1)).alias("sides"))
        return BitSelection(self.index, both.filter("sides = 2").select("bucket", "bits"))._without_empty()

    def difference(self, other: "BitSelection") -> "BitSelection":
        """Rows of this selection that aren't in the other one."""
        if other.index.df is not self.index.df:
            raise ValueError("selections of different row indexes have no common row numbers")
        # buckets the other one lacks stay as they are
        flipped = other.bits.select("bucket", _flipped("bits").alias("bits"), F.lit(True).alias("theirs"))
        sides = self.bits.withColumn("theirs", F.lit(False)).unionAll(flipped)
        left = sides.groupBy("bucket").agg(
            F.bitmap_and_agg("bits").alias("bits"), F.bool_and("theirs").alias("only_theirs"))
        return BitSelection(self.index, left.filter("NOT only_theirs").select("bucket", "bits"))._without_empty()

    def inverted(self) -> "BitSelection":
        """All rows of the index that aren't selected."""
        return self.index.everything().difference(self)

    def _without_empty(self) -> "BitSelection":
        return BitSelection(self.index, self.bits.filter(F.bitmap_count("bits") > 0))

    def count(self) -> int:
        return self.bits.agg(F.coalesce(F.sum(F.bitmap_count("bits")), F.lit(0))).first()[0]

    def counts(self) -> DataFrame:
        """One row: ``selected``."""
        return self.bits.agg(F.coalesce(F.sum(F.bitmap_count("bits")), F.lit(0)).alias("selected"))

    def row_numbers(self) -> DataFrame:
        """``_rn`` of the selected rows: bytes without a set bit are passed over."""
        byte = lambda at: F.conv(F.hex(F.substring("bits", at + 1, F.lit(1))), 16, 10).cast("int")
        bytes_ = F.transform(F.sequence(F.lit(0), F.lit(BYTES - 1)), lambda i: F.struct(i.alias("at"), byte(i).alias("of")))
        used = self.bits.select("bucket", F.inline(F.filter(bytes_, lambda b: b["of"] > 0)))
        eight = used.select("bucket", "at", "of", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("bit"))
        hit = F.get(F.array(*[F.lit(1 << b) for b in range(8)]), F.col("bit")).bitwiseAND(F.col("of")) > 0
        at = (F.col("bucket") - 1) * BITS + F.col("at") * 8 + F.col("bit")
        return eight.filter(hit).select(at.alias(ROW_NUMBER))

    def rows(self) -> DataFrame:
        """The selected rows' keys (and the other indexed columns)."""
        return self.index.df.join(self.row_numbers(), ROW_NUMBER, "left_semi").drop(ROW_NUMBER)


def _flipped(bits: str) -> Column:
    """All bits of a bitmap the other way, by its hexadecimal digits."""
    return F.unhex(F.translate(F.hex(bits), HEX, FLIPPED))
