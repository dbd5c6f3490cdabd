"""Small helpers the operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# the white space of the text rules: space, and tab to carriage return
SPACES = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """``name``, or a longer one if ``df`` already has such a column (in any case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def quoted(name: str) -> Column:
    """A column by its exact name, dots included."""
    return F.col("`" + name.replace("`", "``") + "`")


def text_of(name: str) -> Column:
    """The text, with null as the empty text."""
    return F.coalesce(quoted(name).cast("string"), F.lit(""))


def words_of(text: Column) -> Column:
    """The runs of characters that are not white space, in order."""
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def squeezed(text: Column) -> Column:
    """The text without its white space."""
    return F.regexp_replace(text, r"[\x20\x09-\x0D]+", "")


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def partitions_for(df: DataFrame, least: int = 1) -> int:
    """Shuffle partitions of the session, at least ``least``."""
    return max(least, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
