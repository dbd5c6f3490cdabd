"""Time layouts found from the texts themselves, one decision for a whole column.

A text is cut into its fields: three of a date (numbers, or a month's name), and a clock
with optional seconds, fraction and AM or PM.  What the fields' ranges are over all texts
of a column decides their order: a first field above twelve cannot be a month, and the
other way round.  Where neither is, the day comes first.  Two-digit years 69 to 99 are of
the twentieth century, others of this one.  One aggregate looks at a column, whatever it holds;
a text in no known shape, or a date that does not exist, has no time.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F, types as T

from seriesmend.functions.binding import let
from seriesmend.model import named
from seriesmend.sources.tables import TEMPORAL_TYPES
from seriesmend.sources.timeaxis import ISO_FORMATS, parse_time_text

# The first letters of the months, and the first year of the last century.
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
PIVOT_YEAR = 69

_DATE = r"(\d{4}|\d{1,2}|[A-Za-z]{3,9})\.?[-/., ]+(\d{1,2}|[A-Za-z]{3,9})\.?(?:st|nd|rd|th)?[-/., ]+(\d{4}|\d{1,2})"
_CLOCK = r"(?:[T, ]+(\d{1,2})[:.](\d{2})(?:[:.](\d{2})(?:[.,](\d{1,9}))?)?(?: *([AaPp])\.?[Mm]\.?)?)?"
SHAPE = rf"^\s*{_DATE}{_CLOCK}\s*$"
# What any of the ISO layouts begins with: four digits of a year, which may have a sign.
LEADING_YEAR = r"^[+-]?\d{4}"
WEEKDAY = r"^\s*(?:Mon|Tue|Wed|Thu|Fri|Sat|Sun)[a-z]*[,. ]+"


def _fields(text: Column) -> Column:
    """The eight fields of a text (three of the date, hour, minute, second, fraction, half of
    the day), empty where it has none; NULL if it has another shape."""
    def cut(plain: Column) -> Column:
        # a text of this shape has no bar, so it has changed; any other one has not
        marked = F.regexp_replace(plain, SHAPE, "$1|$2|$3|$4|$5|$6|$7|$8")
        return let(marked, lambda m: F.when(m != plain, F.split(m, r"\|")))

    return let(F.regexp_replace(text, WEEKDAY, ""), cut)


def _number(field: Column) -> Column:
    # a field is empty, digits or letters; a cast that fails is slow, so it is not tried
    return F.when((field >= "0") & (field < "A"), field.try_cast("int"))


@dataclass(frozen=True)
class TimeShapes:
    """The order of numeric dates in a column: ``month_first`` ("12/31/2024"), and
    ``day_before_month`` where the year leads ("2024-31-12")."""

    month_first: bool = False
    day_before_month: bool = False

    def parse(self, text: Column) -> Column:
        """Text to time (no zone), by the library's ISO layouts or else by shape."""
        iso = F.when(text.rlike(LEADING_YEAR), parse_time_text(text, ISO_FORMATS))
        return F.coalesce(iso, self._by_shape(text))

    def _by_shape(self, text: Column) -> Column:
        # every step is bound once
        return let(_fields(text), lambda f: let(self._numbers(f), _as_time))

    def _numbers(self, f: Column) -> Column:
        """Year, month, day, hour, minute, second and microseconds of the fields."""
        a, b, c = f[0], f[1], f[2]
        months = F.array(*[F.lit(m) for m in MONTHS])
        month_of = lambda x: F.coalesce(
            _number(x), F.nullif(F.array_position(months, F.lower(F.substring(x, 1, 3))), F.lit(0)).cast("int"))
        first_is_name, second_is_name = a >= "A", b >= "A"   # fields are digits or letters
        leads = (F.length(a) == 4) & ~first_is_name
        month_second = second_is_name | F.lit(not self.day_before_month)
        month_first = first_is_name | (~second_is_name & F.lit(self.month_first))
        year = F.when(leads, a).otherwise(c)
        month = F.when(leads, F.when(month_second, b).otherwise(c)).when(month_first, a).otherwise(b)
        day = F.when(leads, F.when(month_second, c).otherwise(b)).when(month_first, b).otherwise(a)
        century = F.when(F.length(year) > 2, 0).when(_number(year) >= PIVOT_YEAR, 1900).otherwise(2000)
        half, hour = F.lower(f[7]), _number(f[3])
        clock = F.when(half == "", hour).when(hour.between(1, 12), hour % 12 + F.when(half == "p", 12).otherwise(0))
        # a year leads in one place only, and an hour that is there must be one
        sound = ~(leads & (F.length(c) > 2)) & ((f[3] == "") | clock.isNotNull())
        return F.struct(
            F.when(sound, _number(year) + century).alias("year"), month_of(month).alias("month"), _number(day).alias("day"),
            F.coalesce(clock, F.lit(0)).alias("hour"), F.coalesce(_number(f[4]), F.lit(0)).alias("minute"),
            F.coalesce(_number(f[5]), F.lit(0)).alias("second"),
            F.rpad(F.substring(f[6], 1, 6), 6, "0").cast("long").alias("micros"),
        )


def _as_time(n: Column) -> Column:
    # second 60 would be the next minute
    at = F.try_make_timestamp_ntz(*[n[c] for c in ("year", "month", "day", "hour", "minute")], F.when(n["second"] < 60, n["second"]))
    return F.timestamp_micros(F.unix_micros(at.cast("timestamp")) + n["micros"]).cast("timestamp_ntz")


def shapes_of(df: DataFrame, *columns: str) -> TimeShapes:
    """The order that reads most dates of these text columns, decided on all their texts."""
    texts = [named(c).cast("string") for c in columns if isinstance(df.schema[c].dataType, T.StringType)]
    if not texts:
        return TimeShapes()

    def small(f: Column) -> Column:
        number = f[0] < "A"
        short, leads = number & (F.length(f[0]) < 3), number & (F.length(f[0]) == 4)
        return F.struct(
            (short & (_number(f[1]) <= 12)).alias("day_first"), (short & (_number(f[0]) <= 12)).alias("month_first"),
            (leads & (_number(f[1]) <= 12)).alias("year_month"), (leads & (_number(f[2]) <= 12)).alias("year_day"),
        )

    # a text is cut once for all four
    cut = df.select(F.inline(F.array(*[let(_fields(t), small) for t in texts])))
    found = cut.agg(*[F.count_if(F.coalesce(named(c), F.lit(False))).alias(c) for c in cut.columns]).first()
    return TimeShapes(found["month_first"] > found["day_first"], found["year_day"] > found["year_month"])


def time_by_shapes(df: DataFrame, column: str, shapes: TimeShapes) -> Column:
    """A column as time: temporal ones are cast, all others are read as text."""
    if isinstance(df.schema[column].dataType, TEMPORAL_TYPES):
        return named(column).cast("timestamp_ntz")
    return shapes.parse(named(column).cast("string"))
