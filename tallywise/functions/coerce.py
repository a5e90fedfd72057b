"""Numeric, date and text coercion as column expressions."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TEMPORAL = (T.DateType, T.TimestampType, T.TimestampNTZType)

# Fixed values: (shape of the text, Java date pattern).  The ISO shape is read
# by a cast, which also takes a time of day.  The shape test comes first, so
# that a value meets at most one parser.
ISO_SHAPE = r"^\s*\d{4}-\d{1,2}-\d{1,2}([ T]\d{1,2}:\d{2}(:\d{2}(\.\d+)?)?)?\s*$"
DATE_SHAPES = (
    (r"^\d{4}/\d{1,2}/\d{1,2}$", "yyyy/M/d"),
    (r"^\d{1,2} [A-Za-z]{3} \d{4}$", "d MMM yyyy"),
    (r"^\d{1,2}-[A-Za-z]{3}-\d{4}$", "d-MMM-yyyy"),
    (r"^[A-Za-z]{3} \d{1,2}, \d{4}$", "MMM d, yyyy"),
    (r"^\d{8}$", "yyyyMMdd"),
    (r"^\d{4}\.\d{1,2}\.\d{1,2}$", "yyyy.M.d"),
    (r"^[A-Za-z]{4,9} \d{1,2}, \d{4}$", "MMMM d, yyyy"),
    (r"^\d{1,2} [A-Za-z]{4,9} \d{4}$", "d MMMM yyyy"),
    (r"^[A-Za-z]{3} \d{4}$", "MMM yyyy"),
    (r"^[A-Za-z]{4,9} \d{4}$", "MMMM yyyy"),
    (r"^\d{4}-\d{1,2}$", "yyyy-M"),
)
# Dates that tell day and month apart by their place only; a column is read in one of the
# two ways throughout.
PLACED_SHAPE = r"^\d{1,2}([/.-])\d{1,2}\1(?:\d{4}|\d{2})\z"
_MONTH, _DAY = r"(0?[1-9]|1[0-2])", r"(0?[1-9]|[12]\d|3[01])"
# The shape, and the same day in ISO order.
MONTH_FIRST = (rf"^{_MONTH}([/.-]){_DAY}\2(\d{{4}}|\d{{2}})\z", "$4-$1-$3")
DAY_FIRST = (rf"^{_DAY}([/.-]){_MONTH}\2(\d{{4}}|\d{{2}})\z", "$4-$3-$1")
# The same date forms may be followed by a time of day.
TIME_SHAPE = r"^(.*\d) (\d{1,2}:\d{2}(?::\d{2}(?:\.\d+)?)?)(?: ?([AaPp])[Mm])?$"
# ISO with an offset, which is turned to UTC.
ZONED_SHAPE = r"^\s*\d{4}-\d{1,2}-\d{1,2}[ T]\d{1,2}:\d{2}(:\d{2}(\.\d+)?)?\s?(Z|[+-]\d{2}:?\d{2})\s*$"


def is_numeric(dtype: T.DataType) -> bool:
    return isinstance(dtype, T.NumericType)


def is_temporal(dtype: T.DataType) -> bool:
    return isinstance(dtype, TEMPORAL)


def is_text(dtype: T.DataType) -> bool:
    return isinstance(dtype, T.StringType)


def name_of(column: str) -> Column:
    """A column reference that takes any name, dots included."""
    return F.col("`" + column.replace("`", "``") + "`")


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once per row and hand it to ``body``.

    A column used twice in an expression is computed twice; an array of one
    element binds it.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def word_list(words: Iterable[str]) -> Column:
    """A constant array of texts, made by one expression."""
    return F.split(F.lit("|".join(words)), r"\|")


# Fixed value: how a number is written.  Java's "1d" and "2.5f" are not numbers.
NUMBER_SHAPE = r"(?i)^\s*[+-]?(?:(?:\d+\.?\d*|\.\d+)(?:e[+-]?\d+)?|inf(?:inity)?)\s*$"


def text_to_number(value: Column) -> Column:
    """Text to double; anything that is not a number becomes null."""
    return F.when(value.rlike(NUMBER_SHAPE), value.try_cast("double"))


def number(df: DataFrame, column: str) -> Column:
    """A measure as double, null where it is missing, NaN or not a number.

    Integers are widened too: a long total over a very large table overflows,
    which ANSI mode reports as an error.
    """
    dtype, value = df.schema[column].dataType, name_of(column)
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        value = value.cast("double")
        return F.when(~F.isnan(value), value)
    if is_numeric(dtype) or isinstance(dtype, T.BooleanType):
        return value.cast("double")
    if is_text(dtype):
        return text_to_number(value)
    return F.lit(None).cast("double")


def digits_to_long(text: Column) -> Column:
    """Text of up to 18 digits as a long, else null.

    The shape test keeps ordinary text from the cast, which reports a failure
    by an exception even where it only leads to null.
    """
    return F.when(text.rlike(r"^\d{1,18}$"), text.cast("bigint"))


def _timed(trimmed: Column) -> Column:
    """Whether a time of day stands behind the day; most texts have no colon and skip the pattern."""
    return trimmed.contains(":") & trimmed.rlike(TIME_SHAPE)


def _day_text(trimmed: Column) -> Column:
    """The text of the day, without a time of day behind it."""
    return F.when(_timed(trimmed), F.regexp_extract(trimmed, TIME_SHAPE, 1)).otherwise(trimmed)


def _placed_day(text: Column, order: tuple[str, str]) -> Column:
    """The date of a text of the placed shape, null if there is no such day.

    Half of the texts of a column are no dates in one of the two orders; the shape rules out
    nearly all of those, since a parser reports each by an exception.
    """
    shape, iso = order
    turned = F.regexp_replace(text, shape, iso)
    short_year = ~F.substring(text, -3, 1).between("0", "9")
    dated = F.concat(F.when(short_year, "20").otherwise(""), turned)
    return F.when(text.rlike(shape), dated.try_cast("date"))


def date_readings(value: Column) -> Column:
    """Whether a text is a date when read in either order: a struct (month_first, day_first) of flags.

    Only dates told apart by place alone are read twice.
    """
    trimmed = F.trim(value)

    def both(month_first: Column, day_first: Column) -> Column:
        return F.struct(month_first.alias("month_first"), day_first.alias("day_first"))

    placed = both(_placed_day(trimmed, MONTH_FIRST).isNotNull(), _placed_day(trimmed, DAY_FIRST).isNotNull())
    month_first = text_to_timestamp(value).isNotNull()
    # The time of day may be none.
    timed = F.when(
        _day_text(trimmed).rlike(PLACED_SHAPE), both(month_first, text_to_timestamp(value, True).isNotNull())
    ).otherwise(let(month_first, lambda found: both(found, found)))
    return F.when(trimmed.rlike(PLACED_SHAPE), placed).otherwise(timed)


def text_to_timestamp(value: Column, day_first: bool = False) -> Column:
    """Text to a zone-free timestamp by a fixed list of formats, null if none fits.

    ``day_first`` is how dates like 3/4/2024 are read; ``cleaning.date_orders`` finds it out
    for a whole column.
    """
    order = DAY_FIRST if day_first else MONTH_FIRST
    trimmed = F.trim(value)
    timed = _timed(trimmed)
    day_text = _day_text(trimmed)
    clock = F.regexp_extract(trimmed, TIME_SHAPE, 2)
    half = F.lower(F.regexp_extract(trimmed, TIME_SHAPE, 3))
    hour = F.substring_index(clock, ":", 1).try_cast("int")
    of_day = (hour % 12 + F.when(half == "p", 12).otherwise(0)).cast("string")
    later = F.concat(F.lpad(of_day, 2, "0"), F.regexp_extract(clock, r"^\d+(:.*)$", 1))
    clock = F.when(half == "", clock).when(hour.between(1, 12), later)

    def parsed(text: Column) -> Column:
        day = F.when(text["day"].rlike(PLACED_SHAPE), _placed_day(text["day"], order))
        # All shapes end in a digit.
        day = day.when(~F.substring(text["day"], -1, 1).between("0", "9"), F.lit(None))
        for shape, pattern in DATE_SHAPES:
            day = day.when(text["day"].rlike(shape), F.try_to_date(text["day"], pattern))
        return F.struct(day.alias("day"), text["timed"].alias("timed"), text["time"].alias("time"))

    def joined(found: Column) -> Column:
        # Dates know no time zone; the time of day is put back by an ISO cast.
        text = F.concat_ws(" ", found["day"].cast("string"), F.when(found["day"].isNotNull(), found["time"]))
        return F.when(found["timed"], text.try_cast("timestamp_ntz")).otherwise(found["day"].cast("timestamp_ntz"))

    texts = F.struct(day_text.alias("day"), timed.alias("timed"), F.when(timed, clock).alias("time"))
    other = let(let(texts, parsed), joined)
    # An instant is shown in the session's zone; the text's own offset has been taken off by then.
    zoned = value.contains(":") & value.rlike(ZONED_SHAPE)
    instant = F.when(zoned, trimmed).try_cast("timestamp").cast("timestamp_ntz")
    in_utc = F.convert_timezone(F.current_timezone(), F.lit("UTC"), instant)
    return (
        F.when(value.rlike(ISO_SHAPE), trimmed.try_cast("timestamp_ntz"))
        .when(trimmed.rlike(PLACED_SHAPE), _placed_day(trimmed, order).cast("timestamp_ntz"))
        .when(zoned, in_utc)
        .otherwise(other)
    )


def moment(df: DataFrame, column: str) -> Column:
    """A column as a zone-free timestamp; numbers are never taken for epochs."""
    dtype = df.schema[column].dataType
    if is_temporal(dtype):
        return name_of(column).cast("timestamp_ntz")
    if is_text(dtype):
        return text_to_timestamp(name_of(column))
    return F.lit(None).cast("timestamp_ntz")


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN in float columns becomes null; other columns pass unchanged."""
    floats = {
        f.name
        for f in df.schema.fields
        if isinstance(f.dataType, (T.DoubleType, T.FloatType))
    }
    if not floats:
        return df
    return df.select(
        *[
            F.when(~F.isnan(name_of(c)), name_of(c)).alias(c) if c in floats else name_of(c)
            for c in df.columns
        ]
    )


def json_row(df: DataFrame, columns: list[str] | None = None) -> Column:
    """One row as JSON text: nulls kept, NaN as null, timestamps in ISO form."""
    fields = []
    for name in columns or df.columns:
        dtype, value = df.schema[name].dataType, name_of(name)
        if isinstance(dtype, (T.DoubleType, T.FloatType)):
            value = F.when(~F.isnan(value), value)
        elif isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
            value = F.date_format(value, "yyyy-MM-dd'T'HH:mm:ss")
        fields.append(value.alias(name))
    return F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})
