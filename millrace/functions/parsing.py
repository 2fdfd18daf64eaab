"""Parse text cells into typed measurements, all in Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions import fixed_values as fixed
from millrace.functions.text import clean, fold, is_missing, json_text, let

# The date and the time are each all-extended or all-compact: groups 2 and 6 remember the
# separator and are matched again. The kept groups are year, month, day, hour, minute,
# second, fraction and offset.
_TIME_PATTERN = (
    r"^(\d{4})(-?)(\d{2})\2(\d{2})"
    r"(?:[^0-9]([01]\d|2[0-3])(?:(:?)([0-5]\d)(?:\6([0-5]\d)(?:[.,](\d+))?)?)?"
    r"(Z|[+-](?:[01]\d|2[0-3])(?::?[0-5]\d)?)?)?$"
)
# The usual spelling, which Spark's own cast reads the same way.
_PLAIN_TIME = (
    r"^(?!0000)\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(?:\.\d{1,6})?(?:Z|[+-](?:0\d|1[0-7]):[0-5]\d)?$"
)
_MARK = "\u0001"
_GROUPS = _MARK.join(f"${n}" for n in (1, 3, 4, 5, 7, 8, 9, 10))


def plain_timestamp(text: Column, zone: str = fixed.DEFAULT_ZONE) -> Column:
    """Trimmed text in the usual spelling as an instant, null for any other text.

    Costs one pattern without groups and one cast, and covers nearly all rows.
    """
    has_zone = F.endswith(text, F.lit("Z")) | F.substring(text, -6, 1).isin("+", "-")
    instant = F.when(has_zone, text.try_cast("timestamp")).otherwise(
        F.to_utc_timestamp(F.concat(text, F.lit("Z")).try_cast("timestamp"), zone)
    )
    return F.when(text.rlike(_PLAIN_TIME), instant)


def timestamp_parts(text: Column) -> Column:
    """Split ISO 8601 text into its eight groups; any other text gives another size.

    The text is rebuilt rather than cast as it stands: Spark's cast accepts bare years
    and times, and refuses compact dates.
    """
    return F.when(
        ~F.contains(text, F.lit(_MARK)),
        F.split(F.regexp_replace(text, _TIME_PATTERN, _GROUPS), _MARK),
    )


def timestamp_from_parts(parts: Column, zone: str = fixed.DEFAULT_ZONE) -> Column:
    """The instant for :func:`timestamp_parts`; without an offset it is read in ``zone``."""

    def part(index: int, default: str = "00") -> Column:
        value = F.get(parts, F.lit(index))
        return F.when(value == "", F.lit(default)).otherwise(value)

    offset = F.get(parts, F.lit(7))
    stamp = F.concat(
        part(0), F.lit("-"), part(1), F.lit("-"), part(2), F.lit(" "),
        part(3), F.lit(":"), part(4), F.lit(":"), part(5), F.lit("."),
        F.substring(part(6), 1, 6), F.lit("Z"),
    ).try_cast("timestamp")
    hours = F.coalesce(F.substring(offset, 2, 2).try_cast("int"), F.lit(0))
    minutes = F.when(F.length(offset) > 3, F.right(offset, F.lit(2)).try_cast("int")).otherwise(0)
    sign = F.when(F.startswith(offset, F.lit("-")), F.lit(60)).otherwise(F.lit(-60))
    instant = F.when(offset == "", F.to_utc_timestamp(stamp, zone)).otherwise(
        F.timestamp_add("SECOND", sign * (hours * 60 + minutes), stamp)
    )
    return F.when((F.size(parts) == 8) & (part(0) != "0000"), instant)


def parse_timestamp(col: Column, zone: str = fixed.DEFAULT_ZONE) -> Column:
    """ISO 8601 text to an instant, null when invalid; all steps in one expression."""
    return let(
        clean(col),
        lambda text: F.coalesce(
            plain_timestamp(text, zone),
            let(timestamp_parts(text), lambda parts: timestamp_from_parts(parts, zone)),
        ),
    )


def finite_number(text: Column) -> Column:
    """Trimmed text as a finite double; underscores may separate digits."""
    plain = F.when(text.rlike(fixed.NUMBER_PATTERN), F.replace(text, F.lit("_"), F.lit("")))
    number = plain.try_cast("double")
    return F.when(F.abs(number) < float("inf"), number)


def truth_value(folded: Column) -> Column:
    return F.when(folded.isin(*fixed.TRUE_WORDS), F.lit(True)).when(
        folded.isin(*fixed.FALSE_WORDS), F.lit(False)
    )


def typed_number(data_type: Column, truth: Column, number: Column) -> Column:
    """The numeric value of a cell for its tag's type, null when it does not fit."""
    return (
        F.when(data_type == "string", F.lit(None).cast("double"))
        .when(data_type == "boolean", truth.cast("double"))
        .when(data_type == "integer", F.when(number == F.rint(number), number + 0.0))
        .otherwise(number)
    )


def typed_json(data_type: Column, text: Column, numeric: Column) -> Column:
    """The cell as JSON text for its tag's type, from :func:`typed_number`."""
    # Digits of an integral double; beyond a long, decimal keeps them up to 38 places.
    digits = F.coalesce(
        numeric.try_cast("bigint").cast("string"),
        numeric.try_cast("decimal(38,0)").cast("string"),
        numeric.cast("string"),
    )
    return (
        F.when(data_type == "string", json_text(text))
        .when(data_type == "boolean", (numeric == 1).cast("string"))
        .when(data_type == "integer", digits)
        .otherwise(numeric.cast("string"))
    )


def parse_value(col: Column, data_type: Column) -> Column:
    """Cell to ``struct(ok, value, numeric_value)`` by the tag's type, in one expression.

    A plan that also needs the parts should compute them as columns of their own, as the
    import does.
    """
    def typed(text: Column) -> Column:
        number = typed_number(data_type, truth_value(fold(text)), finite_number(text))
        return let(
            number,
            lambda n: F.struct(
                ((data_type == "string") | n.isNotNull()).alias("ok"),
                typed_json(data_type, text, n).alias("value"),
                n.alias("numeric_value"),
            ),
        )

    return let(clean(col), typed)


def quality_status(col: Column) -> Column:
    """The status text of a quality cell; a missing cell is good."""
    status = F.substring(clean(col), 1, fixed.STATUS_TEXT_LIMIT)
    return F.when(is_missing(col), F.lit(fixed.DEFAULT_STATUS)).otherwise(status)


def is_good_status(status: Column) -> Column:
    return fold(status).isin(*fixed.GOOD_QUALITY_WORDS)


def outside_range(numeric: Column, low: Column, high: Column) -> Column:
    """True when a number lies outside its optional inclusive bounds."""
    below = F.coalesce(numeric < low, F.lit(False))
    above = F.coalesce(numeric > high, F.lit(False))
    return below | above


def live_value(col: Column) -> Column:
    """A JSON notification value to ``struct(value, numeric_value)``.

    Scalars and lists keep their JSON; anything else becomes JSON text of itself.
    Only booleans and numbers have a numeric form.
    """
    text = clean(col)
    truth = F.when(text == "true", F.lit(1.0)).when(text == "false", F.lit(0.0))
    number = F.when(text.rlike(r"^-?\d+(\.\d+)?([eE][+-]?\d+)?$"), text.try_cast("double"))
    keeps = text.startswith('"') | text.startswith("[") | truth.isNotNull() | number.isNotNull()
    return F.struct(
        F.when(text.isNull() | (text == "null"), F.lit(None).cast("string"))
        .when(keeps, text)
        .otherwise(json_text(text))
        .alias("value"),
        F.coalesce(truth, number).alias("numeric_value"),
    )


def utc_or(col: Column, fallback: Column) -> Column:
    return F.coalesce(col, fallback)
