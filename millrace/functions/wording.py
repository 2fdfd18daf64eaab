"""Rules over question and answer texts, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions import fixed_values as fixed
from millrace.functions.text import let

# Unicode classes for \s, \d and \b, and "." that stops at a line feed only.
_FLAGS = "(?Ud)"
_LEADING = " \n\t*#"


def found(text: Column, pattern: str) -> Column:
    return text.rlike(_FLAGS + pattern)


def requested_operation(question: Column) -> Column:
    """``acquisition_status`` for a plain question about current tasks, else null."""
    asks = (
        found(question, fixed.TASK_SUBJECT)
        & ~found(question, fixed.TASK_EXCLUDED)
        & found(question, fixed.TASK_NOW)
        & found(question, fixed.TASK_MEASURE)
    )
    return F.when(asks, F.lit("acquisition_status"))


def written_number(token: Column) -> Column:
    """Digits or Chinese numerals below a thousand as a number; null when ill-formed."""
    plain = F.translate(token, fixed.CHINESE_DIGITS, fixed.CHINESE_DIGIT_VALUES)

    def digit(pattern: str) -> Column:
        return F.coalesce(F.regexp_extract(plain, pattern, 1).try_cast("int"), F.lit(0))

    tens = F.when(F.contains(plain, F.lit("十")), F.greatest(digit("([1-9])十"), F.lit(1))).otherwise(0)
    numeral = digit("([1-9])百") * 100 + tens * 10 + digit("([1-9])$")
    well_formed = plain.rlike("^(?:[1-9]|[1-9]?十[1-9]?|[1-9]百(?:[1-9]?十)?[1-9]?)$")
    return (
        F.when(token == fixed.HALF, F.lit(0.5))
        .when(token.rlike("^[0-9]"), token.try_cast("double"))
        .when(well_formed, numeral.cast("double"))
    )


def trend_window(question: Column) -> Column:
    """The time window a trend question asks for.

    ``struct(recognised, hours, blocked)``: whole hours from 1 to 24, sorted; ``blocked``
    when any window is outside that, or when buckets are asked for.
    """
    pattern = F.lit(_FLAGS + fixed.WINDOW_PATTERN)
    factors = F.create_map(*[F.lit(x) for pair in fixed.UNIT_HOURS.items() for x in map(_unit, pair)])

    def window(token: Column, unit: Column) -> Column:
        hours = written_number(token) * F.try_element_at(factors, unit)
        fits = (hours == F.floor(hours)) & hours.between(1, 24)
        return F.when(F.coalesce(fits, F.lit(False)), hours.cast("int")).otherwise(F.lit(-1))

    grouped = found(question, fixed.GROUPING_PATTERN)

    def shape(windows: Column) -> Column:
        return F.struct(
            (found(question, fixed.TREND_PATTERN) & ((F.size(windows) > 0) | grouped)).alias("recognised"),
            F.sort_array(F.array_distinct(F.filter(windows, lambda h: h > 0))).alias("hours"),
            (grouped | F.exists(windows, lambda h: h < 0)).alias("blocked"),
        )

    windows = F.zip_with(
        F.regexp_extract_all(question, pattern, F.lit(1)),
        F.regexp_extract_all(question, pattern, F.lit(2)),
        window,
    )
    return let(windows, shape)


def _unit(value: object) -> object:
    return float(value) if isinstance(value, (int, float)) else value


def permits(window: Column, requested_hours: Column) -> Column:
    """Whether a trend over ``requested_hours`` answers what was asked."""
    allowed = ~window["blocked"] & (
        (F.size(window["hours"]) == 0) | F.array_contains(window["hours"], requested_hours)
    )
    return F.when(window["recognised"], allowed).otherwise(F.lit(True))


def conditional_conclusion(status: Column, answer: Column) -> Column:
    """A leading yes that the next words make depend on something unresolved."""
    return (status == "answered") & found(F.ltrim(answer, F.lit(_LEADING)), fixed.CONDITIONAL_PATTERN)


def settled_status(status: Column, answer: Column) -> Column:
    """An explicit refusal counts as no answer."""
    refuses = found(F.ltrim(answer, F.lit(_LEADING)), fixed.REFUSAL_PATTERN)
    return F.when((status == "answered") & refuses, F.lit("no_answer")).otherwise(status)


def unsupported_identifiers(answer: Column, sources: Column) -> Column:
    """Versioned identifiers of the answer that the sources do not contain."""
    named = F.regexp_extract_all(answer, F.lit(_FLAGS + fixed.VERSIONED_IDENTIFIER), F.lit(0))
    return F.filter(named, lambda name: ~F.contains(sources, name))


def grounding_problem(answer: Column, sources: Column, cited: Column) -> Column:
    """The first unsupported claim of an answer, null when none is found.

    ``sources`` is the question with all cited texts, ``cited`` the cited texts alone.
    """
    optional = (
        found(answer, fixed.OPTIONAL_QUALITY)
        & found(answer, fixed.WARNING_COUNT)
        & F.coalesce(F.contains(cited, F.lit("quality_code")), F.lit(False))
    )
    claims = F.exists(
        F.split(answer, fixed.CLAUSE_BREAK),
        lambda clause: ~found(clause, fixed.HEDGED_CLAUSE) & found(clause, fixed.PROVENANCE_CLAIM),
    )
    return (
        F.when(F.size(unsupported_identifiers(answer, sources)) > 0, "unsupported_versioned_identifier")
        .when(optional, "quality_mapping_required_for_warning_count")
        .when(claims, "unsupported_database_provenance_claim")
    )
