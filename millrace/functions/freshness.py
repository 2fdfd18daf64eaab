"""Age, staleness and display expressions for readings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions import fixed_values as fixed


def seconds_between(later: Column, earlier: Column) -> Column:
    """Signed difference in seconds with its microseconds."""
    return (F.unix_micros(later) - F.unix_micros(earlier)) / F.lit(1_000_000.0)


def stale_after_seconds(interval_ms: Column) -> Column:
    return F.greatest(
        F.lit(float(fixed.STALE_FLOOR_SECONDS)), interval_ms * fixed.STALE_INTERVALS / F.lit(1000.0)
    )


def is_stale(age: Column, interval_ms: Column) -> Column:
    return age > stale_after_seconds(interval_ms)


def is_future(age: Column) -> Column:
    return age < -fixed.FUTURE_TOLERANCE_SECONDS


def age_text(age: Column) -> Column:
    """Age in seconds as display text."""
    seconds = F.greatest(F.lit(0.0), age)
    days = F.floor(seconds / 86400)
    hours = F.floor(F.pmod(seconds, F.lit(86400.0)) / 3600)
    # Tenths are cut from a decimal, so that the text needs no locale and no float printing.
    tenths = F.round(seconds, 1).cast("decimal(20,1)").cast("string")
    return (
        F.when(age.isNull() | F.isnan(age) | (F.abs(age) == float("inf")), F.lit("时间无效"))
        .when(is_future(age), F.lit("时间超前，请检查时钟"))
        .when(seconds < 60, F.concat(tenths, F.lit(" 秒")))
        .when(
            seconds < 3600, F.concat(F.floor(seconds / 60).cast("string"), F.lit(" 分钟"))
        )
        .when(
            seconds < 86400, F.concat(F.floor(seconds / 3600).cast("string"), F.lit(" 小时"))
        )
        .otherwise(
            F.concat(days.cast("string"), F.lit(" 天 "), hours.cast("string"), F.lit(" 小时"))
        )
    )


def local_time_text(col: Column, zone: str = fixed.DEFAULT_ZONE) -> Column:
    """An instant as local ISO text with its offset; null reads as "none yet"."""
    shown = F.date_format(F.from_utc_timestamp(F.to_utc_timestamp(col, F.current_timezone()), zone),
                          "yyyy-MM-dd'T'HH:mm:ss")
    minutes = F.round(
        seconds_between(F.from_utc_timestamp(col, zone), F.from_utc_timestamp(col, "UTC")) / 60
    ).cast("int")
    size = F.abs(minutes)
    offset = F.concat(
        F.when(minutes < 0, F.lit("-")).otherwise(F.lit("+")),
        F.lpad(F.floor(size / 60).cast("string"), 2, "0"),
        F.lit(":"),
        F.lpad((size % 60).cast("string"), 2, "0"),
    )
    return F.when(col.isNull(), F.lit("暂无")).otherwise(F.concat(shown, offset))


def stored_time_text(col: Column, zone: str = fixed.DEFAULT_ZONE) -> Column:
    """Stored time text as local time; text without an offset is kept and flagged."""
    from millrace.functions.parsing import parse_timestamp

    has_offset = col.rlike(r"(Z|[+-]\d{2}(:?\d{2})?)$") & col.rlike(r"\d[^0-9]\d{2}")
    return (
        F.when(col.isNull() | (col == ""), F.lit("暂无"))
        .when(has_offset, local_time_text(parse_timestamp(col), zone))
        .otherwise(F.concat(col, F.lit("（时区未知）")))
    )


def phase_label(elapsed: Column) -> Column:
    base, disturbed, recovered = fixed.PHASE_WORDS
    return (
        F.when(elapsed < 60, F.lit(base)).when(elapsed < 120, F.lit(disturbed)).otherwise(
            F.lit(recovered)
        )
    )


def cautions(
    enabled: Column, has_sample: Column, is_good: Column, status: Column,
    stale: Column, future: Column, source: Column,
) -> Column:
    """Warnings attached to one latest reading, in display order, joined by ``；``."""
    notes = F.array(
        F.when(~enabled, F.lit("测点已禁用")),
        F.when(~has_sample, F.lit("指定来源没有样本，无法提供当前值")),
        F.when(has_sample & ~is_good, F.concat(F.lit("质量码异常（"), status, F.lit("）"))),
        F.when(has_sample & stale, F.lit("数据已过期")),
        F.when(has_sample & future, F.lit("采样时间超前，请核对时钟")),
        F.when(has_sample & (source == "file"), F.lit("来源为历史文件导入，不是实时采集")),
    )
    return F.array_join(F.array_compact(notes), "；")
