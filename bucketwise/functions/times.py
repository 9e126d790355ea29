"""Instants, local calendars and daylight-saving rules (session time zone must be UTC)."""

from __future__ import annotations

from zoneinfo import available_timezones

from pyspark.sql import Column, functions as F

from bucketwise import constants as C
from bucketwise.functions.text import group

# names in the local zone database that are no zones of the JVM
NOT_ZONES = ("Factory", "ROC", "localtime")
DAY_MINUTES = 24 * 60


def iso_utc(ts: Column) -> Column:
    """ISO text with offset, microseconds only when present."""
    base = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    micros = F.when(F.unix_micros(ts) % 1_000_000 != 0, F.concat(F.lit("."), F.date_format(ts, "SSSSSS"))).otherwise("")
    return F.concat(base, micros, F.lit("+00:00"))


ZONED_STAMP = r"^(\d{4}-\d{2}-\d{2})[T ](\d{2}:\d{2})(:\d{2}(?:\.\d+)?)?\s*(Z|[+-]\d{2}(?::?\d{2}(?::\d{2})?)?)$"


def _zoned_instant(value: Column) -> Column:
    """Zoned ISO text, brought to seconds and an offset with a colon before it is parsed."""
    part = lambda i: F.regexp_extract(value, ZONED_STAMP, i)
    seconds = F.when(part(3) == "", ":00").otherwise(part(3))
    offset = F.when(part(4) == "Z", "+00:00").otherwise(
        F.regexp_replace(F.regexp_replace(part(4), r"^([+-]\d{2})$", "$1:00"), r"^([+-]\d{2})(\d{2})$", "$1:$2")
    )
    return F.try_to_timestamp(F.concat(part(1), F.lit("T"), part(2), seconds, offset))


def parse_instant(text: Column) -> Column:
    """Epoch (seconds, or milliseconds from 1e11 up), zoned ISO text or a bare date; else null.

    Zoned text may leave out the seconds and may write its offset as ``Z``, ``+hh``, ``+hhmm`` or ``+hh:mm``.
    """
    value = F.trim(text)
    number = value.try_cast("double")
    finite = number.isNotNull() & ~F.isnan(number) & (F.abs(number) < 1e15)
    seconds = F.when(F.abs(number) >= 1e11, number / 1000.0).otherwise(number)
    dated = value.rlike(C.ISO_DATE)
    return (
        F.when(finite, F.timestamp_micros(F.round(seconds * 1e6).cast("bigint")))
        .when(number.isNull() & value.rlike(ZONED_STAMP), _zoned_instant(value))
        .when(number.isNull() & dated, value.try_cast("date").cast("timestamp"))
    )


def is_known_zone(zone: Column) -> Column:
    """Membership in the IANA zone list, a fixed set of about 600 names."""
    return F.coalesce(zone.isin(sorted(available_timezones() - set(NOT_ZONES))), F.lit(False))


def checked_zone(zone: Column) -> Column:
    """The zone if it is known, else null. Compute it once per row; the functions below take its result."""
    return F.when(is_known_zone(zone), zone)


def minutes_later(ts: Column, minutes: Column) -> Column:
    return F.timestamp_micros(F.unix_micros(ts) + minutes.cast("bigint") * F.lit(60_000_000))


def _readings(wall: Column, zone: Column) -> tuple[Column, Column, Column]:
    """(first reading, second reading, has two) of a wall time in a checked zone.

    The readings of a repeated wall time lie as far apart as the zone's offset falls between a day before and a day
    after it: an hour mostly, but also half an hour or two.
    """
    first = F.to_utc_timestamp(wall, zone)
    offset = lambda at: F.unix_micros(F.from_utc_timestamp(at, zone)) - F.unix_micros(at)
    day = F.lit(DAY_MINUTES)
    step = offset(minutes_later(first, -day)) - offset(minutes_later(first, day))
    second = F.timestamp_micros(F.unix_micros(first) + step)
    return first, second, (step > 0) & (F.from_utc_timestamp(second, zone) == wall)


def local_to_utc(wall: Column, zone: Column, offset_seconds: Column, occurrence: Column) -> Column:
    """Wall time to UTC for the n-th (0-based) occurrence of that wall time in its series.

    Null for a wall time inside a spring gap and for repeats the calendar does not have. ``zone`` is checked; where it
    is null, the fixed offset holds.
    """
    first, second, twice = _readings(wall, zone)
    by_zone = (
        F.when(F.from_utc_timestamp(first, zone) != wall, F.lit(None).cast("timestamp"))
        .when(occurrence == 0, first)
        .when(twice & (occurrence == 1), second)
    )
    by_offset = F.timestamp_micros(
        F.unix_micros(wall) - offset_seconds.cast("bigint") * F.lit(1_000_000)
    )
    return F.when(zone.isNotNull(), by_zone).otherwise(by_offset)


def local_kind(wall: Column, zone: Column) -> Column:
    first, _, twice = _readings(wall, zone)
    return (
        F.when(zone.isNull(), "fixed")
        .when(F.from_utc_timestamp(first, zone) != wall, "gap")
        .when(twice, "ambiguous")
        .otherwise("unambiguous")
    )


def occurrences(walls: Column) -> Column:
    """Array of (wall, nth): for every text its earlier repeats in the array, counted to two; in order.

    Two sorts and a zip, so a long series costs little more than its length.
    """
    placed = F.array_sort(F.transform(walls, lambda w, i: F.struct(w.alias("wall"), i.alias("at"))))
    names = F.transform(placed, lambda x: x["wall"])
    none = F.lit(None).cast("string")
    n = F.size(walls)
    # null walls drop out later, whatever their count
    near = F.arrays_zip(
        placed.alias("x"), F.slice(F.concat(F.array(none), names), F.lit(1), n).alias("one"),
        F.slice(F.concat(F.array(none, none), names), F.lit(1), n).alias("two"),
    )
    counted = F.transform(
        near,
        lambda z: F.struct(
            z["x"]["at"].alias("at"), z["x"]["wall"].alias("wall"),
            F.when(z["x"]["wall"] == z["two"], 2).when(z["x"]["wall"] == z["one"], 1).otherwise(0).alias("nth"),
        ),
    )
    return F.array_sort(counted)


def decision_instant(event_date: Column, zone: Column, lead_hours: Column) -> Column:
    """Local midnight minus the lead on the wall clock, then UTC."""
    midnight = event_date.cast("timestamp")
    wall = F.timestamp_micros(
        F.unix_micros(midnight) - F.round(lead_hours * 3.6e9).cast("bigint")
    )
    return F.to_utc_timestamp(wall, zone)


def local_date(ts: Column, zone: Column) -> Column:
    return F.date_format(F.from_utc_timestamp(ts, zone), "yyyy-MM-dd")


LOCAL_STAMP_FORMATS = (
    "yyyy-MM-dd'T'HH:mm", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm", "yyyy-MM-dd",
)


def local_stamp(text: Column) -> Column:
    """Naive local stamp in one of the accepted layouts as a wall-clock timestamp."""
    value = F.trim(text)
    return F.coalesce(*[F.try_to_timestamp(value, F.lit(f)) for f in LOCAL_STAMP_FORMATS])


def local_date_token(text: Column) -> Column:
    prefix = F.substring(F.trim(text), 1, 10)
    fallback = F.when(prefix.rlike(C.ISO_DATE), prefix.try_cast("date").cast("timestamp"))
    return F.date_format(F.coalesce(local_stamp(text), fallback), "yyyy-MM-dd")


def valid_iso_date(text: Column) -> Column:
    return F.when(text.rlike(C.ISO_DATE), F.date_format(text.try_cast("date"), "yyyy-MM-dd"))


def month_number(name: Column) -> Column:
    pairs = {m: i + 1 for i, m in enumerate(C.MONTHS)} | C.MONTH_ABBREVIATIONS
    table = F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair])
    return F.try_element_at(table, F.lower(F.trim(name)))


def month_name(number: Column) -> Column:
    return F.get(F.array(*[F.lit(m) for m in C.MONTHS]), number.cast("int") - 1)


def calendar_date(year: Column, month: Column, day: Column) -> Column:
    """ISO text of a real calendar date, null otherwise."""
    text = F.concat_ws(
        "-",
        F.lpad(year.cast("string"), 4, "0"),
        F.lpad(month.cast("string"), 2, "0"),
        F.lpad(day.cast("string"), 2, "0"),
    )
    whole = year.isNotNull() & month.isNotNull() & day.isNotNull()
    return F.when(whole, F.date_format(text.try_cast("date"), "yyyy-MM-dd"))


def event_month(event_date: Column) -> Column:
    return F.substring(event_date, 1, 7)


def month_of(event_date: Column) -> Column:
    return F.when(F.length(event_date) >= 7, F.substring(event_date, 6, 2).try_cast("int"))


def season(event_date: Column) -> Column:
    m = F.substring(event_date, 6, 2).try_cast("int")
    return (
        F.when(m.isin(12, 1, 2), "winter")
        .when(m.isin(3, 4, 5), "spring")
        .when(m.isin(6, 7, 8), "summer")
        .otherwise("autumn")
    )


def available_at(issued: Column) -> Column:
    return F.timestamp_seconds(F.unix_seconds(issued) + C.AVAILABILITY_LAG_HOURS * 3600)


def day_start_epoch(value: Column) -> Column:
    return F.unix_seconds(value.try_cast("date").cast("timestamp"))


def day_end_epoch(value: Column) -> Column:
    return day_start_epoch(value) + F.lit(86399)


def _floor_run(seconds: Column) -> Column:
    step = C.RUN_STEP_HOURS * 3600
    return F.floor(seconds / F.lit(step)) * F.lit(step)


def forecast_run(decision: Column, event_end: Column) -> Column:
    """Newest public run at the decision that covers the event's local day, as issue time."""
    step = C.RUN_STEP_HOURS * 3600
    snapped = _floor_run(F.unix_seconds(decision))
    end = F.unix_seconds(event_end)
    issued = F.least(snapped - C.AVAILABILITY_LAG_HOURS * 3600, _floor_run(end))
    reachable = issued >= snapped - (C.RUN_STEPS_BACK - 1) * step
    covers = end <= issued + C.RUN_HORIZON_HOURS * 3600
    return F.when(reachable & covers, F.timestamp_seconds(issued))


def date_parts(text: Column, pattern: str) -> Column:
    """struct(year, month, day) of a month-name date, fields null where absent."""
    return F.struct(
        group(text, pattern, 3).cast("int").alias("year"),
        month_number(group(text, pattern, 1)).alias("month"),
        group(text, pattern, 2).cast("int").alias("day"),
    )
