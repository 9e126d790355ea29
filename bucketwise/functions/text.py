"""Text extraction: bucket labels, cities, stations, families and settlement labels."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from bucketwise import constants as C


def filled(col: Column) -> Column:
    """The text, null when it is empty. Inside a branch ``nullif`` would compute ``col`` twice."""
    return F.get(F.array_remove(F.array(col), ""), F.lit(0))


def blank_to_null(col: Column) -> Column:
    return filled(F.trim(col.cast("string")))


def group(col: Column, pattern: str, index: int) -> Column:
    """Regex group, null when the pattern or the group did not match."""
    return filled(F.regexp_extract(col, pattern, index))


def fahrenheit_to_celsius(v: Column) -> Column:
    return (v - F.lit(32.0)) * F.lit(5.0) / F.lit(9.0)


def celsius_to_fahrenheit(v: Column) -> Column:
    return v * F.lit(9.0) / F.lit(5.0) + F.lit(32.0)


def json_list(text: Column) -> Column:
    """JSON array (or JSON-encoded array string) as strings; anything else is an empty list."""
    return F.coalesce(F.from_json(text, "array<string>"), F.array().cast("array<string>"))


def temperature_bucket(label: Column) -> Column:
    """Label text to struct(kind, min_c, max_c, unit, native_min, native_max), null if no bucket."""
    text = F.trim(label)
    kinds = (
        ("range", C.BUCKET_RANGE, 3),
        ("below", C.BUCKET_BELOW, 2),
        ("above", C.BUCKET_ABOVE, 2),
        ("exact", C.BUCKET_EXACT, 2),
    )
    bare = text.rlike(C.BARE_NUMBER) | text.rlike(C.BARE_RANGE)

    def parsed(kind: str, pattern: str, unit_group: int) -> Column:
        word = F.upper(F.substring(F.regexp_extract(text, pattern, unit_group), 1, 1))
        unit = F.when(word != "", word).when(bare, F.lit("C"))
        first = F.regexp_extract(text, pattern, 1).try_cast("double")
        second = (
            F.regexp_extract(text, pattern, 2).try_cast("double") if kind == "range" else first
        )
        none = F.lit(None).cast("double")
        low = none if kind == "below" else F.least(first, second)
        high = none if kind == "above" else F.greatest(first, second)

        def celsius(v: Column) -> Column:
            return F.when(unit == "F", fahrenheit_to_celsius(v)).otherwise(v)

        body = F.struct(
            F.lit(kind).alias("kind"),
            celsius(low).alias("min_c"),
            celsius(high).alias("max_c"),
            unit.alias("unit"),
            low.alias("native_min"),
            high.alias("native_max"),
        )
        return F.when(unit.isNotNull(), body)

    result = None
    for kind, pattern, unit_group in kinds:
        hit = text.rlike(pattern)
        value = parsed(kind, pattern, unit_group)
        result = F.when(hit, value) if result is None else result.when(hit, value)
    return result


def topic_blob(question: Column, slug: Column) -> Column:
    return F.lower(F.concat_ws(" ", F.coalesce(question, F.lit("")), F.coalesce(slug, F.lit(""))))


def is_topic_text(question: Column, slug: Column) -> Column:
    return is_topic_blob(topic_blob(question, slug))


def is_topic_blob(blob: Column) -> Column:
    """``blob`` is read up to seven times: pass a column of its own for many rows."""
    any_city = F.lit(False)
    for city in C.TARGET_CITIES:
        any_city = any_city | blob.contains(city)
    return blob.contains("temperature") & any_city


def city_of(question: Column, slug: Column, description: Column) -> Column:
    """Word-bounded city, longest name first."""
    blob = F.replace(F.concat_ws(" ", question, slug, description), F.lit("-"), F.lit(" "))
    found = None
    for city in sorted(C.TARGET_CITIES, key=lambda c: (-len(c), c)):
        hit = blob.rlike(rf"(?i)\b{city}\b")
        found = F.when(hit, city) if found is None else found.when(hit, city)
    return found


def station_of(description: Column) -> Column:
    """struct(code, note): URL path segment first, else exactly one parenthesised code."""
    by_path = group(description, C.STATION_IN_PATH, 1)
    codes = F.array_distinct(
        F.regexp_extract_all(F.upper(description), F.lit(C.STATION_IN_PARENTHESES), F.lit(1))
    )
    code = F.when(by_path.isNotNull(), F.upper(by_path)).when(F.size(codes) == 1, codes[0])
    note = F.when(by_path.isNull() & (F.size(codes) > 1), F.lit(C.NOTE_MANY_STATIONS))
    return F.struct(code.alias("code"), note.alias("note"))


def parse_status(city: Column, event_date: Column, question: Column) -> Column:
    on_topic = F.lower(question).contains("temperature")
    return (
        F.when(city.isNotNull() & event_date.isNotNull() & on_topic, "resolved")
        .when(city.isNotNull() | event_date.isNotNull() | on_topic, "partial")
        .otherwise("unresolved")
    )


def normalize_text(col: Column) -> Column:
    return blank_to_null(F.lower(col))


def normalize_station(col: Column) -> Column:
    return filled(F.regexp_extract(F.upper(F.trim(col)), C.STATION_CODE, 0))


def _without_bucket(text: Column) -> Column:
    """Lower-case text without :data:`SLUG_BUCKET_SUFFIX`; common endings are told apart before any pattern runs."""
    out = None
    for word in C.SLUG_BUCKET_WORDS:
        cut = F.left(text, F.length(text) - len(word))
        out = F.when(text.endswith(word), cut) if out is None else out.when(text.endswith(word), cut)
    degrees = F.regexp_extract(text, C.SLUG_DEGREES, 1)
    return out.when(text.endswith("c") | text.endswith("f"), degrees).otherwise(
        F.regexp_replace(text, C.SLUG_BUCKET_SUFFIX, "")
    )


def slug_family(slug: Column) -> Column:
    """Shared part of a slug family. Patterns run only on texts that hold what they look for."""
    def step(x: Column) -> Column:
        # lambdas name a value that several branches read, so it is made once
        head = F.when(x.startswith("will-the-"), F.substring(x, 10, 1 << 30)).otherwise(x)
        return F.when(x.contains("-be-"), F.regexp_replace(head, r"-be-[^-]+(?=-on-)", "")).otherwise(head)

    cut = F.transform(F.transform(F.array(F.lower(F.trim(slug))), _without_bucket), step)
    return F.get(F.array_remove(cut, ""), F.lit(0))


def question_family(question: Column) -> Column:
    """Shared phrase of a question family, without the bucket part ("be ... on" becomes "on")."""
    cleaned = F.regexp_replace(question, r"(?i)\bbe\s+[^?]+\s+on\s+", "on ")
    phrase = F.coalesce(
        group(cleaned, C.QUESTION_FAMILY, 1), group(question, C.QUESTION_FAMILY, 1)
    )
    def tidy(x: Column) -> Column:
        blanks = x.contains("  ")
        for sign in "\t\n\x0b\f\r":
            blanks = blanks | x.contains(sign)
        return F.trim(F.when(blanks, F.regexp_replace(x, r"\s+", " ")).otherwise(x))

    tidied = F.get(F.array_remove(F.transform(F.array(F.lower(F.trim(phrase))), tidy), ""), F.lit(0))
    # most texts without the topic word never reach the patterns
    topical = question.contains("temperature") | F.lower(question).contains("temperature")
    return F.when(topical, tidied)


def resolution_url(urls: Column) -> Column:
    first = F.get(
        F.filter(urls, lambda u: F.lower(u).contains(C.RESOLUTION_HOST)), F.lit(0)
    )
    bare = F.transform(
        F.array(first),
        lambda u: F.when(u.endswith("."), F.rtrim(u, F.lit("."))).otherwise(F.regexp_replace(u, r"\.+$", "")),
    )
    return F.lower(F.get(bare, F.lit(0)))


def resolution_station(urls: Column) -> Column:
    """Station code of the first URL whose path names one."""
    named = F.filter(urls, lambda u: F.lower(u).contains(C.RESOLUTION_PATH))
    paths = F.transform(
        named, lambda u: F.regexp_extract(u, r"^(?:[A-Za-z][\w+.-]*:)?(?://[^/?#]*)?([^?#]*)", 1)
    )
    hits = F.filter(
        F.transform(paths, lambda p: F.regexp_extract(p, C.RESOLUTION_STATION, 1)),
        lambda c: c != "",
    )
    return normalize_station(F.get(hits, F.lit(0)))


def normalize_unit(unit: Column) -> Column:
    """C, F or K; null when the unit is not a temperature unit."""
    text = F.upper(F.regexp_replace(F.trim(unit), "[° ]", ""))
    table = F.create_map(*[F.lit(x) for pair in C.UNIT_ALIASES.items() for x in pair])
    return F.try_element_at(table, text)


def to_celsius(value: Column, unit: Column) -> Column:
    code = normalize_unit(unit)
    return (
        F.when(code == "C", value)
        .when(code == "F", fahrenheit_to_celsius(value))
        .when(code == "K", value - F.lit(273.15))
    )


def is_temperature_variable(name: Column) -> Column:
    return F.lower(name).rlike("temperature|dew_?point")


def settlement_label(
    closed: Column, resolved: Column, outcomes: Column, outcome_prices: Column
) -> Column:
    """struct(label, reason): winner of an unambiguous 1/0 settlement, else why there is none."""
    labels = json_list(outcomes)
    raw = json_list(outcome_prices)
    numbers = F.transform(raw, lambda p: F.trim(p).try_cast("double"))
    bad = F.exists(numbers, lambda p: p.isNull())
    prices = F.when(bad, F.array().cast("array<double>")).otherwise(numbers)
    ones = F.size(F.filter(prices, lambda p: F.abs(p - 1.0) <= 1e-9))
    zeros = F.size(F.filter(prices, lambda p: F.abs(p) <= 1e-9))
    winner = F.transform(prices, lambda p: F.abs(p - 1.0) <= 1e-9)
    reason = (
        F.when(
            ~(F.coalesce(closed, F.lit(False)) | F.coalesce(resolved, F.lit(False))),
            C.NOT_SETTLED,
        )
        .when((F.size(labels) < 2) | (F.size(prices) < 2), C.SETTLEMENT_SHORT)
        .when(F.size(labels) != F.size(prices), C.SETTLEMENT_LENGTH)
        .when((ones != 1) | (zeros != F.size(prices) - 1), C.SETTLEMENT_AMBIGUOUS)
    )
    index = (F.array_position(winner, F.lit(True)) - 1).cast("int")
    label = F.when(reason.isNull(), F.get(labels, index))
    return F.struct(label.alias("label"), reason.alias("reason"))
