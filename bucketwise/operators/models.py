"""Chronological split and the two empirical models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from bucketwise import constants as C
from bucketwise.functions.classify import is_yes, settlement_degree
from bucketwise.functions.text import celsius_to_fahrenheit, group
from bucketwise.functions.times import month_of
from bucketwise.operators import intervals as I
from bucketwise.operators.keyed import first_per_key
from bucketwise.operators.lanes import last_before, running_total
from bucketwise.sources.scratch import materialize, settle

# first-seen order of snapshot rows inside one date or event; one token may stand in several events of a day, so what is
# taken from the first row follows it wherever the order must be total
ROW_ORDER = ("token_id", "event_date", "condition_id")


# ---- split -----------------------------------------------------------------------------

def split_dates(
    df: DataFrame,
    date_col: str = "event_date",
    train: float = C.TRAIN_FRACTION,
    validation: float = C.VALIDATION_FRACTION,
    test: float = C.TEST_FRACTION,
) -> DataFrame:
    """(event_date, split) over unique sorted dates.

    The numbering runs over distinct calendar days only, a set bounded by the calendar itself.
    """
    if min(train, validation, test) < 0 or abs(train + validation + test - 1.0) > 1e-12:
        raise ValueError("split fractions must be non-negative and sum to 1")
    dates = df.select(F.col(date_col).alias("event_date")).filter("event_date IS NOT NULL").distinct()
    totals = dates.agg(F.count(F.lit(1)).alias("n"))
    n = F.col("n")
    n_train = F.floor(n * F.lit(train)).cast("bigint")
    n_val = F.floor(n * F.lit(validation)).cast("bigint")
    n_val = F.when(
        n_train + n_val >= n, F.greatest(F.lit(0).cast("bigint"), n - n_train - 1)
    ).otherwise(n_val)
    w = Window.orderBy("event_date")
    return (
        dates.withColumn("_rn", F.row_number().over(w))
        .join(F.broadcast(totals))  # one row
        .select(
            "event_date",
            F.when(F.col("_rn") <= n_train, "train")
            .when(F.col("_rn") <= n_train + n_val, "validation")
            .otherwise("test")
            .alias("split"),
        )
    )


def with_split(df: DataFrame, dates: DataFrame) -> DataFrame:
    return df.join(dates, "event_date")


# ---- features ----------------------------------------------------------------------------

def feature_rows(df: DataFrame) -> DataFrame:
    """Decision-time features only; labels and diagnostics never appear here."""
    return df.select(
        "token_id", "station_icao", "city", "event_date", "forecast_daily_max_c", "dew_point_c",
        "humidity_pct", "cloud_cover_pct", "wind_speed", "observation_max_so_far_c",
        "forecast_lead_hours", month_of(F.col("event_date")).alias("month"),
    )


def _known(col: Column) -> Column:
    return F.when(col != "", col)


# ---- frequency model -----------------------------------------------------------------------

def fit_frequency(train: DataFrame) -> DataFrame:
    """(level, station, month, city, label, n): winner counts at four grains.

    One winning label counts once per (date, station). City is a plain attribute of the first row.
    First-seen follows ``ROW_ORDER``, then the city.
    """
    label = F.coalesce("bucket_label", F.lit(""))
    wins = first_per_key(
        train.filter(is_yes(F.col("settlement_label"))).withColumn("_label", label),
        ["event_date", "station_icao", "_label"],
        [*ROW_ORDER, "city"],
    ).select(
        _known(F.col("station_icao")).alias("station"),
        month_of(F.col("event_date")).alias("month"),
        _known(F.col("city")).alias("city"),
        F.col("_label").alias("label"),
    )
    # pre-aggregate at the finest grain, then all four grains in one pass over the small table
    fine = wins.groupBy("station", "month", "city", "label").agg(F.count(F.lit(1)).alias("n"))
    sets = [["station", "month", "label"], ["station", "label"], ["city", "label"], ["label"]]
    rolled = fine.groupingSets([[F.col(c) for c in s] for s in sets], "station", "month", "city", "label").agg(
        F.grouping_id().alias("_set"), F.sum("n").alias("n")
    )
    level = F.col("_set")
    station, month, city = F.col("station").isNotNull(), F.col("month").isNotNull(), F.col("city").isNotNull()
    # a bit of the set's number is 1 for a column that was rolled up
    named = (
        F.when((level == 0b0010) & station & month, "station_month").when((level == 0b0110) & station, "station")
        .when((level == 0b1100) & city, "city").when(level == 0b1110, "global")
    )
    return rolled.select(named.alias("level"), "station", "month", "city", "label", "n").where("level is not null")


def _grain(level: Column, station: Column, month: Column, city: Column) -> Column:
    empty = F.lit("")
    return F.concat_ws(
        "\u0001", level, F.coalesce(station, empty), F.coalesce(month.cast("string"), empty), F.coalesce(city, empty)
    )


def frequency_grain(events: DataFrame, fit: DataFrame) -> DataFrame:
    """(event_key, _grain): the first grain with any counts, station-month, station, city, global.

    An event's candidate grains meet the fitted ones in one join; the global grain needs none.
    """
    none = F.lit(None).cast("string")
    station, month, city = F.col("station"), F.col("month"), F.col("city")
    candidates = F.array(
        F.struct(F.lit(0).alias("no"), F.when(station.isNotNull() & month.isNotNull(), _grain(F.lit("station_month"), station, month, none)).alias("grain")),
        F.struct(F.lit(1).alias("no"), F.when(station.isNotNull(), _grain(F.lit("station"), station, none, none)).alias("grain")),
        F.struct(F.lit(2).alias("no"), F.when(city.isNotNull(), _grain(F.lit("city"), none, none, city)).alias("grain")),
    )
    fitted = fit.select(_grain(F.col("level"), station, month, city).alias("grain")).distinct()
    found = (
        events.select("event_key", F.inline(candidates)).where("grain is not null").join(fitted, "grain")
        .groupBy("event_key").agg(F.min_by("grain", "no").alias("_found"))
    )
    rest = _grain(F.lit("global"), none, none, none)
    return events.select("event_key").join(found, "event_key", "left").select(
        "event_key", F.coalesce("_found", rest).alias("_grain")
    )


def _event_heads(rows: DataFrame) -> DataFrame:
    """Attributes of each event's lowest token, by map-side combined aggregation."""
    head = F.struct(
        F.col("station_icao").alias("station"), "city", "event_date", "forecast_daily_max_c"
    )
    return rows.groupBy("event_key").agg(F.min_by(head, F.struct(*ROW_ORDER, head)).alias("_h")).select(
        "event_key", "_h.*"
    )


def normalize_weights(rows: DataFrame, keys: list[str], weight: str) -> DataFrame:
    """Weights to probabilities per group; a group without weight becomes uniform.

    Totals are aggregated and joined back, so a huge group never sits in one window.
    """
    totals = rows.groupBy(*keys).agg(
        F.sum(weight).alias("_total"), F.count(F.lit(1)).alias("_n")
    )
    return (
        rows.join(totals, keys)
        .withColumn(
            "probability",
            F.when(F.col("_total") > 0, F.col(weight) / F.col("_total")).otherwise(
                F.lit(1.0) / F.col("_n")
            ),
        )
        .drop("_total", "_n")
    )


def predict_frequency(rows: DataFrame, fit: DataFrame) -> DataFrame:
    """(event_key, token_id, label, probability) from the frequency model.

    ``rows`` need event_key and snapshot columns.
    """
    heads = _event_heads(rows).select(
        "event_key",
        _known(F.col("station")).alias("station"),
        month_of(F.col("event_date")).alias("month"),
        _known(F.col("city")).alias("city"),
    )
    # many events share a grain: attach one grain key, then one equi-join on (grain, label)
    used = frequency_grain(heads, fit)
    counts = fit.select(
        _grain(F.col("level"), F.col("station"), F.col("month"), F.col("city")).alias("_grain"), "label", "n"
    )
    labelled = rows.select(
        "event_key", *ROW_ORDER, F.coalesce("bucket_label", F.lit("")).alias("label")
    ).join(used, "event_key")
    weighted = labelled.join(counts, ["_grain", "label"], "left").withColumn(
        # an unnamed bucket has no history of its own
        "weight", F.when(F.col("label") != "", F.coalesce(F.col("n"), F.lit(0))).otherwise(0).cast("double")
    )
    return last_per_token(normalize_weights(weighted, ["event_key"], "weight"), rows)


def last_per_token(rows: DataFrame, source: DataFrame) -> DataFrame:
    """One prediction per (event, token): a repeated token keeps its last row.

    An unnamed bucket is called ``bucket-i`` by its place in token order; only the events that hold
    one are ranked, by narrow rows.
    """
    blank = source.filter("bucket_label IS NULL OR bucket_label = ''").select("event_key").distinct()
    place = Window.partitionBy("event_key").orderBy(*ROW_ORDER)
    label = F.coalesce("bucket_label", F.lit(""))
    places = (
        source.select("event_key", *ROW_ORDER, label.alias("label")).join(blank, "event_key", "left_semi")
        .select("event_key", *ROW_ORDER, "label", (F.row_number().over(place) - 1).alias("_i"))
        .filter("label = ''")
        .select("event_key", *ROW_ORDER, F.concat(F.lit("bucket-"), F.col("_i")).alias("_name"))
    )
    named = rows.join(places, ["event_key", *ROW_ORDER], "left").withColumn(
        "label", F.coalesce("_name", "label")
    )
    last = [F.col(c).desc() for c in (*ROW_ORDER, "label", "probability")]
    return first_per_key(named, ["event_key", "token_id"], last).select(
        "event_key", "token_id", "label", "probability"
    )


# ---- forecast-error model ----------------------------------------------------------------------

def fit_errors(train: DataFrame) -> DataFrame:
    """(station, error, n): histogram of actual minus forecast; null station is the global row.

    A date and station count once, by their first row in ``ROW_ORDER``, then by forecast and actual value.
    """
    seen = first_per_key(
        train.filter("forecast_daily_max_c IS NOT NULL AND diagnostic_actual_max_c IS NOT NULL"),
        ["event_date", "station_icao"],
        [*ROW_ORDER, "forecast_daily_max_c", "diagnostic_actual_max_c"],
    )
    cells = (
        seen.select(
            _known(F.col("station_icao")).alias("station"),
            (F.col("diagnostic_actual_max_c") - F.col("forecast_daily_max_c")).alias("error"),
        )
        .groupBy("station", "error")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    world = cells.groupBy("error").agg(F.sum("n").alias("n")).select(
        F.lit(None).cast("string").alias("station"), "error", "n"
    )
    return cells.filter("station IS NOT NULL").unionByName(world)


def family_unit() -> Column:
    """Aggregate: the single declared unit of an event, else the single unit its labels show."""
    declared = F.when(F.col("temperature_unit") != "", F.col("temperature_unit"))
    word = F.coalesce(
        group(F.col("bucket_label"), C.LABEL_UNIT, 1), group(F.col("bucket_label"), C.LABEL_UNIT, 2)
    )
    shown = F.upper(F.substring(word, 1, 1))
    one_declared = F.min(declared) == F.max(declared)
    one_shown = F.min(shown) == F.max(shown)
    return F.when(one_declared, F.min(declared)).when(one_shown, F.min(shown))


def native_bounds() -> tuple[Column, Column]:
    """Native bounds, read from the label only when both columns are empty."""
    low, high = F.col("temperature_native_min"), F.col("temperature_native_max")
    given = low.isNotNull() | high.isNotNull()
    label, kind = F.col("bucket_label"), F.col("bucket_kind")
    span_low = group(label, C.LABEL_RANGE, 1).cast("double")
    span_high = group(label, C.LABEL_RANGE, 2).cast("double")
    number = group(label, C.LABEL_NUMBER, 1).cast("double")
    is_span = span_low.isNotNull()
    below = F.coalesce(kind == "below", F.lit(False))
    above = F.coalesce(kind == "above", F.lit(False))
    lo = F.when(given, low).when(is_span, span_low).when(~below, number)
    hi = F.when(given, high).when(is_span, span_high).when(~above, number)
    return lo, hi


def ladder_rungs(rows: DataFrame) -> DataFrame:
    """(event_key, unit, priority, token_id, kind, lo, hi): what can win in an event.

    Rows with the same kind and bounds are shadowed by the first token, so they collapse before
    anything is gathered; bounds are native for Fahrenheit events and Celsius otherwise.
    """
    units = rows.groupBy("event_key").agg(
        F.when(family_unit() == "F", "F").otherwise("C").alias("unit")
    )
    nat_lo, nat_hi = native_bounds()
    kind = F.col("bucket_kind")
    is_f = F.col("unit") == "F"
    lo = F.when(is_f, nat_lo).otherwise(F.col("temperature_celsius_min"))
    hi = F.when(is_f, nat_hi).otherwise(F.col("temperature_celsius_max"))
    priority = (
        F.when(kind == "exact", 0)
        .when((kind == "range") | kind.isNull(), 1)
        .when(kind == "below", 2)
        .when(kind == "above", 3)
    )
    bounded = (
        rows.join(units, "event_key")
        .select("event_key", "unit", *ROW_ORDER, priority.alias("priority"),
                lo.alias("lo"), hi.alias("hi"))
        .filter(
            ((F.col("priority") == 0) & F.col("lo").isNotNull())
            | ((F.col("priority") == 1) & F.col("lo").isNotNull() & F.col("hi").isNotNull())
            | ((F.col("priority") == 2) & F.col("hi").isNotNull())
            | ((F.col("priority") == 3) & F.col("lo").isNotNull())
        )
    )
    return bounded.groupBy("event_key", "unit", "priority", "lo", "hi").agg(
        F.min(F.struct(*ROW_ORDER)).alias("_first")
    ).select("event_key", "unit", "priority", "lo", "hi", "_first.*")


def settled_value(unit: Column, value: Column) -> Column:
    """What a Celsius value settles as: whole Fahrenheit degrees, or the value as it is."""
    degree = settlement_degree(celsius_to_fahrenheit(value)).cast("double")
    return F.when(unit == "F", degree).otherwise(value)


def _half_degree(at: Column, side: int) -> tuple[Column, Column]:
    """(bound, open) of the doubles whose difference from ``at``, as rounded, is under a half on one side.

    Next to a half doubles lie 2^-54 apart, and a tie between two of them rounds to the half. So the difference reaches it
    up to 2^-55 before ``at + 0.5`` where doubles are fine enough to show it.
    """
    half = at + side * 0.5
    outside = lambda x: F.abs(x - at) >= 0.5
    tries = [half - side * 2.0**-54, half - side * 2.0**-55, half]
    bound = F.when(outside(tries[0]), tries[0]).when(outside(tries[1]), tries[1]).otherwise(half)
    return bound, outside(tries[0]) | outside(tries[1]) | outside(half)


def rung_spans(rungs: DataFrame) -> DataFrame:
    """(event_key, start, start_open, end, end_open, rung): the settled values that a rung accepts, as an interval.

    ``rung`` sorts as winners do: exact before range before below before above, first token inside a kind.
    """
    lo, hi, priority, is_f = F.col("lo"), F.col("hi"), F.col("priority"), F.col("unit") == "F"
    degree = settlement_degree(lo).cast("double")
    exact = priority == 0
    low, low_open = _half_degree(lo, -1)
    high, high_open = _half_degree(lo, 1)
    start = F.when(exact, F.when(is_f, degree).otherwise(low)).when(priority.isin(1, 3), lo)
    end = F.when(exact, F.when(is_f, degree).otherwise(high)).when(priority.isin(1, 2), hi)
    near = exact & ~is_f
    return rungs.select(
        "event_key", start.alias("start"), (near & low_open).alias("start_open"), end.alias("end"), (near & high_open).alias("end_open"),
        F.struct("priority", *ROW_ORDER).alias("rung"),
    ).where("not (isnan(coalesce(start, 0D)) or isnan(coalesce(end, 0D)) or coalesce(start > end, false))")


def match_values(values: DataFrame, rungs: DataFrame) -> DataFrame:
    """Adds the winning ``token_id`` to (event_key, value, ...) rows; null when none fits.

    Winner: exact before range before below before above, first token inside a kind. An event's rungs are cut into
    disjoint segments, in which settled values are looked up in order; events with very many rungs or values are spread.
    """
    rungs = materialize(rungs, "rungs")
    spans = rung_spans(rungs)
    numbered = materialize(I.bounds(spans, ["event_key"]), "numbered")
    units = rungs.groupBy("event_key").agg(F.first("unit").alias("unit"))
    settled = materialize(values.join(units, "event_key", "left").withColumn("_settled", settled_value(F.col("unit"), F.col("value"))), "settled")
    where = materialize(I.segment_of(settled.where("unit is not null"), numbered, ["event_key"], "_settled"), "where")
    tree = materialize(I.nodes(spans, numbered, ["event_key"], "rung"), "tree")
    hits = (
        where.join(I.winners(where.select("event_key", "segment").distinct(), tree, ["event_key"]), ["event_key", "segment"])
        .select("event_key", "_settled", F.col("winner").alias("_hit"))
    )
    return (
        settled.join(hits, ["event_key", "_settled"], "left")
        .withColumns({c: F.col(f"_hit.{c}") for c in ROW_ORDER})
        .select(*values.columns, *ROW_ORDER)
    )


def _below(unit: Column, implied: Column, bound: Column, behind: Column) -> Column:
    """Does the implied value settle before the bound (or before what lies behind it)?"""
    settled = settled_value(unit, implied)
    return (settled < bound) | (behind & (settled == bound))


def errors_below(asked: DataFrame, errors: DataFrame) -> DataFrame:
    """Adds ``below`` to (source, forecast, unit, bound, behind): how many errors move the forecast below the bound.

    A prefix sum of the source's histogram gives all errors that are clearly below. The rounding of forecast + error
    and of whole degrees can only matter next to the bound: those few errors, found by an equality of thousandths, are
    tested as they are. No error is compared with a bound otherwise.
    """
    edge = F.when(
        F.col("unit") == "F",
        (F.when(F.col("behind"), F.floor("bound") + 0.5).otherwise(F.ceil("bound") - 0.5) - 32.0) * 5.0 / 9.0,
    ).otherwise(F.col("bound"))
    slack = F.lit(1e-6) + (F.abs("bound") + F.abs("forecast")) * 1e-12
    asked = materialize(asked.withColumn("_edge", edge - F.col("forecast")).withColumn("error", F.col("_edge") - slack).withColumn("_top", F.col("_edge") + slack), "asked")
    sums = running_total(materialize(errors, "errors"), ["source"], "error", F.col("n"), "_upto")
    upto = last_before(asked, sums.select("source", "error", "_upto"), ["source"], "error", "_upto")
    cell = lambda x: F.floor(F.col(x) * 1000).cast("long")
    key = ["source", "forecast", "unit", "bound", "behind"]
    near = (
        asked.select(*key, F.col("error").alias("_from"), "_top", F.explode(F.sequence(cell("error"), cell("_top"))).alias("_cell"))
        .join(errors.withColumn("_cell", cell("error")), ["source", "_cell"])
        .where("error > _from and error <= _top")
        .where(_below(F.col("unit"), F.col("forecast") + F.col("error"), F.col("bound"), F.col("behind")))
        .groupBy(*key).agg(F.sum("n").alias("_near"))
    )
    return (
        asked.join(upto, ["source", "error"], "left").join(near, key, "left")
        .select(*key, (F.coalesce("_upto", F.lit(0)) + F.coalesce("_near", F.lit(0))).alias("below"))
    )


def predict_errors(rows: DataFrame, fit: DataFrame) -> DataFrame:
    """(event_key, token_id, label, probability) from the forecast-error model.

    Every training error moves the event's forecast to an implied value; the share of implied values settling in a
    bucket is its probability. Stations without history use all errors. An event's ladder is cut into disjoint segments;
    a segment's weight is the difference of two prefix sums of the error histogram, each looked up once for all events
    that ask for the same source, forecast and bound.
    """
    weights = settle(rows.sparkSession, lambda: error_weights(rows, fit), "weights")
    labelled = rows.select(
        "event_key", *ROW_ORDER, F.coalesce("bucket_label", F.lit("")).alias("label")
    )
    weighted = labelled.join(weights, ["event_key", *ROW_ORDER], "left").withColumn(
        "weight", F.coalesce(F.col("weight"), F.lit(0)).cast("double")
    )
    return last_per_token(normalize_weights(weighted, ["event_key"], "weight"), rows)


def error_weights(rows: DataFrame, fit: DataFrame) -> DataFrame:
    """(event_key, token and its order, weight): how many implied values of the event settle in the bucket of each first token."""
    heads = _event_heads(rows).select("event_key", _known(F.col("station")).alias("station"), "forecast_daily_max_c")
    with_history = fit.filter("station IS NOT NULL").select("station").distinct()
    world = F.lit("\u0001all")
    source = heads.join(with_history.withColumn("_own", F.lit(True)), "station", "left").select(
        "event_key", F.when(F.col("_own"), F.col("station")).otherwise(world).alias("source"),
        F.col("forecast_daily_max_c").alias("forecast"),
    ).filter("forecast IS NOT NULL AND abs(forecast) < double('inf')")
    errors = fit.select(F.coalesce("station", world).alias("source"), "error", "n").where("abs(error) < double('inf')")
    totals = errors.groupBy("source").agg(F.sum("n").alias("total"))

    rungs = materialize(ladder_rungs(rows), "rungs")
    spans = rung_spans(rungs)
    numbered = materialize(I.bounds(spans, ["event_key"]), "numbered")
    tree = materialize(I.nodes(spans, numbered, ["event_key"], "rung"), "tree")
    units = rungs.groupBy("event_key").agg(F.first("unit").alias("unit"))
    cases = materialize(source.join(units, "event_key").join(totals, "source", "left"), "cases")
    # the border in front of segment 2 k + 1 is the bound, that in front of 2 k + 2 lies behind it
    borders = materialize(
        numbered.join(cases, "event_key").withColumn("behind", F.explode(F.array(F.lit(False), F.lit(True))))
        .withColumn("segment", 2 * F.col("k") + 1 + F.col("behind").cast("int")),
        "borders",
    )
    case = ["source", "forecast", "unit", "bound", "behind"]
    below = borders.join(errors_below(borders.select(*case).distinct(), errors), case).select("event_key", "segment", "below")
    below = materialize(below, "below")
    segments = borders.select("event_key", "segment").unionByName(cases.select("event_key", F.lit(0).cast("long").alias("segment")))
    return (
        I.winners(segments, tree, ["event_key"])
        .join(below, ["event_key", "segment"], "left").withColumnRenamed("below", "_low").withColumn("segment", F.col("segment") + 1)
        .join(below, ["event_key", "segment"], "left").join(cases.select("event_key", "total"), "event_key")
        .groupBy("event_key", "winner")
        .agg(F.sum(F.coalesce("below", "total", F.lit(0)) - F.coalesce("_low", F.lit(0))).alias("weight"))
        .select("event_key", *[f"winner.{c}" for c in ROW_ORDER], "weight")
    )
