"""Event groups: identity, coherence, bucket-ladder topology, acceptance and quarantine."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from bucketwise import constants as C
from bucketwise.functions import text as X
from bucketwise.functions.classify import is_yes
from bucketwise.functions.identity import dedup_key, key_text, with_identity
from bucketwise.functions.times import month_name, month_number
from bucketwise.operators.keyed import with_row_id
from bucketwise.operators.lanes import LANE_ROWS
from bucketwise.sources.scratch import materialize, settle

TEMPERATURE_KINDS = ("exact", "range", "above", "below")
RUNG_BUCKET_DEGREES = 64
# events are counted by this many hashes
EVENT_PARTS = 4096


def with_event_key(df: DataFrame, stored_key: str | None = None) -> DataFrame:
    """Adds ``event_key`` and ``identity``; a stored canonical key takes precedence for grouping."""
    out = with_identity(df)
    key = key_text(F.col("identity.canonical_event_key"))
    if stored_key is not None:
        key = F.coalesce(
            F.when(F.size(stored_key) > 0, key_text(F.col(stored_key))), key
        )
    return out.withColumn("event_key", key)


def _differs(name: str) -> Column:
    return F.coalesce(F.col(f"{name}_min") != F.col(f"{name}_max"), F.lit(False))


def _span(name: str, value: Column) -> list[Column]:
    """Two values exist in a group exactly when its minimum and maximum differ."""
    return [F.min(value).alias(f"{name}_min"), F.max(value).alias(f"{name}_max")]


def _month_day(month: Column, day: Column) -> Column:
    """The named day; null where the pattern of the two groups did not match."""
    name = F.coalesce(month_name(month_number(month)), F.lower(month))
    return F.when(month.isNotNull(), F.concat_ws("-", name, day.cast("int").cast("string")))


def child_evidence(df: DataFrame) -> DataFrame:
    """Adds what the child texts of a row say about city, date, station and topic."""
    question, slug = F.col("question"), F.col("slug")
    both = F.concat(
        F.coalesce(question, F.lit("")), F.lit("\n"), F.coalesce(slug, F.lit(""))
    )

    def found(pattern: str, index: int) -> Column:
        return F.regexp_extract_all(both, F.lit(pattern), F.lit(index))

    # of the cities only one has a blank inside
    cities = F.transform(
        found(C.CITY_IN_TEXT, 1), lambda c: F.when(F.lower(c).startswith("new"), F.lit("new york")).otherwise(F.lower(c))
    )
    stations = F.transform(found(C.RESOLUTION_STATION, 1), F.upper)
    # what is read several times is a column first, so it is made once
    staged = df.withColumns(
        {
            "_blob": X.topic_blob(question, slug),
            "_slug_month": X.group(slug, C.DATE_IN_SLUG, 1), "_slug_day": X.group(slug, C.DATE_IN_SLUG, 2),
            "_question_month": X.group(question, C.DATE_IN_QUESTION, 1),
            "_question_day": X.group(question, C.DATE_IN_QUESTION, 2),
        }
    )
    no_stations = F.array().cast("array<string>")
    return staged.withColumns(
        {
            "text_cities": cities,
            "text_stations": F.when(F.col("_blob").contains(C.RESOLUTION_PATH), stations).otherwise(no_stations),
            "slug_day": _month_day(F.col("_slug_month"), F.col("_slug_day")),
            "question_day": _month_day(F.col("_question_month"), F.col("_question_day")),
            "off_topic": (question.isNotNull() | slug.isNotNull()) & ~X.is_topic_blob(F.col("_blob")),
        }
    ).drop("_blob", "_slug_month", "_slug_day", "_question_month", "_question_day")


# what the verdict on a group reads
VERDICT_COLUMNS = (
    "event_key", "identity", "token_id", "question", "slug", "event_id", "event_slug", "city", "station_icao", "event_date",
    "temperature_unit", "temperature_native_min", "temperature_native_max", "bucket_label", "bucket_kind", "settlement_label",
    "neg_risk_market_id", "source_station_icao", "provenance_urls",
)


def group_facts(rows: DataFrame) -> DataFrame:
    """One row per event_key with everything the coherence checks need.

    Only constant-size, map-side combinable aggregates are used, so group size does not matter:
    a group holds two different values exactly when its minimum and maximum differ. The texts are
    shuffled once, a row per group and task: rows that lie together by event send little more than
    one row per event.
    """
    date, unit_kind = F.col("event_date"), F.lower(F.trim(F.coalesce("bucket_kind", F.lit(""))))
    own_day = F.concat_ws(
        "-",
        month_name(F.substring(date, 6, 2).try_cast("int")),
        F.substring(date, 9, 2).try_cast("int").cast("string"),
    )
    single = {
        "event_id": X.normalize_text(F.col("event_id")),
        "city": X.normalize_text(F.col("city")),
        "station": X.normalize_station(F.col("station_icao")),
        "date": F.nullif(date, F.lit("")),
        "unit": X.normalize_text(F.col("temperature_unit")),
        "res_station": X.normalize_station(F.col("source_station_icao")),
        "res_url": X.resolution_url(F.col("provenance_urls")),
        "res_icao": X.resolution_station(F.col("provenance_urls")),
        "event_slug": X.normalize_text(F.col("event_slug")),
        "neg": X.normalize_text(F.col("neg_risk_market_id")),
        "slug_family": X.slug_family(F.col("slug")),
        "question_family": X.question_family(F.col("question")),
        "slug_day": F.col("slug_day"),
        "question_day": F.col("question_day"),
    }
    kind = F.col("kind")
    cells = child_evidence(rows).select(
        "event_key",
        *[c.alias(f"x_{n}") for n, c in single.items()],
        *[f(c).alias(f"{n}_{f.__name__[6:]}") for n, c in (("text_city", "text_cities"), ("text_station", "text_stations"))
          for f in (F.array_min, F.array_max)],
        "off_topic", "settlement_label", own_day.alias("own_day"),
        F.col("identity.ambiguous").alias("ambiguous"),
        _label().alias("label"),
        unit_kind.alias("kind"),
    )
    flags = {
        "off_topic": F.col("off_topic"), "ambiguous": F.col("ambiguous"), "blank_label": F.col("label") == "",
        "blank_kind": kind.isin("", "unknown"), "some_temperature": kind.isin(*TEMPERATURE_KINDS),
        "some_other": ~kind.isin(*TEMPERATURE_KINDS),
    }
    aggs: list[Column] = [
        F.count(F.lit(1)).alias("n"), F.count_if(is_yes(F.col("settlement_label"))).alias("n_yes"),
        F.count("settlement_label").alias("n_labelled"),
    ]
    for name in single:
        aggs += _span(name, F.col(f"x_{name}"))
    for name in ("text_city", "text_station"):
        aggs += [F.min(f"{name}_min").alias(f"{name}_min"), F.max(f"{name}_max").alias(f"{name}_max")]
    aggs += [F.min("own_day").alias("own_day"), *[F.bool_or(c).alias(n) for n, c in flags.items()]]
    # label repeats are counted on a narrow side, so the wide rows shuffle once
    labels = (
        rows.select("event_key", _label().alias("label"))
        .distinct()
        .groupBy("event_key")
        .agg(F.count(F.lit(1)).alias("n_labels"))
    )
    return cells.groupBy("event_key").agg(*aggs).join(labels, "event_key")


def _label() -> Column:
    return F.lower(F.trim(F.coalesce("bucket_label", F.lit(""))))


def _weak_conflict(days: list[str]) -> Column:
    """Positive proof in child texts of another city, day, station or topic."""
    low = F.least(*[F.col(f"{d}_min") for d in days]) if len(days) > 1 else F.col(f"{days[0]}_min")
    high = (
        F.greatest(*[F.col(f"{d}_max") for d in days]) if len(days) > 1 else F.col(f"{days[0]}_max")
    )
    other_day = (low != high) | (low != F.col("own_day"))
    checks = [
        _differs("text_city"),
        F.col("text_city_min") != F.col("city_min"),
        other_day,
        _differs("text_station"),
        F.col("text_station_min") != F.col("station_min"),
        F.col("off_topic"),
    ]
    proof = F.lit(False)
    for check in checks:
        proof = proof | F.coalesce(check, F.lit(False))
    return proof


def _first_code(pairs: list[tuple[Column, Column | str]]) -> Column:
    chain = None
    for condition, code in pairs:
        chain = F.when(condition, code) if chain is None else chain.when(condition, code)
    return chain


def coherence_code() -> Column:
    """First conflict of A27/A28 order over :func:`group_facts`; null when coherent."""
    return _first_code(
        [
            (F.col("ambiguous"), C.IDENTITY_AMBIGUOUS),
            (_differs("event_id"), C.EVENT_ID_CONFLICT),
            (_differs("city"), C.CITY_CONFLICT),
            (_differs("station"), C.STATION_CONFLICT),
            (_differs("date"), C.DATE_CONFLICT),
            (_differs("unit"), C.UNIT_CONFLICT),
            (
                _differs("res_station") | _differs("res_url") | _differs("res_icao")
                | F.coalesce(F.col("res_station_min") != F.col("res_icao_min"), F.lit(False)),
                C.RESOLUTION_CONFLICT,
            ),
            (_differs("event_slug"), C.SLUG_CONFLICT),
            (_differs("neg"), C.MARKET_FAMILY_CONFLICT),
            (_differs("slug_family") & _weak_conflict(["slug_day"]), C.SLUG_CONFLICT),
            (
                _differs("question_family") & _weak_conflict(["slug_day", "question_day"]),
                C.QUESTION_CONFLICT,
            ),
        ]
    )


def weak_evidence() -> dict[str, Column]:
    """Verdict columns of the weak child evidence, for reporting."""
    return {
        "slug_conflict": _differs("slug_family") & _weak_conflict(["slug_day"]),
        "question_conflict": _differs("question_family")
        & _weak_conflict(["slug_day", "question_day"]),
    }


def structure_code() -> Column:
    return _first_code(
        [
            (F.col("blank_label"), C.STRUCTURE_CONFLICT),
            (F.col("n_labels") < F.col("n"), C.DUPLICATE_OUTCOME),
            (F.col("blank_kind"), C.STRUCTURE_CONFLICT),
            (F.col("some_temperature") & F.col("some_other"), C.STRUCTURE_CONFLICT),
        ]
    )


def settlement_code() -> Column:
    return _first_code(
        [
            (F.col("n_yes") > 1, C.SETTLEMENT_CARDINALITY),
            (
                (F.col("n_labelled") == F.col("n")) & (F.col("n_yes") == 0),
                C.SETTLEMENT_UNRESOLVED,
            ),
        ]
    )


def previous_rung(rungs: DataFrame) -> DataFrame:
    """Adds ``prev``, the neighbour before each rung in (lo, hi, token) order inside its event.

    The order is cut into fixed degree spans; the window runs inside one span and the first rung of
    a span gets the last rung of the span before it, carried from a table with one row per span.
    """
    rung = F.struct("lo", "hi", "token_id", "span_lo", "span_hi")
    cut = rungs.withColumn("_b", F.floor(F.col("lo") / RUNG_BUCKET_DEGREES)).withColumn("_me", rung)
    spans = cut.groupBy("event_key", "_b").agg(F.max("_me").alias("_last"))
    chain = Window.partitionBy("event_key").orderBy("_b")
    carried = spans.select("event_key", "_b", F.lag("_last").over(chain).alias("_carry"))
    inside = Window.partitionBy("event_key", "_b").orderBy("lo", "hi", "token_id")
    return (
        cut.withColumn("_near", F.lag("_me").over(inside))
        .join(carried, ["event_key", "_b"])
        .withColumn("prev", F.coalesce("_near", "_carry"))
        .drop("_b", "_me", "_near", "_carry")
    )


def _num(col: Column) -> Column:
    return F.coalesce(col.cast("string"), F.lit("None"))


def ladder_topology(rows: DataFrame, order: Sequence) -> DataFrame:
    """(event_key, topology_detail): first structural fault of each event's native ladder.

    Interiors must touch (next low = previous high + 1), open ends must be single and abut.
    Fahrenheit rungs are compared as whole degrees (half to even).
    """
    kind = F.lower(F.trim("bucket_kind"))
    lo, hi = F.col("temperature_native_min"), F.col("temperature_native_max")
    fits = F.coalesce(
        F.when(kind == "exact", lo == hi)
        .when(kind == "range", lo <= hi)
        .when(kind == "below", hi.isNotNull() & lo.isNull())
        .when(kind == "above", lo.isNotNull() & hi.isNull()),
        F.lit(False),
    )
    unit = X.normalize_text(F.col("temperature_unit"))
    rungs = rows.select(
        "event_key", "token_id", *order, kind.alias("kind"), lo.alias("lo"), hi.alias("hi"),
        fits.alias("fits"), unit.alias("unit"),
    ).filter(F.col("kind").isin(*TEMPERATURE_KINDS))

    bad_bounds = F.concat(
        F.lit("invalid_native_bounds:token="), F.col("token_id"), F.lit(";kind="), F.col("kind"),
        F.lit(";native_min="), _num(F.col("lo")), F.lit(";native_max="), _num(F.col("hi")),
    )
    # collapse equal rungs first: copies meet map-side, and everything after sees distinct rungs
    unfit, rung_order = ~F.col("fits"), F.struct(*order)
    cells = materialize(rungs.groupBy("event_key", "kind", "lo", "hi", "fits").agg(
        F.count(F.lit(1)).alias("copies"),
        F.min("token_id").alias("token_id"),
        F.min("unit").alias("unit"),
        F.max("unit").alias("unit_max"),
        F.min_by(F.when(unfit, bad_bounds), F.when(unfit, rung_order)).alias("_bad"),
        F.min(F.when(unfit, rung_order)).alias("_ord"),
    ), "rungs")
    is_below, is_above = F.col("kind") == "below", F.col("kind") == "above"
    basic = cells.groupBy("event_key").agg(
        F.min("unit").alias("unit"),
        F.max("unit_max").alias("unit_max"),
        F.min_by(F.when(~F.col("fits"), F.col("_bad")),
                 F.when(~F.col("fits"), F.col("_ord"))).alias("bad"),
        F.max("copies").alias("copies"),
        F.count_if(is_below).alias("n_below"),
        F.count_if(is_above).alias("n_above"),
        F.max(F.when(is_below, F.col("hi"))).alias("below_hi"),
        F.min(F.when(is_above, F.col("lo"))).alias("above_lo"),
    )
    is_f = F.coalesce(F.col("unit").startswith("f"), F.lit(False))
    early = _first_code(
        [
            (F.coalesce(F.col("unit") != F.col("unit_max"), F.lit(False)), F.lit("native_unit_mismatch")),
            (F.col("bad").isNotNull(), F.col("bad")),
            (F.col("copies") > 1, F.lit("duplicate_semantic_coverage")),
            ((F.col("n_below") > 1) | (F.col("n_above") > 1), F.lit("invalid_tail:multiple_open_ends")),
        ]
    )
    heads = basic.select(
        "event_key", is_f.alias("is_f"), early.alias("early"), "below_hi", "above_lo"
    )

    def span(col: Column) -> Column:
        return F.when(F.col("is_f"), F.bround(col)).otherwise(col)

    interiors = (
        cells.filter(F.col("kind").isin("exact", "range"))
        .select("event_key", "kind", "lo", "hi", "token_id")
        .join(heads.filter("early IS NULL").select("event_key", "is_f"), "event_key")
        .withColumn("span_lo", span(F.col("lo")))
        .withColumn(
            "span_hi", F.when(F.col("kind") == "exact", F.col("span_lo")).otherwise(span(F.col("hi")))
        )
    )

    def shown(col: Column) -> Column:
        return F.when(F.col("is_f"), col.cast("bigint").cast("string")).otherwise(_num(col))

    where = F.when(F.col("is_f"), F.lit(";spans=")).otherwise(F.lit(";native="))

    def fault(word: str) -> Column:
        return F.concat(
            F.lit(f"{word}:tokens="), F.col("prev.token_id"), F.lit(","), F.col("token_id"), where,
            shown(F.col("prev.span_lo")), F.lit("-"), shown(F.col("prev.span_hi")), F.lit(","),
            shown(F.col("span_lo")), F.lit("-"), shown(F.col("span_hi")),
        )

    seam = F.when(F.col("span_lo") <= F.col("prev.span_hi"), fault("overlap")).when(
        F.col("span_lo") != F.col("prev.span_hi") + 1, fault("gap")
    )
    place = F.struct("lo", "hi", "token_id")
    walked = (
        previous_rung(interiors)
        .withColumn("_fault", seam)
        .groupBy("event_key")
        .agg(
            F.min_by(
                F.when(F.col("_fault").isNotNull(), F.col("_fault")),
                F.when(F.col("_fault").isNotNull(), place),
            ).alias("fault"),
            F.min_by("span_lo", place).alias("first_lo"),
            F.max_by("span_hi", place).alias("last_hi"),
        )
    )
    below, above = span(F.col("below_hi")), span(F.col("above_lo"))
    first_lo, last_hi = F.col("first_lo"), F.col("last_hi")
    low_tail = F.concat(
        F.lit("invalid_tail:low;below_hi="), shown(below), F.lit(";first_interior_lo="), shown(first_lo)
    )
    joined_tails = F.concat(
        F.lit("invalid_tail:low_high_connect;below_hi="), shown(below), F.lit(";above_lo="), shown(above)
    )
    high_tail = F.concat(
        F.lit("invalid_tail:high;above_lo="), shown(above), F.lit(";last_interior_hi="), shown(last_hi)
    )
    detail = (
        F.when(F.col("early").isNotNull(), F.col("early"))
        .when(F.col("fault").isNotNull(), F.col("fault"))
        .when(first_lo != below + 1, low_tail)
        .when(first_lo.isNull() & (above != below + 1), joined_tails)
        .when(above != last_hi + 1, high_tail)
    )
    return heads.join(walked, "event_key", "left").select("event_key", detail.alias("topology_detail"))


def group_verdicts(rows: DataFrame, order: Sequence) -> DataFrame:
    """(event_key, n, accepted, code, detail): first failing check wins."""
    # the facts' shuffle is over before the ladders are walked
    facts = materialize(
        group_facts(rows).select(
            "event_key", "n", F.coalesce(coherence_code(), structure_code()).alias("early"), settlement_code().alias("settlement")
        ),
        "facts",
    )
    joined = facts.join(ladder_topology(rows, order), "event_key", "left")
    early = F.col("early")
    code = F.coalesce(
        early,
        F.when(F.col("topology_detail").isNotNull(), C.STRUCTURE_CONFLICT),
        F.col("settlement"),
    )
    names = {
        C.EVENT_ID_CONFLICT: "event_id", C.CITY_CONFLICT: "city", C.STATION_CONFLICT: "station_icao",
        C.DATE_CONFLICT: "event_date", C.UNIT_CONFLICT: "temperature_unit",
    }
    field = _first_code([(early == k, F.lit(v)) for k, v in names.items()])
    detail = F.when(early.isNotNull(), field).otherwise(F.col("topology_detail"))
    return joined.select(
        "event_key", "n", code.isNull().alias("accepted"), code.alias("code"), detail.alias("detail")
    )


def _list_text(col: str) -> Column:
    inner = F.array_join(F.col(col), "', '")
    return F.when(F.size(col) > 0, F.concat(F.lit("['"), inner, F.lit("']"))).otherwise(F.lit("[]"))


def quarantine_rows(rows: DataFrame, reason: Column, detail: Column) -> DataFrame:
    return rows.select(
        reason.alias("reason"), "condition_id", "market_id", "token_id", "city", "station_icao",
        "event_date", detail.alias("details"),
    )


def accept_event_groups(
    df: DataFrame, order: Sequence[str], stored_key: str | None = None
) -> tuple[DataFrame, DataFrame]:
    """(accepted rows, quarantine rows): ambiguous rows out, copies isolated, incoherent groups out."""
    routed = route_event_groups(df, order, stored_key)
    accepted = routed.filter("_code IS NULL").drop("_code", "_detail")
    bad = routed.filter("_code IS NOT NULL")
    provenance = F.concat(
        F.lit("urls="), _list_text("provenance_urls"), F.lit("; raw_paths="), _list_text("raw_paths"),
        F.lit("; hashes="), _list_text("content_hashes"),
    )
    return accepted, quarantine_rows(
        bad, F.col("_code"), F.concat_ws("; ", F.col("_detail"), provenance)
    )


def route_event_groups(
    df: DataFrame, order: Sequence[str], stored_key: str | None = None
) -> DataFrame:
    """Every row with its quarantine code (``_code``, null = accepted) and ``_detail``."""
    keyed = with_event_key(df, stored_key)
    # of the identity only the ambiguity is read later
    rows = with_row_id(
        keyed.withColumn("identity", F.struct(F.col("identity.ambiguous").alias("ambiguous"))), "event-groups"
    )

    def judge() -> DataFrame:
        clear = materialize(clear_firsts(rows, order), "clear")
        verdicts = group_verdicts(clear, order).select("event_key", "code", "detail")
        firsts = clear.select("_row", F.lit(True).alias("is_first"))
        return (
            rows.select("_row", "event_key").join(firsts, "_row", "left").join(verdicts, "event_key", "left")
            .select("_row", F.coalesce("is_first", F.lit(False)).alias("is_first"), "code", "detail")
        )

    # verdicts are found on narrow columns; the wide rows meet them in one join
    out = rows.join(settle(df.sparkSession, judge, "judged"), "_row")
    ambiguous, copy = F.col("identity.ambiguous"), ~F.col("is_first")
    return (
        out.withColumn(
            "_code",
            F.when(ambiguous, C.IDENTITY_AMBIGUOUS)
            .when(copy, C.DUPLICATE_SNAPSHOT)
            .otherwise(F.col("code")),
        )
        .withColumn(
            "_detail",
            F.when(ambiguous, F.lit(None).cast("string"))
            .when(copy, _dedup_key())
            .otherwise(F.col("detail")),
        )
        .drop("_row", "is_first", "code", "detail", "identity")
    )


def _dedup_key() -> Column:
    return dedup_key(F.col("condition_id"), F.col("token_id"), F.col("event_date"), F.col("decision_ts"))


def clear_firsts(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """What verdicts read of the first row of every snapshot key in its event, unambiguous rows only.

    The rows are shuffled once, by event, and leave in event order, so a later aggregation by event sends a row per event.
    Large events (:func:`large_parts`) are spread by their snapshot keys. ``rows``: a table with ``_row``.
    """
    part = F.pmod(F.xxhash64("event_key"), F.lit(EVENT_PARTS))
    clear = rows.filter(~F.col("identity.ambiguous"))
    large = large_parts(clear.select(part.alias("part")))
    if large:  # only then: a constant would be folded out of the window's keys and cost a second shuffle
        copies = F.pmod(F.xxhash64(_dedup_key()), F.lit(EVENT_PARTS))
        clear = clear.withColumn("_spread", F.when(part.isin(large), copies).otherwise(-1))
    by = ["event_key", "_spread"] if large else ["event_key"]
    first = Window.partitionBy(*by, "_dedup").orderBy(*order, "_row")
    read = dict.fromkeys(["_row", *by, *VERDICT_COLUMNS, "condition_id", "decision_ts", *order])
    telling = F.filter("provenance_urls", lambda u: F.lower(u).contains(C.RESOLUTION_HOST) | F.lower(u).contains(C.RESOLUTION_PATH))
    return (
        clear.withColumn("provenance_urls", telling).select(*read).repartition(*by)
        .withColumn("_dedup", _dedup_key()).withColumn("_rn", F.row_number().over(first)).filter("_rn = 1")
        .select("_row", *VERDICT_COLUMNS, *order)
    )


def large_parts(parts: DataFrame) -> list[int]:
    """The numbers in ``part`` that stand for events too large for one task: twice the mean and a lane's rows more.

    Events share a part by their hash; one that is called large for its neighbours is only spread.
    """
    counts = parts.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    found = {r.part: r.n for r in counts.collect()}  # EVENT_PARTS rows at most
    limit = LANE_ROWS + 2 * sum(found.values()) // EVENT_PARTS
    return sorted(part for part, n in found.items() if n > limit)
