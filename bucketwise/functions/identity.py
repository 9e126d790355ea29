"""Keys and identities: canonical events, snapshot keys, trades and request URLs."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F

from bucketwise import constants as C
from bucketwise.functions.text import question_family, slug_family
from bucketwise.functions.times import iso_utc


def _filled(col: Column) -> Column:
    return col.isNotNull() & (col != "")


def with_identity(df: DataFrame) -> DataFrame:
    """Adds ``identity``: struct(canonical_event_key, source, evidence_fields, ambiguous,
    quarantine_reason).

    The strongest available evidence wins; city, station and date alone never identify an event.
    Families are extracted only for rows that carry no explicit identifier.
    """
    event_id, neg, event_slug = F.col("event_id"), F.col("neg_risk_market_id"), F.col("event_slug")
    city, station, date = F.col("city"), F.col("station_icao"), F.col("event_date")
    unnamed = ~(
        F.coalesce(_filled(event_id), F.lit(False))
        | F.coalesce(_filled(neg), F.lit(False))
        | F.coalesce(_filled(event_slug), F.lit(False))
    )
    family, phrase = F.col("_family"), F.col("_phrase")

    def identity(source: str, key: list[Column], evidence: list[str]) -> Column:
        ambiguous = source == "ambiguous"
        return F.struct(
            F.array(F.lit(source), *key).alias("canonical_event_key"),
            F.lit(source).alias("source"),
            F.array(*[F.lit(e) for e in evidence]).cast("array<string>").alias("evidence_fields"),
            F.lit(ambiguous).alias("ambiguous"),
            F.lit(C.IDENTITY_AMBIGUOUS if ambiguous else None)
            .cast("string")
            .alias("quarantine_reason"),
        )

    by_question = phrase.isNotNull() & _filled(city) & _filled(station) & _filled(date)
    chain = (
        F.when(_filled(event_id), identity("event_id", [event_id], ["event_id"]))
        .when(_filled(neg), identity("neg_risk_market_id", [neg], ["neg_risk_market_id"]))
        .when(
            _filled(event_slug),
            identity("event_slug", [F.lower(F.trim(event_slug))], ["event_slug"]),
        )
        .when(family.isNotNull(), identity("slug_family", [family], ["slug"]))
        .when(
            by_question,
            identity(
                "question_family",
                [phrase, city, station, date],
                ["question", "city", "station_icao", "event_date"],
            ),
        )
        .otherwise(identity("ambiguous", [F.col("condition_id"), F.col("token_id")], []))
    )
    return (
        df.withColumn("_family", F.when(unnamed, slug_family(F.col("slug"))))
        .withColumn(
            "_phrase", F.when(unnamed & family.isNull(), question_family(F.col("question")))
        )
        .withColumn("identity", chain)
        .drop("_family", "_phrase")
    )


def key_text(key: Column) -> Column:
    """One-string form of a canonical key, cheap to hash and to shuffle."""
    return F.array_join(key, "\u0001")


def dedup_key(
    condition_id: Column, token_id: Column, event_date: Column, decision_ts: Column
) -> Column:
    return F.concat_ws("|", condition_id, token_id, event_date, iso_utc(decision_ts))


def trade_id(fields: Mapping[str, Column], explicit: list[Column]) -> Column:
    """First non-empty explicit id, else a digest of all named fields.

    Field names and null markers are part of the digest input, so two different field sets can
    never collide by concatenation. A transaction hash alone is not unique.
    """
    parts = [
        F.concat(F.lit(f"{name}="), F.coalesce(F.to_json(F.struct(col.alias("v"))), F.lit("{}")))
        for name, col in sorted(fields.items())
    ]
    digest = F.sha2(F.concat_ws("\u0001", *parts), 256)
    given = [F.when(F.trim(c.cast("string")) != "", c.cast("string")) for c in explicit]
    return F.coalesce(*given, digest)


def _form_decode(text: Column) -> Column:
    return F.coalesce(F.try_url_decode(text), text)


def _form_encode(text: Column) -> Column:
    encoded = F.url_encode(text)
    return F.replace(F.replace(encoded, F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def canonical_url(url: Column) -> Column:
    """Query items decoded, sorted and re-encoded; the fragment is dropped."""
    base = F.regexp_replace(url, r"#.*$", "")
    head = F.regexp_extract(base, r"^([^?]*)", 1)
    query = F.regexp_extract(base, r"\?(.*)$", 1)
    items = F.filter(F.split(query, "&"), lambda x: x != "")
    pairs = F.transform(
        items,
        lambda x: F.struct(
            _form_decode(F.regexp_extract(x, r"^([^=]*)", 1)).alias("k"),
            _form_decode(F.regexp_extract(x, r"^[^=]*=(.*)$", 1)).alias("v"),
        ),
    )
    text = F.array_join(
        F.transform(
            F.array_sort(pairs),
            lambda p: F.concat(_form_encode(p["k"]), F.lit("="), _form_encode(p["v"])),
        ),
        "&",
    )
    return F.when(text == "", head).otherwise(F.concat(head, F.lit("?"), text))
