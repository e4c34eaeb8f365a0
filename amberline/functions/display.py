"""Status, provenance and identity fields shown next to a number."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from amberline.config import CHANNEL_ALIAS, CHANNEL_COLUMNS, CHANNEL_FAMILY, CHANNEL_LABEL, CHANNEL_SHOWN


def literal_map(mapping: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])


def observed_classification(asset_class: Column, npa_status: Column, dpd: Column) -> Column:
    """Classification as supplied, else the observed DPD, else a plain blank."""
    stated = F.coalesce(F.nullif(asset_class, F.lit("")), F.nullif(npa_status, F.lit("")))
    fallback = F.when(dpd.isNotNull(), F.concat(F.lit("not supplied, DPD "), F.round(dpd).cast("bigint").cast("string")))
    return F.coalesce(stated, fallback, F.lit("not supplied"))


def synthetic_cif(account_id: Column) -> Column:
    """Nine digits led by 9: the last eight digits of the id, zero-padded."""
    digits = F.right(F.regexp_replace(account_id.cast("string"), r"\D", ""), F.lit(8))
    return F.concat(F.lit("9"), F.lpad(digits, 8, "0"))


def canonical_channel(name: Column) -> Column:
    key = F.lower(F.trim(name))
    return F.coalesce(F.element_at(literal_map(CHANNEL_ALIAS), key), key)


CHANNEL_FIELDS = {channel: CHANNEL_SHOWN.get(channel, CHANNEL_COLUMNS.get(channel, ())) for channel in CHANNEL_FAMILY}
ENTRIES = "array<string>"
ENTRY = "channel string, label string, present boolean, family string, source string, fields array<string>"


def channel_entries(text: Column) -> Column:
    """A JSON list of channels as an array: names bare, objects as their JSON text; anything else is an empty list."""
    return F.coalesce(F.from_json(text, ENTRIES), F.array().cast(ENTRIES))


def normalise_channels(entries: Column, source: Column | None = None) -> Column:
    """Names and objects (as JSON text) -> rows (channel, label, present, family, source, fields), aliases resolved.

    An object's own label, family, source and fields stand before the known ones;
    a channel is present unless an object says it is not.
    """
    source = F.lit(None).cast("string") if source is None else source
    fields = F.create_map(*[x for c, columns in CHANNEL_FIELDS.items() for x in (F.lit(c), F.array(*map(F.lit, columns)).cast("array<string>"))])
    labels, families = literal_map(CHANNEL_LABEL), literal_map(CHANNEL_FAMILY)

    def row(entry: Column) -> Column:
        given = F.when(F.startswith(F.ltrim(entry), F.lit("{")), F.from_json(entry, ENTRY))
        channel = canonical_channel(F.coalesce(given["channel"], F.when(given.isNull(), entry), F.lit("")))
        stated = lambda name: F.nullif(given[name], F.lit(""))
        return F.struct(
            channel.alias("channel"), F.coalesce(stated("label"), F.element_at(labels, channel), channel).alias("label"),
            F.coalesce(given["present"], F.lit(True)).alias("present"), F.coalesce(stated("family"), F.element_at(families, channel)).alias("family"),
            F.coalesce(stated("source"), source).alias("source"),
            F.coalesce(given["fields"], F.element_at(fields, channel), F.array().cast("array<string>")).alias("fields"))

    return F.transform(entries, row)


def channel_set(entries: Column) -> Column:
    """The channels an account has, each once, in order."""
    return F.array_sort(F.array_distinct(F.transform(F.filter(normalise_channels(entries), lambda c: c["present"]), lambda c: c["channel"])))


FIELD_CHANNEL = {field: channel for fields in (CHANNEL_COLUMNS, CHANNEL_SHOWN) for channel, columns in fields.items() for field in columns}


def field_state(value: Column, field: str, channels: Column) -> Column:
    """observed / not_applicable / unobserved; an empty channel list proves nothing."""
    channel = FIELD_CHANNEL.get(field)
    if channel is None:
        return F.when(value.isNotNull(), "observed").otherwise("unobserved")
    present = F.transform(channels, canonical_channel)
    absent = (F.size(present) > 0) & ~F.array_contains(present, channel)
    return F.when(value.isNotNull(), "observed").when(absent, "not_applicable").otherwise("unobserved")


def sync_state(status: Column, subscription: Column, error: Column, calls: Column, mode: Column, live: Column) -> Column:
    """State of one feed; an error outranks everything, a reused answer outranks sandbox and live."""
    s, sub = F.lower(F.coalesce(status, F.lit(""))), F.lower(F.coalesce(subscription, F.lit("")))
    failed = error.isNotNull() | (s == "error") | s.startswith("4") | s.startswith("5")
    waiting = ~sub.isin("", "approved", "active")
    never = F.coalesce(calls, F.lit(0)) == 0
    return (F.when(failed, "error").when(never & waiting, "pending").when(never, "never")
            .when(mode == "cached", "cached").when(mode == "sandbox_fixture", "sandbox").when(~live, "sandbox").otherwise("ok"))


def mode_badge(mode: Column) -> Column:
    """Run mode -> source badge."""
    m = F.lower(F.coalesce(mode, F.lit("")))
    return (F.when(m.isin("bank", "bank_api", "live", "sandbox", "sandbox_fixture"), "BANK_API").when(m == "fixture", "FIXTURE")
            .when(m.isin("simulated", "demo"), "SIMULATED").otherwise("NOT_COLLECTED"))


def family_badge(value: Column, cached: Column) -> Column:
    """Source of one family -> badge; a reused answer keeps its own badge."""
    v = F.upper(F.coalesce(value, F.lit("")))
    return (F.when((v == "BANK_API") & cached, "BANK_API_CACHED").when(v.isin("BANK_API", "BANK_API+SANDBOX_FIXTURE"), "BANK_API")
            .when(v.isin("SIMULATED", "FIXTURE"), v).otherwise("NOT_COLLECTED"))


def alert_memo(account_id: Column, portfolio: Column, sanctioned: Column, score: Column, classification: Column,
               reasons: Column) -> Column:
    """Short review request for a Red account."""
    drivers = F.when(F.size(reasons) > 0, F.array_join(reasons, "; ")).otherwise("score level alone")
    return F.concat(
        F.lit("Review account "), account_id.cast("string"), F.lit(" ("), portfolio, F.lit(", sanctioned "),
        F.round(sanctioned).cast("bigint").cast("string"), F.lit("). Score "), F.round(score * 100).cast("bigint").cast("string"),
        F.lit("%, band red. Books: "), classification, F.lit(". Drivers: "), drivers, F.lit("."))
