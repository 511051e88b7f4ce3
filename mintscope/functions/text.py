"""Text, time and list expressions as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def uri_scheme(uri: Column) -> Column:
    return F.when(F.instr(uri, ":") > 0, F.lower(F.substring_index(uri, ":", 1))).otherwise("unknown")


def uri_host(uri: Column) -> Column:
    """What stands between :// and the next slash; NULL without ://."""
    return F.when(F.instr(uri, "://") > 0, F.split(F.split(uri, "://")[1], "/")[0])


def distinct_ratio(s: Column) -> Column:
    """Distinct characters by all characters, 0 for an empty text."""
    chars = F.filter(F.split(s, ""), lambda c: c != "")
    return F.when(F.char_length(s) > 0, F.size(F.array_distinct(chars)) / F.char_length(s)).otherwise(F.lit(0.0))


def non_ascii_ratio(s: Column) -> Column:
    plain = F.char_length(F.regexp_replace(s, r"[^\x00-\x7F]", ""))
    return F.when(F.char_length(s) > 0, (F.char_length(s) - plain) / F.char_length(s)).otherwise(F.lit(0.0))


def client_fingerprint(limit: Column, price: Column, accounts: Column, instructions: Column, programs: Column) -> Column:
    """cul:..|cup:..|acct:..|ix:..|pgm:.., `na` for what is missing, NULL if all are."""
    part = lambda name, c: F.concat(F.lit(f"{name}:"), F.coalesce(c.cast("string"), F.lit("na")))
    return F.when(F.coalesce(limit, price, accounts, instructions, programs).isNotNull(), F.concat_ws("|", part("cul", limit), part("cup", price), part("acct", accounts), part("ix", instructions), part("pgm", programs)))


def truthy(s: Column) -> Column:
    return F.coalesce(F.lower(F.trim(s)).isin("true", "1", "yes", "y"), F.lit(False))


def number(s: Column) -> Column:
    return s.try_cast("double")


def int_or_zero(s: Column) -> Column:
    return F.coalesce(s.try_cast("double").try_cast("long"), F.lit(0))


def timestamp_of(s: Column) -> Column:
    """ISO text, with Z or " UTC" or without; NULL for lists and what isn't a time."""
    return F.when(~s.rlike(r"^\s*[\[(]"), F.try_to_timestamp(F.regexp_replace(F.regexp_replace(F.trim(s), " UTC$", ""), "Z$", "+00:00")))


def hour_of(us: Column) -> Column:
    return F.hour(F.timestamp_micros(us))


def weekday_of(us: Column) -> Column:
    """Monday is 0."""
    return F.weekday(F.timestamp_micros(us))


def slug(s: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(s)), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def reason_list(s: Column) -> Column:
    """A text joined by | as an array: trimmed, without empties and repeats, in order."""
    return F.array_distinct(F.filter(F.transform(F.split(s, r"\|"), lambda x: F.trim(x)), lambda x: x != ""))


def mint_list(s: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(F.split(s, "[|,]"), lambda x: F.trim(x)), lambda x: x != ""))


def first_gate(reasons: Column, priority: list[str]) -> Column:
    """The first name of `priority` that is in reasons, else NULL."""
    return F.get(F.filter(F.array(*[F.lit(p) for p in priority]), lambda p: F.array_contains(reasons, p)), F.lit(0))


def row_hash(columns: list[str]) -> Column:
    """SHA-256 of the named columns as JSON in the order of their names."""
    return F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}), 256)


def ordinal(s: Column, levels: list[str]) -> Column:
    """The place of s in levels, from 0; NULL if it is none."""
    return F.nullif(F.array_position(F.array(*[F.lit(x) for x in levels]), s), F.lit(0)) - 1


def reconcile_key(signature: Column, slot: Column, kind: Column) -> Column:
    return F.coalesce(F.concat(F.lit("sig:"), signature), F.concat(F.lit("slot:"), slot.cast("string"), F.lit(":"), kind))
