"""Symbols, partition names, spans and venue clocks."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numbers import col


def venue_symbol(symbol: str | Column, venue: str | Column) -> Column:
    """A normalised BASE-QUOTE symbol in the venue's spelling; NULL if it isn't normalised."""
    s, v = col(symbol), col(venue)
    parts = F.split(s, "-", 2)
    ok = (F.size(parts) == 2) & (parts[0] != "") & (parts[1] != "")
    return F.when(ok, F.when(v == "kraken", F.concat_ws("/", parts[0], parts[1])).when(v == "bitstamp", F.lower(F.concat(parts[0], parts[1]))).otherwise(s))


def partition_name(symbol: str | Column) -> Column:
    """What may stand in a path; all dots or nothing become 'unknown'."""
    clean = F.regexp_replace(col(symbol), "[^A-Za-z0-9_.-]", "_")
    return F.when(clean.isNull() | clean.rlike(r"^\.*$"), F.lit("unknown")).otherwise(clean)


def rfc3339_ns(text: str | Column) -> Column:
    """Nanoseconds since 1970; fraction cut to nine digits, no zone is UTC, second 60 is 59; NULL if malformed."""
    t = col(text)
    p = r"^(\d{4}-\d{2}-\d{2})[Tt ](\d{2}:\d{2}):(\d{2})(?:\.(\d+))?\s*(Z|z|[+-]\d{2}:?\d{2})?$"
    part = lambda i: F.regexp_extract(t, p, i)
    second = F.when(part(3) == "60", F.lit("59")).otherwise(part(3))
    local = F.concat_ws(" ", part(1), F.concat_ws(":", part(2), second))
    whole = F.unix_seconds(F.try_to_timestamp(F.concat(local, F.lit("Z")), F.lit("yyyy-MM-dd HH:mm:ssX")))
    nanos = F.coalesce(F.rpad(F.substring(part(4), 1, 9), 9, "0").try_cast("long"), F.lit(0))
    zone = F.regexp_replace(part(5), ":", "")
    hours, minutes = F.substring(zone, 2, 2).try_cast("long"), F.substring(zone, 4, 2).try_cast("long")
    offset = F.when(zone.rlike("^[+-]"), F.when(zone.startswith("-"), -1).otherwise(1) * (hours * 3600 + minutes * 60)).otherwise(0)
    return F.when(t.rlike(p), (whole - offset) * 1_000_000_000 + nanos)


def micros_ns(micros: str | Column) -> Column:
    return col(micros).try_cast("long") * 1000


def display_ts(ns: str | Column) -> Column:
    return F.timestamp_micros(F.floor(col(ns) / 1000).cast("long"))


def span_label(span_ms: str | Column) -> Column:
    """60s, or 250ms where it isn't whole seconds."""
    s = col(span_ms)
    return F.when(s % 1000 == 0, F.concat((s / 1000).cast("long").cast("string"), F.lit("s"))).otherwise(F.concat(s.cast("string"), F.lit("ms")))


_SPAN = re.compile(r"^(\d+(?:\.\d+)?)(ms|s|m|h)?$")


def parse_spans(text: str) -> list[int]:
    """'1s,10s,250ms' -> milliseconds; a bare number is seconds; zero and nonsense are errors."""
    out = []
    for part in (x.strip() for x in text.split(",")):
        m = _SPAN.match(part)
        ms = round(float(m[1]) * {"ms": 1, "s": 1000, "m": 60_000, "h": 3_600_000}[m[2] or "s"]) if m else 0
        if ms <= 0:
            raise ValueError(f"not a window span: {part!r}")
        out.append(ms)
    return out


def parse_symbols(text: str) -> list[str]:
    out = [x.strip().upper() for x in text.split(",") if x.strip()]
    for s in out:
        base, _, quote = s.partition("-")
        if not base or not quote:
            raise ValueError(f"not a BASE-QUOTE symbol: {s!r}")
    if len(set(out)) != len(out):
        raise ValueError("a symbol is given twice")
    return out


def parse_venues(text: str) -> list[str]:
    from ..schemas import VENUES

    out = [x.strip().lower() for x in text.split(",") if x.strip()]
    if bad := [x for x in out if x not in VENUES]:
        raise ValueError(f"unknown venue: {bad[0]!r}")
    return sorted(set(out), key=lambda v: VENUES[v][0])
