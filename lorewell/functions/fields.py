"""Dates, names and other metadata fields."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lorewell import schema as C
from lorewell.functions.text import col, strip, text_or_empty

# Date patterns in the order they are tried, and words that are no names.
FULL_DATES = ["MMMM d, yyyy", "MMM d, yyyy", "d MMMM yyyy", "d MMM yyyy", "d-M-yyyy", "d/M/yyyy", "yyyy/M/d"]
MONTHS = ["MMMM yyyy", "MMM yyyy"]
NOT_NAMES = (
    "executive summary,top,context,action items,introduction,abstract,summary,author,authors,date,categories,document,version,"
    "staff,admin,editorial,research,read more,share"
).split(",")
NAME_PART = r"[A-Z][A-Za-z.'À-ſ-]*"
NAME = rf"^{NAME_PART}(?:\s+(?:{NAME_PART}|de|da|van|von|bin|al)){{1,4}}$"


def normalize_date(c: Column | str) -> Column:
    """yyyy-MM-dd, yyyy-MM or yyyy as far as known, else ""."""
    s = strip(text_or_empty(c))
    iso = r"^(\d{4}-\d{2}-\d{2})(?:[T ][\d:.]+(?:Z|[+-]\d{2}:?\d{2})?)?$"
    plain = F.regexp_replace(s, r"(\d)(?:st|nd|rd|th)\b", "$1")
    day = F.coalesce(*[F.try_to_timestamp(plain, F.lit(f)) for f in FULL_DATES])
    month = F.coalesce(*[F.try_to_timestamp(plain, F.lit(f)) for f in MONTHS])
    return (
        F.when(s.rlike(iso), F.regexp_extract(s, iso, 1))
        .when(day.isNotNull(), F.date_format(day, "yyyy-MM-dd"))
        .when(month.isNotNull(), F.date_format(month, "yyyy-MM"))
        .when(s.rlike(r"^(19|20)\d{2}$"), s)
        .otherwise("")
    )


def parse_date(c: Column | str) -> Column:
    """normalize_date(), or the trimmed text itself where no date is found."""
    found = normalize_date(c)
    return F.when(found != "", found).otherwise(strip(text_or_empty(c)))


def pdf_date(c: Column | str) -> Column:
    """D:YYYYMMDD... of PDF metadata."""
    s = F.regexp_extract(text_or_empty(c), r"(\d{4})(\d{2})(\d{2})", 0)
    return F.when(s != "", F.concat_ws("-", F.substring(s, 1, 4), F.substring(s, 5, 2), F.substring(s, 7, 2))).otherwise("")


def split_authors(c: Column | str) -> Column:
    parts = F.split(text_or_empty(c), r"\n+|,|;|(?U)\s+&\s+|(?U)\s+and\s+|\|")
    tidy = F.transform(parts, lambda p: F.regexp_replace(F.regexp_replace(p, r"(?U)\s+", " "), "^[ .:\\-–—]+|[ .:\\-–—]+$", ""))
    return F.filter(tidy, lambda p: p != "")


def looks_like_name(c: Column) -> Column:
    s = F.trim(c)
    return F.length(s).between(3, 60) & ~s.rlike(r"\d") & ~F.lower(s).isin(*NOT_NAMES) & s.rlike(NAME)


def clean_authors(c: Column | str, known: Column | None = None) -> Column:
    """Plausible names in first-seen order; `known` maps lower-case names to their canonical spelling."""
    cand = split_authors(c)
    if known is not None:
        cand = F.transform(cand, lambda n: F.coalesce(F.try_element_at(known, F.lower(n)), F.when(looks_like_name(n), n)))
        return F.array_distinct(F.filter(cand, lambda n: n.isNotNull()))
    return F.array_distinct(F.filter(cand, looks_like_name))


def source_priority(c: Column | str) -> Column:
    out = None
    for k, v in C.SOURCE_PRIORITY.items():
        out = F.when(F.lower(col(c)) == k, v) if out is None else out.when(F.lower(col(c)) == k, v)
    return out.otherwise(C.DEFAULT_PRIORITY)


def access(c: Column | str) -> Column:
    return F.when(col(c) == C.INTERNAL_SOURCE, "internal").otherwise("public")


def confidence(c: Column | str) -> Column:
    s, out = F.coalesce(col(c), F.lit(0.0)), None
    for name, least in C.CONFIDENCE:
        out = F.when(s >= least, name) if out is None else out.when(s >= least, name)
    return out.otherwise("none")


def decode_categories(c: Column | str) -> Column:
    """Base64 of a URL-encoded, comma-separated list."""
    raw = F.decode(F.unbase64(text_or_empty(c)), "UTF-8")
    return F.filter(F.transform(F.split(F.try_url_decode(raw), ","), strip), lambda x: x != "")


def year(c: Column | str) -> Column:
    return F.regexp_extract(text_or_empty(c), r"((?:19|20)\d{2})", 1)


def local_due(now: Column, zone: str, at: str, last_run: Column) -> Column:
    """Schedule gate: past the local time of day, and not yet run on this local date."""
    local = F.convert_timezone(F.lit("UTC"), F.lit(zone), now.cast("timestamp_ntz"))
    return (F.date_format(local, "HH:mm") >= at) & (last_run.isNull() | (F.to_date(local) > last_run))


def next_local(now: Column, zone: str, at: str) -> Column:
    """The next time (UTC) at which the zone's clock shows `at`, after now."""
    local = F.convert_timezone(F.lit("UTC"), F.lit(zone), now.cast("timestamp_ntz"))
    day = F.when(F.date_format(local, "HH:mm") < at, F.to_date(local)).otherwise(F.date_add(F.to_date(local), 1))
    return F.convert_timezone(F.lit(zone), F.lit("UTC"), F.concat_ws(" ", day.cast("string"), F.lit(f"{at}:00")).cast("timestamp_ntz"))


def display_name(c: Column | str, names: dict[str, str] | None = None) -> Column:
    """A source's name for readers: the given one, or its words with capitals."""
    out = F.initcap(F.regexp_replace(text_or_empty(c), "[_-]+", " "))
    for k, v in (names or {}).items():
        out = F.when(F.lower(col(c)) == k, v).otherwise(out)
    return out
