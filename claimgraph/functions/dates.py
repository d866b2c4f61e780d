"""Dates that come as text in many forms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from claimgraph.functions.text import let, unescape

# Shapes of dates, and the form that reads each: only one is tried, since a text that fails to parse costs many times one that does.
DAY = r"[0-9]{1,2} [A-Z][a-z]{2} [0-9]{4}"
FORMS = {
    r"[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}[+-][0-9]{4}": "yyyy-MM-dd'T'HH:mm:ssZ",
    r"[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}": "yyyy-MM-dd'T'HH:mm:ss",
    r"[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}[+-][0-9]{4}": "yyyy-MM-dd'T'HH:mmZ",
    r"[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}": "yyyy-MM-dd'T'HH:mm",
    r"[0-9]{4}-[0-9]{2}-[0-9]{2}": "yyyy-MM-dd",
    DAY + r" [0-9]{1,2}:[0-9]{2}:[0-9]{2} [+-][0-9]{4}": "d MMM yyyy H:mm:ss Z",
    DAY + r" [0-9]{1,2}:[0-9]{2} [+-][0-9]{4}": "d MMM yyyy H:mm Z",
    DAY + r" [0-9]{1,2}:[0-9]{2}:[0-9]{2}": "d MMM yyyy H:mm:ss",
    DAY + r" [0-9]{1,2}:[0-9]{2}": "d MMM yyyy H:mm",
    DAY: "d MMM yyyy",
    r"[A-Z][a-z]{2} [0-9]{1,2}, [0-9]{4}": "MMM d, yyyy",
    r"[0-9]{4}-[0-9]{2}": "yyyy-MM",
    r"[A-Z][a-z]{2} [0-9]{4}": "MMM yyyy",
    r"[0-9]{4}": "yyyy",
}
# Names of zones in mail dates.
ZONES = {"GMT": "+0000", "UTC": "+0000", "UT": "+0000", "EST": "-0500", "EDT": "-0400", "CST": "-0600", "CDT": "-0500", "MST": "-0700", "MDT": "-0600", "PST": "-0800", "PDT": "-0700"}
MONTH = r"(?:Jan(?:uary)?|Feb(?:ruary)?|Mar(?:ch)?|Apr(?:il)?|May|June?|July?|Aug(?:ust)?|Sep(?:tember)?|Oct(?:ober)?|Nov(?:ember)?|Dec(?:ember)?)"
IN_WORDS = rf"(?i)\b{MONTH}\s+[0-9]{{1,2}},\s+[0-9]{{4}}\b"
ISO = r"^([0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{8})(?:[T ](?:[01][0-9]|2[0-3])(?::?[0-5][0-9](?::?[0-5][0-9](?:[.,][0-9]+)?)?)?(?:Z|[+-][0-9]{2}(?::?[0-9]{2}(?::?[0-9]{2})?)?)?)?$"
# Meta keys that name the day of publication, and the characters around a heading that are searched for it.
META_KEYS = ("article:published_time", "datepublished", "publishdate")
NEAR = 1800


def parse_date(text: Column) -> Column:
    """A date, or date and time, in any of FORMS, as a timestamp in UTC; null if none fits.

    A weekday in front, fractions of a second and the rest of a month's name are passed over; zones may be names of ZONES,
    Z, or hours with or without a colon; without one, UTC.
    """
    plain = F.regexp_replace(F.trim(text), r"\s+", " ")
    plain = F.regexp_replace(plain, r"^[A-Za-z]{3,9},\s*", "")
    plain = F.regexp_replace(plain, r"(?i)\b(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\.?", "$1")
    for name in ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"):
        plain = F.regexp_replace(plain, rf"(?i)\b{name}\b", name)
    plain = F.regexp_replace(plain, r"([0-9]{2}:[0-9]{2}:[0-9]{2})[.,][0-9]+", "$1")
    plain = F.regexp_replace(plain, r"(?<=[0-9]{2}) ?Z$", "+0000")
    plain = F.regexp_replace(plain, r"([+-][0-9]{2}):([0-9]{2})$", "$1$2")
    plain = F.regexp_replace(plain, r"^([0-9]{4}-[0-9]{2}-[0-9]{2})[T ]([0-9]{2}:)", "$1T$2")
    plain = F.regexp_replace(plain, r"^([0-9]{4}-[0-9]{2}-[0-9]{2}T\S+) ([+-])", "$1$2")
    for name, zone in ZONES.items():
        plain = F.regexp_replace(plain, rf" {name}$", f" {zone}")
    plain = F.regexp_replace(plain, r"^([0-9]{4}-[0-9]{2}-[0-9]{2}T\S+) ([+-])", "$1$2")

    def read(x: Column) -> Column:
        out = F
        for shape, form in FORMS.items():
            out = out.when(x.rlike(f"^{shape}$"), F.try_to_timestamp(x, F.lit(form)))
        return out

    return F.transform(F.array(plain), read)[0]


def freshness(text: Column) -> Column:
    """An ISO time in UTC of '2024-03-05 10:00 UTC', '2024-03-05 10:00', '2024-03-05T10:00:00+00:00' or '2024-03-05', the last with '|dateonly' behind; else null. No age is told."""
    t = F.trim(text)
    minute, stamp = t.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2} [0-9]{2}:[0-9]{2}( UTC)?$"), t.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}(Z|[+-][0-9]{2}:?[0-9]{2})$")
    day = t.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$")
    return F.when(minute | stamp | day, F.concat(F.date_format(parse_date(t), "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.when(day, "|dateonly").otherwise("")))


def date_in_url(url: Column) -> Column:
    """The date of a path with /2024/03/05 or /2024/Mar/05; null if there is none."""
    named = F.regexp_extract(url, rf"(?i)/([0-9]{{4}}/{MONTH}/[0-9]{{1,2}})(?:/|$)", 1)
    in_words = F.concat(F.initcap(F.substring(named, 6, 3)), F.lit(" "), F.regexp_extract(named, "[0-9]+$", 0), F.lit(", "), F.substring(named, 1, 4))
    numbers = F.try_to_timestamp(F.regexp_replace(F.nullif(F.regexp_extract(url, r"/((?:19|20)[0-9]{2}/[0-9]{1,2}/[0-9]{1,2})(?:/|$)", 1), F.lit("")), "/", "-"), F.lit("yyyy-M-d")).cast("date")
    return F.coalesce(numbers, F.when(named != "", F.try_to_timestamp(in_words, F.lit("MMM d, yyyy"))).cast("date"))


def published(text: Column) -> Column:
    """The day of an ISO date or date and time, in its own zone, or of 'March 5, 2024' or 'Mar 5, 2024'; else null."""
    # Parsed only where the form fits: a text that fails to parse costs many times one that does.
    def parsed(x: Column) -> Column:
        iso = F.regexp_replace(F.regexp_extract(x, ISO, 1), "-", "")
        form = F.when(x.rlike("^[A-Za-z]{3} "), "MMM d, yyyy").otherwise("MMMM d, yyyy")
        return F.when(iso != "", F.try_to_timestamp(iso, F.lit("yyyyMMdd"))).when(x.rlike("^[A-Za-z]{3,9} [0-9]{1,2}, [0-9]{4}$"), F.try_to_timestamp(F.initcap(x), form)).cast("date")

    plain = lambda x: F.regexp_replace(F.trim(F.when(x.contains("&"), unescape(x)).otherwise(x)), r"\s+", " ")
    return let(text, lambda x: F.when(x.rlike("[0-9]"), let(plain(x), parsed)))


def page_date(html: Column) -> Column:
    """The day a page says it was published: datePublished of its JSON, else its meta tags, else the date in words nearest to the first h1, of those within NEAR characters; of equally near ones the first. Null if there is none."""
    return let(F.coalesce(html, F.lit("")), day_of_page)


def day_of_page(raw: Column) -> Column:
    """``page_date`` of a page that is there; each part of it is found once, and later ones only where earlier ones say nothing."""

    def of_meta(tag: Column) -> Column:
        attr = lambda name: F.coalesce(F.try_element_at(F.regexp_extract_all(tag, F.lit(rf"(?i)(?<![:\w-]){name}\s*=\s*[\"']([^\"']*)[\"']"), 1), F.lit(-1)), F.lit(""))
        key = F.lower(F.coalesce(*[F.nullif(attr(n), F.lit("")) for n in ("property", "name", "itemprop")]))
        return F.when(key.isin(*META_KEYS), published(attr("content")))

    metas = F.filter(F.transform(F.regexp_extract_all(raw, F.lit(r"(?i)<meta\b[^>]*>"), 0), of_meta), lambda d: d.isNotNull())

    def nearest(at: Column) -> Column:
        begin = F.greatest(at - NEAR, F.lit(0))
        # A match begins after the matches before it and the text between them.
        length = lambda xs, n: F.aggregate(F.slice(xs, 1, n), F.lit(0), lambda a, x: a + F.length(x))

        def placed(x: Column) -> Column:
            told, between = x["told"], x["between"]
            return F.transform(told, lambda d, i: F.struct(F.abs(begin + length(between, i + 1) + length(told, i) - at).alias("off"), i.alias("i"), d.alias("d")))

        split = lambda region: F.struct(F.regexp_extract_all(region, F.lit(IN_WORDS), 0).alias("told"), F.split(region, IN_WORDS).alias("between"))
        places = let(let(F.substr(raw, begin + 1, at + NEAR - begin), split), placed)
        return published(F.array_min(places)["d"])

    near = let(F.split(raw, r"(?i)<h1\b", 2), lambda parts: F.when(F.size(parts) > 1, let(F.length(F.get(parts, F.lit(0))), nearest)))
    return F.coalesce(published(F.regexp_extract(raw, r"(?i)[\"']datePublished[\"']\s*:\s*[\"']([^\"']+)[\"']", 1)), F.get(metas, F.lit(0)), near)


def day_bucket(age: Column) -> Column:
    """Heading of an age in days."""
    return F.when(age.isNull(), "Date not stated").when(age <= 0, "Today").when(age == 1, "Yesterday").when(age < 7, "Earlier this week").when(age < 31, "Earlier this month").otherwise("Older")


def too_old(age: Column, limit: Column) -> Column:
    """Strictly older than the limit; what has no date is never too old."""
    return F.coalesce(age > limit, F.lit(False))
