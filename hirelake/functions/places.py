"""Places and times of postings: normal forms, workplace types, business days, platforms of URLs."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, functions as F

from hirelake.functions.urls import host, path

#: Texts that name no place.
PLACEHOLDERS = (
    "n/a", "na", "none", "null", "unknown", "unspecified", "not specified", "tbd", "various", "various locations",
    "multiple locations", "multiple", "anywhere", "location", "-",
)
#: Hosts of applicant systems and the platform they stand for.
PLATFORMS = (
    ("greenhouse.io", "greenhouse"), ("lever.co", "lever"), ("ashbyhq.com", "ashby"), ("smartrecruiters.com", "smartrecruiters"),
    ("myworkdayjobs.com", "workday"), ("recruitee.com", "recruitee"), ("breezy.hr", "breezy"), ("bamboohr.com", "bamboohr"),
    ("workable.com", "workable"), ("teamtailor.com", "teamtailor"), ("icims.com", "icims"), ("jobvite.com", "jobvite"),
)
REMOTE, HYBRID, ONSITE = r"(?i)\b(?:remote|work from home|wfh|telecommute)\b", r"(?i)\bhybrid\b", r"(?i)\b(?:on-?site|in[- ]office)\b"


def place(raw: Column) -> Column:
    """Trimmed of marks and squeezed; null for a placeholder."""
    out = F.regexp_replace(F.regexp_replace(raw, r"\s+", " "), r"^[\s,;|/.\-]+|[\s,;|/.\-]+$", "")
    return F.when((out != "") & ~F.lower(out).isin(*PLACEHOLDERS), out)


def places(raw: Column) -> Column:
    """The places of a text that names several, in order, each once without regard to case."""
    parts = F.filter(F.transform(F.split(raw, r"\s*(?:\||;|\s/\s|&|\bor\b)\s*"), place), lambda p: p.isNotNull())
    keys = F.transform(parts, lambda p: F.lower(p))
    return F.filter(parts, lambda p, i: F.array_position(keys, F.get(keys, i)) == i + 1)


def workplace(text: Column) -> Column:
    """REMOTE before HYBRID before ONSITE, else UNSPECIFIED."""
    like = lambda p: F.coalesce(F.regexp_like(text, F.lit(p)), F.lit(False))
    return F.when(like(REMOTE), "REMOTE").when(like(HYBRID), "HYBRID").when(like(ONSITE), "ONSITE").otherwise("UNSPECIFIED")


def platform(url: Column) -> Column:
    """struct(platform, slug) of a posting's URL; null for a host of none."""
    h, out = F.coalesce(host(url), F.lit("")), None
    slug = F.nullif(F.regexp_extract(path(url), r"^/([^/]+)", 1), F.lit(""))
    for domain, name in PLATFORMS:
        hit = (h == domain) | F.endswith(h, F.lit("." + domain))
        value = F.struct(F.lit(name).alias("platform"), slug.alias("slug"))
        out = F.when(hit, value) if out is None else out.when(hit, value)
    return out


def business_days_before(day: date, n: int) -> date:
    """The day n weekdays before; a weekend day itself doesn't count."""
    while n:
        day -= timedelta(days=1)
        n -= day.weekday() < 5
    return day


def local_day_start(ts: Column, zone: str, offset_days: int = 0) -> Column:
    """The UTC time at which the local day of ts begins, moved by whole days."""
    local = F.date_trunc("day", F.from_utc_timestamp(ts, zone))
    return F.to_utc_timestamp(local + F.make_dt_interval(F.lit(offset_days)), zone)


def local_day_window(ts: Column, zone: str) -> Column:
    """struct(start, end): the UTC times between which the local day of ts lies; days of a change of clocks have 23 or 25 hours."""
    return F.struct(local_day_start(ts, zone).alias("start"), local_day_start(ts, zone, 1).alias("end"))


def local_date_time(day: Column, zone: str, end: bool = False) -> Column:
    """The UTC time of a local calendar day's first second, or its last one."""
    local = F.to_timestamp_ntz(F.concat(day.cast("date").cast("string"), F.lit(" 23:59:59" if end else " 00:00:00")))
    return F.to_utc_timestamp(local.cast("timestamp"), zone)


def naive_utc(text: Column) -> Column:
    """A time in text as UTC without a zone (in a session whose zone is UTC): with an offset or Z it is moved, without one it is UTC already; null for what is no time."""
    t = F.trim(text)
    return F.to_timestamp_ntz(F.date_format(t.try_cast("timestamp"), "yyyy-MM-dd HH:mm:ss.SSSSSS"))


#: Words of a location that tell no place apart.
LOCATION_STOP_WORDS = ("united", "states", "usa", "the", "and", "area", "greater", "metro")


def location_tokens(text: Column) -> Column:
    """The distinct words of three letters or digits and more, without the stop words; of null, none."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]{3,}"), F.lit(0))
    return F.array_except(F.array_distinct(words), F.array(*map(F.lit, LOCATION_STOP_WORDS)))


def posted_location(posting: Column) -> Column:
    """The place of a JSON-LD posting's jobLocation: a text as it is; of a place its city, else region, else country, else name; of a list all of them, set apart by " | "."""
    some = lambda x: F.nullif(F.trim(x), F.lit(""))

    def one(place: Column) -> Column:
        at = lambda path: F.get_json_object(place, path)
        address = at("$.address")
        inside = F.coalesce(*(some(at(f"$.address.{n}")) for n in ("addressLocality", "addressRegion", "addressCountry")))
        named = F.when(F.startswith(address, F.lit("{")), inside).when(address.isNotNull(), some(address)).otherwise(some(at("$.name")))
        return F.when(F.startswith(F.ltrim(place), F.lit("{")), named).otherwise(some(F.regexp_replace(place, '^"|"$', "")))

    where = F.get_json_object(posting, "$.jobLocation")
    many = F.array_join(F.filter(F.transform(F.from_json(where, "array<string>"), one), lambda x: x.isNotNull()), " | ")
    return F.coalesce(F.when(F.startswith(F.ltrim(where), F.lit("[")), many).otherwise(one(where)), F.lit(""))


def relative_label(ts: Column, as_of: Column) -> Column:
    days = F.datediff(as_of, ts)
    return (
        F.when(days <= 0, "today").when(days == 1, "yesterday").when(days < 7, F.concat(days.cast("string"), F.lit("d ago")))
        .when(days < 30, F.concat((days / 7).cast("int").cast("string"), F.lit("w ago"))).otherwise(F.concat((days / 30).cast("int").cast("string"), F.lit("mo ago")))
    )
