"""Postings of applicant systems' boards: for each platform, where its payload keeps a record's fields.

A payload is one posting's JSON as text. Rules are data: JSON paths by field, the first that isn't
empty wins. What a platform doesn't give is null, so a later step may fill it.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import chain

from pyspark.sql import Column, DataFrame, functions as F

from hirelake.functions.content import html_to_text
from hirelake.functions.locations import parsed
from hirelake.functions.names import title_passes
from hirelake.functions.salary import normalized
from hirelake.functions.urls import title_from_slug

#: JSON paths of the fields by platform.
RULES: dict[str, dict[str, Sequence[str]]] = {
    "greenhouse": {
        "title": ("title",), "url": ("absolute_url",), "location": ("location.name",), "html": ("content",), "cents_min": ("pay_input_ranges[0].min_cents",),
        "cents_max": ("pay_input_ranges[0].max_cents",), "currency": ("pay_input_ranges[0].currency_type",), "interval": ("pay_input_ranges[0].title",), "posted": ("first_published",), "refreshed": ("updated_at",), "source_id": ("id",),
    },
    "lever": {
        "title": ("text",), "url": ("hostedUrl", "applyUrl"), "location": ("categories.location", "categories.team"), "body": ("descriptionPlain",), "pay_min": ("salaryRange.min",), "pay_max": ("salaryRange.max",),
        "currency": ("salaryRange.currency",), "interval": ("salaryRange.interval",), "posted_ms": ("createdAt",), "source_id": ("id",), "workplace": ("workplaceType",),
    },
    "ashby": {
        "title": ("title",), "url": ("jobUrl", "applyUrl"), "location": ("location",), "body": ("descriptionPlain",), "html": ("descriptionHtml",), "pay_min": ("compensation.base_salary[0].min",),
        "pay_max": ("compensation.base_salary[0].max",), "currency": ("compensation.base_salary[0].currency",), "interval": ("compensation.base_salary[0].interval",), "posted": ("publishedAt",), "source_id": ("id",), "remote": ("isRemote",),
    },
    "smartrecruiters": {"title": ("name",), "location": ("location.city", "location.region", "location.country"), "posted": ("releasedDate",), "source_id": ("id",), "remote": ("location.remote",)},
    "workday": {"title": ("title",), "path": ("externalPath",), "location": ("locationsText",)},
    "recruitee": {"title": ("title",), "url": ("careers_url", "url"), "location": ("location", "city"), "html": ("description",)},
    "breezy": {"title": ("name", "title"), "url": ("url",), "location": ("location.name",), "html": ("description",)},
    "jazzhr": {"title": ("title",), "url": ("board_url", "url"), "location": ("city", "state", "country"), "html": ("description",)},
    "personio": {"title": ("name",), "url": ("url",), "location": ("office",), "html": ("jobDescriptions",)},
    "teamtailor": {"title": ("attributes.title", "title"), "url": ("links.careersite-job-url", "url"), "location": ("location",), "html": ("attributes.body", "body")},
    "workable": {"title": ("title",), "url": ("url", "shortlink"), "location": ("city", "state", "country"), "html": ("description",)},
    "paylocity": {"title": ("JobTitle", "title"), "url": ("url",), "location": ("LocationName",), "html": ("Description",)},
    "pinpoint": {
        "title": ("title",), "url": ("url",), "location": ("location.city", "location.province", "location.name"), "html": ("description",), "pay_min": ("compensation_minimum",), "pay_max": ("compensation_maximum",),
        "currency": ("compensation_currency",), "interval": ("compensation_frequency",), "source_id": ("id",),
    },
    "bamboohr": {"title": ("jobOpeningName",), "url": ("url",), "location": ("location.city", "location.state")},
    "rippling": {"title": ("name",), "url": ("url",), "location": ("workLocation.label",)},
    "microsoft": {"title": ("title",), "url": ("url",), "location": ("properties.primaryLocation",), "posted": ("postingDate",), "source_id": ("jobId",)},
    "eightfold": {"title": ("name",), "url": ("canonicalPositionUrl",), "location": ("location",), "source_id": ("id",)},
    "ibm": {"title": ("title",), "url": ("url",), "location": ("field_keyword_19",), "source_id": ("id",)},
    "adp": {"title": ("requisitionTitle",), "url": ("url",), "location": ("requisitionLocations[0].nameCode.shortName",), "posted": ("postDate",), "source_id": ("itemID",)},
    "oracle_cloud": {"title": ("Title",), "url": ("url",), "location": ("PrimaryLocation",), "html": ("ShortDescriptionStr",)},
    "ultipro": {"title": ("Title",), "url": ("url",), "location": ("Locations[0].Address.City", "Locations[0].Address.State.Code"), "html": ("BriefDescription",), "source_id": ("Id",)},
    "successfactors": {"title": ("jobtitle", "title"), "url": ("url",), "location": ("location",), "body": ("description",), "posted": ("posted_date",), "source_id": ("req_id",)},
    "amazon": {"title": ("title",), "url": ("job_path",), "location": ("normalized_location", "location"), "html": ("description",)},
    "phenom": {"url": ("loc", "url")},
    "icims": {"title": ("title",), "url": ("url",), "location": ("location",)},
}
#: Platforms whose location is the join of its parts, in the order of the paths.
JOINED = ("smartrecruiters", "jazzhr", "workable", "pinpoint", "bamboohr", "ultipro")
#: Words of an interval, in order, and the period they stand for.
INTERVALS = (("year", "annual"), ("annual", "annual"), ("hour", "hourly"), ("month", "monthly"), ("week", "weekly"), ("day", "daily"))


def period_of(interval: Column) -> Column:
    out = F.lit("unknown")
    for word, period in reversed(INTERVALS):
        out = F.when(F.contains(F.lower(interval), F.lit(word)), period).otherwise(out)
    return out


def record(payload: Column, platform: str, slug: Column | None = None) -> dict[str, Column]:
    """The fields of one platform's payload."""
    rule, none = RULES[platform], F.lit(None).cast("string")

    def each(name: str) -> list[Column]:
        return [F.nullif(F.trim(F.get_json_object(payload, f"$.{p}")), F.lit("")) for p in rule.get(name, ())]

    def first(name: str) -> Column:
        return F.coalesce(*each(name), none)

    slug = none if slug is None else slug
    place = F.nullif(F.concat_ws(", ", *each("location")), F.lit("")) if platform in JOINED else first("location")
    remote = F.lower(F.coalesce(first("remote"), first("workplace")))
    url, ident, title = first("url"), first("source_id"), first("title")
    if platform == "ashby":
        place = F.coalesce(place, F.when(remote == "true", "Remote"))
    if platform == "smartrecruiters":
        url = F.concat(F.lit("https://jobs.smartrecruiters.com/"), slug, F.lit("/"), ident)
    if platform == "workday":
        url = F.concat(F.lit("https://"), slug, F.lit(".myworkdayjobs.com"), first("path"))
        ident = F.nullif(F.regexp_extract(first("path"), r"_([^_/]+)$", 1), F.lit(""))
    if platform == "amazon":
        url = F.concat(F.lit("https://www.amazon.jobs"), url)
    if platform == "phenom":
        title = title_from_slug(url)
    cents = [first(n).try_cast("double") / 100 for n in ("cents_min", "cents_max")]
    low, high = (F.coalesce(first(n).try_cast("double"), c) for n, c in zip(("pay_min", "pay_max"), cents, strict=True))
    period = period_of(first("interval"))
    posted = F.coalesce(first("posted").try_cast("timestamp"), F.timestamp_millis(first("posted_ms").try_cast("long")))
    return {
        "title": title, "url": url, "location": place, "body": F.coalesce(first("body"), html_to_text(first("html"))), "source_id": ident, "posted": posted,
        "posted_precision": F.when(posted.isNotNull(), "exact"), "refreshed": first("refreshed").try_cast("timestamp"), "is_remote": F.when(remote.isNotNull(), remote.isin("true", "remote")),
        "pay_low": low, "pay_high": high, "period": F.when(low.isNotNull() | high.isNotNull(), period), "currency": F.upper(first("currency")),
    }


def record_of(payload: Column, platform: Column, slug: Column) -> Column:
    """The fields of payloads of any platform as one struct: the rules are looked up by the row's platform, so one plan maps them all. Unknown platforms: nulls."""
    names = sorted({n for rule in RULES.values() for n in rule})
    # each platform's paths, a field an array, looked up once a row
    rules = F.create_map(*chain.from_iterable((F.lit(p), F.struct(*(F.array(*(F.lit(f"$.{x}") for x in rule.get(n, ()))).cast("array<string>").alias(n) for n in names))) for p, rule in RULES.items()))

    def looked_up(row: Column) -> Column:
        def each(n: str) -> Column:
            return F.filter(F.transform(row["rule"][n], lambda p: F.nullif(F.trim(F.call_function("get_json_object", row["payload"], p)), F.lit(""))), lambda v: v.isNotNull())

        return F.struct(*(row[n].alias(n) for n in ("payload", "platform", "slug")), *(each(n).alias(n) for n in names))

    def fields(row: Column) -> Column:
        kind, first = row["platform"], {n: F.get(row[n], F.lit(0)) for n in names}
        remote = F.lower(F.coalesce(first["remote"], first["workplace"]))
        place = F.when(kind.isin(*JOINED), F.nullif(F.array_join(row["location"], ", "), F.lit(""))).when((kind == "ashby") & (remote == "true"), F.coalesce(first["location"], F.lit("Remote"))).otherwise(first["location"])
        url = (
            F.when(kind == "smartrecruiters", F.concat(F.lit("https://jobs.smartrecruiters.com/"), row["slug"], F.lit("/"), first["source_id"]))
            .when(kind == "workday", F.concat(F.lit("https://"), row["slug"], F.lit(".myworkdayjobs.com"), first["path"]))
            .when(kind == "amazon", F.concat(F.lit("https://www.amazon.jobs"), first["url"])).otherwise(first["url"])
        )
        ident = F.when(kind == "workday", F.nullif(F.regexp_extract(first["path"], r"_([^_/]+)$", 1), F.lit(""))).otherwise(first["source_id"])
        posted = F.coalesce(first["posted"].try_cast("timestamp"), F.timestamp_millis(first["posted_ms"].try_cast("long")))
        low, high = (F.coalesce(first[f"pay_{x}"].try_cast("double"), first[f"cents_{x}"].try_cast("double") / 100) for x in ("min", "max"))
        return F.struct(
            F.when(kind == "phenom", title_from_slug(first["url"])).otherwise(first["title"]).alias("title"), url.alias("url"), place.alias("location"),
            F.coalesce(first["body"], html_to_text(first["html"])).alias("body"), ident.alias("source_id"), posted.alias("posted"), F.when(posted.isNotNull(), "exact").alias("posted_precision"),
            first["refreshed"].try_cast("timestamp").alias("refreshed"), F.when(remote.isNotNull(), remote.isin("true", "remote")).alias("is_remote"), low.alias("pay_low"), high.alias("pay_high"),
            F.when(low.isNotNull() | high.isNotNull(), period_of(first["interval"])).alias("period"), F.upper(first["currency"]).alias("currency"),
        )

    # the row's values pass through arrays of one, so that no step repeats the one before it
    once = F.array(F.struct(payload.alias("payload"), platform.alias("platform"), slug.alias("slug"), F.try_element_at(rules, platform).alias("rule")))
    return F.get(F.transform(F.transform(once, looked_up), fields), F.lit(0))


def records(payloads: DataFrame, platform: str, payload: str = "payload", wanted: tuple[str, ...] = (), unwanted: tuple[str, ...] = (), slug: str | None = None) -> DataFrame:
    """One row per payload whose raw title passes the gate, with its locations parsed; without title or URL it is left out."""
    fields = record(F.col(payload), platform, F.col(slug) if slug else None)
    out = payloads.withColumns(fields).where(F.col("title").isNotNull() & F.col("url").isNotNull())
    if wanted or unwanted:
        out = out.where(title_passes(F.col("title"), wanted, unwanted))
    pay = normalized(F.col("pay_low"), F.col("pay_high"), F.col("period"), F.lit("ats_structured"))
    return out.withColumns({"platform": F.lit(platform), "locations": parsed(F.col("location")), "salary": F.when(F.col("period").isNotNull(), pay)})
