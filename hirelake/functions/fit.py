"""Fit classes, heuristic factors and location fit, as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from hirelake.functions.ratios import fuzzy
from hirelake.functions.vocab import TERMINAL_TIERS

#: Seniority words and their factor, in order; penalty words come first.
SENIORITY = (("staff", 100), ("principal", 100), ("lead", 90), ("senior", 80), ("sr.", 80), ("manager", 85), ("head of", 90), ("director", 70))
PENALTY = ("junior", "jr.", "associate", "entry", "intern")


def _sum(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns)


def classified(
    axes: list[Column], legitimacy_note: Column, tier: Column, body_length: Column, degenerate: Column,
    least_body: int = 1500, apply_mean: float = 3.5, strong: int = 3,
) -> Column:
    """The fit class of six sub-scores; null (to be quarantined) where they aren't six whole numbers from 1 to 5."""
    valid = reduce(lambda a, b: a & b, [F.coalesce(x.between(1, 5), F.lit(False)) for x in axes])
    n_strong = _sum([(x >= 4).cast("int") for x in axes])
    every = lambda test: reduce(lambda a, b: a & b, [test(x) for x in axes])
    return (
        F.when(F.coalesce(F.trim(legitimacy_note), F.lit("")) != "", "reject")
        .when(F.coalesce(degenerate, F.lit(False)), "low_signal")
        .when(tier.isin(*TERMINAL_TIERS) & (F.coalesce(body_length, F.lit(0)) < least_body), "low_signal")
        .when(~valid, None)
        .when(every(lambda x: x == 3), "low_signal")
        .when(~every(lambda x: x != 1), "reject")
        .when(every(lambda x: x >= 3) & (n_strong >= strong) & (_sum(axes) / len(axes) >= apply_mean), "apply")
        .when(every(lambda x: x >= 2), "consider")
        .otherwise("skip")
    )


def target_member(axes: list[Column], classification: Column, floor: float = 3.5) -> Column:
    """Scored, with a mean of at least the floor and not rejected; a null class isn't a member."""
    mean = _sum(axes) / len(axes)
    return F.coalesce((mean >= floor) & ~classification.isin("reject", "low_signal"), F.lit(False))


def composite(axes: list[Column]) -> Column:
    return _sum([F.coalesce(x, F.lit(0)) for x in axes])


def seniority_factor(title: Column) -> Column:
    low = F.lower(title)
    out = F.lit(40)
    for word, value in reversed(SENIORITY):
        out = F.when(F.contains(low, F.lit(word)), value).otherwise(out)
    for word in PENALTY:
        out = F.when(F.contains(low, F.lit(word)), 0).otherwise(out)
    return out


def salary_factor(low: Column, high: Column, wanted: float) -> Column:
    """By the middle against the wanted salary; a bound of 0 counts as absent unless both are missing."""
    some = lambda x: F.coalesce(x, F.lit(0)) != 0
    middle = F.when(some(low) & some(high), (low + high) / 2).when(some(high), high).otherwise(F.coalesce(low, F.lit(0)))
    return (
        F.when(low.isNull() & high.isNull(), 50).when(middle >= wanted * 1.2, 100).when(middle >= wanted, 85)
        .when(middle >= wanted * 0.8, 50).otherwise(10)
    )


def recency_factor(posted: Column, as_of: Column) -> Column:
    days = (F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(posted.cast("timestamp"))) / 86_400_000_000
    return F.when(posted.isNull(), 50).when(days < 1, 100).when(days < 3, 85).when(days < 7, 65).when(days < 14, 40).otherwise(20)


def industry_factor(text: Column, industries: tuple[str, ...]) -> Column:
    if not industries:
        return F.lit(50)
    low = F.lower(text)
    n = _sum([F.contains(low, F.lit(i.lower())).cast("int") for i in industries])
    return F.when(n >= 2, 100).when(n == 1, 75).otherwise(30)


def title_factor(title: Column, targets: tuple[str, ...], unwanted: tuple[str, ...] = ()) -> Column:
    """50 without targets, 0 with an unwanted phrase, else the best ratio of sorted words against a target."""
    if not targets:
        return F.lit(50)
    low = F.lower(title)
    best = F.greatest(*(fuzzy(low, F.lit(t.lower()), "token_sort") for t in targets), F.lit(0))
    out = best
    for phrase in unwanted:
        out = F.when(F.contains(low, F.lit(phrase.lower())), 0).otherwise(out)
    return out


def place_factor(location: Column, targets: tuple[str, ...]) -> Column:
    """50 without targets, 100 for remote, 90 for the whole United States, else the best partial ratio against a target."""
    if not targets:
        return F.lit(50)
    low = F.lower(location)
    best = F.greatest(*(fuzzy(low, F.lit(t.lower()), "partial") for t in targets), F.lit(0))
    return F.when(F.contains(low, F.lit("remote")), 100).when(low.isin("united states", "us", "usa"), 90).otherwise(best)


def company_factor(company: Column, unwanted: tuple[str, ...]) -> Column:
    return F.when(F.lower(company).isin(*[c.lower() for c in unwanted]), 0).otherwise(50)


def heuristic_score(factors: dict[str, Column], weights: dict[str, float]) -> Column:
    """The weighted sum, to one digit by halves to even."""
    return F.bround(_sum([factors[k].cast("double") * F.lit(float(weights.get(k, 0))) for k in factors]), 1)


def location_fit(locations: Column, targets: tuple[str, ...], home: str | None = None, prefers_remote: bool = False) -> Column:
    """5, 4, 1 or null for an array of struct(city, region, country, country_code, workplace_type).

    targets in small letters; "remote" among them means remote work is wanted.
    """
    remote_wanted = "remote" in targets
    places = [t for t in targets if t != "remote"]

    def matches(x: Column) -> Column:
        hits = [F.lit(False)]
        for t in places:
            for part in (x["city"], x["region"]):
                low = F.coalesce(F.lower(part), F.lit(""))
                hits.append((low != "") & (F.contains(low, F.lit(t)) | F.contains(F.lit(t), low)))
            hits.append(F.contains(F.coalesce(F.lower(x["country"]), F.lit("")), F.lit(t)))
        return reduce(lambda a, b: a | b, hits)

    is_remote = lambda x: F.coalesce(x["workplace_type"], F.lit("")) == "REMOTE"
    presence = lambda x: F.coalesce(x["workplace_type"], F.lit("")).isin("HYBRID", "ONSITE")
    code = lambda x: x["country_code"]
    geo = lambda x: x["city"].isNotNull() | x["country_code"].isNotNull()
    some = F.exists(locations, matches)
    out = F.when(some, 5)
    if home:
        away = F.forall(locations, lambda x: ~is_remote(x) & F.coalesce(code(x) != home, F.lit(False)))
        out = F.when(away & ~some, 1).otherwise(out)
    if prefers_remote:
        out = F.when(F.forall(locations, lambda x: presence(x) & geo(x)), 1).otherwise(out)
        out = F.when(F.exists(locations, lambda x: presence(x) & matches(x)), 4).otherwise(out)
    if home:
        out = F.when(F.forall(locations, lambda x: is_remote(x) & F.coalesce(code(x) != home, F.lit(False))), 1).otherwise(out)
    if home and remote_wanted:
        out = F.when(F.exists(locations, lambda x: is_remote(x) & F.coalesce(code(x) == home, F.lit(False))), 5).otherwise(out)
    if remote_wanted:
        out = F.when(F.exists(locations, lambda x: is_remote(x) & code(x).isNull()), 5).otherwise(out)
    return F.when(F.coalesce(F.size(locations), F.lit(0)) > 0, out)
