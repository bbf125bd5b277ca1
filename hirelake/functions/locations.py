"""Locations of postings as arrays of structs: parsing, display form, repeats, merging.

Cities come from CITIES, a short table; a longer one can be given. A city that isn't in it is taken
on the word of the state or country beside it, so without either it stays unresolved.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import chain

from pyspark.sql import Column, functions as F

from hirelake.functions.places import places, workplace

KIND = "struct<city:string,region:string,region_code:string,country:string,country_code:string,workplace_type:string,raw:string,unresolved:boolean>"
#: States and their codes.
STATES = {
    "AL": "Alabama", "AK": "Alaska", "AZ": "Arizona", "AR": "Arkansas", "CA": "California", "CO": "Colorado", "CT": "Connecticut", "DE": "Delaware", "DC": "District of Columbia",
    "FL": "Florida", "GA": "Georgia", "HI": "Hawaii", "ID": "Idaho", "IL": "Illinois", "IN": "Indiana", "IA": "Iowa", "KS": "Kansas", "KY": "Kentucky", "LA": "Louisiana",
    "ME": "Maine", "MD": "Maryland", "MA": "Massachusetts", "MI": "Michigan", "MN": "Minnesota", "MS": "Mississippi", "MO": "Missouri", "MT": "Montana", "NE": "Nebraska",
    "NV": "Nevada", "NH": "New Hampshire", "NJ": "New Jersey", "NM": "New Mexico", "NY": "New York", "NC": "North Carolina", "ND": "North Dakota", "OH": "Ohio", "OK": "Oklahoma",
    "OR": "Oregon", "PA": "Pennsylvania", "RI": "Rhode Island", "SC": "South Carolina", "SD": "South Dakota", "TN": "Tennessee", "TX": "Texas", "UT": "Utah", "VT": "Vermont",
    "VA": "Virginia", "WA": "Washington", "WV": "West Virginia", "WI": "Wisconsin", "WY": "Wyoming",
}
#: Countries and their codes.
COUNTRIES = {
    "AR": "Argentina", "AU": "Australia", "AT": "Austria", "BE": "Belgium", "BR": "Brazil", "BG": "Bulgaria", "CA": "Canada", "CL": "Chile", "CN": "China", "CO": "Colombia",
    "CR": "Costa Rica", "HR": "Croatia", "CZ": "Czechia", "DK": "Denmark", "EG": "Egypt", "EE": "Estonia", "FI": "Finland", "FR": "France", "DE": "Germany", "GR": "Greece",
    "HK": "Hong Kong", "HU": "Hungary", "IN": "India", "ID": "Indonesia", "IE": "Ireland", "IL": "Israel", "IT": "Italy", "JP": "Japan", "KE": "Kenya", "KR": "South Korea",
    "LV": "Latvia", "LT": "Lithuania", "LU": "Luxembourg", "MY": "Malaysia", "MX": "Mexico", "NL": "Netherlands", "NZ": "New Zealand", "NG": "Nigeria", "NO": "Norway",
    "PK": "Pakistan", "PE": "Peru", "PH": "Philippines", "PL": "Poland", "PT": "Portugal", "RO": "Romania", "SA": "Saudi Arabia", "RS": "Serbia", "SG": "Singapore",
    "SK": "Slovakia", "SI": "Slovenia", "ZA": "South Africa", "ES": "Spain", "SE": "Sweden", "CH": "Switzerland", "TW": "Taiwan", "TH": "Thailand", "TR": "Turkey", "UA": "Ukraine",
    "AE": "United Arab Emirates", "GB": "United Kingdom", "US": "United States", "UY": "Uruguay", "VN": "Vietnam",
}
#: Other names of countries.
ALIASES = {"UK": "GB", "U.K.": "GB", "ENGLAND": "GB", "SCOTLAND": "GB", "USA": "US", "U.S.A.": "US", "U.S.": "US", "AMERICA": "US", "UNITED STATES OF AMERICA": "US"}
#: Cities that are known by name alone, with state code and country code.
CITIES = {
    "san francisco": ("CA", "US"), "los angeles": ("CA", "US"), "san diego": ("CA", "US"), "san jose": ("CA", "US"), "new york": ("NY", "US"), "new york city": ("NY", "US"),
    "seattle": ("WA", "US"), "austin": ("TX", "US"), "dallas": ("TX", "US"), "houston": ("TX", "US"), "boston": ("MA", "US"), "chicago": ("IL", "US"), "denver": ("CO", "US"),
    "atlanta": ("GA", "US"), "miami": ("FL", "US"), "philadelphia": ("PA", "US"), "phoenix": ("AZ", "US"), "portland": ("OR", "US"), "london": (None, "GB"), "manchester": (None, "GB"),
    "berlin": (None, "DE"), "munich": (None, "DE"), "hamburg": (None, "DE"), "paris": (None, "FR"), "amsterdam": (None, "NL"), "dublin": (None, "IE"), "madrid": (None, "ES"),
    "barcelona": (None, "ES"), "lisbon": (None, "PT"), "rome": (None, "IT"), "milan": (None, "IT"), "zurich": (None, "CH"), "vienna": (None, "AT"), "warsaw": (None, "PL"),
    "stockholm": (None, "SE"), "toronto": (None, "CA"), "vancouver": (None, "CA"), "montreal": (None, "CA"), "sydney": (None, "AU"), "melbourne": (None, "AU"),
    "bangalore": (None, "IN"), "bengaluru": (None, "IN"), "hyderabad": (None, "IN"), "tel aviv": (None, "IL"), "tokyo": (None, "JP"),
}
#: vendors' labels of workplace types.
WORKPLACE_LABELS = {"ONSITE": "ONSITE", "ON-SITE": "ONSITE", "ON_SITE": "ONSITE", "ON SITE": "ONSITE", "REMOTE": "REMOTE", "HYBRID": "HYBRID", "UNSPECIFIED": "UNSPECIFIED"}

_TOKENS = r"(?i)#LI-(?:Remote|Hybrid|Onsite)\b|\b(?:fully\s+)?remote(?:[\s-]*only)?\b|\bhybrid\b|\bon[\s-]?site\b|\bin[\s-]?office\b"
_TRAIL = r"(?i)\s/\s*((?:fully\s+)?remote(?:[\s-]*only)?|hybrid|on[\s-]?site|in[\s-]?office)\s*$"
_EDGES = r"^[\s,;|/.()\[\]\-–—]+|[\s,;|/.()\[\]\-–—]+$"


def _map(values: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for x in chain.from_iterable(values.items())))


def country_code(name: Column) -> Column:
    """The code of a country by code, name or another name; null for what is none."""
    key = F.upper(F.trim(name))
    by = {**{c: c for c in COUNTRIES}, **{n.upper(): c for c, n in COUNTRIES.items()}, **ALIASES}
    return F.try_element_at(_map(by), key)


def state_code(name: Column) -> Column:
    """The code of a state by code or name; null for what is none."""
    by = {**{c: c for c in STATES}, **{n.upper(): c for c, n in STATES.items()}}
    return F.try_element_at(_map(by), F.upper(F.trim(name)))


def workplace_label(value: Column) -> Column:
    """A vendor's label as a workplace type; UNSPECIFIED for what is none."""
    return F.coalesce(F.try_element_at(_map(WORKPLACE_LABELS), F.upper(F.trim(value))), F.lit("UNSPECIFIED"))


def tagged_workplace(body: Column) -> Column:
    """The workplace type of a body's hashtag; other words of a body don't count."""
    out = F.lit("UNSPECIFIED")
    for kind in ("Onsite", "Hybrid", "Remote"):
        out = F.when(F.regexp_like(body, F.lit(rf"(?i)#LI[-\s]?{kind}\b")), kind.upper()).otherwise(out)
    return out


def _steps(segments: Column, promoted: Column, cities: dict[str, tuple[str | None, str]]) -> Column:
    """Each segment as a location, step by step, so that no step's expression is repeated in the next."""

    known: list[str] = []

    def then(rows: Column, **fields: Callable[[Column], Column]) -> Column:
        """The rows with further fields, each from the row."""
        out = F.transform(rows, lambda x: F.struct(*(x[n].alias(n) for n in known), *(f(x).alias(n) for n, f in fields.items())))
        known.extend(fields)
        return out

    rows = F.transform(segments, lambda s: F.struct(s.alias("raw"), workplace(s).alias("own"), F.regexp_replace(F.regexp_replace(F.regexp_replace(s, _TOKENS, " "), r"\s+", " "), _EDGES, "").alias("rest")))
    known += ["raw", "own", "rest"]
    rows = then(rows, parts=lambda x: F.filter(F.transform(F.split(x["rest"], r"\s*,\s*|\s+[-–—]\s+"), lambda p: F.regexp_replace(p, _EDGES, "")), lambda p: p != ""))
    rows = then(rows, last=lambda x: F.try_element_at(x["parts"], F.lit(-1)))
    rows = then(rows, in_state=lambda x: (F.size(x["parts"]) >= 2) & state_code(x["last"]).isNotNull(), named=lambda x: country_code(x["last"]))
    rows = then(
        rows,
        land=lambda x: F.when(x["in_state"], "US").otherwise(x["named"]),
        left=lambda x: F.when(~x["in_state"] & x["named"].isNotNull(), F.slice(x["parts"], 1, F.greatest(F.size(x["parts"]) - 1, F.lit(0)))).otherwise(x["parts"]),
    )
    rows = then(rows, first=lambda x: F.get(x["left"], F.lit(0)), outer=lambda x: F.when(F.size(x["left"]) >= 2, F.try_element_at(x["left"], F.lit(-1))))
    rows = then(rows, city_land=lambda x: F.try_element_at(_map({c: v[1] for c, v in cities.items()}), F.lower(x["first"])), city_state=lambda x: F.try_element_at(_map({c: v[0] or "" for c, v in cities.items()}), F.lower(x["first"])))
    rows = then(rows, same=lambda x: x["city_land"].isNotNull() & (x["land"].isNull() | (x["land"] == x["city_land"])))
    # a state without a city
    rows = then(rows, alone=lambda x: F.when((F.size(x["left"]) == 1) & ~x["same"] & F.coalesce(x["land"] == "US", F.lit(True)), state_code(x["first"])))
    rows = then(rows, code=lambda x: F.coalesce(x["land"], F.when(x["same"], x["city_land"]), F.when(x["alone"].isNotNull(), F.lit("US"))))
    rows = then(rows, state=lambda x: F.coalesce(F.when(x["code"] == "US", state_code(x["outer"])), x["alone"], F.when(x["same"] & (x["code"] == "US") & x["outer"].isNull(), F.nullif(x["city_state"], F.lit("")))))
    rows = then(rows, city=lambda x: F.when(x["alone"].isNull() & (x["same"] | x["land"].isNotNull()), x["first"]))
    return F.transform(
        rows,
        lambda x: F.struct(
            x["city"].alias("city"), F.when(x["code"].isNotNull(), F.coalesce(F.try_element_at(_map(STATES), x["state"]), x["outer"])).alias("region"), x["state"].alias("region_code"),
            F.try_element_at(_map(COUNTRIES), x["code"]).alias("country"), x["code"].alias("country_code"), F.when(x["own"] != "UNSPECIFIED", x["own"]).otherwise(promoted).alias("workplace_type"),
            x["raw"].alias("raw"), (x["city"].isNull() & x["code"].isNull()).alias("unresolved"),
        ).cast(KIND),
    )


def parsed(raw: Column, body: Column | None = None, cities: dict[str, tuple[str | None, str]] | None = None) -> Column:
    """The locations that a text names, each once; an empty array for none. A body's hashtag fills what the text leaves open."""
    promoted = F.coalesce(F.when(F.regexp_like(raw, F.lit(_TRAIL)), workplace(F.regexp_extract(raw, _TRAIL, 1))), F.lit("UNSPECIFIED"))
    if body is not None:
        promoted = F.when(promoted == "UNSPECIFIED", F.coalesce(tagged_workplace(body), F.lit("UNSPECIFIED"))).otherwise(promoted)
    # the row's values enter as one struct, so that they are worked out once
    once = F.array(F.struct(promoted.alias("promoted"), F.coalesce(places(F.regexp_replace(raw, _TRAIL, "")), F.array().cast("array<string>")).alias("segments")))
    return F.flatten(F.transform(once, lambda r: without_repeats(_steps(r["segments"], r["promoted"], cities or CITIES))))


def _same(x: Column, y: Column, names: tuple[str, ...]) -> Column:
    out = F.lit(True)
    for n in names:
        out = out & x[n].eqNullSafe(y[n])
    return out


_PLACE = ("country_code", "region_code", "city")


def without_repeats(locations: Column) -> Column:
    """The first of each (country, region, city, workplace type), in order."""
    none = F.array().cast(f"array<{KIND}>")
    return F.aggregate(locations, none, lambda have, x: F.when(F.exists(have, lambda y: _same(x, y, (*_PLACE, "workplace_type"))), have).otherwise(F.concat(have, F.array(x))))


def merged(old: Column, new: Column) -> Column:
    """Both lists, one entry a place in order: the first one's, with the first workplace type that is specified. Entries without any place are one if they have the same type."""
    none = F.array().cast(f"array<{KIND}>")
    nowhere = lambda x: x["country_code"].isNull() & x["region_code"].isNull() & x["city"].isNull()

    def is_it(x: Column, y: Column) -> Column:
        return _same(x, y, _PLACE) & (~nowhere(x) | (x["workplace_type"] == y["workplace_type"]))

    def add(have: Column, x: Column) -> Column:
        told = F.transform(have, lambda y: F.when(is_it(x, y) & (y["workplace_type"] == "UNSPECIFIED"), y.withField("workplace_type", x["workplace_type"])).otherwise(y))
        return F.when(F.exists(have, lambda y: is_it(x, y)), told).otherwise(F.concat(have, F.array(x)))

    return F.aggregate(F.concat(F.coalesce(old, none), F.coalesce(new, none)), none, add)


def display(raw: Column) -> Column:
    """Without "(+N other)", post codes and a trailing US; state names as codes, shouted words in small letters with capitals."""
    text = F.regexp_replace(raw, r"(?i)\s*\(?\+\s*\d+\s+(?:others?|more)[^)]*\)?", "")
    text = F.regexp_replace(text, r"\s*\b\d{5}(?:-\d{4})?\b", "")
    text = F.trim(F.regexp_replace(F.regexp_replace(text, r"(?i),\s*(?:US|USA|U\.S\.A?\.?|United States(?: of America)?)\s*$", ""), r"\s+", " "))
    parts = F.transform(F.split(text, r"\s*,\s*"), lambda p: F.when((F.length(p) > 3) & (p == F.upper(p)), F.initcap(F.lower(p))).otherwise(p))
    parts = F.transform(parts, lambda p, i: F.when(i > 0, F.coalesce(state_code(p), p)).otherwise(p))
    return F.array_join(F.filter(parts, lambda p: p != ""), ", ")
