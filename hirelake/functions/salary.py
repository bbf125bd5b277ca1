"""Salary texts and observations, as column expressions.

An observation is struct(min_value, max_value, period, currency, provenance); its normal form is
struct(salary_min, salary_max, period, resolution) in units a year. Nothing raises: what can't be
read is null, what isn't plausible keeps its code with an empty pair.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Fixed values.
LEAST, MOST = 30_000, 5_000_000
FACTORS = {"annual": 1, "hourly": 2080, "daily": 260, "weekly": 52, "monthly": 12, "unknown": 1}
COLUMN_PERIODS = ("annual", "hourly", "monthly", "unknown")
CURRENCIES = (("CA$", "CAD"), ("C$", "CAD"), ("A$", "AUD"), ("S$", "SGD"), ("£", "GBP"), ("€", "EUR"), ("₹", "INR"))
PERIODS = (
    (r"(?i)/\s*hr\b|per\s+hour|an?\s+hour|hourly", "hourly"),
    (r"(?i)/\s*yr\b|per\s+year|a\s+year|annually|/\s*annum|per\s+annum", "annual"),
    (r"(?i)/\s*mo\b|per\s+month|monthly", "monthly"),
    (r"(?i)/\s*wk\b|per\s+week|weekly", "weekly"),
    (r"(?i)/\s*day\b|per\s+day|daily", "daily"),
)
#: The patterns of amounts and ranges.
_CURRENCY = r"(?:USD|CAD|EUR|GBP|AUD|SGD|INR|[$£€₹CASca]{0,3})\s*"
_AMOUNT = r"([0-9][0-9,]*\.?[0-9]*)\s*([KkMm])?(?![A-Za-z])"
RANGE = _CURRENCY + _AMOUNT + r"\s*(?:to|-|–|—|~)\s*" + _CURRENCY + _AMOUNT


def period_of(text: Column) -> Column:
    out = F.lit("unknown")
    for pattern, name in reversed(PERIODS):
        out = F.when(F.regexp_like(text, F.lit(pattern)), name).otherwise(out)
    return out


def currency_of(text: Column) -> Column:
    out = F.lit("USD")
    for mark, code in reversed(CURRENCIES):
        out = F.when(F.contains(text, F.lit(mark)), code).otherwise(out)
    return out


def column_period(period: Column) -> Column:
    return F.when(period.isin(*COLUMN_PERIODS), period).otherwise("unknown")


def factor(period: Column) -> Column:
    out = F.lit(1)
    for name, n in FACTORS.items():
        out = F.when(period == name, F.lit(n)).otherwise(out)
    return out


def annualized(value: Column, period: Column) -> Column:
    return value * factor(period)


def observed(text: Column, provenance: Column) -> Column:
    """The range in a text as an observation; null without one. Bare numbers under 1000 without a period are thousands."""

    def matched(t: Column) -> Column:
        return F.struct(t.alias("text"), F.regexp_extract(t, RANGE, 0).alias("hit"))

    def read(r: Column) -> Column:
        # the range alone reads as it does in its text, and is short
        part = lambda k: F.regexp_extract(r["hit"], RANGE, k)
        number = lambda k: F.replace(part(k), F.lit(","), F.lit("")).try_cast("double")
        has = r["hit"] != ""
        return F.struct(
            number(1).alias("low"), number(3).alias("high"), F.lower(part(2)).alias("u"), F.lower(part(4)).alias("v"),
            F.when(has, period_of(r["text"])).alias("period"), F.when(has, currency_of(r["text"])).alias("currency"),
        )

    def told(r: Column) -> Column:
        bare = (r["period"] == "unknown") & (r["u"] == "") & (r["v"] == "") & (r["low"] < 1000) & (r["high"] < 1000)
        size = lambda n, unit: r[n] * F.when(r[unit] == "k", 1000).when(r[unit] == "m", 1_000_000).otherwise(1) * F.when(bare, 1000).otherwise(1)
        found = F.struct(size("low", "u").alias("min_value"), size("high", "v").alias("max_value"), r["period"].alias("period"), r["currency"].alias("currency"), provenance.alias("provenance"))
        return F.when(r["low"].isNotNull() & r["high"].isNotNull(), found)

    return F.get(F.transform(F.transform(F.transform(F.array(text), matched), read), told), F.lit(0))  # each step once a row


def normalized(low: Column, high: Column, period: Column, provenance: Column) -> Column:
    """The yearly pair and how it was reached. Each step is worked out once a row and handed to the next."""
    none = F.lit(None).cast("long")
    pair = lambda x, y, code: F.struct(x.alias("x"), y.alias("y"), code.alias("code"))
    fits = lambda v: v.between(LEAST, MOST)

    def years(r: Column) -> Column:
        known = r["period"] != "unknown"
        one = lambda v: F.when(known, v * r["factor"]).otherwise(v)
        told = F.when(~known | (r["period"] == "annual"), "ok").otherwise(F.concat(F.lit("salvaged_"), r["period"]))
        small = lambda v: v.isNull() | ((v > MOST) & fits(v / 100))
        cents = (r["provenance"] == "ats_structured") & ~known & small(r["low"]) & small(r["high"])
        return F.struct(*(r[n].alias(n) for n in ("low", "high", "period")), one(r["low"]).alias("a"), one(r["high"]).alias("b"), told.alias("code"), F.coalesce(cents, F.lit(False)).alias("cents"))

    def sides(r: Column) -> Column:
        a, b = (F.when(fits(r[n]), r[n].cast("long")) for n in ("a", "b"))
        c, d = ((r[n] / 100).cast("long") for n in ("low", "high"))
        good = (r["low"].isNull() | fits(r["a"])) & (r["high"].isNull() | fits(r["b"]))
        kept = F.when(r["low"].isNull() & r["high"].isNull(), pair(none, none, F.lit("empty"))).when(good, pair(a, b, r["code"])).when(r["cents"], pair(c, d, F.lit("salvaged_cents"))).otherwise(pair(none, none, F.lit("implausible")))
        return F.struct(r["period"].alias("period"), kept.alias("p"))

    def in_order(r: Column) -> Column:
        x, y, code = (r["p"][n] for n in ("x", "y", "code"))
        wrong = F.coalesce(x > y, F.lit(False))
        far = wrong & (x > y * 10)
        low, high = (F.when(far, none).when(wrong, p).otherwise(q) for p, q in ((y, x), (x, y)))
        return F.struct(low.alias("salary_min"), high.alias("salary_max"), column_period(r["period"]).alias("period"), F.when(far, "implausible").otherwise(code).alias("resolution"))

    period = F.when(period.isin(*FACTORS), period).otherwise("unknown")
    once = F.array(F.struct(low.alias("low"), high.alias("high"), period.alias("period"), provenance.alias("provenance")))
    once = F.transform(once, lambda r: F.struct(*(r[n].alias(n) for n in ("low", "high", "period", "provenance")), factor(r["period"]).alias("factor")))
    return F.get(F.transform(F.transform(F.transform(once, years), sides), in_order), F.lit(0))


#: How a pair was reached that may be shown.
RESOLVED = ("ok", "salvaged_hourly", "salvaged_daily", "salvaged_weekly", "salvaged_monthly", "salvaged_cents")


def captured(observation: Column) -> Column:
    """What a source's observation gives a posting: the yearly pair and period only where it was resolved, currency, provenance, and the observation itself with how it was judged; null without one."""

    def judged(o: Column) -> Column:
        return F.struct(o.alias("o"), normalized(o["min_value"], o["max_value"], o["period"], o["provenance"]).alias("n"))

    def made(r: Column) -> Column:
        good = r["n"]["resolution"].isin(*RESOLVED)
        out = F.struct(
            F.when(good, r["n"]["salary_min"]).alias("salary_min"), F.when(good, r["n"]["salary_max"]).alias("salary_max"), F.when(good, r["n"]["period"]).alias("period"), r["o"]["currency"].alias("currency"),
            r["o"]["provenance"].alias("provenance"), r["n"]["resolution"].alias("resolution"), F.array(r["o"]).alias("observations"),
        )
        return F.when(r["o"].isNotNull(), out)

    return F.get(F.transform(F.transform(F.array(observation), judged), made), F.lit(0))


def from_text(text: Column, provenance: str = "jd_regex") -> Column:
    """struct(salary_min, salary_max) that a text names, both or neither: a range that is plausible as it stands or a year long."""
    got = captured(observed(text, F.lit(provenance)))

    def both(c: Column) -> Column:
        whole = c["salary_min"].isNotNull() & c["salary_max"].isNotNull() & (c["resolution"] != "salvaged_cents")
        return F.struct(F.when(whole, c["salary_min"]).alias("salary_min"), F.when(whole, c["salary_max"]).alias("salary_max"))

    return F.get(F.transform(F.array(got), both), F.lit(0))


def ordered(low: Column, high: Column, ratio: int = 10) -> Column:
    """A stored pair with its sides in order; too far apart the wrong way, both are null."""
    pair = lambda x, y: F.struct(x.alias("salary_min"), y.alias("salary_max"))
    none = F.lit(None).cast("double")
    wrong = F.coalesce(low > high, F.lit(False))
    return F.when(wrong & (low <= high * ratio), pair(high, low)).when(wrong, pair(none, none)).otherwise(pair(low, high))


def reconciled(new: Column, old: Column, new_rank: Column, old_rank: Column) -> Column:
    """The pair to keep, as one: a new one that isn't empty wins from equal rank on."""
    empty = new["salary_min"].isNull() & new["salary_max"].isNull()
    return F.when(~empty & (new_rank >= old_rank), new).otherwise(old)
