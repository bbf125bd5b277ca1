"""Companies: upserts by name, slugs that went to an aggregator, links from postings, the gate of a scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from hirelake.functions.names import company_key
from hirelake.functions.urls import slug_strength
from hirelake.functions.vocab import rank
from hirelake.operators.matching import best_fuzzy

#: What a probe found out, and words that make a name an aggregator's.
PROBE_RANK = {"miss": 0, "pending": 1, "hit": 2}
AGGREGATOR_WORDS = ("jobs", "careers", "hiring", "talent", "talents")


def is_aggregator(name: Column) -> Column:
    return F.coalesce(F.arrays_overlap(F.split(F.lower(name), "[^a-z]+"), F.array(*map(F.lit, AGGREGATOR_WORDS))), F.lit(False))


def upserted_companies(old: DataFrame, new: DataFrame) -> DataFrame:
    """name, platform, slug, probe, homepage and kind (inserted, updated, unchanged), one row per name.

    old has these columns but kind; new also has seen, its order in time. Several new rows of a name
    are folded: the best probe, then the latest. A probe never gives way to a lesser one; platform and
    slug that another company owns, or that several new names ask for, are taken by none of the askers.
    Rows of new without a name don't count.
    """
    fields = F.struct("platform", "slug", "probe", "homepage")
    named = new.where(F.coalesce(F.trim("name"), F.lit("")) != "")
    order = F.struct(rank(PROBE_RANK, F.col("probe")), F.col("seen"), F.xxhash64("platform", "slug", "homepage"))
    best = named.groupBy("name").agg(F.max_by(fields, order).alias("n"), F.max_by("homepage", F.when(F.col("homepage").isNotNull(), order)).alias("n_home"))
    both = old.select("name", fields.alias("o")).join(best, "name", "full_outer")
    o, n = F.col("o"), F.col("n")
    better = n.isNotNull() & (rank(PROBE_RANK, n["probe"]) >= rank(PROBE_RANK, F.coalesce(o["probe"], F.lit("miss"))))
    pair = F.when(better & n["platform"].isNotNull() & n["slug"].isNotNull(), F.struct(n["platform"].alias("platform"), n["slug"].alias("slug")))
    asked = both.withColumn("pair", pair).withColumn("better", better)
    # a pair that two names hold or ask for is settled by counting names, one row per pair
    holders = old.where(F.col("platform").isNotNull() & F.col("slug").isNotNull()).select("name", F.struct("platform", "slug").alias("pair"))
    claims = holders.unionByName(asked.where("pair IS NOT NULL").select("name", "pair")).groupBy("pair").agg(F.min("name").alias("least"), F.max("name").alias("most"))
    free = claims.where("least = most").select("pair", F.lit(True).alias("free"))
    settled = asked.join(free, "pair", "left")
    may = F.col("better") & (F.col("pair").isNull() | F.coalesce("free", F.lit(False)))
    pick = lambda c: F.when(may, F.coalesce(n[c], o[c])).otherwise(o[c])
    out = settled.select(
        "name", "o", "n", pick("platform").alias("platform"), pick("slug").alias("slug"),
        F.when(may | o.isNull(), n["probe"]).otherwise(o["probe"]).alias("probe"), F.coalesce("n_home", o["homepage"]).alias("homepage"),
    )
    kind = F.when(o.isNull(), "inserted").when(n.isNull() | F.struct("platform", "slug", "probe", "homepage").eqNullSafe(o), "unchanged").otherwise("updated")
    return out.withColumn("kind", kind).drop("o", "n")


#: Lengths of the strings that units and whole texts meet by; a unit uses the longest that fits into it.
GRAM_SIZES = (3, 6)


def _grams(text: Column, size: int) -> Column:
    """The distinct strings of so many letters of a text; none where it is shorter."""
    places = F.when(F.length(text) >= size, F.sequence(F.lit(1), F.length(text) - (size - 1)))
    return F.coalesce(F.array_distinct(F.transform(places, lambda i: F.substr(text, i, F.lit(size)))), F.array().cast("array<string>"))


def _held(units: DataFrame, wholes: DataFrame) -> DataFrame:
    """unit, whole of the units that lie in a whole text; both sides distinct. A unit meets by its rarest string of six letters alone (of three where it has fewer), so no common one brings all together.

    Rows of strings are many times those of the texts, which the planner can't know: it is told to sort, or it would send them to every task by way of the driver.
    """
    short = lambda c: F.when(F.length(c) < GRAM_SIZES[0], F.array(c))
    own = short(F.col("unit"))
    for size in reversed(GRAM_SIZES):
        own = F.coalesce(own, F.when((F.length("unit") >= size), _grams(F.col("unit"), size)))
    grams = wholes.select("whole", F.explode(F.coalesce(short(F.col("whole")), F.concat(*[_grams(F.col("whole"), n) for n in GRAM_SIZES]))).alias("gram"))
    of_units = units.select("unit", F.explode(own).alias("gram"))
    counted = of_units.join(grams.groupBy("gram").agg(F.count("*").alias("df")).hint("merge"), "gram")
    rarest = counted.groupBy("unit").agg(F.min(F.struct("df", "gram")).alias("g")).select("unit", F.col("g.gram").alias("gram"))
    return rarest.hint("merge").join(grams, "gram").where(F.contains("whole", F.col("unit"))).select("unit", "whole")


def misplaced_slugs(companies: DataFrame, key: str = "company_id", name: str = "company") -> DataFrame:
    """owner_id, candidate_id, platform, slug and strength: an aggregator holds the slug of a company without one.

    Strength is that of slug_strength. What must lie in the other is the whole text of one (3) or a word of
    it (2), so distinct texts and words meet, each by its rarest string of six or three letters, and of equal ones
    only the least id goes on: a word that every name has costs one row for each name, not one for each pair.
    Slugs under three letters meet only equal ones. Of equal candidates the least id.
    """
    plain = lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9]+", "")
    words = lambda c: F.filter(F.split(F.lower(c), "[^a-z0-9]+"), lambda w: F.length(w) >= 3)
    has = (F.coalesce("platform", F.lit("")) != "") & (F.coalesce("slug", F.lit("")) != "")
    owners = companies.where(has & is_aggregator(F.col(name))).select(F.col(key).alias("owner_id"), "platform", "slug", plain("slug").alias("whole"), words("slug").alias("words")).where("whole <> ''")
    free = companies.where(F.coalesce("platform", F.lit("")) == "").select(F.col(key).alias("candidate_id"), plain(name).alias("whole"), words(F.col(name)).alias("words")).where("whole <> ''")
    own_units = owners.select("owner_id", F.col("whole").alias("unit"), F.lit(3).alias("strength")).unionByName(owners.select("owner_id", F.explode("words").alias("unit"), F.lit(2).alias("strength")))
    free_units = free.select("candidate_id", F.col("whole").alias("unit"), F.lit(3).alias("strength")).unionByName(free.select("candidate_id", F.explode("words").alias("unit"), F.lit(2).alias("strength")))
    names = free.groupBy("whole").agg(F.min("candidate_id").alias("candidate_id"))
    # slugs and their words in names
    in_names = _held(own_units.select("unit").distinct(), names.select("whole")).join(names.hint("merge"), "whole").groupBy("unit").agg(F.min("candidate_id").alias("candidate_id"))
    one = own_units.join(in_names.hint("merge"), "unit").select("owner_id", "candidate_id", "strength")
    # names and their words in slugs
    least = free_units.groupBy("unit", "strength").agg(F.min("candidate_id").alias("candidate_id"))
    in_slugs = _held(least.select("unit").distinct(), owners.select("whole").distinct()).join(least.hint("merge"), "unit")
    two = in_slugs.groupBy("whole", "strength").agg(F.min("candidate_id").alias("candidate_id")).join(owners.select("owner_id", "whole").hint("merge"), "whole").select("owner_id", "candidate_id", "strength")
    best = one.unionByName(two).groupBy("owner_id").agg(F.max_by(F.struct("candidate_id", "strength"), F.struct("strength", (-F.col("candidate_id")).alias("turn"))).alias("x"))
    return owners.select("owner_id", "platform", "slug").join(best.hint("merge"), "owner_id").select("owner_id", "platform", "slug", "x.*")


def healed_slugs(companies: DataFrame, jobs: DataFrame, key: str = "company_id", name: str = "company") -> tuple[DataFrame, DataFrame]:
    """Companies with misplaced slugs moved to their best candidate, and jobs moved along. A candidate that two owners would serve gets the least owner's."""
    moves = misplaced_slugs(companies, key, name).groupBy("candidate_id").agg(F.min_by(F.struct("owner_id", "platform", "slug"), "owner_id").alias("m")).select("candidate_id", "m.*")
    # a company gains or loses: owners have a platform, candidates none
    given = F.struct(F.col("candidate_id").alias(key), F.col("platform").alias("_p"), F.col("slug").alias("_s"), F.lit(False).alias("_lost"))
    taken = F.struct(F.col("owner_id").alias(key), F.lit(None).cast("string").alias("_p"), F.lit(None).cast("string").alias("_s"), F.lit(True).alias("_lost"))
    both = companies.join(moves.select(F.inline(F.array(given, taken))).hint("merge"), key, "left")
    changed = {c: F.when(~F.coalesce("_lost", F.lit(False)), F.coalesce(F.col(g), F.nullif(F.col(c), F.lit("")))) for c, g in (("platform", "_p"), ("slug", "_s"))}
    moved = jobs.join(moves.select(F.col("owner_id").alias(key), F.col("candidate_id").alias("_to")).hint("merge"), key, "left").withColumn(key, F.coalesce("_to", key)).drop("_to")
    return both.withColumns(changed).drop("_p", "_s", "_lost"), moved


def linked(jobs: DataFrame, companies: DataFrame, denied: DataFrame, least: int = 90) -> DataFrame:
    """name, company (the one it belongs to) and how (exact, fuzzy, created or denied) of each distinct company name of the jobs.

    jobs: company. companies: company. denied: name. Names meet by their key first; the rest by the
    best fuzzy ratio; what is left makes a new company. Blank names don't count.
    """
    names = jobs.select(F.col("company").alias("name")).where(F.coalesce(F.trim("company"), F.lit("")) != "").distinct().withColumn("k", company_key(F.col("name")))
    out = denied.select(company_key(F.col("name")).alias("k"), F.lit(True).alias("_denied")).distinct()
    known = companies.where(F.col("company").isNotNull()).groupBy(company_key(F.col("company")).alias("k")).agg(F.min("company").alias("_exact"))
    first = names.join(out, "k", "left").join(known, "k", "left")
    rest = first.where("_denied IS NULL AND _exact IS NULL").select("name")
    near = best_fuzzy(rest, companies.select(F.col("company").alias("name")), "name", least).select(F.col("l_name").alias("name"), F.col("r_name").alias("_near"))
    how = F.when(F.col("_denied"), "denied").when(F.col("_exact").isNotNull(), "exact").when(F.col("_near").isNotNull(), "fuzzy").otherwise("created")
    return first.join(near, "name", "left").select("name", F.when(how != "denied", F.coalesce("_exact", "_near", "name")).alias("company"), how.alias("how"))


def unlinked_counts(jobs: DataFrame, denied: DataFrame) -> DataFrame:
    """denied and n of the jobs that have a company's name but no company_id."""
    out = denied.select(company_key(F.col("name")).alias("k")).distinct().withColumn("denied", F.lit(True))
    rows = jobs.where(F.col("company_id").isNull() & (F.coalesce(F.trim("company"), F.lit("")) != "")).withColumn("k", company_key(F.col("company")))
    return rows.join(out, "k", "left").groupBy(F.coalesce("denied", F.lit(False)).alias("denied")).agg(F.count("*").alias("n"))


def newest_by_plain_name(wanted: DataFrame, jobs: DataFrame) -> DataFrame:
    """wanted (name) with dedup_key of the newest job whose company is equal without marks, case and spaces; null for none."""
    plain = lambda c: F.nullif(F.regexp_replace(F.lower(c), "[^a-z0-9]+", ""), F.lit(""))
    newest = jobs.withColumn("_k", plain("company")).where("_k IS NOT NULL").groupBy("_k").agg(F.max_by("dedup_key", F.struct("first_seen", "dedup_key")).alias("dedup_key"))
    return wanted.withColumn("_k", plain("name")).join(newest, "_k", "left").drop("_k")


def stubs(mail: DataFrame, jobs: DataFrame) -> DataFrame:
    """name and first_mail of each sender company (name) of mail (name, sent) without any job: the jobs to be made up."""
    found = newest_by_plain_name(mail, jobs)
    plain = F.regexp_replace(F.lower("name"), "[^a-z0-9]+", "")
    return found.where(F.col("dedup_key").isNull() & (F.coalesce(plain, F.lit("")) != "")).groupBy(plain.alias("_k")).agg(F.min_by("name", F.struct("sent", "name")).alias("name"), F.min("sent").alias("first_mail")).drop("_k")


def may_scan(companies: DataFrame, jobs: DataFrame, score: Column, threshold: float = 20) -> DataFrame:
    """companies with may_scan: none of their jobs has a score yet, or one reaches the threshold. Jobs go by name or raw name."""
    best = jobs.select("company", score.alias("_score")).where("_score IS NOT NULL").groupBy("company").agg(F.max("_score").alias("_best"))
    out = companies
    for column, to in (("name", "_a"), ("name_raw", "_b")):
        out = out.join(best.select(F.col("company").alias(column), F.col("_best").alias(to)), column, "left")
    top = F.greatest("_a", "_b")
    return out.withColumn("may_scan", top.isNull() | (top >= threshold)).drop("_a", "_b")
